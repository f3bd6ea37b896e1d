"""Ties, repeated rows, very long texts and independent recomputations."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import zstandard
from oracle import SF
from pyspark.sql import functions as F
from test_row_operators import brute_measures, check_packing, library_ids

from tarnlake.llm import bpe, chat, exact_dedup, langid, packing, quality, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "The Quick brown fox, " * 120_000  # 2.5 million characters


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# --- exact deduplication, quality rules ---


def test_exact_long_texts(spark):
    df = frame(spark, [(1, LONG, None, None, 0), (2, LONG.upper().lower(), None, None, 0), (3, LONG.upper(), None, None, 0), (4, LONG + "é", None, None, 0), (5, LONG.upper() + "É", None, None, 0)])
    got = {r["doc_id"]: r for r in exact_dedup.duplicate_groups(df).collect()}
    assert [got[i]["keep_id"] for i in (1, 2, 3, 4, 5)] == [3, 3, 3, 4, 5]
    assert got[1]["text_sha256"] == hashlib.sha256(LONG.lower().encode()).hexdigest()
    assert sorted(r["doc_id"] for r in exact_dedup.drop_duplicates(df).collect()) == [3, 4, 5]


def test_quality_long_and_repeated_rows(spark):
    long_ = " ".join(f"w{i}" for i in range(200_000)) + "\nline\nline"
    df = frame(spark, [(1, long_, "en", "a", 0), (1, long_, "en", "a", 0), (2, LONG, "en", "a", 0), (3, "x", "en", "a", 0)])
    got = sorted((r["doc_id"], r["n_words"], r["n_dup_lines"], r["base_failed"], r["kept"], round(r["host_rate"], 12)) for r in quality.host_rules(df).collect())
    assert [g[:4] for g in got] == [(1, 200_002, 1, False), (1, 200_002, 1, False), (2, 480_000, 0, True), (3, 1, 0, True)]
    assert len({g[5] for g in got}) == 1
    assert brute_measures("a b c a b c") == quality.measure("a b c a b c")


def test_rate_at_the_limit_keeps(spark):
    good = " ".join(f"word{i}" for i in range(60))
    df = frame(spark, [(i, good if i % 2 else "bad", "en", "h", 0) for i in range(20)])
    rate = quality.host_rules(df).first()["host_rate"]
    assert {r["kept"] for r in quality.host_rules(df, max_rate=rate).filter("NOT base_failed").collect()} == {True}
    assert {r["kept"] for r in quality.host_rules(df, max_rate=rate - 1e-9).filter("NOT base_failed").collect()} == {False}


# --- encoding, packing ---


def test_encoding_and_packing_of_repeated_and_long_rows(spark, monkeypatch):
    texts = ["same text here"] * 3 + [LONG[:300_000], LONG[:300_000], "", None]
    df = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r["ids_sha256"] for r in bpe.digest(df).collect()}
    assert got == {i: hashlib.sha256(np.array(library_ids(t), "<u4").tobytes()).hexdigest() for i, t in enumerate(texts)}
    check_packing(packing.digest(df).collect(), dict(enumerate(texts)))
    again = packing.pack(frame(spark, [(7, "one two", None, None, 0)] * 3)).collect()
    assert sum(r["length"] for r in again) == 3 * (len(library_ids("one two")) + 1)
    # a long text in parts
    mine = bpe.tokenizer(bpe.public_tokenizers.path(bpe.WORD_FILE))
    monkeypatch.setattr(bpe, "STRETCH", 1000)
    for text in (LONG[:50_000], "x" * 5000 + " " + LONG[:3000], "\n".join(["é" * 700] * 9), "a " * 999 + "b"):
        assert "".join(bpe.stretches(text)) == text
        assert np.frombuffer(mine.encode([text, "z"])[0], "<u4").tolist() == library_ids(text)


def test_best_fit_fills_most_windows_by_itself(spark):
    rng = random.Random(1)
    lengths = [min(4096, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000)]
    windows = packing.best_fit_decreasing(lengths)
    assert sum(lengths) / (4096 * len(windows)) > 0.99


# --- chat ---


def test_repeated_turn_numbers_long_and_empty_conversations(spark):
    kind = "conv_id bigint, turn bigint, role string, text string"
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "z"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), *[(2, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(2000)]]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, kind)
    got = {r["conv_id"]: r for r in chat.format_pairs(chat.last_reply_pairs(df), "conv_id").collect()}
    assert got[1]["prompt"] == "<|assistant|>\na\n<|assistant|>\na\n" and got[1]["chosen"] == "<|assistant|>\nz\n" and got[1]["rejected"] == "<|assistant|>\na\n"
    assert got[2]["n_prompt_turns"] == 1999 and got[2]["chosen"] == "<|assistant|>\nt1999\n" and got[2]["rejected"] == "<|assistant|>\nt1997\n"
    assert chat.format_pairs(chat.last_reply_pairs(df.limit(0)), "conv_id").count() == 0


# --- language identification ---


def test_language_against_plain_compression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    sizes = [len(raw) for _, raw in model]
    assert max(sizes) - min(sizes) < 2 * langid.SAMPLE_CHARS
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for r in random.Random(2).sample(docs.collect(), 60):
        raw = r["text"].lower().encode()
        if not any(c.isalpha() for c in r["text"]):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        totals = {}
        for lang, words in model:
            given = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given.precompute_compress(level=langid.LEVEL)
            press = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False)
            totals[lang] = sum(len(press.compress(raw[i : i + langid.BLOCK])) for i in range(0, len(raw), langid.BLOCK))
        assert totals[got[r["doc_id"]]["lang_pred"]] == min(totals.values())


def test_language_ties_repeats_and_bounds(spark):
    rng = random.Random(3)
    words = {lang: ["".join(rng.choices(letters, k=6)) for _ in range(300)] for lang, letters in (("aa", "abcdefgh"), ("bb", "qrstuvwx"))}
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, " ".join(rng.choices(words["aa" if k % 3 else "bb"], k=80)), "aa" if k % 3 else "bb", "s", 0) for k, i in enumerate(ids[:300])]
    rows += [(ids[400], "x " * 5000, "long", "s", 0), (ids[401], "z " * 6000, "long", "s", 0), (ids[402], "rare word", "rare", "s", 0)]
    df = frame(spark, rows + rows[:5])
    model = dict(langid.train(df))
    assert list(model)[:2] == ["aa", "bb"] and len(model["long"]) in (10_000, 12_000) and model["rare"] == b"rare word"
    assert [lang for lang, _ in langid.train(df, languages=2)] == ["aa", "bb"]
    same = (("one", b"abc abc"), ("two", b"abc abc"))
    odd = frame(spark, [(1, "abc abc abc", None, None, 0)] * 2 + [(2, LONG, None, None, 0)])
    got = langid.predict(odd, list(same)).collect()
    assert [r["lang_pred"] for r in got] == ["one"] * 3 and [r["score"] for r in got] == [0.0] * 3 and all(r["rejected"] for r in got)


# --- toxicity ---


def plain_loss(x, grade, params, penalty):
    """The negative log-likelihood of ordered grades, written out row by row."""
    d = x.shape[1]
    cuts = [params[d]]
    for g in params[d + 1 :]:
        cuts.append(cuts[-1] + math.exp(g))
    total = 0.0
    for row, y in zip(x, grade):
        score = float(row @ params[:d])
        at_least = [1.0, *[1 / (1 + math.exp(c - score)) for c in cuts], 0.0]
        total -= math.log(at_least[y] - at_least[y + 1])
    return total / len(x) + penalty / 2 * float(params[:d] @ params[:d])


def test_toxicity_fit_against_plain_likelihood():
    rng = np.random.default_rng(4)
    x = rng.poisson(0.4, (200, 5)).astype(float)
    grade = np.clip((x @ [1.0, 0.5, 0, 0, 2] + rng.logistic(size=200)).astype(int), 0, toxicity.GRADES)
    sparse = toxicity.Sparse.of([{j: v for j, v in enumerate(row) if v} for row in x], 5)
    for _ in range(3):
        params = rng.normal(size=5 + toxicity.GRADES) * 0.5
        value, grad = toxicity.loss(sparse, grade, params, 0.01)
        assert value == pytest.approx(plain_loss(x, grade, params, 0.01))
        for i in range(len(params)):
            step = np.eye(len(params))[i] * 1e-6
            assert grad[i] == pytest.approx((plain_loss(x, grade, params + step, 0.01) - plain_loss(x, grade, params - step, 0.01)) / 2e-6, abs=1e-5)
    weights, cuts = toxicity.fit(sparse, grade, penalty=0.01)
    best = np.concatenate([weights, [cuts[0]], np.log(np.diff(cuts))])
    assert np.abs(toxicity.loss(sparse, grade, best, 0.01)[1]).max() < 1e-3
    for _ in range(20):
        assert plain_loss(x, grade, best, 0.01) <= plain_loss(x, grade, best + rng.normal(size=len(best)) * 0.05, 0.01) + 1e-6


def test_toxicity_against_plain_scores_ties_and_repeats(spark):
    model = toxicity.Model({"vile": 0, "awf-": 1, "awful": 2}, np.array([1.5, 0.25, 0.5]), np.array([1.0, 2.0, 3.5]))
    model = toxicity.Model({"vile": 0, "awfu-": 1, "awful": 2}, model.weights, model.thresholds)
    texts = [None, "", "vile", "VILE vile awful Awfully", "vile " * 300_000, "fine", "vile", "vile"]
    got = toxicity.predict(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), model).collect()
    for r in got:
        words = collections.Counter((texts[r["doc_id"]] or "").lower().split())
        begin = sum(n for w, n in words.items() if w.startswith("awfu") and len(w) > 4)
        score = 1.5 * math.log1p(words["vile"]) + 0.25 * math.log1p(begin) + 0.5 * math.log1p(words["awful"])
        at_least = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        assert r["severity"] == pytest.approx(sum(at_least)) and r["p_toxic"] == pytest.approx(at_least[0])
        shares = np.array([1, *at_least]) - np.array([*at_least, 0])
        assert r["grade"] == int(shares.argmax()) and r["toxic"] == (at_least[0] >= toxicity.CUT)
    # of equally likely grades the lowest
    even = toxicity.Model({"w": 0}, np.zeros(1), np.array([0.0, 50.0, 60.0]))
    assert toxicity.predict(spark.createDataFrame([(1, "w")], "doc_id bigint, text string"), even).first()["grade"] == 0


def test_toxicity_training_ignores_the_order_of_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").select("doc_id", c) for t, c in (("documents", "text"), ("labels", "toxic")))
    twice = docs.unionByName(docs.filter("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" more"))))
    models = [toxicity.train(d, labels, sample=200) for d in (twice, twice.orderBy(F.desc("text")).repartition(5))]
    assert models[0].words == models[1].words and np.array_equal(models[0].weights, models[1].weights)
