"""Operators that look at one row at a time, and exact deduplication, against brute force and the tokenizers library."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SF, compare
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnlake.llm import bpe, common, exact_dedup, langid, packing, quality
from tarnlake.llm.queries import ORACLES, QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
ODD = [None, "", " \n\t", "a", "It's  A TEST's!!\x1c\x85x", "ΑΣ ΟΔΟΣ́", "<|endoftext|>x <|startoftext|>", "é​ İı 東京 𝔘ñ 12³½", "Ω" * 3000 + "zq" * 3000, "the " * 20000]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


# --- exact deduplication ---


def test_exact_groups_and_kept_rows(spark):
    texts = ["Same", "sAME", None, "", "É", "é", "x", "other"] + ["hot"] * 300
    df = frame(spark, texts).withColumn("keep_id", F.lit("clash")).withColumn("__maybe", F.lit(1))
    want = collections.defaultdict(list)
    for i, t in enumerate(texts):
        want["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.duplicate_groups(df).collect()}
    for norm, ids in want.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()
    kept = exact_dedup.drop_duplicates(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(max(x) for x in want.values())
    assert kept.columns == df.columns


def test_exact_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a", 1), (3, "a", 1), (3, "a", 1), (None, "b", 1)], "doc_id bigint, text string, n int")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.duplicate_groups(df).collect()), key=repr)
    assert got == sorted([(None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, None, 1, True)], key=repr)
    assert sorted(exact_dedup.drop_duplicates(df).collect(), key=repr) == sorted([(3, "a", 1), (None, "b", 1)], key=repr)
    assert exact_dedup.duplicate_groups(df.limit(0)).count() == 0 == exact_dedup.drop_duplicates(df.limit(0)).count()


def test_filter_misses_no_repeat_and_lets_few_through(spark):
    df = spark.range(4000).select(F.xxhash64(F.when(F.col("id") % 10 == 0, F.col("id") % 400).otherwise(F.col("id"))).alias("k"))
    cells = common.repeated_filter(df, "k")
    flags = common.maybe_in(df, F.col("k"), cells, "m").groupBy("k").agg(F.count("*").alias("n"), F.min("m").alias("m")).collect()
    assert all(r["m"] for r in flags if r["n"] > 1) and sum(r["m"] for r in flags if r["n"] == 1) < 20


# --- quality rules ---


def brute_measures(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@given(st.text(alphabet="ab \n\t\x0b\x85 #|é", max_size=60))
@settings(max_examples=300, deadline=None)
def test_measures(text):
    assert quality.measure(text) == brute_measures(text)


def test_host_rules_judge_hosts_not_single_documents(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, "en", "good", 1) for i in range(40)] + [(100 + i, "bad" if i % 10 else good, "en", "bad", 1) for i in range(40)] + [(200, "short", "en", "small", 1), (201, good, "en", "small", 1), (202, good, "en", None, 1), (203, None, "en", None, 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash")).withColumn("N_WORDS", F.lit(0))
    got = {r["doc_id"]: r for r in quality.host_rules(df).collect()}
    assert len(got) == len(rows) and all(got[i]["kept"] for i in range(40))
    assert not any(got[100 + i]["kept"] for i in range(40)) and not got[100]["base_failed"]
    assert got[201]["kept"] and not got[200]["kept"] and got[202]["kept"] and not got[203]["kept"]
    assert quality.host_rules(df.limit(0)).count() == 0


# --- byte-pair encoding ---


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@given(st.one_of(st.text(max_size=40), st.text(alphabet="abehinorst'ÉéÇç.,!09 \n<|>", max_size=60)))
@settings(max_examples=400, deadline=None)
def test_bpe_equals_library(text):
    mine = bpe.tokenizer(PATH)
    (ids,) = mine.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == library_ids(text)
    assert mine.decode(ids) == LIBRARY.decode(library_ids(text), skip_special_tokens=False)


def test_bpe_every_code_point():
    mine = bpe.tokenizer(PATH)
    for c in [*range(0xD800), *range(0xE000, 0x30000, 7)]:
        text = f"a{chr(c)}b"
        assert np.frombuffer(mine.encode([text])[0], "<u4").tolist() == library_ids(text), hex(c)


def test_bpe_fragments_are_cut_where_no_token_spans():
    mine = bpe.tokenizer(PATH)
    word = "étréçàthing".encode()
    parts = mine.cuts(word)
    assert b"".join(parts) == word and len(parts) > 1
    assert not any(mine.joined[a[-1] << 8 | b[0]] for a, b in zip(parts, parts[1:]))
    words = [("thenationinggggggg" * 20 + "é").encode()[:n] for n in (1, 2, 5, 63, 200, 361)] + [b"a" * n for n in range(1, 40)]
    ids, counts = mine.merge(words)
    assert ids.tolist() == [i for w in words for i in mine.merge_long(w)] and counts.tolist() == [len(mine.merge_long(w)) for w in words]


def test_bpe_query(spark):
    df = frame(spark, ODD).withColumn("ids", F.lit(1)).withColumn("N_tokens", F.lit(1))
    got = {r["doc_id"]: r for r in bpe.digest(df).collect()}
    for i, t in enumerate(ODD):
        ids = library_ids(t)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest(df.limit(0)).count() == 0


def test_bpe_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op9_bpe"](spark, SF).collect()}
    for r in docs.collect():
        ids = library_ids(r["text"])
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


# --- packing ---


def check_packing(rows, texts, window=4096):
    """Each id lies in one piece, sequences are gapless, full or a power of two."""
    docs, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(docs) == set(texts)
    for i, pieces in docs.items():
        ids = library_ids(texts[i]) + [2]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == window or at < window and at & (at - 1) == 0
    return sequences


def test_packing_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_packing(QUERIES["op6_packing"](spark, SF).collect(), texts)


def test_packing_odd_texts(spark):
    df = frame(spark, ODD).withColumn("length", F.lit("clash"))
    check_packing(packing.digest(df).collect(), dict(enumerate(ODD)))
    assert packing.pack(df.limit(0)).count() == 0


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=200, deadline=None)
def test_best_fit_decreasing(lengths):
    windows = packing.best_fit_decreasing(lengths, 64)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    plain: list[list[int]] = []  # brute force: the fullest window that still takes the item
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [w for w in plain if sum(lengths[k] for k in w) + lengths[i] <= 64]
        if fits:
            max(fits, key=lambda w: sum(lengths[k] for k in w)).append(i)
        else:
            plain.append([i])
    fill = lambda ws: sorted(sum(lengths[i] for i in w) for w in ws)
    assert fill(windows) == fill(plain)
    done = packing.fill_gaps([[(i, 0, lengths[i]) for i in w] for w in windows], 64)
    sizes = sorted(sum(p[2] for p in w) for w in done)
    assert sum(sizes) == sum(lengths) and all(s == 64 or s & (s - 1) == 0 for s in sizes)
    spans = collections.defaultdict(list)
    for w in done:
        for i, a, n in w:
            spans[i].append((a, n))
    for i, parts in spans.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == lengths[i]


# --- language identification ---


def test_language_query(spark):
    got = QUERIES["op10_language_id"](spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    held = [r for r in got if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) / len(held) > 0.95


def test_language_odd_rows(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(df)
    odd = frame(spark, [*ODD, "123 456 !!", df.first()["text"]]).withColumn("score", F.lit("clash"))
    got = [r for r in sorted(langid.predict(odd, model).collect(), key=lambda r: r["doc_id"])]
    unknown = [r["doc_id"] for r in got if r["lang_pred"] == "und"]
    assert unknown == [0, 1, 2, len(ODD)] and all(r["rejected"] for r in got if r["lang_pred"] == "und")
    assert not got[-1]["rejected"] and {r["lang_pred"] for r in got} <= {"und", "en", "de", "fr", "es"}
    nothing = spark.createDataFrame([(1, "x", None, "s", 1), (None, None, None, None, None)], DOCS)
    assert langid.train(nothing) == [] and {r["lang_pred"] for r in langid.identify_documents(nothing).collect()} == {"und"}
    assert langid.identify_documents(df.limit(0)).count() == 0
    kept = langid.keep_identified(df.limit(200))
    assert kept.columns == df.columns and 190 <= kept.count() <= 200


def test_long_language_text_is_used_whole():
    rng = random.Random(1)
    a, b = (["".join(rng.choices(letters, k=6)) for _ in range(300)] for letters in ("abcdefg", "uvwxyz"))
    models = langid.compressors((("a", " ".join(a).encode()), ("b", " ".join(b).encode())))
    text = " ".join(rng.choices(a, k=500)) + " " + " ".join(rng.choices(b, k=20000))
    assert langid.identify(text, models)[0] == "b"
