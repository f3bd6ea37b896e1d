"""Toxicity, licenses, chat formatting and the pipeline."""

import hashlib
import random

import corpus_pipeline
import numpy as np
from oracle import SF
from pyspark.sql import functions as F
from test_near_dedup import brute as near_brute
from test_row_operators import check_packing
from test_suffix_dedup import brute as suffix_brute

from tarnlake.llm import chat, licenses, toxicity
from tarnlake.llm.queries import QUERIES

DOCS = "doc_id bigint, text string"


# --- toxicity ---


def test_toxicity_query_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs.filter("doc_id % 2 = 0"), labels)  # learnt on half, tested on the other
    insults = ("trash", "pathetic", "idiot", "worthless", "disgusting", "stupid", "clown", "scum", "loser", "moron")
    assert set(insults) <= set(model.words)
    rows = toxicity.predict(docs.filter("doc_id % 2 = 1").withColumn("raw", F.col("text")), model).collect()
    planted = {r["doc_id"] for r in rows if sum(w in insults for w in toxicity.WORD.findall((r["raw"] or "").lower())) > 1}
    flagged = {r["doc_id"] for r in rows if r["toxic"]}
    told = {r["doc_id"]: r["toxic"] for r in labels.filter("doc_id % 2 = 1").collect()}
    toxic = {i for i, y in told.items() if y}  # with insults of other languages too
    assert len(planted) > 100 and len(planted & flagged) / len(planted) > 0.98
    assert len(toxic & flagged) / len(toxic) > 0.93 and len(flagged & (told.keys() - toxic)) / (len(told) - len(toxic)) < 0.006
    assert all(0 <= r["severity"] <= 3 and 0 <= r["p_toxic"] <= 1 for r in rows)


def test_more_insults_are_more_severe(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        text = rng.choices(words, k=60) + (["vile", "awful"] * (1 + i // 4 % 6) if bad else [])
        rows.append((i, " ".join(text), int(bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", F.col("y").alias("toxic")))
    assert np.all(np.diff(model.thresholds) > 0)
    odd = spark.createDataFrame([(0, None, 1), (1, "", 1), (2, "wa wb", 1), (3, "VILE awful", 1), (4, "vile awful " * 6, 1), (4, "vile awful " * 6, 1), (None, "x" * 50000, 1)], "doc_id bigint, text string, severity int")
    got = toxicity.predict(odd, model).collect()
    s = [r["severity"] for r in got]
    assert s[0] == s[1] == s[2] == s[6] < 0.5 < s[3] < s[4] == s[5] and [r["toxic"] for r in got[:5]] == [False, False, False, True, True]
    assert toxicity.predict(odd.limit(0), model).count() == 0
    nothing = toxicity.train(odd.select("doc_id", "text"), spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int"))
    assert {r["severity"] for r in toxicity.predict(odd, nothing).collect()} == {0.0}


# --- licenses ---


def test_license_query(spark):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    got = {r["doc_id"]: r for r in QUERIES["op3_license_scan"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        want = [(lines[x], i) for i, x in enumerate(r["text"].split("\n")) if x in lines]
        found = list(zip(got[r["doc_id"]]["licenses"], got[r["doc_id"]]["lines"]))
        assert [f for f in found if r["text"].split("\n")[f[1]] in lines] == want


def test_license_wording(spark):
    cases = {
        "This work is licensed under the GNU General Public License, version 2.": ["GPL-2.0-only"],
        "This work is licensed under the GNU General Public License, version 4.": [],
        "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0-only"],
        "Licensed under CC BY 4.0.": ["CC-BY-4.0"],
        "Licensed under CC BY-ND 4.0.": [],
        "# (c) someone. Code released under the BSD 3-Clause license, see file": ["BSD-3-Clause"],
        "a driver's license costs a lot": [],
        "one\nLicensed under the MIT License.\n\nLicensed under the Apache License, Version 2.0.": ["MIT", "Apache-2.0"],
        "x" * 100000: [],
    }
    df = spark.createDataFrame([*enumerate(cases), (98, None), (99, "")], DOCS).withColumn("lines", F.lit(1))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, (text, want) in enumerate(cases.items()):
        assert got[i]["licenses"] == want, text
    assert got[98]["licenses"] == got[99]["licenses"] == [] and got[5]["differences"] == ["-licensed"]
    assert licenses.scan_licenses(df.limit(0)).count() == 0


# --- chat ---


def brute_pair(chosen, rejected):
    n = next((i for i, (a, b) in enumerate(zip(chosen, rejected)) if a != b), min(len(chosen), len(rejected)))

    def out(turns):
        text, spans = "", []
        for role, say in turns:
            text += f"<|{role}|>\n"
            if role == "assistant":
                spans.append(f"{len(text)}-{len(text) + len(say) + 1}")
            text += say + "\n"
        return text, " ".join(spans)

    return (n, out(chosen[:n])[0], out(chosen[n:])[0], out(rejected[n:])[0], out(chosen[n:])[1], out(rejected[n:])[1])


def test_pairs_of_two_tables(spark):
    rng = random.Random(6)
    roles, says = ["system", "user", "assistant"], ["", "a", "bé", "long " * 9000]
    want, left, right = {}, [], []
    for p in range(60):
        a = [(rng.choice(roles), rng.choice(says)) for _ in range(rng.randrange(6))]
        b = a[: rng.randrange(6)] + [(rng.choice(roles), rng.choice(says)) for _ in range(rng.randrange(3))]
        left += [(p, i, *t) for i, t in enumerate(a)]
        right += [(p, i, *t) for i, t in enumerate(b)]
        if a or b:
            want[p] = brute_pair(a, b)
    left += [(None, 0, "user", "x"), (1000, None, None, None)]
    want[1000] = brute_pair([("", "")], [])
    kind = "pair_id bigint, turn bigint, role string, text string"
    rng.shuffle(left)
    l, r = spark.createDataFrame(left, kind).withColumn("turns", F.lit(1)), spark.createDataFrame(right, kind).withColumn("chosen", F.lit(1))
    got = {x["pair_id"]: tuple(x[c] for c in ("n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")) for x in chat.format_preferences(l, r).collect()}
    assert got == want
    assert chat.format_preferences(l.limit(0), r.limit(0)).count() == 0


def test_last_reply_pairs(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "end"), (2, 0, "user", "only"), (3, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.format_pairs(chat.last_reply_pairs(df), "conv_id").collect()}
    assert set(got) == {1, 3}
    assert got[1]["prompt"] == "<|user|>\nq\n<|assistant|>\na\n<|user|>\nr\n" and got[1]["chosen"] == "<|assistant|>\nb\n" and got[1]["rejected"] == "<|assistant|>\na\n"
    assert got[1]["chosen_mask"] == "14-16" and got[3]["rejected"] == "<|assistant|>\n\n"


# --- pipeline ---


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(1000, None, None, None, None), (1001, "", "en", None, 0), (1002, None, "en", "s", 1)], docs.schema)
    docs = docs.unionByName(odd)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(f"file://{tmp_path}/{name}")
        outs.append((docs, docs := spark.read.parquet(f"file://{tmp_path}/{name}")))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    before, after = outs[0]
    assert {1000, 1001, 1002}.isdisjoint(texts(after)) and after.count() >= before.count() - 10
    before, after = map(texts, outs[1])
    groups = {}
    for i, t in before.items():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        groups[key] = max(i, groups.get(key, i))
    assert after == {i: before[i] for i in groups.values()}
    before, after = map(texts, outs[2])
    assert set(after) == {i for i, (_, c) in near_brute(before, 5).items() if i == c}
    before, after = map(texts, outs[3])
    want = suffix_brute(before)
    for i, t in after.items():
        assert len(before[i].encode()) == want[i][0]
        if not want[i][1] or hashlib.sha256(t.encode()).hexdigest() == want[i][3]:
            continue
        assert want[i][0] - want[i][1] - 8 <= len(t.encode()) < want[i][0] - want[i][1]  # halves of characters dropped
    check_packing([r.asDict() | {"ids_crc32": __import__("zlib").crc32(r["ids"])} for r in outs[4][1].collect()], after)


def test_run_writes_all_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
