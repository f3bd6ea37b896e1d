"""Components, and near-duplicates against all pairs by brute force."""

import collections
import random

import pytest
from oracle import SF
from pyspark.sql import functions as F

from tarnlake.llm import near_dedup
from tarnlake.llm.components import star_components
from tarnlake.llm.queries import QUERIES


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(texts, k=4):
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        common = collections.Counter(j for x in sets[i] for j in where[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(rows, texts):
    want = brute(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200)]
    star = [(500, rng.randrange(501, 700)) for _ in range(300)]
    edges = spark.createDataFrame(chain + star, "u bigint, v bigint")
    got = {r["id"]: r["component_id"] for r in star_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[201] == 200 and 100 not in got
    assert {got[v] for _, v in star} == {500}
    assert star_components(edges.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(QUERIES["op7_minhash"](spark, SF).collect(), texts)


@pytest.mark.parametrize("bound, value", [("BLOCK", 7), ("BLOCK_SHINGLES", 800)])
def test_groups_chains_and_odd_texts(spark, monkeypatch, bound, value):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = [None, "", " \n", "One two", "one TWO", "É x", "é x", "one two three four", "one two three four five"]
    base = [word() for _ in range(120)]
    texts += [" ".join(base)] * 30  # exact copies
    for _ in range(60):  # near copies of one text: each differs from it a little, some too much from each other
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    drift = [word() for _ in range(150)]  # a chain: neighbours are alike, the ends aren't
    for _ in range(25):
        drift = list(drift)
        for _ in range(3):
            drift[rng.randrange(150)] = word()
        texts.append(" ".join(drift))
    texts.append(" ".join(word() for _ in range(30000)))
    rng.shuffle(texts)
    monkeypatch.setattr(near_dedup, bound, value)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("component_id", F.lit("x")).withColumn("bands", F.lit(1))
    check(near_dedup.near_duplicates(df, words=4).collect(), dict(enumerate(texts)))
    kept = near_dedup.drop_near_duplicates(df, words=4)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in brute(dict(enumerate(texts))).items() if i == c)
    assert kept.columns == df.columns


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, "a b c d e"), (9, None)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, words=4).collect()), key=repr)
    assert got == sorted([(None, 2, None, True), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False), (9, 0, 9, True)], key=repr)
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0 == near_dedup.drop_near_duplicates(df.limit(0)).count()
