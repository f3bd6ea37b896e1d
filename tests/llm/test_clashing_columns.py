"""Columns of the caller may have any name: every operator gives what it gives without them, and carries them."""

import corpus_pipeline
import pytest
from oracle import SF
from pyspark.sql import functions as F

from tarnlake.llm import bpe, chat, exact_dedup, langid, licenses, near_dedup, packing, quality, suffix_dedup, toxicity

NAMES = ["alpha", "beta", "__bits", "__word", "__mask", "__f", "__n", "__host", "__salt", "__maybe", "__sha", "__gone", "__read0", "id", "n", "key", "salt", "maybe", "digest", "row", "host", "content", "whole", "own", "c", "r", "say", "said", "turns", "0", "1", "odd name"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9002, "", "en", "s", 0), (None, "some words", None, "s", 10)], rows.schema)
    return rows.unionByName(odd).coalesce(2).cache()


def clashing(df):
    return df.select("*", *[F.lit(f"value of {c}").alias(c) for c in NAMES])


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*[F.col(f"`{c}`") for c in columns]).collect()), key=repr)


CARRYING = {
    "drop_duplicates": exact_dedup.drop_duplicates,
    "possibly_repeated": exact_dedup.possibly_repeated,
    "drop_near_duplicates": near_dedup.drop_near_duplicates,
    "remove_repeats": suffix_dedup.remove_repeats,
    "host_rules": quality.host_rules,
    "keep_identified": langid.keep_identified,
    "encode_decode": bpe.encode_decode,
    "scan_licenses": licenses.scan_licenses,
}
PLAIN = {
    "duplicate_groups": exact_dedup.duplicate_groups,
    "near_duplicates": near_dedup.near_duplicates,
    "identify_documents": langid.identify_documents,
    "pack": lambda df: packing.pack(df).select("doc_id", "start", "length"),
}


@pytest.mark.parametrize("name", sorted(CARRYING))
def test_columns_are_carried(docs, name):
    plain = CARRYING[name](docs)
    got = CARRYING[name](clashing(docs))
    assert set(got.columns) == {*plain.columns, *NAMES}
    assert rows_of(got, plain.columns) == rows_of(plain, plain.columns)
    assert rows_of(got, NAMES) == [tuple(f"value of {c}" for c in NAMES)] * plain.count()


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_columns_are_ignored(docs, name):
    plain, got = PLAIN[name](docs), PLAIN[name](clashing(docs))
    assert got.columns == plain.columns and rows_of(got, plain.columns) == rows_of(plain, plain.columns)


def test_toxicity_carries_columns(docs, spark):
    model = toxicity.Model({"bad": 0}, toxicity.np.ones(1), toxicity.np.array([1.0, 2.0, 3.0]))
    got = toxicity.predict(clashing(docs), model)
    assert {*NAMES, "severity", "grade"} <= set(got.columns) and got.count() == docs.count()


@pytest.mark.parametrize("key", ["c", "r", "n", "own", "turns", "turn.key"])
def test_keys_of_conversations(spark, key):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b")]
    plain = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = [tuple(r) for r in chat.format_pairs(chat.last_reply_pairs(plain), "conv_id").collect()]
    df = plain.withColumnRenamed("conv_id", key).withColumn("chosen", F.lit(1)).withColumn("replies", F.lit(1))
    got = chat.format_pairs(chat.last_reply_pairs(df, key), key)
    assert [tuple(r) for r in got.collect()] == want


def test_pipeline_stages_keep_their_columns(docs, spark, tmp_path):
    rows, plain = clashing(docs), docs
    for name, stage in corpus_pipeline.STAGES:
        a, b = stage(spark, plain, SF), stage(spark, rows, SF)
        assert a.columns == b.columns and a.count() == b.count()
        a.write.parquet(f"file://{tmp_path}/{name}")
        plain = spark.read.parquet(f"file://{tmp_path}/{name}")
        rows = clashing(plain) if name != "packing" else plain


def test_pipeline_of_nothing(docs, spark):
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing, SF)
        assert out.count() == 0
        nothing = out
