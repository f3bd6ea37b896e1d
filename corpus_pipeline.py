"""A corpus made ready for training: each stage works on what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm import exact_dedup, langid, near_dedup, packing, suffix_dedup
from tarnlake.llm.common import remove, shared_folder

#: What each stage but the last returns; other columns of its input, of any name, are left out.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some margin; NULL, empty and letterless texts, and ties, are rejected.

    Repeated rows share their fate. The languages are learnt from the input's own labelled rows: without any, none stays.
    """
    return langid.keep_identified(docs).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id, one row of it if rows repeat.

    A NULL text is an empty one, and a NULL id is below all others.
    """
    return exact_dedup.drop_duplicates(docs).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one with the smallest id.

    Rows that repeat an id are one document. Texts without words (NULL, empty) and rows without an id stay.
    """
    return near_dedup.drop_near_duplicates(docs).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has too; n_chars is counted again.

    A NULL text becomes an empty one. Rows that repeat an id don't cut each other, and rows without an id stay whole.
    """
    cut = suffix_dedup.remove_repeats(docs, carry_text=False, as_text=True).drop("text").withColumnRenamed("kept_text", "text")
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 4096 tokens; a NULL or empty text is its end mark alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", passages), ("packing", pack)]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    What a stage wrote goes when the next one is written; the last stage's table stays, as the result reads it.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
