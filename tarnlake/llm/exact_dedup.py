"""Exact deduplication by two passes over Bloom filters; DataFrame functions only.

The first pass hashes every text to a cell (word and three bits) of a blocked Bloom filter; cells
are counted, and those hit twice make the filter. The second pass tests every row against it: a row
outside it has no copy and passes straight through. Only the others shuffle, as (id, digest), and are
grouped by the SHA-256 of the normalised text, which decides. The filter has a fixed number of words;
more repeated texts than it holds only let more rows through to the grouping, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import grouped_back, maybe_in, numbered, renamed, repeated_filter, salt_of, settled, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only; of a text without other letters that is its lower case, which is much the faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _key(text_col: str) -> Column:
    # texts equal in ASCII lower case are equal in full lower case too
    return F.xxhash64(F.lower(text_of(text_col)))


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(ascii_lower(text_of(text_col)), 256))


def possibly_repeated(df: DataFrame, text_col: str = "text", flag: str = "maybe_repeated") -> DataFrame:
    """df with a flag that is false only where no other row has an equal text. A column named like the flag is replaced."""
    rows, (text,) = numbered(df, text_col)
    cells = repeated_filter(rows.select(_key(text).alias("key")), "key")
    return renamed(maybe_in(rows, _key(text), cells, "maybe").withColumnRenamed("maybe", flag), df.columns, [flag])


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256.

    Texts, however long, are equal if identical after lower-casing A-Z; NULL is the empty text. The largest
    id of a group stays; NULL ids rank below all others. Rows that repeat an id and a text are each listed,
    each kept if their id is. No row of an empty table. Other columns, of any name, are ignored.

    Texts are read once: both passes work on ids and digests.
    """
    plain, (own, text) = numbered(df, id_col, text_col)
    rows = settled(plain.select(F.col(own).alias("id"), _digest(text).alias("digest")))
    key = F.xxhash64("digest")
    told = maybe_in(rows, key, repeated_filter(rows.select(key.alias("key")), "key"), "maybe")
    alone = told.filter("NOT maybe").select("id", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    grouped = grouped_back(
        told.filter("maybe").select("id", "digest").withColumn("salt", salt_of("id")), ["digest"], "salt",
        [F.max("id").alias("most"), F.count("*").alias("n")],
        [F.max("most").alias("keep_id"), F.sum("n").alias("group_size")],
    )
    every = alone.unionByName(grouped.select("id", "digest", "keep_id", "group_size"))
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return every.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, one of each group of equal texts, with all their columns, of any names.

    Rows outside the filter keep their place. The others are grouped by digest, and each task
    passes on one row of a group only. Ids, NULLs and texts count as in duplicate_groups(); of rows
    that repeat an id and a text, any one stays. No row of an empty table.
    """
    rows, (own, text) = numbered(df, id_col, text_col)
    cells = repeated_filter(rows.select(_key(text).alias("key")), "key")
    told = maybe_in(rows, _key(text), cells, "maybe")
    some = told.filter("maybe").select(_digest(text).alias("digest"), F.struct(*rows.columns).alias("row"), F.col(own).alias("id"))
    # NULL ids are ignored by max_by: they stay only where a group has no other
    best = some.groupBy("digest").agg(F.coalesce(F.max_by("row", "id"), F.any_value("row")).alias("row")).select("row.*")
    return renamed(told.filter("NOT maybe").select(*rows.columns).unionByName(best), df.columns)


ORACLE = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
