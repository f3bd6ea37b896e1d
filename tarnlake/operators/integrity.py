"""Keys and references between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._guard import named, require_columns
from .report import top_key


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their counts; NULL is a value. Empty: the key is unique."""
    require_columns(df, keys)
    return df.groupBy(*map(named, keys)).agg(F.count("*").alias("n")).filter("n > 1")


def _keys(df: DataFrame, key: str) -> DataFrame:
    require_columns(df, [key])
    return df.select(named(key)).filter(named(key).isNotNull())


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key no parent has. NULL keys refer to nothing and aren't orphans."""
    require_columns(child, [key])
    return child.filter(named(key).isNotNull()).join(_keys(parent, key), key, "left_anti")


def matched(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    require_columns(child, [key])
    return child.join(_keys(parent, key), key, "left_semi")


def orphan_summary(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """One row: child rows in all, matched, orphaned and with a NULL key."""
    require_columns(child, [key])
    per_key = child.groupBy(named(key)).agg(F.count("*").alias("__n"))
    known = _keys(parent, key).distinct().withColumn("__known", F.lit(True))
    found = per_key.join(known, key, "left")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("__n"))), F.lit(0))
    has, null = F.col("__known").isNotNull(), named(key).isNull()
    return found.agg(total(F.lit(True)).alias("rows"), total(has).alias("matched"), total(~has & ~null).alias("orphans"), total(null).alias("null_keys"))


def top_key_check(child: DataFrame, parent: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """The child's most frequent key, whether the parent has it, and the parent's attributes of it."""
    require_columns(parent, [key, *attributes])
    top = top_key(child, key)
    # one parent row: the one with the least attributes, should the key repeat
    found = parent.join(F.broadcast(top.select(key)), key, "left_semi").groupBy(named(key)).agg(F.min(F.struct(*map(named, attributes))).alias("__a"))
    return top.join(found, key, "left").select(named(key), "total", F.col("__a").isNotNull().alias("exists"), *[F.col("__a").getField(a).alias(a) for a in attributes])
