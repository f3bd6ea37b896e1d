"""Business reports: frequencies, shares, ranges, grouped statistics, top keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import percent
from ._guard import named, require_columns


def frequency(df: DataFrame, column: str, by_value: bool = False, count_name: str = "n") -> DataFrame:
    """How often each value occurs (NULL is a value); most frequent first, or by value."""
    require_columns(df, [column])
    counts = df.groupBy(named(column)).agg(F.count("*").alias(count_name))
    return counts.orderBy(named(column)) if by_value else counts.orderBy(F.desc(count_name), named(column))


def share_of_total(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    """quantity and percent of all rows for each value, most frequent first; one plan, no driver round trip."""
    require_columns(df, [column])
    counts = df.groupBy(named(column)).agg(F.count("*").alias("quantity"))
    total = counts.agg(F.sum("quantity").alias("__total"))  # one row
    shares = counts.crossJoin(F.broadcast(total))
    return shares.select(named(column), "quantity", percent(F.col("quantity"), F.col("__total"), digits).alias("percent")).orderBy(F.desc("quantity"), named(column))


def value_range(df: DataFrame, column: str, first: str = "first", last: str = "last") -> DataFrame:
    require_columns(df, [column])
    return df.agg(F.min(named(column)).alias(first), F.max(named(column)).alias(last))


def global_stats(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    require_columns(df, [column])
    c = named(column)
    return df.agg(F.min(c).alias("min_value"), F.max(c).alias("max_value"), F.round(F.avg(c), digits).alias("avg_value"))


def grouped_stats(df: DataFrame, key: str, column: str, digits: int = 2, with_total: bool = False, order_by: str = "quantity", round_all: bool = True) -> DataFrame:
    """quantity, avg, min, max (and total) of a column for each key, the largest of the result column order_by first.

    round_all=False rounds the mean only.
    """
    require_columns(df, [key, column])
    if order_by not in ("quantity", "total", "avg_value", "min_value", "max_value") or order_by == "total" and not with_total:
        raise ValueError(f"no result column {order_by} to order by")
    c = named(column)
    rounded = lambda x, name: (F.round(x, digits) if round_all or name == "avg_value" else x).alias(name)
    total = [rounded(F.sum(c), "total")] if with_total else []
    stats = [F.count("*").alias("quantity"), *total, rounded(F.avg(c), "avg_value"), rounded(F.min(c), "min_value"), rounded(F.max(c), "max_value")]
    return df.groupBy(named(key)).agg(*stats).orderBy(F.desc(order_by), named(key))


def top_key(df: DataFrame, key: str, count_name: str = "total") -> DataFrame:
    """The most frequent non-NULL key and its count; the smallest key wins a tie. No row if there is no key."""
    require_columns(df, [key])
    return df.filter(named(key).isNotNull()).groupBy(named(key)).agg(F.count("*").alias(count_name)).orderBy(F.desc(count_name), named(key)).limit(1)


def recurrence(df: DataFrame, key: str) -> DataFrame:
    """Min, max and mean number of rows a key has, the number of keys, and whether none recurs (NULLs over no rows)."""
    require_columns(df, [key])
    per_key = df.groupBy(named(key)).agg(F.count("*").alias("__n"))
    stats = per_key.agg(F.min("__n").alias("min_rows"), F.max("__n").alias("max_rows"), F.avg("__n").alias("avg_rows"), F.count("*").alias("keys"))
    return stats.withColumn("no_recurrence", F.col("max_rows") == 1)


def nonpositive(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value is zero or less; NULLs don't match."""
    require_columns(df, [column])
    return df.filter(named(column) <= 0)


def listing(df: DataFrame, columns: Sequence[str], ascending: Sequence[str] = (), descending: Sequence[str] = ()) -> DataFrame:
    """Chosen columns ordered by some ascending, then others descending."""
    require_columns(df, [*columns, *ascending, *descending])
    return df.orderBy(*map(named, ascending), *[named(c).desc() for c in descending]).select(*map(named, columns))


def sample_rows(df: DataFrame, n: int = 10, order: Sequence[str] = ()) -> DataFrame:
    """The first n rows, in the given order if there is one."""
    require_columns(df, order)
    return (df.orderBy(*map(named, order)) if order else df).limit(n)


def category_report(fact: DataFrame, dim: DataFrame, key: str, label: str, n: int | None = 20) -> DataFrame:
    """How many facts each label has, most first, cut to n rows; facts without a label count under NULL.

    The left join repeats facts if the dimension's key repeats: check it with key_violations().
    Facts are counted by key first, so that only one row a key meets the dimension.
    """
    require_columns(fact, [key])
    require_columns(dim, [key, label])
    per_key = fact.groupBy(named(key)).agg(F.count("*").alias("__n"))
    labels = dim.select(named(key), named(label))
    report = per_key.join(labels, key, "left").groupBy(named(label)).agg(F.sum("__n").alias("n")).orderBy(F.desc("n"), named(label))
    return report if n is None else report.limit(n)
