"""What a table holds: volume, NULLs, duplicates, distinct values, statistics.

Each operator is one aggregate over one scan. NULL counts as a value wherever
values are told apart; floats compare as Spark groups them (0.0 = -0.0, NaN = NaN).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, NumericType, StringType, StructType, VariantType

from ..functions import null_count
from ._guard import named, require_columns

_NESTED = (ArrayType, MapType, StructType, VariantType)


def schema_frame(df: DataFrame) -> DataFrame:
    """Position, name, type and nullability of each column; runs no job."""
    require_columns(df, [])
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, nullable boolean")


def volume(df: DataFrame) -> DataFrame:
    require_columns(df, [])
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def null_counts(df: DataFrame) -> DataFrame:
    """One row with the NULL count of each column (0 over no rows)."""
    require_columns(df, [])
    return df.agg(*[null_count(named(c)).alias(c) for c in df.columns]) if df.columns else df.limit(0)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and their difference, in one job."""
    require_columns(df, [])
    groups = df.groupBy(*map(named, df.columns)).agg(F.count("*").alias("__n"))
    total = F.coalesce(F.sum("__n"), F.lit(0))
    return groups.agg(total.alias("total"), F.count("*").alias("distinct")).withColumn("duplicates", F.col("total") - F.col("distinct"))


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, how: str = "together") -> DataFrame:
    """A row per column with its number of distinct values. Maps can't be compared and are left out.

    how: "together" is one aggregate, which repeats each row once a column; "by_column" groups each column by itself,
    from a scan of that column alone, for wide tables; "approx" sketches them (2 % off), in one pass without repeats.
    """
    columns = [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))] if columns is None else list(columns)
    require_columns(df, columns)
    if how not in ("together", "by_column", "approx"):
        raise ValueError("how is together, by_column or approx")
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n bigint")
    if how == "by_column":
        return reduce(DataFrame.unionByName, [df.groupBy(named(c)).agg(F.lit(1)).agg(F.count("*").alias("n")).select(F.lit(c).alias("column"), "n") for c in columns])
    values = (lambda c: F.approx_count_distinct(c, 0.02)) if how == "approx" else F.count_distinct
    count = lambda c: values(named(c)) + F.coalesce(F.max(named(c).isNull().cast("bigint")), F.lit(0))
    one = df.agg(*[count(c).alias(f"c{i}") for i, c in enumerate(columns)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n")) for i, c in enumerate(columns)])))


def column_duplicates(df: DataFrame, column: str) -> DataFrame:
    """Rows, distinct values and surplus rows of one column."""
    require_columns(df, [column])
    return duplicate_rows(df.select(named(column)))


def all_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many rows are NULL in every column (0 for a table without columns)."""
    columns = df.columns if columns is None else list(columns)
    require_columns(df, columns)
    empty = reduce(and_, [named(c).isNull() for c in columns]) if columns else F.lit(False)
    return df.filter(empty).agg(F.count("*").alias("n"))


def table_profile(df: DataFrame) -> DataFrame:
    """One row with rows, columns, duplicates and all-NULL rows (0 for a table without columns), from one grouping."""
    require_columns(df, [])
    groups = df.groupBy(*map(named, df.columns)).agg(F.count("*").alias("__n"))
    empty = reduce(and_, [named(c).isNull() for c in df.columns]) if df.columns else F.lit(False)
    total = F.coalesce(F.sum("__n"), F.lit(0))
    return groups.agg(total.alias("rows"), F.lit(len(df.columns)).alias("columns"), (total - F.count("*")).alias("duplicates"), F.coalesce(F.sum(F.when(empty, F.col("__n"))), F.lit(0)).alias("all_null"))


def column_profile(df: DataFrame) -> DataFrame:
    """Type, NULLs, NaNs (floats only) and distinct values of each column, in one aggregate."""
    schema = schema_frame(df).select("column", "type")
    if not df.columns:
        return schema.selectExpr("*", "0L nulls", "0L nans", "0L distinct")
    parts, rows = [], []
    for i, f in enumerate(df.schema):
        c = named(f.name)
        parts += [null_count(c).alias(f"u{i}")]
        parts += [(F.count_if(F.isnan(c)) if isinstance(f.dataType, (FloatType, DoubleType)) else F.lit(None).cast("bigint")).alias(f"a{i}")]
        told = not isinstance(f.dataType, (MapType, VariantType))
        parts += [(F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("bigint")), F.lit(0)) if told else F.lit(None).cast("bigint")).alias(f"d{i}")]
        rows.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"u{i}").alias("nulls"), F.col(f"a{i}").alias("nans"), F.col(f"d{i}").alias("distinct")))
    return df.agg(*parts).select(F.inline(F.array(*rows)))


def describe_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row per string column: n (not NULL), min_value and max_value in the order of their bytes."""
    columns = [f.name for f in df.schema if isinstance(f.dataType, StringType)] if columns is None else list(columns)
    require_columns(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n bigint, min_value string, max_value string")
    parts = [x for i, c in enumerate(columns) for x in (F.count(named(c)).alias(f"n{i}"), F.min(named(c)).alias(f"a{i}"), F.max(named(c)).alias(f"z{i}"))]
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"a{i}").alias("min_value"), F.col(f"z{i}").alias("max_value")) for i, c in enumerate(columns)]
    return df.agg(*parts).select(F.inline(F.array(*rows)))


#: Rows of a sketch: a rank that it tells is off by one row in so many.
SKETCH = 10_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> DataFrame:
    """A row per column and point with the least value that has that share of the column's values at or below it (NULL without values).

    A sketch brackets each rank first. What is below a bracket is only counted; of the values inside, about one
    in 2,500, those are grouped and put in order, so no task holds all values of a column.
    """
    require_columns(df, columns)
    values = df.select(*[named(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    wide = 2 / SKETCH
    edges = lambda i: F.percentile_approx(f"x{i}", [e for p in points for e in (max(p - wide, 0.0), min(p + wide, 1.0))], SKETCH)
    bounds = F.broadcast(values.agg(*[x for i in range(len(columns)) for x in (edges(i).alias(f"e{i}"), F.count(f"x{i}").alias(f"n{i}"))]))  # one row
    spans = [(i, j, F.col(f"x{i}"), F.col(f"e{i}")[2 * j], F.col(f"e{i}")[2 * j + 1]) for i in range(len(columns)) for j in range(len(points))]
    met = values.crossJoin(bounds).select(F.inline(F.filter(F.array(*[F.when(x <= high, F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.when(x >= low, x).alias("value"))) for i, j, x, low, high in spans]), lambda s: s.isNotNull())))
    found = met.groupBy("i", "j", "value").agg(F.count("*").alias("n"))  # the value of all below a bracket is NULL
    upto = F.sum("n").over(Window.partitionBy("i", "j").orderBy(F.asc_nulls_first("value")))
    wanted = bounds.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(columns[i]).alias("column"), F.lit(float(p)).alias("point"), F.ceil(F.col(f"n{i}") * p).alias("rank")) for i in range(len(columns)) for j, p in enumerate(points)])))
    ranked = found.withColumn("upto", upto).join(F.broadcast(wanted), ["i", "j"], "right")
    return ranked.groupBy("i", "j", "column", "point").agg(F.min(F.when(F.col("upto") >= F.col("rank"), F.col("value"))).alias("value")).select("column", "point", "value")


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, quartiles: str | None = None) -> DataFrame:
    """A row per numeric column: n, mean, stddev, min_value, max_value as doubles.

    quartiles adds p25, p50 and p75: "exact" by exact_quantiles(), "approx" by a sketch. Columns that aren't
    numbers are left out; describe_strings() has those that are strings.
    """
    columns = [f.name for f in df.schema if isinstance(f.dataType, NumericType)] if columns is None else list(columns)
    require_columns(df, columns)
    if quartiles not in (None, "exact", "approx"):
        raise ValueError("quartiles is exact, approx or None")
    points = [25, 50, 75] if quartiles else []
    if not columns:
        more = "".join(f", p{p} double" for p in points)
        return df.sparkSession.createDataFrame([], f"column string, n bigint, mean double, stddev double, min_value double, max_value double{more}")
    parts, rows = [], []
    for i, c in enumerate(columns):
        x = named(c).cast("double")
        stats = {"n": F.count(x), "mean": F.avg(x), "stddev": F.stddev(x), "min_value": F.min(x), "max_value": F.max(x)}
        for p in points if quartiles == "approx" else ():
            stats[f"p{p}"] = F.percentile_approx(x, p / 100)
        parts += [v.alias(f"{k}_{i}") for k, v in stats.items()]
        rows.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{k}_{i}").alias(k) for k in stats]))
    told = df.agg(*parts).select(F.inline(F.array(*rows)))
    if quartiles != "exact":
        return told
    found = exact_quantiles(df, columns, [p / 100 for p in points]).groupBy("column").agg(*[F.max(F.when(F.col("point") == p / 100, F.col("value"))).alias(f"p{p}") for p in points])
    return told.join(found, "column", "left")
