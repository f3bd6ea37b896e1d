"""The profile of a whole collection of tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import column_profile, table_profile


def profile_all(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Two reports over named tables.

    `tables`: a row per table with its rows, columns, duplicates and all-NULL rows.
    `columns`: a row per table and column with type, NULLs, NaNs and distinct values.
    """
    if not tables:
        raise ValueError("no tables to profile")
    named = lambda df, name: df.select(F.lit(name).alias("table"), "*")
    shape = [named(table_profile(df), n) for n, df in tables.items()]
    columns = [named(column_profile(df), n) for n, df in tables.items()]
    return {"tables": reduce(DataFrame.unionByName, shape), "columns": reduce(DataFrame.unionByName, columns)}
