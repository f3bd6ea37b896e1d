from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame | None, names: Sequence[str]) -> None:
    """Raise ValueError when df is missing or lacks one of the columns."""
    if df is None:
        raise ValueError("no table was given")
    if unknown := [n for n in names if n not in df.columns]:
        raise ValueError(f"unknown columns {unknown}; the table has {df.columns}")


def named(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")
