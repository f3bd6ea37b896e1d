"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(start: str | Column, end: str | Column) -> Column:
    """Whole days from start to end (negative if end is earlier) of dates or timestamps; NULL if either is."""
    return F.datediff(end, start)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(part / whole * 100, digits)


def null_count(column: Column) -> Column:
    """How many values are NULL: 0, not NULL, over no rows."""
    return F.count_if(column.isNull())
