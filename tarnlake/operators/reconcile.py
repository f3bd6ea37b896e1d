from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._guard import require_columns


def reconcile(source: DataFrame, sink: DataFrame, name: str) -> DataFrame:
    """One row: name, row counts of source and sink, and whether they match."""
    require_columns(source, [])
    require_columns(sink, [])
    counts = source.agg(F.count("*").alias("source_rows")).crossJoin(sink.agg(F.count("*").alias("sink_rows")))
    return counts.select(F.lit(name).alias("name"), "source_rows", "sink_rows", (F.col("source_rows") == F.col("sink_rows")).alias("matches"))
