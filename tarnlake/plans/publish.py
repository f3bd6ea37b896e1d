"""Publish tables to a database and check what arrived."""

from __future__ import annotations

from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..sources.jdbc import read_jdbc, write_jdbc


def _write(df: DataFrame, url: str, table: str, attempts: int, **how) -> None:
    """Overwrite a table, again if it fails."""
    if attempts < 1:
        raise ValueError("attempts must be 1 or more")
    for left in reversed(range(attempts)):
        try:
            return write_jdbc(df, url, table, **how)
        except (PySparkException, Py4JJavaError):  # a task's failure is the latter
            if not left:
                raise


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], url: str, schema: str | None = None, truncate: bool = False, properties: Mapping[str, str] | None = None, connections: int | None = None, batch_size: int | None = None, attempts: int = 1) -> DataFrame:
    """Overwrite each table in the database; returns the row counts of source and sink with a match flag.

    A table that fails is overwritten again, `attempts` times in all. The database counts its rows itself, and the
    source's are counted without reading columns (an observed write tells no count over JDBC).
    """
    if not tables:
        raise ValueError("no tables to publish")
    rows = []
    for name, df in tables.items():
        target = f"{schema}.{name}" if schema else name
        _write(df, url, target, attempts, truncate=truncate, properties=properties, connections=connections, batch_size=batch_size)
        source = df.count()
        sink = int(read_jdbc(spark, url, query=f"SELECT count(*) AS n FROM {target}", properties=properties).first()[0])
        rows.append((name, source, sink, source == sink))
    return spark.createDataFrame(rows, "name string, source_rows bigint, sink_rows bigint, matches boolean")
