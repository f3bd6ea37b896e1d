"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped_back, release, salt_of, settled


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with least, the smallest of u's neighbours; a node of any degree is dealt to many tasks."""
    salted = edges.withColumn("__salt", salt_of("v"))
    return grouped_back(salted, ["u"], "__salt", [F.min("v").alias("__m")], [F.min("__m").alias("least")])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def star_components(links: DataFrame) -> DataFrame:
    """id and component_id (the smallest id reachable) of every node with a link, from links (u, v).

    Each round hangs larger neighbours on a node's smallest (large-star), then smaller ones (small-star),
    until nothing moves; all that is left are stars. Self-links and repeated links don't matter.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    edges = settled(edges)
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v"))
        lower = settled(large.distinct())
        small = _with_least(lower)
        # of u's smaller neighbours all but the smallest hang on that one, and u too
        moved = small.filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        edges = settled(moved.unionByName(small.select("u", F.col("least").alias("v"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
        # what earlier rounds shuffled isn't needed again, and with many partitions it fills disks
        del both, large, lower, small, moved
        release(links.sparkSession)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
