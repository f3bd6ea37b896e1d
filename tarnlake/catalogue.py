"""The reference queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from . import sources
from .functions import days_between
from .plans import publish

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "lang", "source").join(table(s, d, "labels"), "doc_id", "left")


def _stats(s: SparkSession, d: str) -> DataFrame:
    return op.describe_numeric(table(s, d, "orders"), ["o_totalprice"], quartiles="exact")


def _lead_times(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").select("o_orderkey", "o_orderdate")
    lines = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return lines.join(orders, "o_orderkey").select(days_between("o_orderdate", "l_shipdate").alias("days"))


def _lead_time_summary(s: SparkSession, d: str) -> DataFrame:
    told = op.describe_numeric(_lead_times(s, d), ["days"], quartiles="exact")
    return told.select("column", "n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min_value", "p25", "p50", "p75", "max_value")


def _csv_scan(s: SparkSession, d: str) -> DataFrame:
    """nation written as CSV and read back by name, with inferred types."""
    folder = sources.scratch_folder(s)
    table(s, d, "nation").write.csv(f"{folder}/nation.csv", header=True)
    return sources.read_tables(s, folder, ["nation"])["nation"]


def _csv_told(s: SparkSession, d: str) -> DataFrame:
    folder = sources.scratch_folder(s)
    table(s, d, "customer").write.csv(f"{folder}/customer.csv", header=True)
    return sources.read_csv(s, f"{folder}/customer.csv", "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


def _snapshots(s: SparkSession, d: str) -> str:
    """Two snapshots of a lake, of which only the older one has region."""
    folder = sources.scratch_folder(s)
    table(s, d, "nation").limit(3).write.parquet(f"{folder}/2024/01/01/100000/nation.parquet")
    table(s, d, "region").write.parquet(f"{folder}/2024/01/01/100000/region.parquet")
    table(s, d, "nation").write.parquet(f"{folder}/2024/01/02/090000/nation.parquet")
    return folder


def _snapshot_names(s: SparkSession, d: str) -> DataFrame:
    folder = _snapshots(s, d)
    return sources.from_rows(s, [("nation", sources.latest_snapshot(s, folder, "nation.parquet")), ("region", sources.latest_snapshot(s, folder, "region.parquet"))], "name string, folder string")


def _listing(s: SparkSession, d: str) -> DataFrame:
    return sources.directory_listing(s, f"{_snapshots(s, d)}/2024/01").select("name", "is_directory")


def _containers(s: SparkSession, d: str) -> DataFrame:
    return sources.container_listing(s, _snapshots(s, d))


def _inventory(s: SparkSession, d: str) -> DataFrame:
    """The tables that hold the files of the data folder, and whether all their files have bytes."""
    name = F.regexp_extract("path", r"/([a-z]+)\.parquet(/|$)", 1)
    return sources.list_files(s, d).groupBy(name.alias("name")).agg((F.min("length") > 0).alias("filled"))


def _database(s: SparkSession, d: str) -> str:
    """An embedded database in this process's memory, with nation published twice."""
    url = f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"
    for _ in range(2):
        publish(s, {"nation": table(s, d, "nation")}, url)
    return url


def _published(s: SparkSession, d: str) -> DataFrame:
    url = f"jdbc:derby:memory:d{uuid.uuid4().hex};create=true"
    return publish(s, {n: table(s, d, n) for n in ("nation", "region", "supplier")}, url, connections=4, batch_size=500, attempts=2)


def _jdbc_parts(s: SparkSession, d: str) -> DataFrame:
    return sources.read_jdbc(s, _database(s, d), "nation", parts=sources.Parts("n_nationkey", 0, 25, 4), fetch_size=100)


def _jdbc_where(s: SparkSession, d: str) -> DataFrame:
    found = sources.read_jdbc(s, _database(s, d), query='SELECT "n_name", "n_regionkey" FROM nation')
    return found.filter("n_regionkey = 1")


def _schemas(s: SparkSession, d: str) -> DataFrame:
    url = _database(s, d)
    return sources.from_rows(s, [(n, sources.schema_exists(s, url, n, "derby")) for n in ("APP", "NOPE")], "name string, found boolean")


def _top_customer(s: SparkSession, d: str) -> DataFrame:
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return op.top_key_check(orders, table(s, d, "customer"), "c_custkey", ["c_name"])


def _price_by_type(s: SparkSession, d: str) -> DataFrame:
    return op.grouped_stats(table(s, d, "part"), "p_type", "p_retailprice")


QUERIES: dict[str, Query] = {
    "status_share": lambda s, d: op.share_of_total(table(s, d, "orders"), "o_orderstatus"),
    "row_count": lambda s, d: op.volume(table(s, d, "orders")),
    "null_counts": lambda s, d: op.null_counts(_labelled(s, d)),
    "schema_frame": lambda s, d: op.schema_frame(table(s, d, "nation")),
    "duplicate_rows": lambda s, d: op.duplicate_rows(table(s, d, "documents").select("lang", "source")),
    "distinct_per_column": lambda s, d: op.distinct_counts(table(s, d, "part"), ["p_brand", "p_type", "p_size"]),
    "column_duplicates": lambda s, d: op.column_duplicates(table(s, d, "documents"), "text"),
    "column_profile": lambda s, d: op.column_profile(_labelled(s, d)).drop("type"),
    "all_null_rows": lambda s, d: op.all_null_rows(_labelled(s, d), ["quality", "toxic"]),
    "describe_numeric": lambda s, d: _stats(s, d).select("column", "n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min_value", "max_value"),
    "summary_quartiles": lambda s, d: _stats(s, d).select("column", "p25", "p50", "p75"),
    "category_report": lambda s, d: op.category_report(table(s, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), table(s, d, "nation"), "n_nationkey", "n_name"),
    "left_join_null_group": lambda s, d: op.frequency(_labelled(s, d), "quality"),
    "date_range": lambda s, d: op.value_range(table(s, d, "orders"), "o_orderdate", "first_order", "last_order"),
    "lead_time_days": lambda s, d: op.frequency(_lead_times(s, d), "days"),
    "lead_time_summary": _lead_time_summary,
    "describe_strings": lambda s, d: op.describe_strings(table(s, d, "customer")),
    "table_profile": lambda s, d: op.table_profile(table(s, d, "lineitem").select("l_partkey", "l_quantity", "l_returnflag")),
    "document_profile": lambda s, d: op.column_profile(table(s, d, "documents")).drop("type"),
    "duplicate_documents": lambda s, d: op.duplicate_rows(table(s, d, "documents").drop("doc_id")),
    "distinct_by_column": lambda s, d: op.distinct_counts(table(s, d, "part"), how="by_column"),
    "mean_by_segment": lambda s, d: op.grouped_stats(table(s, d, "customer"), "c_mktsegment", "c_acctbal", order_by="avg_value", round_all=False),
    "csv_scan": _csv_scan,
    "csv_with_schema": _csv_told,
    "snapshot_scan": lambda s, d: sources.read_snapshot(s, _snapshots(s, d), "nation.parquet"),
    "snapshot_names": _snapshot_names,
    "directory_listing": _listing,
    "container_listing": _containers,
    "file_inventory": _inventory,
    "publish": _published,
    "jdbc_partitions": _jdbc_parts,
    "jdbc_where": _jdbc_where,
    "schema_exists": _schemas,
    "top_customer": _top_customer,
    "orphans": lambda s, d: op.orphans(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id"),
    "matched": lambda s, d: op.matched(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id"),
    "orphan_summary": lambda s, d: op.orphan_summary(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id"),
    "recurrence": lambda s, d: op.recurrence(table(s, d, "orders"), "o_custkey"),
    "key_violations": lambda s, d: op.key_violations(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]),
    "freq_type": lambda s, d: op.frequency(table(s, d, "part"), "p_type"),
    "freq_brand": lambda s, d: op.frequency(table(s, d, "part"), "p_brand"),
    "freq_size": lambda s, d: op.frequency(table(s, d, "part"), "p_size", by_value=True),
    "global_stats": lambda s, d: op.global_stats(table(s, d, "customer"), "c_acctbal"),
    "stats_by_segment": lambda s, d: op.grouped_stats(table(s, d, "customer"), "c_mktsegment", "c_acctbal", with_total=True),
    "price_by_type": _price_by_type,
    "store_listing": lambda s, d: op.listing(table(s, d, "customer"), ["c_mktsegment", "c_name", "c_acctbal"], ["c_mktsegment"], ["c_acctbal"]),
    "nonpositive": lambda s, d: op.nonpositive(table(s, d, "customer"), "c_acctbal").select("c_custkey", "c_acctbal"),
    "sample_rows": lambda s, d: op.sample_rows(table(s, d, "nation"), 10, ["n_nationkey"]),
    "reconcile": lambda s, d: op.reconcile(table(s, d, "documents"), table(s, d, "labels"), "documents"),
}

_LABELLED = "(SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def _frequency(column: str) -> str:
    return f"SELECT {column}, count(*) AS n FROM part GROUP BY 1"


def _distinct(column: str, source: str) -> str:
    return f"count(DISTINCT {column}) + (CASE WHEN count(*) > count({column}) THEN 1 ELSE 0 END) FROM {source}"


ORACLES: dict[str, str] = {
    "status_share": "SELECT o_orderstatus, count(*) AS quantity, round(count(*) / (SELECT count(*) FROM orders) * 100, 2) AS percent FROM orders GROUP BY 1",
    "row_count": "SELECT count(*) AS rows, CAST(6 AS INTEGER) AS columns FROM orders",
    "null_counts": f"SELECT count(*) - count(doc_id) AS doc_id, count(*) - count(lang) AS lang, count(*) - count(source) AS source, count(*) - count(quality) AS quality, count(*) - count(toxic) AS toxic FROM {_LABELLED}",
    "schema_frame": "SELECT CAST(position AS INTEGER) AS position, \"column\", type, true AS nullable FROM (VALUES (0, 'n_nationkey', 'int'), (1, 'n_name', 'string'), (2, 'n_regionkey', 'int')) t(position, \"column\", type)",
    "duplicate_rows": "SELECT total, \"distinct\", total - \"distinct\" AS duplicates FROM (SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM (SELECT DISTINCT lang, source FROM documents)) AS \"distinct\")",
    "distinct_per_column": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n FROM part" for c in ("p_brand", "p_type", "p_size")),
    "column_duplicates": "SELECT count(*) AS total, count(DISTINCT text) AS \"distinct\", count(*) - count(DISTINCT text) AS duplicates FROM documents",
    "column_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", (SELECT count(*) - count({c}) FROM {_LABELLED}) AS nulls, CAST(NULL AS BIGINT) AS nans, {_distinct(c, _LABELLED).replace(' FROM', ' AS \"distinct\" FROM', 1)}" for c in ("doc_id", "lang", "source", "quality", "toxic")),
    "all_null_rows": f"SELECT count(*) AS n FROM {_LABELLED} WHERE quality IS NULL AND toxic IS NULL",
    "describe_numeric": "SELECT 'o_totalprice' AS \"column\", count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS stddev, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value FROM orders",
    "summary_quartiles": "SELECT 'o_totalprice' AS \"column\", quantile_disc(o_totalprice, 0.25) AS p25, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.75) AS p75 FROM orders",
    "category_report": "SELECT n_name, count(*) AS n FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, n_name NULLS FIRST LIMIT 20",
    "left_join_null_group": f"SELECT quality, count(*) AS n FROM {_LABELLED} GROUP BY 1",
    "date_range": "SELECT min(o_orderdate) AS first_order, max(o_orderdate) AS last_order FROM orders",
    "lead_time_days": "SELECT CAST(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS INTEGER) AS days, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "lead_time_summary": "SELECT 'days' AS \"column\", count(*) AS n, round(avg(d), 4) AS mean, round(stddev_samp(d), 4) AS stddev, min(d) AS min_value, quantile_disc(d, 0.25) AS p25, quantile_disc(d, 0.5) AS p50, quantile_disc(d, 0.75) AS p75, max(d) AS max_value FROM (SELECT CAST(date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS DOUBLE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "describe_strings": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c}) AS min_value, max({c}) AS max_value FROM customer" for c in ("c_name", "c_mktsegment")),
    "table_profile": "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(3 AS INTEGER) AS columns, CAST(sum(n) - count(*) AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS all_null FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_quantity, l_returnflag)",
    "document_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", (SELECT count(*) - count({c}) FROM documents) AS nulls, CAST(NULL AS BIGINT) AS nans, {_distinct(c, 'documents').replace(' FROM', ' AS \"distinct\" FROM', 1)}" for c in ("doc_id", "text", "lang", "source", "n_chars")),
    "duplicate_documents": "SELECT total, \"distinct\", total - \"distinct\" AS duplicates FROM (SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS \"distinct\")",
    "distinct_by_column": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n FROM (SELECT DISTINCT {c} FROM part)" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    "mean_by_segment": "SELECT c_mktsegment, count(*) AS quantity, round(avg(c_acctbal), 2) AS avg_value, min(c_acctbal) AS min_value, max(c_acctbal) AS max_value FROM customer GROUP BY 1 ORDER BY avg_value DESC",
    "csv_scan": "SELECT * FROM nation",
    "csv_with_schema": "SELECT * FROM customer",
    "snapshot_scan": "SELECT * FROM nation",
    "snapshot_names": "SELECT * FROM (VALUES ('nation', '2024/01/02/090000'), ('region', '2024/01/01/100000')) t(name, folder)",
    "directory_listing": "SELECT * FROM (VALUES ('01', true), ('02', true)) t(name, is_directory)",
    "container_listing": "SELECT '2024' AS name",
    "file_inventory": "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name, true AS filled",
    "publish": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS source_rows, count(*) AS sink_rows, true AS matches FROM {t}" for t in ("nation", "region", "supplier")),
    "jdbc_partitions": "SELECT * FROM nation",
    "jdbc_where": "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1",
    "schema_exists": "SELECT * FROM (VALUES ('APP', true), ('NOPE', false)) t(name, found)",
    "top_customer": "WITH top AS (SELECT o_custkey AS c_custkey, count(*) AS total FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 ORDER BY total DESC, c_custkey LIMIT 1) SELECT top.c_custkey, total, c.c_custkey IS NOT NULL AS \"exists\", c.c_name FROM top LEFT JOIN customer c ON c.c_custkey = top.c_custkey",
    "orphans": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "matched": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "orphan_summary": "SELECT count(*) AS rows, count(l.doc_id) AS matched, count(*) - count(l.doc_id) AS orphans, CAST(0 AS BIGINT) AS null_keys FROM documents d LEFT JOIN labels l USING (doc_id)",
    "recurrence": "SELECT min(n) AS min_rows, max(n) AS max_rows, avg(n) AS avg_rows, count(*) AS keys, max(n) = 1 AS no_recurrence FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)",
    "key_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "freq_type": _frequency("p_type"),
    "freq_brand": _frequency("p_brand"),
    "freq_size": _frequency("p_size"),
    "global_stats": "SELECT min(c_acctbal) AS min_value, max(c_acctbal) AS max_value, round(avg(c_acctbal), 2) AS avg_value FROM customer",
    "stats_by_segment": "SELECT c_mktsegment, count(*) AS quantity, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 2) AS avg_value, round(min(c_acctbal), 2) AS min_value, round(max(c_acctbal), 2) AS max_value FROM customer GROUP BY 1",
    "price_by_type": "SELECT p_type, count(*) AS quantity, round(avg(p_retailprice), 2) AS avg_value, round(min(p_retailprice), 2) AS min_value, round(max(p_retailprice), 2) AS max_value FROM part GROUP BY 1",
    "store_listing": "SELECT c_mktsegment, c_name, c_acctbal FROM customer",
    "nonpositive": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal <= 0",
    "sample_rows": "SELECT * FROM nation ORDER BY n_nationkey LIMIT 10",
    "reconcile": "SELECT 'documents' AS name, s AS source_rows, k AS sink_rows, s = k AS matches FROM (SELECT (SELECT count(*) FROM documents) AS s, (SELECT count(*) FROM labels) AS k)",
}
