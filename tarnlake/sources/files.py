"""Files in a lake: CSV and Parquet scans, listings and timestamped snapshots."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Options = Mapping[str, str] | None


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, options: Options = None) -> DataFrame:
    """A CSV with a header. Without a schema the types are inferred, which costs one more pass."""
    reader = spark.read.options(header=True, **(options or {}))
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str, options: Options = None) -> DataFrame:
    return spark.read.options(**(options or {})).parquet(path)


def read_tables(spark: SparkSession, base: str, names: Sequence[str], schemas: Mapping[str, StructType | str] | None = None, options: Options = None) -> dict[str, DataFrame]:
    """The CSV files `{base}/{name}.csv`, by name."""
    return {n: read_csv(spark, f"{base.rstrip('/')}/{n}.csv", (schemas or {}).get(n), options) for n in names}


def from_rows(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def list_files(spark: SparkSession, base: str, options: Options = None) -> DataFrame:
    """path, length and modification time of every file below base; contents are not read."""
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True, **(options or {})).load(base)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors share; where that is unset, below a temporary folder if this is the only machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def directory_listing(spark: SparkSession, path: str) -> DataFrame:
    """The entries directly below path: name, is_directory and length."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    rows = [(s.getPath().getName(), s.isDirectory(), s.getLen()) for s in found]
    return spark.createDataFrame(sorted(rows), "name string, is_directory boolean, length bigint")


def container_listing(spark: SparkSession, root: str) -> DataFrame:
    """The containers of a store: the directories directly below its root."""
    return directory_listing(spark, root).filter("is_directory").select("name")


def latest_snapshot(spark: SparkSession, base: str, file_name: str | None = None, options: Options = None) -> str:
    """The newest folder below base, relative to it, that holds file_name (or any file).

    Folder names sort as text in time order (YYYY/MM/DD/HHMMSS). Files directly in base
    belong to no snapshot. Raises FileNotFoundError when there is none.
    """
    # a Parquet table may be a folder of part files: its own path counts as the file
    parts = F.split(F.regexp_replace("path", r"^[a-zA-Z][\w+.-]*:/*", "/"), "/")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base).toUri().getPath().rstrip("/")
    below = F.slice(parts, root.count("/") + 2, F.size(parts))
    if file_name is None:
        folder = F.slice(below, 1, F.size(below) - 1)
    else:
        at = F.array_position(below, file_name).cast("int")
        folder = F.when(at > 0, F.slice(below, 1, at - 1))
    folders = list_files(spark, base, options).select(F.array_join(folder, "/").alias("folder"))
    newest = folders.filter(F.col("folder") != "").agg(F.max("folder")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no snapshot folder below {base}" + (f" holds {file_name}" if file_name else ""))
    return newest


def read_snapshot(spark: SparkSession, base: str, file_name: str, options: Options = None) -> DataFrame:
    """The Parquet file (or folder) file_name of the newest snapshot that has it."""
    return read_parquet(spark, f"{base.rstrip('/')}/{latest_snapshot(spark, base, file_name, options)}/{file_name}", options)
