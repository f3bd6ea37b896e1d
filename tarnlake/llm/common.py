"""What several operators share: the shared folder, batches of rows, lookups that hot keys can't overload, row filters."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows handed to Python code at once; bounds a task's memory also where texts are long.
SLICE_ROWS = 256
#: Parts into which the rows of one key are dealt.
SALTS = 64


_resident: dict = {}


def resident(name: str, key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from batch to batch: of the last operator only, as workers outlive operators."""
    if (name, key) not in _resident:
        _resident.clear()
        _resident[name, key] = make()
    return _resident[name, key]


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, keeps: bool = False) -> DataFrame:
    """df.mapInArrow(fn, schema), after which each worker hands freed memory back to the machine.

    Python workers outlive operators, and what their allocators hold would add to the next one's need.
    keeps=False also drops what resident() holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _resident.clear()
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library can
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one if this is the only machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one, with whatever file system it is on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let shuffle files of plans that are done with go now, where the driver's JVM can be asked: they stay until it collects the plans."""
    gc.collect()
    with contextlib.suppress(AttributeError, PySparkException):  # a remote session has no such gateway
        spark.sparkContext._jvm.System.gc()


def text_of(column: str) -> Column:
    """A text column with NULL as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def place_of(df: DataFrame, name: str) -> int:
    """The position of a column: of that very name, or of the same in another case."""
    if name in df.columns:
        return df.columns.index(name)
    return [c.lower() for c in df.columns].index(name.lower())


def numbered(df: DataFrame, *reads: str) -> tuple[DataFrame, list[str]]:
    """df with its columns renamed to their numbers, and the new names of the columns `reads`.

    An operator may then give its own columns any name that isn't a number: none of the caller's clashes.
    """
    return df.toDF(*map(str, range(len(df.columns)))), [str(place_of(df, c)) for c in reads]


def renamed(rows: DataFrame, names: Sequence[str], results: Sequence[str] = (), leave: Sequence[str] = ()) -> DataFrame:
    """The numbered columns of rows under their own names, then the results; columns named like a result (in any case) are replaced."""
    taken = {n.lower() for n in (*results, *leave)}
    return rows.select(*[F.col(str(i)).alias(c) for i, c in enumerate(names) if c.lower() not in taken], *results)


def add_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], added: str, reads: Sequence[str], rows_at_once: int = SLICE_ROWS, carry: bool = True) -> DataFrame:
    """df with the columns of the DDL string `added`, which fn computes from each slice of rows.

    fn sees only the columns `reads`; carry=False leaves them out of the result. Columns of df that
    have an added name are replaced.
    """
    new = StructType.fromDDL(added)
    where = [place_of(df, c) for c in reads]
    taken = {n.lower() for n in new.names}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in taken and (carry or i not in where)]
    schema = StructType([*[df.schema[i] for i in kept], *new.fields])
    n = len(kept)
    # the read columns ride at the end, in case one of them is replaced
    plain, _ = numbered(df)
    rows = plain.select(*[F.col(str(i)) for i in kept], *[F.col(str(i)).alias(f"read{k}") for k, i in enumerate(where)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows_at_once):
            out = fn(pa.RecordBatch.from_arrays(part.columns[n:], names=list(reads)))
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *out], names=schema.names)

    return mapped(rows, run, schema, keeps=True)


def salt_of(*columns: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def grouped_back(rows: DataFrame, keys: Sequence[str], salt: str, partial: Sequence[Column], total: Sequence[Column]) -> DataFrame:
    """rows with the totals of their group, however many rows the group has.

    Groups are aggregated first by key and salt, then by key, and the totals return to each
    (key, salt): a group of any size is dealt to as many tasks as it has salts. Keys aren't NULL.
    """
    parts = rows.groupBy(*keys, salt).agg(*partial)
    totals = parts.groupBy(*keys).agg(*total)
    per_salt = parts.select(*keys, salt).join(totals, list(keys))
    return rows.join(per_salt, [*keys, salt])


# --- a blocked Bloom filter as a table: one row of 64 bits for each of a fixed number of words ---

#: Words of a filter, the proven bound of what is broadcast: 2**20 rows of two 64-bit numbers, about 35 MB as a hash relation.
#: It has so many rows only where about 2**20 keys are in it, and no more however many are.
FILTER_WORDS = 1 << 20


def filter_cell(key: Column, words: int = FILTER_WORDS) -> tuple[Column, Column]:
    """The word of a 64-bit key and the three bits it sets there."""
    one = F.lit(1).cast("bigint")
    bit = lambda by: F.call_function("shiftleft", one, F.shiftrightunsigned(key, by).bitwiseAND(F.lit(63)).cast("int"))
    mask = bit(58).bitwiseOR(bit(52)).bitwiseOR(bit(46))
    return F.pmod(key, F.lit(words)), mask


def maybe_in(rows: DataFrame, key: Column, cells: DataFrame, flag: str) -> DataFrame:
    """rows with a flag: false only if the filter (columns __word, __bits) certainly lacks the key."""
    word, mask = filter_cell(key)
    probe = rows.withColumn("__word", word).withColumn("__mask", mask)
    found = probe.join(F.broadcast(cells), "__word", "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))
    return found.withColumn(flag, hit).drop("__word", "__mask", "__bits")


def filter_of(keys: DataFrame, key: str) -> DataFrame:
    """The filter that holds every key of a column."""
    word, mask = filter_cell(F.col(key))
    return keys.select(word.alias("__word"), mask.alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))


def repeated_filter(keys: DataFrame, key: str) -> DataFrame:
    """The filter of the keys seen at least twice: no repeated key is missed, few others are let in.

    Cells hit by a single row are dropped before their words are put together.
    """
    word, mask = filter_cell(F.col(key))
    hits = keys.select(word.alias("__word"), mask.alias("__mask")).groupBy("__word", "__mask").agg(F.count("*").alias("__n"))
    return hits.filter("__n > 1").groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))


def drop_ids(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """df without the rows whose id is in the one column of ids.

    Rows that the filter of the ids certainly lacks keep their place; only the others shuffle.
    """
    gone = ids.toDF("gone").withColumn("key", F.xxhash64("gone"))
    rows, (own,) = numbered(df, id_col)
    told = maybe_in(rows, F.xxhash64(own), filter_of(gone, "key"), "maybe")
    sure = told.filter("maybe").join(gone.select("gone").distinct(), F.col(own) == F.col("gone"), "left_anti")
    return renamed(told.filter("NOT maybe").unionByName(sure), df.columns)
