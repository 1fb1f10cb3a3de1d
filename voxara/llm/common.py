"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few fixed-size columns that are broadcast at most (about 100 bytes each); beyond, such a join shuffles.
BROADCAST_ROWS = 500_000
#: Keys that join_hot broadcasts at most.
HOT_KEYS = 100_000
#: Rows of a batch that goes to a Python worker while a table is stashed.
BATCH_ROWS = 4_000
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session that has none gets a temporary folder; a cluster without the setting is an error,
    since a machine-local folder there loses rows.
    """
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        global _LOCAL
        _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="voxara-")
        at = f"file://{_LOCAL}"
    return at.rstrip("/")


_LOCAL = ""


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/voxara-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, plans send Python workers at most BATCH_ROWS rows at a time (texts of several kB make the default's batches large)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stash(df: DataFrame, name: str, packed: bool = False) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder and reads it again, which cuts lineage; also returns the path.

    packed, for tables that are small beside what they are made from: rows move to as few files as their size asks for,
    instead of one for each task. Without Hadoop's native library every file makes its executor spawn chmod several times.
    """
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        (df.hint("rebalance") if packed else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a stashed table that no later read needs."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def few(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A hint to broadcast tables of as many rows as table (which is stored) has, or none if those are more than BROADCAST_ROWS."""
    return F.broadcast if table.count() <= BROADCAST_ROWS else lambda df: df


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) on key with a stored table, one row for each key, whose weight is the number of rows that have it.

    A small table is broadcast. Of a larger one the keys that HOT_KEYS-th of all rows have, of which there are HOT_KEYS
    at most, are broadcast and the others shuffled, so that no task gets all rows of a hot key.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    least = table.select(F.sum(weight)).first()[0] / HOT_KEYS
    hot = table.filter(F.col(weight) >= least)
    mild = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col(weight) < least), key, how)
    return rows.join(F.broadcast(hot), key).select(mild.columns).union(mild)


def absent(docs: DataFrame, gone: DataFrame, keys: list[Column]) -> DataFrame:
    """docs without the rows whose keys (one Column for each column of gone) are a row of gone; nulls in gone are equal to nulls.

    gone is stored first, so that its size decides whether the texts must be shuffled. Names of docs' columns don't matter.
    """
    names = [f"_gone{i}_{uuid.uuid4().hex}" for i in range(len(keys))]
    table, _ = stash(gone.toDF(*names), "gone")
    same = [k.eqNullSafe(table[n]) for k, n in zip(keys, names, strict=True)]
    return docs.join(few(table)(table), same, "left_anti")


def tidy(run: Batches) -> Batches:
    """A function of Arrow batches that hands freed memory back at its end: Spark reuses Python workers, and what they keep counts while the JVM works."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split at bytes 20 and 09-0D: bytes.lower() and bytes.split() know ASCII alone."""
    return text.lower().split() if text else []
