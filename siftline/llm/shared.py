"""Materialised intermediates in the folder that the whole cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it back, so a lost
executor never loses an intermediate. Where the session names no such folder (local tests), one
temporary folder is made for it.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else that of setCheckpointDir; only a local session may have none and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="siftline-")
    return _LOCAL[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_root(spark)}/siftline-{label}-{uuid.uuid4().hex}"
    _forget_at_exit(spark, path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back."""
    return write_rows(df, new_path(df.sparkSession, label))


def write_rows(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_A_FILE = 1_000_000


def materialise_few(df: DataFrame, label: str) -> DataFrame:
    """The same in as many files as the number of rows needs; the rows are cached until they are written.

    For small tables of many rounds, which would have a file for each partition: for every file on a
    local file system an executor starts processes (``chmod``).
    """
    held = df.persist()
    try:
        return materialise(held.coalesce(-(-held.count() // ROWS_A_FILE) or 1), label)
    finally:
        held.unpersist()


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    def clean() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the JVM may have ended already
            pass

    atexit.register(clean)


def give_back() -> None:
    """Returns memory that a worker does not use any more to the machine: workers live on through other stages, and what they keep adds up in an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim:
        trim(0)


BATCH_BYTES = 4 << 20


def text_batches(spark: SparkSession) -> None:
    """Whole texts are long: for the rest of the session, a batch for Python closes at ``BATCH_BYTES`` unless a lower limit is set.

    The limit is read when a query runs, not when it is built, so it cannot be taken back here.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def keep_rows(docs: DataFrame, kept: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` that ``kept`` (doc_id, key) names, one of those with equal id and key, with the columns of ``docs``.

    Both steps deal by one column of id and key, so texts are shuffled once.
    """
    name = "__sl_key"
    while name in docs.columns:
        name += "_"
    own = docs.withColumn(name, F.struct("doc_id", key.alias("key")))
    named = kept.select(F.struct("doc_id", "key").alias(name)).distinct()
    return own.join(named, name, "left_semi").dropDuplicates([name]).select(*docs.columns)


HOT_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined with their group (distinct ``key``, number of its rows ``size``), however large groups are.

    Fewer than ``HOT_GROUPS`` groups can have more than that part of all rows: these are broadcast, so their
    rows stay where they are; only the rows of other groups are shuffled. ``groups`` is read three times.
    """
    total = groups.agg(F.sum(size).alias("n")).first()["n"] or 0
    hot = F.col(size) * HOT_GROUPS > total
    few = rows.join(F.broadcast(groups.filter(hot)), key)
    rest = rows.join(F.broadcast(groups.filter(hot).select(key)), key, "left_anti").join(groups.filter(~hot), key)
    return few.unionByName(rest)
