"""Shared plumbing of the training-data operators: column picking, shared-folder tables, text splitting."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python step holds at a time.
STEP_BYTES = 2_000_000


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of ``df`` and no others, whatever else it carries.

    Columns are found by position: an exact name first, then one that differs in case, so that
    extra, repeated or clashing names never make a reference ambiguous. A missing column raises
    ValueError.
    """
    have = df.columns
    plain = df.toDF(*(f"_p{i}" for i in range(len(have))))
    out = []
    for name in names:
        at = next((i for i, x in enumerate(have) if x == name), None)
        if at is None:
            at = next((i for i, x in enumerate(have) if x.lower() == name.lower()), None)
        if at is None:
            raise ValueError(f"no column {name!r} among {have}")
        out.append(F.col(f"_p{at}").alias(name))
    return plain.select(*out)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, set here only where it is unset and all run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: With this setting Spark deletes the shuffle files of a query when the query has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Where the tables of ``stored`` are.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps restart from the files.

    The shuffle files of the write are not needed after it and go at once, not when the driver collects garbage. The
    table itself goes when the driver ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path is not None:
            files, at = _files(df.sparkSession, path)
            files.delete(at, True)


@functools.lru_cache(maxsize=1)
def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches in order, each of at most ``most`` bytes of ``column`` or of one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and held + n > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if len(sizes) > begin:
            yield batch.slice(begin)


