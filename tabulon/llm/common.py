"""What the operators of this subpackage share: the workspace that all executors
see, single-evaluation of sub-expressions and the word definition."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One run of these characters separates two words.
SPACES = r"[\x20\x09-\x0D]+"
#: ASCII capitals and what they become; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.
    Only where that is unset and all runs in one process, as in tests, a temporary folder is taken."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tabulon-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{workspace(spark)}/tabulon/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the workspace and read it back: cuts lineage,
    survives lost executors, and each later reader prunes to its own columns."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).parquet(path)
    schema = df.schema
    if partition_by:  # partition columns come last when read
        schema = type(schema)([f for f in schema if f.name not in partition_by] + [f for f in schema if f.name in partition_by])
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``materialize`` has left; results that still read them end."""
    for owner, path in [x for x in _written if x[0] is spark]:
        _written.remove((owner, path))
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001 - the session may be gone; nothing else depends on it
            return


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        if spark._sc is not None and spark._sc._jsc is not None:
            release(spark)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` whose batches are small and whose worker gives memory back at its
    task's end: workers are kept, and an idle one should not hold what its last task took.
    The session's limit on a batch's bytes is lowered, unless it was set to less."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_BYTES).removesuffix("b")) > 8 << 20:
        conf.set(BATCH_BYTES, str(8 << 20))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def give_back() -> None:
    """Return free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once however often ``body`` uses it. (The
    optimizer copies a projected expression into each use inside a lambda.)"""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of ``text``; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def rows_like(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in like.columns])
