"""Tables between steps, and the keyed stores."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.walk import walk

_staged: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder of ``spark.checkpoint.dir`` that all executors share; where that is
    unset and all runs in one process, as in tests, in a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tabulon-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at.rstrip('/')}/tabulon/{name}-{uuid.uuid4().hex}"
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to a new place and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that ``stage`` has left; results that still read them end."""
    for owner, path in [x for x in _staged if x[0] is spark]:
        _staged.remove((owner, path))
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001 - the session may be gone; nothing else depends on it
            return


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _staged}.values():
        if spark._sc is not None and spark._sc._jsc is not None:
            release(spark)


def insert_once(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``new`` with the outcome of an idempotent insert: the first of each key that
    is not stored yet is inserted, the others are duplicates of ``kept``."""
    first = F.min_by("id", order)
    old = existing.groupBy(key).agg(first.alias("old"))
    fresh = new.groupBy(key).agg(first.alias("fresh"))
    j = new.join(old, key, "left").join(fresh, key)
    kept = F.coalesce("old", "fresh")
    return j.select("id", key, kept.alias("kept"), (kept != F.col("id")).alias("duplicate"))


def apply_revisions(submissions: DataFrame, key: str, order: str) -> DataFrame:
    """Optimistic concurrency: of submissions (key, revision, order) that name the current
    revision the first is accepted, and each acceptance raises the revision by one. Each
    outcome depends on all before it: a key's submissions are walked in order."""

    def step(now: int, revision: int) -> tuple:
        return now + (revision == now), revision == now

    return walk(submissions.select(key, order, "revision"), (key,), (order, "revision"), ("revision",), 1, step, "accepted", "boolean")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Insert-or-replace by key: rows of ``changes`` win."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)
