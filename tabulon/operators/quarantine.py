"""Quarantine as an append-only log of actions: audit, plan, apply, verify, restore.

An action is (seq, doc_id, action, digest, reasons); a document is quarantined while its last action is ``apply``. Nothing is ever changed in
place: applying copies documents to the quarantine store and then appends to the log, so that a run that stops
half way leaves a copy that nothing refers to, and the next run does the rest. Stores hold (doc_id, content, digest)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import append_batch, read_batches
from .dedup import content_hash

LOG = "seq long, doc_id long, action string, digest string, reasons array<string>"
HELD = "doc_id long, content string, digest string"


def audit_plan(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(path, doc_id, digest, reasons) of the files (path, content) whose content is that of a candidate (doc_id, digest, reasons);
    candidates without a file drop out."""
    held = files.select("path", content_hash(F.col("content")).alias("digest"))
    return candidates.select("doc_id", "digest", "reasons").join(held, "digest").select("path", "doc_id", "digest", "reasons")


def preflight(plan: DataFrame, active: DataFrame, held: DataFrame) -> DataFrame:
    """Each planned document (doc_id, digest) with its ``state`` before anything moves: ready, already held, or what forbids it. ``active`` and ``held`` are (doc_id, content)."""
    a = active.select("doc_id", content_hash(F.col("content")).alias("now"))
    h = held.select("doc_id", content_hash(F.col("content")).alias("copy"))
    j = plan.join(a, "doc_id", "left").join(h, "doc_id", "left")
    state = F.when(F.col("now").isNotNull() & (F.col("now") != F.col("digest")), "source changed").when(F.col("copy").isNotNull() & (F.col("copy") != F.col("digest")), "target conflict")
    state = state.when(F.col("now").isNull() & F.col("copy").isNull(), "source missing").when(F.col("copy").isNotNull(), "held").otherwise("ready")
    return j.select(*plan.columns, state.alias("state"))


def states(log: DataFrame) -> DataFrame:
    """(doc_id, state, digest, reasons) by the last action of each document: quarantined or restored. Repeated actions are one."""
    last = log.groupBy("doc_id").agg(F.max_by(F.struct("action", "digest", "reasons"), F.struct("seq", "action")).alias("x"))
    return last.select("doc_id", F.when(F.col("x.action") == "apply", "quarantined").otherwise("restored").alias("state"), "x.digest", "x.reasons")


def active(documents: DataFrame, log: DataFrame) -> DataFrame:
    """Documents that are not in quarantine."""
    return documents.join(states(log).where("state = 'quarantined'").select("doc_id"), "doc_id", "left_anti")


def unregistered(excluded: DataFrame, registered: DataFrame) -> DataFrame:
    """Excluded documents that the registry does not know; none may be."""
    return excluded.select("doc_id").distinct().join(registered.select("doc_id"), "doc_id", "left_anti")


class Quarantine:
    """The log and the store of copies in a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        return read_batches(self.spark, f"{self.path}/log", LOG)

    def held(self) -> DataFrame:
        return read_batches(self.spark, f"{self.path}/held", HELD).dropDuplicates(["doc_id", "digest"])

    def _append(self, rows: DataFrame, action: str) -> None:
        seq = self.log().agg(F.coalesce(F.max("seq"), F.lit(0)).alias("n")).first()["n"] + 1
        append_batch(rows.select(F.lit(seq).cast("long").alias("seq"), "doc_id", F.lit(action).alias("action"), "digest", "reasons"), f"{self.path}/log")

    def apply(self, plan: DataFrame, documents: DataFrame) -> None:
        """Quarantine the documents of ``plan`` (doc_id, digest, reasons). All are checked first and nothing happens if one may not move; documents
        that are quarantined already are passed over."""
        held = self.held()
        checked = preflight(plan, documents.select("doc_id", "content"), held)
        wrong = checked.where("state not in ('ready', 'held')").groupBy("state").count().collect()
        if wrong:
            raise ValueError("quarantine: " + ", ".join(f"{r['count']} {r['state']}" for r in wrong))
        fresh = documents.join(checked.where("state = 'ready'").select("doc_id", "digest"), "doc_id").select("doc_id", "content", "digest")
        if not fresh.isEmpty():
            append_batch(fresh, f"{self.path}/held")
        done = states(self.log()).where("state = 'quarantined'").select("doc_id")
        todo = plan.join(done, "doc_id", "left_anti").select("doc_id", "digest", "reasons")
        if not todo.isEmpty():
            self._append(todo, "apply")

    def restore(self, documents: DataFrame) -> None:
        """End the quarantine of ``documents`` (doc_id), of those that are in it."""
        back = states(self.log()).where("state = 'quarantined'").join(documents.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "digest", "reasons")
        if not back.isEmpty():
            self._append(back, "restore")

    def verify(self, dataset: DataFrame) -> dict[str, int]:
        """How many quarantined documents have a copy with their digest, lack one, and are still in ``dataset`` (doc_id); the last two must be 0."""
        now = states(self.log()).where("state = 'quarantined'")
        copies = self.held().select("doc_id", content_hash(F.col("content")).alias("copy"))
        j = now.join(copies, "doc_id", "left")
        kept = now.join(dataset.select("doc_id").distinct(), "doc_id", "left_semi").count()
        r = j.agg(F.count_if(F.col("copy") == F.col("digest")).alias("ok"), F.count_if(~F.col("copy").eqNullSafe(F.col("digest"))).alias("bad")).first()
        return {"copies": r["ok"], "without_copy": r["bad"], "in_dataset": kept}
