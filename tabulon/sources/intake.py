"""Intake of document files: each different content is parsed once, and given up after two attempts.

The registry is an append-only table of attempts, the cells another one, both in batches that appear whole. An attempt is written
before its files are parsed, so that a run that dies counts as one; a run that starts again goes on with what
is neither parsed nor given up. Files may come as a table (path, content), or as a stream of files, whose progress Spark keeps."""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_label
from .files import SCHEMA, open_formulas, parse
from .sinks import append_batch, read_batches
from .store import stage

ATTEMPTS = 2
RECORDS = "digest string, path string, format string, status string, attempts int, n_cells long, incomplete boolean, error string"
CELLS = "digest string, " + SCHEMA.removeprefix("path string, ").removesuffix(", error string")
FILES = "path string, modificationTime timestamp, length long, content binary"


class Intake:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def attempts(self) -> DataFrame:
        return read_batches(self.spark, f"{self.path}/records", RECORDS)

    def records(self) -> DataFrame:
        """One row for each different content: parsed, failed (may be tried again), given up, or pending where no attempt has ended."""
        best = F.max_by(F.struct("path", "format", "status", "n_cells", "incomplete", "error"), F.when(F.col("status") == "parsed", 3).when(F.col("status") == "failed", 2).otherwise(1))
        r = self.attempts().groupBy("digest").agg(F.sum("attempts").cast("int").alias("attempts"), best.alias("r"))
        status = F.when((F.col("r.status") != "parsed") & (F.col("attempts") >= ATTEMPTS), "given up").otherwise(F.col("r.status"))
        return r.select("digest", "r.path", "r.format", status.alias("status"), "attempts", "r.n_cells", "r.incomplete", "r.error")

    def cells(self) -> DataFrame:
        """Cells of parsed contents. A content that two runs have parsed at once counts once."""
        return read_batches(self.spark, f"{self.path}/cells", CELLS).dropDuplicates(["digest", "block", "row", "col"])

    def documents(self) -> DataFrame:
        """(digest, cell_count, text_hash, incomplete) of parsed contents: equal texts have equal hashes, whatever their format."""
        place = F.sort_array(F.collect_list(F.struct("block", "row", "col", "text")))
        text = F.array_join(F.transform(place, lambda c: normalize_label(c["text"])), " ")
        c = self.cells().groupBy("digest").agg(F.count("*").alias("cell_count"), F.sha2(text, 256).alias("text_hash"))
        return self.records().where("status = 'parsed'").select("digest", "incomplete").join(c, "digest", "left").select("digest", F.coalesce("cell_count", F.lit(0)).alias("cell_count"), "text_hash", "incomplete")

    def add(self, files: DataFrame, excluded: DataFrame | None = None) -> None:
        """Parse the files (path, content) whose content is new or has an attempt left, and that is not ``excluded`` (digest)."""
        named = files.select("path", "content", F.sha2("content", 256).alias("digest"))
        done = self.records().where("status in ('parsed', 'given up')").select("digest")
        todo = named.groupBy("digest").agg(F.min("path").alias("path")).join(done, "digest", "left_anti")
        if excluded is not None:
            todo = todo.join(excluded.select("digest"), "digest", "left_anti")
        todo = stage(todo, "todo")
        if todo.isEmpty():
            return
        suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        none = lambda kind: F.lit(None).cast(kind)
        append_batch(todo.select("digest", "path", suffix.alias("format"), F.lit("pending").alias("status"), F.lit(1).alias("attempts"), none("long").alias("n_cells"), none("boolean").alias("incomplete"), none("string").alias("error")), f"{self.path}/records")
        found = stage(_parsed(named.join(todo, ["digest", "path"], "left_semi")), "parsed")
        cells = found.where("block is not null").select(*[c.split()[0] for c in CELLS.split(", ")])
        append_batch(cells, f"{self.path}/cells")
        ended = found.groupBy("digest", "path").agg(F.max("error").alias("error"), F.count("block").alias("n_cells"), F.bool_or("incomplete").alias("incomplete"))
        ended = ended.select("digest", "path", suffix.alias("format"), F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("status"), F.lit(0).alias("attempts"), "n_cells", "incomplete", "error")
        append_batch(ended, f"{self.path}/records")

    def stream(self, folder: str, excluded: DataFrame | None = None):
        """Take in all files under ``folder`` that have not come yet; returns the running query. Started again it goes on where it stopped."""
        files = self.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)
        run = lambda batch, _: self.add(batch.select("path", "content"), excluded)
        return files.writeStream.foreachBatch(run).option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).start()

    def report(self) -> DataFrame:
        """(format, status, documents, cells)."""
        return self.records().groupBy("format", "status").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_cells"), F.lit(0)).alias("cells"))


def _parsed(files: DataFrame) -> DataFrame:
    """Cells, or one row with an error, or one row without a cell, of each file (digest, path, content)."""
    names = ["digest", *[x.split()[0] for x in SCHEMA.split(", ")], "incomplete"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for digest, path, data in zip(b["digest"], b["path"], b["content"], strict=True):
                data = bytes(data)
                rows = parse(path, data) or [(path, *[None] * 9)]
                unread = False
                if path.lower().endswith(".xlsx") and rows[0][-1] is None:
                    try:
                        unread = open_formulas(data) > 0
                    except (ValueError, zipfile.BadZipFile, ElementTree.ParseError):
                        unread = True
                yield pd.DataFrame([(digest, *r, unread) for r in rows], columns=names, dtype=object)

    return files.select("digest", "path", "content").mapInPandas(run, "digest string, " + SCHEMA + ", incomplete boolean")


def content_digest(data: bytes) -> str:
    """The name of a content in the registry."""
    return hashlib.sha256(data).hexdigest()
