"""Token counts of documents in flat, unindexed token files.

A token file is nothing but identifiers of two bytes, one document after the other, an
end-of-document identifier after each. Files are read in blocks that end anywhere. In
each block an array search finds the separators and gives the tokens before the first,
between neighbours, and after the last. A prefix scan over the blocks of a file then
stitches what block ends have cut: it carries the tokens since the last separator and
the number of documents so far.

Blocks are rows (file, block, data). Token files written here are stored as such rows
by Spark's own sink, so that they reach any store; ``file_blocks`` gives the same rows
for plain files in a folder that the executors see.

Defined results: null or empty text has no token and its document counts 0; a file's
last document without separator is counted, flagged ``ended`` false; a file without
identifiers has no document; a file of odd length stops with an error; repeated rows are
documents of their own; an empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_batches, materialize

#: Identifiers in a block.
BLOCK = 1 << 18
END = 50256


@lru_cache(maxsize=2)
def encoder(path: str | None):
    """Byte-level BPE from a file of base64 tokens and ranks."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write one token file for each partition of ``df``; rows (part, file, block, data,
    place, doc): blocks, and the ids of the documents in the order of writing."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        file = TaskContext.get().partitionId()
        rest = np.zeros(0, "<u2")
        block = place = 0
        doc = None
        for batch in batches:
            doc = batch.column(0).type
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                ids = [np.array([*x, END], "<u2") for x in (enc.encode_ordinary(t) if t else [] for t in texts)]
                rest = np.concatenate([rest, *ids])
                cut = len(rest) // BLOCK * BLOCK
                data = [rest[i : i + BLOCK].tobytes() for i in range(0, cut, BLOCK)]
                rest = rest[cut:]
                yield _rows(file, block, data, doc)
                block += len(data)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(["ids"] * n), pa.array([file] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(place, place + n), pa.int64()), part.column(0)], names=["part", "file", "block", "data", "place", "doc"])
                place += n
        if len(rest):
            yield _rows(file, block, [rest.tobytes()], doc)

    def _rows(file: int, block: int, data: list[bytes], doc: pa.DataType) -> pa.RecordBatch:
        n = len(data)
        return pa.RecordBatch.from_arrays([pa.array(["tokens"] * n, pa.string()), pa.array([file] * n, pa.int64()), pa.array(range(block, block + n), pa.int64()), pa.array(data, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, doc)], names=["part", "file", "block", "data", "place", "doc"])

    rows = in_batches(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), run, f"part string, file long, block long, data binary, place long, doc {kind}")
    return materialize(rows, "tokens", "part")


def file_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Rows (file, block, data) of the plain token files under ``path``: the listing comes
    from Spark, and each task reads only its own range of bytes."""
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length"))
    ranges = listed.where("length > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / (2 * block)))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs

        for batch in batches:
            for file, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(file if "://" in file else file.replace("file:/", "file:///", 1))
                with store.open_input_file(place) as f:
                    data = f.read_at(min(2 * block, f.size() - 2 * block * number), 2 * block * number)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    return ranges.repartition(F.col("file"), F.col("block")).mapInArrow(run, "file string, block long, data binary")


def scan(blocks: DataFrame, end: int = END) -> DataFrame:
    """For each block: (file, block, size, head, inner, tail): its identifiers, tokens
    before the first separator, of whole documents, after the last; without a separator
    ``head`` is null."""
    kind = blocks.schema["file"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(data) % 2:
                    raise ValueError("a token file ends inside an identifier")
                ids = np.frombuffer(data, "<u2")
                at = np.flatnonzero(ids == end)
                out.append((file, block, len(ids), int(at[0]) if len(at) else None, np.diff(at) - 1 if len(at) else np.zeros(0, np.int64), len(ids) - 1 - int(at[-1]) if len(at) else len(ids)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["file", "block", "size", "head", "inner", "tail"])

    return in_batches(blocks.select("file", "block", "data"), run, f"file {kind}, block long, size long, head long, inner array<long>, tail long")


def counts(blocks: DataFrame, end: int = END) -> DataFrame:
    """(file, place, n_tokens, ended) of each document, places from 0 in each file.

    The scan's result is written. The prefix scan over a file's blocks carries four numbers
    a block (of 512 KB), never the lengths; these are joined to it by block."""
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    scanned = materialize(scan(blocks, end), "scan")
    sums = scanned.select("file", "block", "tail", F.col("head").isNotNull().alias("has"), F.when(F.col("head").isNotNull(), F.size("inner") + 1).otherwise(0).alias("n"))
    sums = sums.withColumn("run", F.sum(F.col("has").cast("int")).over(upto)).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # tokens since the last separator, up to and with this block; one run starts at each block with a separator
    sums = sums.withColumn("open", F.sum("tail").over(Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0))).withColumn("final", F.lead("block").over(order).isNull())
    sums = materialize(sums.drop("run", "tail"), "sums")
    lens = F.concat(F.array(F.col("head") + F.col("carry")), F.col("inner"))
    closed = scanned.where("head is not null").select("file", "block", "head", "inner").join(sums.where("has").select("file", "block", "base", "carry"), ["file", "block"])
    closed = closed.select("file", "base", F.posexplode(lens)).select("file", (F.col("base") + F.col("pos")).alias("place"), F.col("col").alias("n_tokens"), F.lit(True).alias("ended"))
    left = sums.where("final and open > 0").select("file", (F.col("base") + F.col("n")).alias("place"), F.col("open").alias("n_tokens"), F.lit(False).alias("ended"))
    return closed.unionByName(left)


def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    written = write_tokens(docs)
    ids = written.where("part = 'ids'").select("file", "place", F.col("doc").alias("doc_id"))
    return counts(written.where("part = 'tokens'")).join(ids, ["file", "place"]).select("doc_id", "n_tokens")
