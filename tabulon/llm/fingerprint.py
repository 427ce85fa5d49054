"""Document fingerprints: sketches scaled by a threshold.

Every shingle hash below a fixed fraction of the hash range is kept, so that a sketch
grows with its document, sketches merge by union, and containment of a short document
in a very long one is estimated from the short one's hashes alone.

Defined results: shingles are of ``SHINGLE`` words; a text of fewer words is one
shingle; null or empty text has none. A fingerprint is the text's SHA-1, a colon and
the kept hashes in ascending order, in hexadecimal, joined by commas. Two fingerprints
of equal texts are equal and have likeness 1; else likeness is the share of common
hashes in all hashes of both (0 if there are none). Repeated rows give equal results;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches
from .shingles import shingle_sets

SHINGLE = 5
#: One in this many hashes is kept.
SCALE = 8
#: Bytes of text in a range of documents.
RANGE_BYTES = 128 << 20


def sketches(texts: list[bytes], scale: int = SCALE, size: int = SHINGLE) -> list[np.ndarray]:
    """The kept hashes (uint64, ascending) of each UTF-8 text."""
    limit = np.uint64(2**64 // scale)
    return [s[: np.searchsorted(s, limit)] for s in shingle_sets(texts, size)]


def fingerprint(text: bytes, sketch: np.ndarray) -> str:
    return hashlib.sha1(text).hexdigest() + ":" + ",".join(["%016x" % x for x in sketch.tolist()])


def common(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    both = common(a, b)
    return both / (len(a) + len(b) - both) if both else 0.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first document's shingles that the second has."""
    return common(a, b) / len(a) if len(a) else 0.0


def merge(parts: list[np.ndarray]) -> np.ndarray:
    """Sketch of the documents together."""
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def with_next(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Rows (bucket, borrowed, id, text), and the number of buckets, such that inside each bucket, sorted by place, each
    row is followed by its next document in descending order of id, and the last row of
    a bucket is a borrowed copy (``borrowed``) of the row after it. Rows with equal ids
    are ordered by their text's hash; null ids come last.

    Buckets are ranges of integer ids with about equally many rows: one for each
    ``RANGE_BYTES`` of text, at least as many as there are shuffle partitions. Only the
    ranges' bounds and each range's first key go to the driver."""
    spark = df.sparkSession
    if df.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be an integer, as documents follow each other in its order")
    d = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    size = d.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    marks = d.agg(F.percentile_approx("id", [i / n for i in range(1, n)], max(1000, 10 * n)).alias("q")).first()["q"] if n > 1 else []
    bounds = -np.array(sorted(set(marks or ()), reverse=True), np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        """The range of each id, the greatest ids first."""
        return pd.Series(np.searchsorted(bounds, -ids.to_numpy(), "left").astype(np.int32))

    key = F.struct((-F.col("id")).alias("m"), F.sha1(F.encode("text", "utf-8")).alias("h"))
    known = bucket_of(F.coalesce(F.col("id").cast("long"), F.lit(0)))
    d = d.withColumn("bucket", F.when(F.col("id").isNull(), len(bounds) + 1).otherwise(known))
    # each bucket's head: the row that sorts first, null ids after all others; ties in id by the text's hash
    firsts = sorted((r["bucket"], r["k"]["m"], r["k"]["h"]) for r in d.withColumn("k", key).groupBy("bucket").agg(F.min("k").alias("k")).collect())
    # a row for each bucket: whom its head is lent to (the first follows the last, too)
    heads = [(b, m, h, firsts[i - 1][0]) for i, (b, m, h) in enumerate(firsts)]
    heads = spark.createDataFrame(heads, "bucket int, m long, h string, lend int")
    at_head = F.col("m").eqNullSafe(-F.col("id").cast("long")) & (F.col("h") == F.sha1(F.encode("text", "utf-8")))
    d = d.join(F.broadcast(heads), "bucket").withColumn("lend", F.when(at_head, F.col("lend")))
    own = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("x"))
    to = F.when(F.col("lend").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("lend").alias("b"), F.lit(True).alias("x"))))
    return d.select("id", "text", F.explode(to).alias("t")).select(F.col("t.b").alias("bucket"), F.col("t.x").alias("borrowed"), "id", "text"), n


def compare(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each document and of its edit, and likeness to the edit and to the next."""
    kind = df.schema[id_col].dataType.simpleString()
    rows, n = with_next(df, id_col=id_col, text_col=text_col)
    # null ids sort last; equal ids by hash; a borrowed row after all others
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "borrowed", F.col("id").desc_nulls_last(), F.sha1(F.encode("text", "utf-8")))
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, id, text) that still wants its next
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                todo = []
                for bucket, borrowed, id_, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if held is not None and held[0] == bucket:
                        todo.append((held[1], held[2], text))
                    held = None if borrowed else (bucket, id_, text)
                if todo:
                    yield _rows(todo, id_col, part.column(2).type)

    return in_batches(rows, run, schema)


def _rows(todo: list[tuple], id_col: str, kind: pa.DataType) -> pa.RecordBatch:
    """(id, text, next text) to result rows."""
    own, edited, following = [], [], []
    for _, text, after in todo:
        cut = len(text) // 3
        own.append(text.encode())
        edited.append((text[: len(text) - cut] + after[:cut]).encode())
        following.append(after.encode())
    a, b = sketches(own), sketches(edited)
    c = [a[i + 1] if i + 1 < len(todo) and following[i] == own[i + 1] else sketches([following[i]])[0] for i in range(len(todo))]
    like = lambda x, y, p, q: 1.0 if x == y else likeness(p, q)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([t[0] for t in todo], kind),
            pa.array([len(t[1]) for t in todo], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
            pa.array([fingerprint(x, s) for x, s in zip(own, a, strict=True)], pa.string()),
            pa.array([fingerprint(x, s) for x, s in zip(edited, b, strict=True)], pa.string()),
            pa.array([like(x, y, p, q) for x, y, p, q in zip(own, edited, a, b, strict=True)], pa.float64()),
            pa.array([like(x, y, p, q) for x, y, p, q in zip(own, following, a, c, strict=True)], pa.float64()),
        ],
        names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op8_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
