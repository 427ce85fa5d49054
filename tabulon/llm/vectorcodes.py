"""Vector codes: product quantisation with exact integer distances.

Components become integers, ``floor(256 * x)``; a vector is cut into ``PARTS`` equal parts,
and each part position has a codebook of ``ENTRIES`` entries, trained by rounds of assigning
all parts to their nearest entry and moving each entry to the floored mean of its parts.

The nearest entry is found by an exponion search. A row starts at the entry ``a`` that it had
before, at distance u. An entry at most as far from the row as ``a`` lies within 2u of ``a``,
by the triangle inequality, so that only the head of the list of ``a``'s neighbours, sorted by
distance, is scanned: those whose squared distance to ``a`` is at most ``4 * u**2``. All
distances are squared integers, and ties go to the lower index, so that codes equal those of
a full search.

Defined results: rows whose vector is null, or has a null or non-finite component, are
dropped, and no others. Scaled components are clamped to ``LIMIT`` either way, so that
distances fit 64 bits. Vectors of unequal lengths, or of a length that ``PARTS`` doesn't
divide, are read as if zeros followed up to the next common length. Codebooks start from the
smallest ids (nulls last, ties by vector), all of them where there are fewer than
``ENTRIES``. Repeated rows are coded each; null labels are one label; an empty table has
an empty result. Only id, vector and label are read.

A codebook has ``ENTRIES * length`` numbers, however many rows there are: it goes through the
driver. Each pass writes its codes, so that the next starts from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Magnitude of a scaled component: squared differences of 2048 components fit 64 bits.
LIMIT = 1 << 25
#: Sums by label are broadcast up to so many labels, and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000


def is_whole(vector: Column) -> Column:
    """Not null, and all components finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))


def scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(F.lit(SCALE) * x.cast("double"), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))


class Book:
    """Entries of one part position, and for each entry all entries by their distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gap = ((entries[:, None] - entries[None]) ** 2).sum(2)
        self.near = np.argsort(gap, axis=1, kind="stable")
        self.gap = np.take_along_axis(gap, self.near, 1)

    def search(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry and squared distance of each row of ``x``, scanning from ``start``."""
        best = start.copy()
        dist = ((x - self.entries[start]) ** 2).sum(1)
        reach = np.empty(len(x), np.int64)
        grouped = np.argsort(start, kind="stable")
        edges = np.searchsorted(start[grouped], np.arange(len(self.entries) + 1))
        for a in range(len(self.entries)):
            rows = grouped[edges[a] : edges[a + 1]]
            reach[rows] = np.searchsorted(self.gap[a], 4 * dist[rows], "right")
        widest = np.argsort(-reach, kind="stable")
        falling = -reach[widest]
        for j in range(len(self.entries)):
            rows = widest[: np.searchsorted(falling, -j)]  # those that reach beyond neighbour j
            if not len(rows):
                break
            entry = self.near[start[rows], j]
            d = ((x[rows] - self.entries[entry]) ** 2).sum(1)
            better = (d < dist[rows]) | ((d == dist[rows]) & (entry < best[rows]))
            rows = rows[better]
            best[rows], dist[rows] = entry[better], d[better]
        return best, dist


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer lists as rows, zeros after the short ones."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Rows (id, label, v, code) with the codes of nearest entries, and their summed distance
    ``error``. ``books`` is (part, entry, position)."""
    parts, _, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Book(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column(2), parts * wide)
            before = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            found = [search[p].search(x[:, p * wide : (p + 1) * wide], before[:, p]) for p in range(parts)]
            code = np.stack([f[0] for f in found], 1).astype(np.uint8)
            error = np.sum([f[1] for f in found], axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error, pa.int64())], names=["id", "label", "v", "code", "error"])

    kinds = dict(rows.dtypes)
    return in_batches(rows.select("id", "label", "v", "code"), run, f"id {kinds['id']}, label {kinds['label']}, v array<int>, code binary, error long")


def part_sums(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, place, n, total): how many parts an entry has, and the sums of their components.
    Each task adds up its rows first."""
    parts, k, wide = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, wide), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = as_matrix(batch.column(0), parts * wide)
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                used, first = np.unique(code[order, p], return_index=True)
                total[p, used] += np.add.reduceat(x[order, p * wide : (p + 1) * wide], first, axis=0)
                n[p, used] += np.diff([*first, len(order)])
        p, e = np.nonzero(n)
        if len(p):
            place = np.tile(np.arange(wide), len(p))
            each = [np.repeat(a, wide) for a in (p, e, n[p, e])]
            yield pa.RecordBatch.from_arrays([pa.array(each[0], pa.int32()), pa.array(each[1], pa.int32()), pa.array(place, pa.int32()), pa.array(each[2], pa.int64()), pa.array(total[p, e].ravel(), pa.int64())], names=["part", "entry", "place", "n", "total"])

    sums = in_batches(coded.select("v", "code"), run, "part int, entry int, place int, n long, total long")
    return sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))


def moved(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Each entry at the floored mean of its parts; unused entries stay."""
    out = books.copy()
    for r in sums.collect():
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    return out


def encode(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (id, label, code binary, error long), and the final codebooks (part, entry, position)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte for each part: 1 to 256 entries")
    vector = F.col(f"`{vector_col}`")
    rows = df.where(is_whole(vector)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), scaled(vector).alias("v"), F.lit(bytes(parts)).alias("code"))
    rows = materialize(rows, "vectors")
    width = rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 1
    wide = -(-width // parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.zeros((len(first), parts * wide), np.int64)
    for i, r in enumerate(first):
        books[i, : len(r.v)] = r.v
    books = books.reshape(len(first), parts, wide).transpose(1, 0, 2).copy()
    for _ in range(rounds if first else 0):
        rows = materialize(assign(rows, books), "codes")
        books = moved(books, part_sums(rows, books))
    return assign(rows, books).select("id", "label", "code", "error"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over equal labels, nulls together. Labels are
    summed before they are shuffled, and their rows are never brought together."""
    coded = materialize(coded, "coded")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(Decimal(2**63 - 1)))
    sums = materialize(coded.groupBy("label").agg(total.cast("long").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    code = F.lower(F.hex("code"))
    return with_label_errors(coded).select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    near = "SELECT vec_id, part, x, min({'d': " + " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, 5)) + ", 'e': e}) AS m FROM parts JOIN {0} USING (part) GROUP BY ALL"
    mean = "SELECT b.part, b.e, CASE WHEN n IS NULL THEN c ELSE s END AS c FROM {0} b LEFT JOIN (SELECT part, m.e AS e, count(*) AS n, [" + ", ".join(f"floor(sum(x[{i}]) / count(*))::BIGINT" for i in range(1, 5)) + "] AS s FROM {1} GROUP BY ALL) USING (part, e)"
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, part, v[4 * part + 1:4 * part + 4] AS x FROM kept, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, e, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
a1 AS MATERIALIZED ({near.replace("{0}", "b0")}), b1 AS MATERIALIZED ({mean.format("b0", "a1")}),
a2 AS MATERIALIZED ({near.replace("{0}", "b1")}), b2 AS MATERIALIZED ({mean.format("b1", "a2")}),
a3 AS MATERIALIZED ({near.replace("{0}", "b2")}),
f AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a3 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256 FROM f JOIN kept USING (vec_id)
"""


ORACLE = _oracle()
