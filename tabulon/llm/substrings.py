"""Substring duplicates: windows of words that start at more than one place are removed.

A window is ``WINDOW`` consecutive words of one document. Which ones repeat is found in two passes.

First, a count-min sketch overestimates counts. Windows are counted by their anchor, the run of
``ANCHOR`` words in them with the least hash: equal windows have equal anchors at different
places, so that an anchor is counted at least as often as each of its windows, and there are
some fifteen times fewer of them. Each block of documents sends a sketch of its own, as lists of the cells
that it touches, which shards of the cell range merge by adding saturated counters. A window
is estimated repeated if all cells of its anchor are; none that repeats is lost.

Second, only windows estimated repeated are grouped exactly, by 127 bits of two hashes of
all their words. A block sends each different one once, whether it has it more than once,
and a shard of the hash range finds those that two blocks have, or one block twice.

What shards answer is a bit for each thing that a block has asked, in its order: a frequent
window has an entry for each block and not for each place. Blocks are dealt out at random, so that copies
of a text, or a hot source, lie in many of them. Documents are written once, bucketed by block, so that texts
are shuffled once; sketches, windows and answers meet them there. Blocks and shards hold bounded amounts of text
and their number grows with it, as does the sketch; so does the number of requests, up to one for each
window asked for.

Defined results: words are cut at ``[\\x20\\x09-\\x0D]``, their case is kept; null and empty texts
have no word; texts shorter than a window lose nothing. All windows are judged on the
input. Each row is a document of its own, also with a null or repeated id, so that the windows of
repeated rows repeat. Extra columns are not read; an empty table has an empty result.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, materialize, new_path
from .shingles import mix, shingle_hashes, window_hashes, word_hashes

WINDOW, ANCHOR = 35, 8
#: Bytes of text in a bucket of documents and in a shard of windows; a bucket has several blocks. Where there are fewer
#: than tasks, blocks are smaller, but no smaller than so.
BUCKET_BYTES, BLOCKS, LEAST_BYTES = 16 << 20, 4, 256 << 10
#: A cell of the sketch for so many bytes of text (an anchor for some 90), in each of so many rows; cells in a shard at most.
BYTES_A_CELL, SHARD_CELLS = 16, 1 << 22
SEEDS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xD6D018F5A1E0AC47))
#: Texts are hashed so many bytes at a time.
RUN = 1 << 20
MANY = np.uint32(1 << 31)

_tables: list[tuple[SparkSession, str]] = []


@atexit.register
def _forget() -> None:
    for spark, name in _tables:
        if spark._sc is not None and spark._sc._jsc is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def runs_of_texts(column: pa.ChunkedArray) -> Iterator[list[bytes]]:
    """UTF-8 texts, some ``RUN`` bytes at a time; null is empty."""
    out, n = [], 0
    for t in column:
        out.append((t.as_py() or "").encode())
        n += len(out[-1])
        if n >= RUN:
            yield out
            out, n = [], 0
    if out:
        yield out


def sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (np.minimum or np.maximum) of each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = least(x[:-have], x[have:])
        have *= 2
    if have < width:
        x = least(x[: len(x) - (width - have)], x[width - have :])
    return x


def anchors(words: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the anchor's hash of the window that starts there (0: none does), and the hashes
    at all places that are an anchor of some window."""
    at = np.zeros(len(words), np.uint64)
    run = min(ANCHOR, size)
    wide = size - run + 1
    if len(words) < size:
        return at, at[:0]
    h = np.maximum(shingle_hashes(words, run), np.uint64(1))
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(words))  # words up to the text's end
    least = sliding(h, wide, np.minimum)
    at[: len(least)] = np.where(left[: len(least)] >= size, least, np.uint64(0))
    highest = sliding(np.concatenate((np.zeros(wide - 1, np.uint64), at[: len(h)])), wide, np.maximum)
    return at, h[h == highest]


class Sizes:
    """Numbers of buckets, blocks and shards, from the bytes of all texts: each block sends a row to each shard, and
    more of them for the sake of more tasks would be more rows from the same text."""

    def __init__(self, size: int, tasks: int):
        full = -(-size // BUCKET_BYTES)
        self.blocks = max(BLOCKS * full, min(tasks, size // LEAST_BYTES), 1)
        self.buckets = max(full, min(tasks, self.blocks))
        self.window_bits = max(1, (full - 1).bit_length())
        self.cell_bits = max(16, (size // BYTES_A_CELL).bit_length())
        self.shard_bits = max(0, self.cell_bits - SHARD_CELLS.bit_length() + 1)


def cells_of(keys: np.ndarray, seed: np.uint64, bits: int) -> np.ndarray:
    return mix(keys ^ seed) >> np.uint64(64 - bits)


def sketch(keys: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A partition's sketch: for each row its touched cells, ascending, and whether more than once."""
    out = []
    for seed in SEEDS:
        cells, n = np.unique(cells_of(keys, seed, bits), return_counts=True)
        out.append((cells, n > 1))
    return out


class Block:
    """Documents of a block, as runs of texts with the windows of each."""

    def __init__(self, texts: pa.ChunkedArray, size: int):
        self.size, self.runs, picked = size, [], [np.zeros(0, np.uint64)]
        for run in runs_of_texts(texts):
            words, counts = word_hashes(run, fold=False)
            at, own = anchors(words, counts, size)
            self.runs.append((run, words, counts, at))
            picked.append(own)
        self.anchors = np.concatenate(picked)

    def estimated(self, answers: list[np.ndarray], bits: int) -> np.ndarray:
        """Anchors, ascending, all cells of which are counted more than once."""
        keys = np.unique(self.anchors)
        hot = np.ones(len(keys), bool)
        for (cells, _), seed, answer in zip(sketch(self.anchors, bits), SEEDS, answers, strict=True):
            hot &= answer[np.searchsorted(cells, cells_of(keys, seed, bits))]
        return keys[hot]

    def windows(self, hot: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows with an anchor in ``hot``: where they start in each run; the different ones by both
        hashes, ascending; whether each is here more than once; and for each window which it is."""
        starts, high, low = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for _, words, _, at in self.runs:
            place = np.minimum(np.searchsorted(hot, at), max(len(hot) - 1, 0))
            starts.append(np.flatnonzero(hot[place] == at) if len(hot) else np.zeros(0, np.int64))
            h, lo = window_hashes(words, starts[-1], self.size)
            high.append(h)
            low.append((lo >> np.uint64(33)).astype(np.uint32))
        h, lo = np.concatenate(high), np.concatenate(low)
        order = np.lexsort((lo, h))
        h, lo = h[order], lo[order]
        head = np.ones(len(h), bool)
        head[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        return starts, h[first], lo[first], np.diff(np.concatenate((first, [len(h)]))) > 1, which


def _rows(shards: list, block: int, bodies: list[bytes]) -> pa.Table:
    return pa.table({"shard": pa.array(shards, pa.int64()), "block": pa.array([block] * len(shards), pa.int64()), "body": pa.array(bodies, pa.binary())})


def _slices(shard_of: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(shard, its places) of ascending shard numbers."""
    edge = np.flatnonzero(np.diff(shard_of, prepend=shard_of[:1] + 1 if len(shard_of) else 0))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(shard_of)]):
        yield int(shard_of[a]), slice(a, b)


def _answers(table: pa.Table, sizes: list[int]) -> list[np.ndarray]:
    """The answers to ``sizes`` many requests: bits in the order of shards."""
    if not sum(sizes):
        return [np.zeros(0, bool) for _ in sizes]
    order = np.argsort(table.column("shard").to_numpy())
    bodies, counts = table.column("body").to_pylist(), table.column("n").to_numpy()
    bits = np.concatenate([np.unpackbits(np.frombuffer(bodies[i], np.uint8), count=int(counts[i])) for i in order]).astype(bool)
    if len(bits) != sum(sizes):
        raise ValueError(f"{sum(sizes)} requests have {len(bits)} answers")
    return np.split(bits, np.cumsum(sizes)[:-1])


def merged_sketches(shards: DataFrame, cells: int) -> DataFrame:
    """Adds up the partition sketches (shard, block, body: cells in the shard) with counters that stop at two, and
    answers for each block which of its cells are counted more than once."""

    def run(table: pa.Table) -> pa.Table:
        asked = [np.frombuffer(b, np.uint32) for b in table.column("body").to_pylist()]
        counters = np.zeros(cells, np.uint8)
        for x in asked:
            at = x & ~MANY
            counters[at] = np.minimum(counters[at] + np.where(x >= MANY, 2, 1), 2)
        return _answer(table, [counters[x & ~MANY] > 1 for x in asked])

    return shards.groupBy("shard").applyInArrow(run, "shard long, block long, n long, body binary")


def exact_groups(shards: DataFrame) -> DataFrame:
    """Groups the windows (shard, block, body: high words, then low words with a mark) by both hashes, and answers for each block
    which are in two blocks, or twice in one."""

    def run(table: pa.Table) -> pa.Table:
        bodies = [np.frombuffer(b, np.uint32) for b in table.column("body").to_pylist()]
        n = [len(b) // 3 for b in bodies]
        high = np.concatenate([b[: 2 * k].view(np.uint64) for b, k in zip(bodies, n)])
        low = np.concatenate([b[2 * k :] for b, k in zip(bodies, n)])
        many, low = low >= MANY, low & ~MANY
        order = np.lexsort((low, high))
        head = np.ones(len(order), bool)
        head[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
        group = np.cumsum(head) - 1
        weight = np.bincount(group, 1.0 + many[order])
        repeated = np.empty(len(order), bool)
        repeated[order] = weight[group] > 1
        return _answer(table, np.split(repeated, np.cumsum(n)[:-1]))

    return shards.groupBy("shard").applyInArrow(run, "shard long, block long, n long, body binary")


def _answer(table: pa.Table, bits: list[np.ndarray]) -> pa.Table:
    out = table.select(["shard", "block"])
    out = out.append_column("n", pa.array([len(b) for b in bits], pa.int64()))
    return out.append_column("body", pa.array([np.packbits(b).tobytes() for b in bits], pa.binary()))


def bucketed(df: DataFrame, sizes: Sizes) -> DataFrame:
    """Rows (id, text) with a random ``block``, as a table in the workspace that is bucketed by it."""
    spark = df.sparkSession
    rows = df.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(sizes.blocks)))
    name = f"tabulon_blocks_{uuid.uuid4().hex}"
    _tables.append((spark, name))
    rows.repartition(sizes.buckets, "block").write.format("parquet").bucketBy(sizes.buckets, "block").option("path", new_path(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Rows (id, n_words, removed as an array of (start, length) in words, text): each document
    without the words of its windows that also start elsewhere; kept words are joined by one space."""
    if size < 1:
        raise ValueError("a window has one word at least")
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    sizes = Sizes(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = bucketed(docs, sizes)
    bits, shard_bits = sizes.cell_bits, sizes.shard_bits
    cells = 1 << (bits - shard_bits)

    def send_sketch(table: pa.Table) -> pa.Table:
        shards, bodies = [], []
        for row, (touched, many) in enumerate(sketch(Block(table.column("text"), size).anchors, bits)):
            shard_of = (touched >> np.uint64(bits - shard_bits)).astype(np.int64) + (row << shard_bits)
            body = (touched & np.uint64(cells - 1)).astype(np.uint32) | np.where(many, MANY, np.uint32(0))
            for shard, own in _slices(shard_of):
                shards.append(shard)
                bodies.append(body[own].tobytes())
        give_back()
        return _rows(shards, table.column("block")[0].as_py(), bodies)

    sent = docs.groupBy("block").applyInArrow(send_sketch, "shard long, block long, body binary")
    counted = materialize(merged_sketches(sent, cells).withColumn("step", F.lit(1)), "counted")

    def estimated(block: Block, answers: pa.Table) -> np.ndarray:
        found = sketch(block.anchors, bits)
        return block.estimated(_answers(answers, [len(c) for c, _ in found]), bits)

    def send_windows(docs: pa.Table, answers: pa.Table) -> pa.Table:
        shards, bodies = [], []
        if docs.num_rows:
            block = Block(docs.column("text"), size)
            _, high, low, many, _ = block.windows(estimated(block, answers))
            low = low | np.where(many, MANY, np.uint32(0))
            for shard, own in _slices((high >> np.uint64(64 - sizes.window_bits)).astype(np.int64)):
                shards.append(shard)
                bodies.append(high[own].tobytes() + low[own].tobytes())
        give_back()
        return _rows(shards, docs.column("block")[0].as_py() if docs.num_rows else 0, bodies)

    sent = docs.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(send_windows, "shard long, block long, body binary")
    grouped = materialize(exact_groups(sent).withColumn("step", F.lit(2)), "grouped")
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def keep(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"id": docs.column("id"), "n_words": pa.array([], pa.int64()), "removed": pa.array([], span), "text": pa.array([], pa.string())})
        block = Block(docs.column("text"), size)
        step = answers.column("step").to_numpy()
        starts, high, _, _, which = block.windows(estimated(block, answers.filter(pa.array(step == 1))))
        repeated = _answers(answers.filter(pa.array(step == 2)), [len(high)])[0][which]
        n_words, removed, kept, done = [], [], [], 0
        for (run, _, counts, _), at in zip(block.runs, starts, strict=True):
            at, done = at[repeated[done : done + len(at)]], done + len(at)
            for text, spans in zip(run, spans_of(at, counts, size), strict=True):
                words = text.split()
                n_words.append(len(words))
                removed.append([{"start": a, "length": b - a} for a, b in spans])
                for a, b in reversed(spans):
                    del words[a:b]
                kept.append(b" ".join(words).decode())
        give_back()
        return pa.table({"id": docs.column("id"), "n_words": pa.array(n_words, pa.int64()), "removed": pa.array(removed, span), "text": pa.array(kept, pa.string())})

    answers = counted.unionByName(grouped)
    out = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(keep, f"id {kind}, n_words long, removed array<struct<start:long,length:long>>, text string")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("text", text_col)


def spans_of(starts: np.ndarray, counts: np.ndarray, size: int) -> list[list[tuple[int, int]]]:
    """For each text (start, end) in its words of what the windows from ``starts`` on cover."""
    out: list[list[tuple[int, int]]] = [[] for _ in counts]
    if len(starts):
        ends = np.cumsum(counts)
        text = np.searchsorted(ends, starts, "right")
        head = np.ones(len(starts), bool)
        head[1:] = (np.diff(starts) > size) | (np.diff(text) != 0)
        first = np.flatnonzero(head)
        last = np.concatenate((first[1:], [len(starts)])) - 1
        base = (ends - counts)[text[first]]
        for t, a, b in zip(text[first].tolist(), (starts[first] - base).tolist(), (starts[last] - base + size).tolist(), strict=True):
            out[t].append((a, b))
    return out


def op12_count_min_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return kept.select("doc_id", "n_words", lost.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
