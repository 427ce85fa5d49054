"""Jaccard join of shingle sets with a count-vector R-tree.

Shingle hashes fall into groups by their leading bits; the counts of a document's
shingles in the groups are its point. Two sets cannot share more than the sum of their
points' coordinate minima. An R-tree over the points bounds whole boxes of documents by
their greatest coordinates, so that most pairs are never looked at; pairs that survive
box and point bounds are verified on their hash sets.

A tree must lie in one task's memory, so that blocks of documents come first, by exact
arguments on the same hashes. A set that links has all but ``100 - percent`` in a hundred of
its shingles in other sets. In a part of the hash range, twice as large, every shingle is
looked up: sets with more shingles of their own than that are alone, and go no further.
Shingles that a run of texts has twice are counted there and sent on once, so that very
frequent ones do not gather in a task.

The sets left are told apart by groups. In sets of a band of sizes, linked sets differ in at most
``k`` shingles; of ``k + 1 + 2 * d`` groups at least ``1 + 2 * d`` are then equal in both.
Each document leaves out its ``d`` smallest groups, which say least; one equal group at
least is left in both. Documents that share one are joined to coarse blocks; a block
beyond ``BLOCK`` documents is cut at random. Each part is one task with a tree, joined with
itself and with a few documents of the whole block, so that most of a large group is one
component already. If that has half of the block, only documents outside it meet the
parts of all others then, else each part meets each other, each pair of parts in one task
with two trees. Within a task, pairs that links already join are skipped: the result is
components, and no component is lost. Equal sets are one class from the start and never compared.

Work grows with the square only in blocks of many thousand different texts that share
most of their text without being linked; each task stays bounded.

Defined results: words are ASCII lower-cased; a text of fewer words than a shingle is one
shingle; null or empty text has no shingle, is linked with nothing and is its own component;
ids are of any type that has an order, and may be null (a component's id is its least non-null id); repeated rows are linked
with each other; an empty table gives an empty result; columns other than id and text are
only carried by ``keep_one``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, materialize
from .components import components
from .shingles import mix, shingle_sets

SHINGLE, PERCENT = 4, 85
#: Linked sets may differ in so many times as many shingles as groups are left out.
LEFT_OUT = 8
#: So many tasks of candidates are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Documents, and shingles, of a part of a block.
BLOCK, BLOCK_SHINGLES = 4000, 2_500_000
LEAF = 16
#: Texts are hashed so many bytes at a time; hashes and signatures leave a task in runs of so many.
BYTES, RUN = 1_000_000, 600_000
#: Hashes that are looked up come to a task so many at once, and are compared in so many ranges.
SHARD, RANGES = 6_000_000, 8
#: A block of several parts has about so many documents that each part compares with.
PIVOTS = 16


def bands(limit: int = 1 << 40) -> np.ndarray:
    """Least set size of each band; bands grow by half."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, np.int64)


LEAST = bands()


def differing(size: int, percent: int) -> int:
    """The most shingles in which two linked sets of at most ``size`` differ."""
    return (100 - percent) * 2 * size // (100 + percent)


def overlap(a, b, percent: int):
    """The least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def texts_of(column: pa.Array, size: int = BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, UTF-8 texts) of runs of rows with about ``size`` bytes; null is empty."""
    at, out, n = 0, [], 0
    for start in range(0, len(column), 64):  # few copies of texts at a time
        for i, t in enumerate(column.slice(start, 64).cast(pa.large_binary()).to_pylist(), start):
            out.append(t or b"")
            n += len(out[-1])
            if n >= size:
                yield at, out
                at, out, n = i + 1, [], 0
    if out:
        yield at, out


def schemes_of(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Band of each set size (from 1), and the next band where the set may link into it, else -1."""
    own = np.searchsorted(LEAST, n, "right") - 1
    return own, np.where(100 * n >= percent * LEAST[own + 1], own + 1, -1)


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit digest of each set as two uint64 columns."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            out[i, 0] = np.add.reduce(mix(s))
            out[i, 1] = np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
    sizes = np.fromiter(map(len, sets), np.uint64, len(sets))
    return np.stack([mix(out[:, 0] + sizes), mix(out[:, 1] + sizes)], 1)


def node(keys: np.ndarray, scheme: np.ndarray) -> np.ndarray:
    return mix(keys[:, 0] ^ mix(scheme.astype(np.uint64) + np.uint64(77))).view(np.int64)


def hex_keys(keys: np.ndarray) -> list[str]:
    return ["%016x%016x" % (a, b) for a, b in keys.tolist()]


def signatures(sets: list[np.ndarray], scheme: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number) of each group that may be equal in a linked set."""
    pick = [i for i, s in enumerate(sets) if len(s) and scheme[i] >= 0]
    if not pick:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pick = np.array(pick)
    k = np.array([differing(int(LEAST[j + 1]) - 1, percent) for j in scheme[pick].tolist()])
    pick, k = pick[k > 0], k[k > 0]  # sets that may not differ at all are one class already
    if not len(pick):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    d = np.maximum(1, k // LEFT_OUT)
    m = k + 1 + 2 * d
    sizes = np.array([len(sets[i]) for i in pick.tolist()])
    h = np.concatenate([sets[i] for i in pick.tolist()])
    who = np.repeat(np.arange(len(pick)), sizes)
    group = ((h >> np.uint64(32)) * m.astype(np.uint64)[who]) >> np.uint64(32)  # ascends in each set
    first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (who[1:] != who[:-1]))))
    total = np.add.reduceat(mix(h), first)
    owner, g, weight = who[first], group[first], np.diff(np.append(first, len(h)))
    salt = mix(scheme[pick].astype(np.uint64) + np.uint64(1))
    sig = mix(total ^ mix(salt[owner] + g))
    # the smallest groups go, empty ones first
    bare = m - np.bincount(owner, minlength=len(pick))
    order = np.lexsort((g, weight, owner))
    count = np.bincount(owner, minlength=len(pick))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
    stay = place >= (d - bare)[owner]
    more_sig, more_owner = [], []
    for i in np.flatnonzero(bare > d).tolist():
        empty = np.setdiff1d(np.arange(int(m[i])), g[owner == i].astype(np.int64))[int(d[i]) :].astype(np.uint64)
        more_sig.append(mix(mix(salt[i] + empty) ^ np.uint64(0xABCDEF)))
        more_owner.append(np.full(len(empty), i))
    return np.concatenate([sig[stay], *more_sig]), pick[np.concatenate([owner[stay], *more_owner]).astype(np.int64)]


def stars(sig: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by (sig, a): mask of the first of each signature, first a of each row's, mask of new a."""
    if not len(sig):
        return np.zeros(0, bool), a, np.zeros(0, bool)
    start = np.concatenate(([True], sig[1:] != sig[:-1]))
    first = a[np.maximum.accumulate(np.where(start, np.arange(len(sig)), 0))]
    new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (a[1:] != a[:-1]))) & (a != first)
    return start, first, new


ROWS = "sig long, a long, b long"


def _rows(sig, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(a), pa.array(b)], names=["sig", "a", "b"])


def pairs_of(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got = np.unique(np.stack([x, y], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    return got[:, 0], got[:, 1]


class Tree:
    """R-tree over count vectors, packed from the top by the coordinate that varies most."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rows: np.ndarray | None = None):
        rows = np.arange(len(points)) if rows is None else rows
        self.rows, self.high = rows, points[rows].max(0)
        self.least, self.most = int(sizes[rows].min()), int(sizes[rows].max())
        self.children: list[Tree] = []
        if len(rows) > LEAF:
            axis = int(np.argmax(points[rows].var(0)))
            order = rows[np.argsort(points[rows, axis], kind="stable")]
            half = len(order) // 2
            self.children = [Tree(points, sizes, order[:half]), Tree(points, sizes, order[half:])]

    def may_link(self, other: Tree, percent: int) -> bool:
        if 100 * self.most < percent * other.least or 100 * other.most < percent * self.least:
            return False
        return int(np.minimum(self.high, other.high).sum()) >= overlap(self.least, other.least, percent)


def join(a: Tree, b: Tree, percent: int) -> Iterator[tuple[Tree, Tree]]:
    """Pairs of leaves that may hold linked points; of a tree with itself, each once."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        if not x.may_link(y, percent):
            continue
        if x is y and x.children:
            p, q = x.children
            todo += [(p, p), (p, q), (q, q)]
        elif x.children and (not y.children or len(x.rows) >= len(y.rows)):
            todo += [(c, y) for c in x.children]
        elif y.children:
            todo += [(x, c) for c in y.children]
        else:
            yield x, y


def stars_of(pairs: list[tuple[int, int]], rank: list) -> list[tuple[int, int]]:
    """(member, first member by rank) of each component of the pairs."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = sorted((root(i), root(j)), key=rank.__getitem__)
        parent[b] = a
    return [(i, root(i)) for i in list(parent) if root(i) != i]


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span the components of the sets. ``side``: 0 (or less) and 1 for two parts,
    of which only pairs across count, or no 1: pairs within."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    bits = int(np.clip(np.ceil(np.log2(max(1.0, float(np.median(sizes)) / 8))), 4, 10))
    points = np.zeros((len(sets), 1 << bits), np.int32)
    for i, s in enumerate(sets):
        points[i] = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    left = Tree(points, sizes, np.flatnonzero(side <= 0))
    right = Tree(points, sizes, np.flatnonzero(side == 1)) if (side == 1).any() else left
    for x, y in join(left, right, percent):
        p, q = points[x.rows], points[y.rows]
        bound = np.minimum(p[:, None, :], q[None, :, :]).sum(2)
        for i, j in zip(*np.nonzero(bound >= overlap(sizes[x.rows][:, None], sizes[y.rows][None, :], percent)), strict=True):
            u, v = int(x.rows[i]), int(y.rows[j])
            if u == v or (ru := root(u)) == (rv := root(v)):
                continue
            s, t = (sets[u], sets[v]) if len(sets[u]) <= len(sets[v]) else (sets[v], sets[u])
            if 100 * len(s) < percent * len(t):
                continue
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            both = int(np.count_nonzero(t[at] == s))
            if (100 + percent) * both >= percent * (len(s) + len(t)):
                parent[max(ru, rv)] = min(ru, rv)
                out.append((u, v))
    return out


def looked_up(percent: int) -> np.uint64:
    """Hashes below this are looked up: of twice as many shingles as a linked set may have of its own."""
    return np.uint64(min(2**64 - 1, 2**64 * 2 * (100 - percent) // 100))


def tags_of(keys: np.ndarray) -> np.ndarray:
    """A number that stands for a set's key; 0 stands for no set."""
    tags = keys[:, 0].view(np.int64)
    return np.where(tags == 0, 1, tags)


def classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, th, jk, n, s, tag, key, nodes) of each row of docs (id, th, jk, text); ``s`` is
    the number of hashes that are looked up."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["id", "th", "jk", "n", "s", "tag", "key", "nodes"]
    below = looked_up(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in texts_of(batch.column(3)):
                sets = shingle_sets(texts, size)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                low = np.fromiter((np.searchsorted(s, below) for s in sets), np.int64, len(sets))
                keys = set_keys(sets)
                own, nxt = schemes_of(np.maximum(n, 1), percent)
                first, second = node(keys, own), node(keys, nxt)
                nodes = [[] if not c else [f] if s < 0 else [f, g] for c, f, g, s in zip(n.tolist(), first.tolist(), second.tolist(), nxt.tolist(), strict=True)]
                given = [batch.column(i).slice(at, len(sets)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*given, pa.array(n), pa.array(low), pa.array(tags_of(keys)), pa.array(hex_keys(keys), pa.string()), pa.array(nodes, pa.list_(pa.int64()))], names=names)

    return in_batches(docs.select("id", "th", "jk", "text"), run, f"id {kind}, th long, jk long, n long, s long, tag long, key string, nodes array<long>")


def requests(tags: np.ndarray, sets: list[np.ndarray], shards: int, below: np.uint64) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(shard, low halves of hashes, tags, hashes of each tag) of a run of sets, of hashes that
    are looked up. Hashes that
    two sets of the run have go to their shard once, with tag 0, and are counted for
    these sets in the row of shard -1, whose hashes are empty."""
    tags, first = np.unique(tags, return_index=True)
    parts = [sets[i] for i in first.tolist()]
    h = np.concatenate([np.zeros(0, np.uint64), *parts])
    owner = np.repeat(np.arange(len(tags)), np.fromiter(map(len, parts), np.int64, len(parts)))
    if not len(h):
        return
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    times = np.diff(np.append(start, len(h)))
    count = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(tags))
    some = np.flatnonzero(count)
    if len(some):
        yield -1, b"", tags[some].tobytes(), count[some].astype(np.uint32).tobytes()
    h, owner = h[start], np.where(times > 1, len(tags), owner[start])
    shard = ((h >> np.uint64(32)) * np.uint64(shards) // ((below >> np.uint64(32)) + np.uint64(1))).astype(np.int64)  # ascends
    place = shard * (len(tags) + 1) + owner
    order = np.argsort(place, kind="stable")
    place, low = place[order], (h[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    of, who = np.divmod(place[start], len(tags) + 1)
    times = np.diff(np.append(start, len(place))).astype(np.uint32)
    named = np.append(tags, 0)[who]
    cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        end = start[j] if j < len(start) else len(low)
        yield int(of[i]), low[start[i] : end].tobytes(), named[i:j].tobytes(), times[i:j].tobytes()


def answers(rows: list[tuple]) -> Iterator[tuple[int, bytes, bytes]]:
    """(run, tags, counts) for the requests (run, hashes, tags, times) to one shard: how many
    hashes of each tag another set has. A set that is in several runs is told in one."""
    step = -(-(1 << 32) // RANGES)
    for low in range(0, 1 << 32, step):  # a range at a time needs so much less memory
        parts = []
        for i, r in enumerate(rows):
            h = np.frombuffer(r[1], np.uint32)
            at = np.flatnonzero((h >= low) & (h < low + step))
            ends = np.cumsum(np.frombuffer(r[3], np.uint32))
            parts.append((h[at], np.frombuffer(r[2], np.int64)[np.searchsorted(ends, at, "right")], np.full(len(at), i, np.int32)))
        yield from _answers(rows, *(np.concatenate(x) for x in zip(*parts, strict=True)))


def _answers(rows: list[tuple], h: np.ndarray, tag: np.ndarray, run: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    if not len(h):
        return
    order = np.lexsort((tag, h))
    h, tag, run = h[order], tag[order], run[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (tag[1:] != tag[:-1])))
    h, tag, run = h[new], tag[new], run[new]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    times = np.diff(np.append(start, len(h)))
    told = np.repeat(times > 1, times) & (tag != 0)
    tag, run = tag[told], run[told]
    order = np.lexsort((tag, run))
    tag, run = tag[order], run[order]
    start = np.flatnonzero(np.concatenate((np.full(min(1, len(tag)), True), (tag[1:] != tag[:-1]) | (run[1:] != run[:-1]))))
    counts, tag, run = np.diff(np.append(start, len(tag))).astype(np.uint32), tag[start], run[start]
    cuts = np.searchsorted(run, np.arange(len(rows) + 1))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        yield rows[i][0], tag[cuts[i] : cuts[i + 1]].tobytes(), counts[cuts[i] : cuts[i + 1]].tobytes()


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])


def shared(docs: DataFrame, size: int, percent: int, shards: int) -> DataFrame:
    """(tag, c): of the hashes of each set that are looked up, how many another set has, at
    least; sets without one have no row. Requests go from runs of texts to shards of the
    hash range, answers back to runs, both packed; what comes out grows with the sets."""
    asking = [("shard", pa.int32()), ("run", pa.int64()), ("h", pa.binary()), ("tags", pa.binary()), ("times", pa.binary())]
    telling = [("run", pa.int64()), ("tags", pa.binary()), ("times", pa.binary())]
    below = looked_up(percent)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[np.ndarray]]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            if held:
                tags = np.concatenate([t for t, _ in held])
                run = int(mix(np.add.reduce(mix(tags.view(np.uint64)), keepdims=True)).view(np.int64)[0])
                rows = requests(tags, [s for _, x in held for s in x], shards, below)
                yield _batch([(shard, run, *row) for shard, *row in rows], asking)
            held.clear()
            count = 0

        for batch in batches:
            for _, texts in texts_of(batch.column(0)):
                sets = shingle_sets(texts, size)
                held.append((tags_of(set_keys(sets)), [s[: np.searchsorted(s, below)] for s in sets]))
                count += sum(map(len, held[-1][1]))
                if count >= RUN:
                    yield from flush()
        yield from flush()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard == -1:  # what a run has found itself
                    yield _batch([(row[0], row[2], row[3])], telling)
                    continue
                if shard != at and rows:
                    yield _batch(list(answers(rows)), telling)
                    rows = []
                at = shard
                rows.append(row)
        if rows:
            yield _batch(list(answers(rows)), telling)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def sums() -> pa.RecordBatch:
            tag, of = np.unique(np.concatenate([np.frombuffer(t, np.int64) for t, _ in rows]), return_inverse=True)
            c = np.bincount(of, np.concatenate([np.frombuffer(n, np.uint32) for _, n in rows]), len(tag))
            return pa.RecordBatch.from_arrays([pa.array(tag), pa.array(c.astype(np.int64))], names=["tag", "c"])

        for batch in batches:
            for run, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if run != at and rows:
                    yield sums()
                    rows = []
                at = run
                rows.append(row)
        if rows:
            yield sums()

    asked = in_batches(docs.select("text"), ask, "shard int, run long, h binary, tags binary, times binary")
    # rows of shard -1 only pass through: they are dealt by their run
    asked = asked.repartition(F.when(F.col("shard") < 0, F.col("run")).otherwise(F.col("shard").cast("long"))).sortWithinPartitions("shard")
    told = in_batches(asked, answer, "run long, tags binary, times binary").repartition("run").sortWithinPartitions("run")
    return in_batches(told, add, "tag long, c long").groupBy("tag").agg(F.sum("c").alias("c"))


def coarse(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) between nodes that share a signature: each to the first node of it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            if held:
                sig = np.concatenate([x[0] for x in held]).view(np.int64)
                a = np.concatenate([x[1] for x in held])
                order = np.lexsort((a, sig))
                sig, a = sig[order], a[order]
                start, first, new = stars(sig, a)
                yield _rows(sig[start], a[start], a[start])
                x, y = pairs_of(first[new], a[new])
                yield _rows(mix((x ^ (y << 1)).view(np.uint64)).view(np.int64), x, y)
            held.clear()
            count = 0

        for batch in batches:
            for _, texts in texts_of(batch.column(0)):
                sets = shingle_sets(texts, size)
                keys = set_keys(sets)
                for scheme in schemes_of(np.maximum(np.fromiter(map(len, sets), np.int64, len(sets)), 1), percent):
                    sig, who = signatures(sets, scheme, percent)
                    held.append((sig, node(keys, scheme)[who]))
                    count += len(sig)
                if count >= RUN:
                    yield from flush()
        yield from flush()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_sig = last_a = None
        for batch in batches:
            sig, a, b = (batch.column(i).to_numpy() for i in range(3))
            done = a != b
            x, y = a[done], b[done]
            sig, a = sig[~done], a[~done]
            if len(sig):
                if last_sig is not None:
                    sig, a = np.concatenate(([last_sig], sig)), np.concatenate(([last_a], a))
                start, first, new = stars(sig, a)
                x, y = np.concatenate([x, first[new]]), np.concatenate([y, a[new]])
                last_sig, last_a = sig[-1], first[-1]
            x, y = pairs_of(x, y)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    rows = in_batches(docs.select("text"), emit, ROWS)
    return in_batches(rows.repartition("sig").sortWithinPartitions("sig"), chain, "a long, b long")


def _parts(docs: DataFrame) -> DataFrame:
    """(block, c, parts) of docs (block, n)."""
    sums = docs.groupBy("block").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    parts = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES))
    return sums.select("block", "c", F.least(parts, F.col("c")).cast("int").alias("parts"))


def _part(parts: str) -> Column:
    return F.pmod(F.xxhash64("key"), F.col(parts)).cast("int")


def _upto(n: str) -> Column:
    return F.sequence(F.lit(0), F.col(n) - 1)


def fine(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between the keys of members (block, key, jk, n) that span the components."""
    sums = materialize(_parts(members).where("c > 1"), "jaccard-blocks")
    placed = members.join(sums, "block").select("block", "c", "parts", "key", "jk", "n", _part("parts").alias("part"))
    placed = materialize(placed, "jaccard-members")
    pivot = (F.col("parts") > 1) & (F.pmod(F.xxhash64("key", F.lit(1)), F.col("c")) < PIVOTS)
    where = F.when(pivot, _upto("parts")).otherwise(F.array("part"))
    tasks = placed.select("jk", "key", "block", F.when(pivot, -1).otherwise(0).alias("side"), F.explode(where).alias("x"))
    tasks = tasks.select("jk", "key", F.struct("block", "x", F.col("x").alias("y"), "side").alias("t"))
    links = materialize(meet(docs, tasks, size, percent), "jaccard-links")
    if not sums.where("parts > 1").limit(1).count():
        return links
    # what a task has joined is named by a document of the whole block, if there is one in it
    labels = links.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("component"))
    large = placed.where("parts > 1").join(labels, "key", "left").withColumn("component", F.coalesce("component", "key"))
    large = materialize(large.select("block", "c", "parts", "part", "key", "jk", "n", "component"), "jaccard-large")
    most = large.groupBy("block", "component").agg(F.count("*").alias("m")).groupBy("block").agg(F.max(F.struct("m", "component")).alias("m")).select("block", F.col("m.component").alias("main"), F.col("m.m").alias("m"))
    large = large.join(materialize(most, "jaccard-main"), "block").withColumn("inner", F.col("component") == F.col("main"))
    large = materialize(large.withColumn("most", 2 * F.col("m") >= F.col("c")).select("block", "parts", "part", "key", "jk", "n", "inner", "most"), "jaccard-sides")
    others = F.filter(_upto("parts"), lambda i: i != F.col("part"))
    pairs = large.where("not most").select("jk", "key", "block", F.col("part").alias("own"), F.explode(others).alias("other"))
    inner = _parts(large.where("most and inner")).select("block", F.col("parts").alias("p"))
    outer = _parts(large.where("most and not inner")).select("block", F.col("parts").alias("q"))
    cut = large.select("block", "key", "jk", "inner").join(materialize(inner.join(outer, "block"), "jaccard-cut"), "block")
    # parts of the largest component are 0 to p - 1, those of the others p to p + q - 1
    own = F.when(F.col("inner"), _part("p")).otherwise(F.col("p") + _part("q"))
    other = F.when(F.col("inner"), F.sequence(F.col("p"), F.col("p") + F.col("q") - 1)).otherwise(F.sequence(F.lit(0), F.col("p") + F.col("q") - 1))
    pairs = pairs.unionByName(cut.select("jk", "key", "block", own.alias("own"), F.explode(other).alias("other")))
    # where a part meets another, sides differ
    task = F.struct("block", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return links.unionByName(meet(docs, pairs.select("jk", "key", task.alias("t")), size, percent))


def meet(docs: DataFrame, tasks: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of the keys that rows (jk, key, t) of ``tasks`` bring together: each linked key and
    the first of its component in the task, those of side -1 before others."""
    tasks = materialize(tasks.groupBy("jk", "key").agg(F.collect_list("t").alias("tasks")), "jaccard-tasks")
    fetched = docs.select("jk", "text").join(tasks, "jk").select("text", "key", "tasks")
    names = ["block", "x", "y", "side", "key", "hashes"]

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
        for batch in batches:
            for at, texts in texts_of(batch.column(0)):
                sets = shingle_sets(texts, size)
                wanted, places = (batch.column(i).slice(at, len(texts)).to_pylist() for i in (1, 2))
                out = [(t["block"], t["x"], t["y"], t["side"], k, s.tobytes()) for s, own, k, ts in zip(sets, hex_keys(set_keys(sets)), wanted, places, strict=True) if own == k for t in ts]
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    tasks = in_batches(fetched, sets_of, "block long, x int, y int, side int, key string, hashes binary")
    tasks = tasks.repartition("block", "x", "y").sortWithinPartitions("block", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, {}

        def links() -> pa.RecordBatch:
            keys = list(rows)
            got = linked([rows[k][1] for k in keys], np.array([rows[k][0] for k in keys]), percent) if len(keys) > 1 and any(rows[k][0] <= 0 for k in keys) else []
            got = stars_of(got, [(rows[k][0], k) for k in keys])
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in got], pa.string()), pa.array([keys[j] for _, j in got], pa.string())], names=["a", "b"])

        for batch in batches:
            for block, x, y, side, key, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, x, y) != task:
                    if rows:
                        yield links()
                    task, rows = (block, x, y), {}
                rows[key] = (side, np.frombuffer(hashes, np.uint64))
        if rows:
            yield links()

    return in_batches(tasks, run, "a string, b string")


def _classes(df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, n, key) of df, and (key, first) of each set: the least row (``absent``
    id, id, hash of text) of its component."""
    if percent < 75:
        raise ValueError("linked sets must differ by less than the step between bands: percent is 75 at least")
    text = F.col(f"`{text_col}`")
    own = F.col(f"`{id_col}`")
    whole = df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    # rows are found again by their id, and those with a null or an id of another type by a hash of id and text
    found_by = F.coalesce(own.cast("long"), F.xxhash64(text)) if whole else F.xxhash64(own, text)
    docs = df.select(own.alias("id"), F.xxhash64(text).alias("th"), found_by.alias("jk"), text.alias("text"))
    rows = materialize(classes(docs, size, percent), "jaccard-rows")
    least = F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "th")).alias("first")
    kinds = rows.where("n > 0").groupBy("key").agg(least, F.min("jk").alias("jk"), *[F.first(c).alias(c) for c in ("n", "s", "tag", "nodes")])
    kinds = materialize(kinds, "jaccard-classes")
    hashes = kinds.agg(F.sum("s")).first()[0] or 0
    found = materialize(shared(docs, size, percent, max(1, -(-hashes // SHARD))), "jaccard-shared")
    alone = F.col("s") - F.coalesce(F.col("c"), F.lit(0))
    alive = kinds.join(found, "tag", "left").where(alone <= F.floor((100 - percent) * F.col("n") / 100)).select("key", "jk", "n", "nodes")
    alive = materialize(alive, "jaccard-alive")
    # of texts that may link, one of each set is read from here on; where these are few, no text is shuffled
    wanted = alive.select("jk").distinct()
    few = alive.count() <= BROADCAST_ROWS
    near = materialize(docs.select("jk", "text").join(F.broadcast(wanted) if few else wanted, "jk"), "jaccard-near")
    blocks = components(coarse(near, size, percent), "jaccard-coarse")
    members = alive.select("key", "jk", "n", F.explode("nodes").alias("node")).join(blocks, "node").select(F.col("component").alias("block"), "key", "jk", "n")
    labels = components(fine(near, members, size, percent), "jaccard-fine")
    # sets in no link are their own component, and need no further shuffle
    named = materialize(kinds.select("key", "first").join(labels.withColumnRenamed("node", "key"), "key", "left"), "jaccard-named")
    tied = named.where("component is not null")
    heads = materialize(tied.groupBy("component").agg(F.min("first").alias("first")), "jaccard-least")
    tied = tied.select("key", "component").join(heads, "component").select("key", "first")
    ids = materialize(tied.unionByName(named.where("component is null").select("key", "first")), "jaccard-ids")
    return rows, ids


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, class) of each row; ``class`` names its shingle set."""
    rows, ids = _classes(df, id_col, text_col, size, percent)
    out = rows.select("id", "n", "key").join(ids.select("key", "first.id").withColumnRenamed("id", "least"), "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"), F.col("key").alias("class"))


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of ``df`` of each component: that with the least id, of equal ids that with
    the least hash of its text, of equal rows any; null ids come last. Rows without a
    shingle all stay."""
    rows, ids = _classes(df, id_col, text_col, size, percent)
    held = rows.where("n > 0").groupBy("key", "id", "th").agg(F.count("*").alias("times"))
    first = F.struct(F.col("id").isNull().alias("absent"), "id", "th")
    held = held.join(ids, "key").select("id", "th", "times", first.eqNullSafe(F.col("first")).alias("stays"))
    # of each (id, text) that does not stay as it is: whether one row of it stays
    touched = materialize(held.where("not stays or times > 1").select("id", "th", "stays").distinct(), "jaccard-touched")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    carried = df.select(row, F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"))
    few = touched.count() <= BROADCAST_ROWS
    side = touched.select(F.col("id").alias("i"), F.col("th").alias("t"), "stays")
    met = carried.join(F.broadcast(side) if few else side, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left")
    kept = met.where("stays is null").select("row.*")
    repeated = touched.where("stays").limit(1).count() > 0
    if not repeated:
        return kept
    one = met.where("stays").groupBy("id", "th").agg(F.first("row").alias("row")).select("row.*")
    return kept.unionByName(one)


def op3_count_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")
