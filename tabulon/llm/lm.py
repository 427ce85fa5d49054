"""Language-model scoring with a small causal self-attention model, trained in numpy.

Words are cut into subword ids of a public vocabulary; the model predicts each next id.
Its inputs and outputs are ``SLOTS`` slots: each of the ``OWN`` most frequent ids has a slot
of its own, the rare others share the rest, of about equal weight, and have a share of
their slot's probability by their counts. A slot's probability is that of its group times
its own in the group; groups are ranges of about equally frequent slots. One attention layer
reads windows of ``WINDOW`` ids; the products of query and key weights and of value and output
weights are trained as one matrix each. Windows begin ``STRIDE`` ids apart, and each id is
scored once: its context is half a window of ids at least, or all there is.

Counts of words and ids cover all training documents. The model starts as the smoothed
counts of ids. Weights are averages of local training: documents are dealt to blocks of about
``BLOCK_BYTES`` by a hash of id and text; in each of ``ROUNDS`` rounds a trainer of each
block starts from the same weights, takes steps over its next share of the block's
training windows and returns its weights. All ids of all training documents pass the
trainers once. Held-out documents give neither counts nor windows.

A block is put in order by id and text, and sums of weights are taken in the order of
blocks, so that neither the order of rows nor the number of partitions changes a score.

Texts are shuffled and cut into ids once; trainers and scores read the written ids. A block
asks for the counts of its distinct words only; answers return to the block, so that no
table of all words is broadcast. To the driver go: two sums, the counts of ids (as
many as the vocabulary has) and at most ``FAN`` sums of weights.

Defined results: null or empty text is one end token; ties do not arise; repeated rows
count and are scored each (rows equal in id and text are in one block); an empty table
gives an empty result; null ids are hashed as the text "" and are in training or held out
with it; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, in_batches, materialize
from .jaccard import texts_of
from .shingles import word_hashes
from .tokenfiles import END, encoder

HELD_MODULUS, HELD = 7, 2
BLOCK_BYTES, RUN_BYTES = 12_000_000, 2_000_000
#: Text whose words' counts are added up in one task.
SHARD_BYTES = 48_000_000
WINDOW, STRIDE, WIDTH = 32, 16, 16
#: Slots of each group, the most frequent ids' first: small groups where most ids are.
SIZES = np.repeat([16, 32, 64, 144], 8)
GROUPS, SLOTS, SHARED = len(SIZES), int(SIZES.sum()), 64
OWN = SLOTS - SHARED
FIRST = np.cumsum(SIZES) - SIZES
GROUP_OF = np.repeat(np.arange(GROUPS, dtype=np.uint8), SIZES)
MEMBER_OF = np.arange(SLOTS) - FIRST[GROUP_OF]
ROUNDS, BATCH, RATE = 4, 384, 0.03
#: Windows that are scored at once; sums of weights that one task adds up.
SCORED, FAN = 1024, 32
#: Ids whose texts are scored in one go.
RUN_IDS = 800_000
#: Words whose ids a worker keeps.
CACHE = 1_000_000
#: The end's place among the hashes of words; no word has it.
END_HASH = np.uint64(2**64 - 1)


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % HELD_MODULUS == HELD for i in ids], bool)


class WordIds:
    """Subword ids of words by hash, in arrays; when there are too many, those that the last texts had stay."""

    def __init__(self, path: str | None):
        self.enc = encoder(path)
        self.sizes = np.fromiter((len(self.enc.decode_single_token_bytes(i)) for i in range(END)), np.int64, END)
        self.hash, self.at, self.len = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def get(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each of the ascending hashes' words, one after the other, and their number;
        the words lie in ``raw``."""
        found = np.minimum(np.searchsorted(self.hash, hashes), max(0, len(self.hash) - 1))
        new = np.flatnonzero(self.hash[found] != hashes) if len(self.hash) else np.arange(len(hashes))
        if len(new):
            ids, lens = self.encode([raw[a:b].lower() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])  # of bytes: A-Z only
            if len(self.hash) + len(new) > CACHE:
                keep = np.unique(found)[np.isin(self.hash[np.unique(found)], hashes)] if len(self.hash) else found[:0]
                self.ids, self.len = self.take(keep), self.len[keep]
                self.hash, self.at = self.hash[keep], np.cumsum(self.len) - self.len
            place = np.searchsorted(self.hash, hashes[new])
            self.hash = np.insert(self.hash, place, hashes[new])
            self.at = np.insert(self.at, place, len(self.ids) + np.cumsum(lens) - lens)
            self.len = np.insert(self.len, place, lens)
            self.ids = np.concatenate([self.ids, ids])
            found = np.searchsorted(self.hash, hashes)
        return self.take(found), self.len[found]

    def take(self, places: np.ndarray) -> np.ndarray:
        n = self.len[places]
        return self.ids[np.repeat(self.at[places] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, each after a blank. No id reaches over a blank, so that all are cut
        at once and told apart by their lengths; bytes that are no UTF-8 go one by one."""
        joined = b" " + b" ".join(words)
        try:
            ids = np.array(self.enc.encode_ordinary(joined.decode()), np.uint16)
            lens = np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w) + 1 for w in words]), "right"), prepend=0)
        except UnicodeDecodeError:
            each = [self.enc.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
            ids, lens = np.array([i for x in each for i in x], np.uint16), np.array(list(map(len, each)))
        return ids, lens


_words: dict[str | None, WordIds] = {}


def word_ids(path: str | None) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


class Batch:
    """The words of some texts: distinct words' hashes and subword ids, and where they are."""

    def __init__(self, texts: list[bytes], path: str | None):
        words, self.counts, (start, end, raw) = word_hashes(texts, places=True)
        self.distinct, first, inverse = np.unique(words, return_index=True, return_inverse=True)
        self.inverse = inverse.astype(np.int32)
        self.ids, self.lens = word_ids(path).get(self.distinct, start[first], end[first], raw)

    def stream(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by END, and the number of ids of each text."""
        lens = self.lens[self.inverse]
        total = np.concatenate(([0], np.cumsum(lens)))
        cut = np.concatenate(([0], np.cumsum(self.counts)))
        sizes = np.diff(total[cut]) + 1
        out = np.full(int(sizes.sum()), END, np.uint16)
        at = np.arange(total[-1])
        shift = np.repeat((np.cumsum(self.lens) - self.lens)[self.inverse] - total[:-1], lens)
        doc = np.repeat(np.arange(len(self.counts)), np.diff(total[cut]))
        out[at + doc] = self.ids[at + shift]
        return out, sizes


def windows_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the windows that cut texts, each closed by END, into WINDOW ids or fewer."""
    ends = np.flatnonzero(ids == END) + 1
    sizes = np.diff(ends, prepend=0)
    per = -(-sizes // WINDOW)
    k = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    left = np.repeat(ends - sizes, per) + k * WINDOW
    return left, np.minimum(WINDOW, np.repeat(ends, per) - left)


def in_order(table: pa.Table) -> pa.Table:
    """Rows (id, th, text) of a block by id and hash of text."""
    return table.sort_by([("id", "ascending"), ("th", "ascending")])


def runs_of(table: pa.Table) -> Iterator[tuple[int, list[bytes]]]:
    text = table.column("text").combine_chunks()
    return texts_of(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks), RUN_BYTES)


def parts(kind: str) -> str:
    return f"part string, blk int, shard int, h binary, n binary, sizes binary, id array<{kind}>"


def gather(table: pa.Table, shards: int, path: str | None) -> pa.Table:
    """Of one block, rows (part, blk, shard, h, n, sizes, id): its words' hashes and training counts by
    shard of the hash range; training counts of ids; ids of the training texts; ids of the held-out texts with,
    of all texts, the packed places of their words among the block's hashes, their numbers of words and
    their row ids. No later step reads the texts."""
    blk = table.column("blk")[0].as_py()
    table = in_order(table)
    held = held_out(table.column("id").to_pylist())
    hashes, counts, places, sizes, runs, apart = [], [], [], [], [], []
    n_ids = np.zeros(END + 1, np.int64)
    for at, texts in runs_of(table):
        b = Batch(texts, path)
        train = ~held[at : at + len(texts)]
        n = np.bincount(b.inverse, np.repeat(train, b.counts), len(b.distinct)).astype(np.int64)
        hashes.append(b.distinct)
        counts.append(n)
        n_ids += np.bincount(b.ids, np.repeat(n, b.lens), END + 1).astype(np.int64)
        places.append(b.inverse)
        sizes.append(b.counts)
        ids, lens = b.stream()
        keep = np.repeat(train, lens)
        runs.append(ids[keep])
        apart.append(ids[~keep])
    trained = int((~held).sum())
    n_ids[END] += trained
    h, inverse = np.unique(np.concatenate([*hashes, [END_HASH]]), return_inverse=True)
    n = np.bincount(inverse, np.concatenate([*counts, [trained]]), len(h)).astype(np.int64)
    cuts = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
    rows = [("words", blk, s, h[i:j].tobytes(), n[i:j].tobytes(), None, None) for s, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]
    seen = np.flatnonzero(n_ids)
    rows.append(("ids", blk, None, seen.tobytes(), n_ids[seen].tobytes(), None, None))
    at = np.cumsum([len(x) for x in hashes]) - [len(x) for x in hashes]
    places = np.concatenate([inverse[a : a + len(x)].astype(np.uint32)[p] for a, x, p in zip(at.tolist(), hashes, places, strict=True)])
    rows.append(("windows", blk, None, np.concatenate(runs).tobytes(), None, None, None))
    rows.append(("texts", blk, None, np.concatenate(apart).tobytes(), pa.compress(places.tobytes(), "zstd", asbytes=True), np.concatenate(sizes).astype(np.int64).tobytes(), table.column("id").to_pylist()))
    give_back()
    cols = zip(*rows, strict=True)
    types = {"part": pa.string(), "blk": pa.int32(), "shard": pa.int32(), "h": pa.binary(), "n": pa.binary(), "sizes": pa.binary(), "id": pa.list_(table.schema.field("id").type)}
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(types.items(), cols, strict=True)})


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def word_totals(gathered: DataFrame) -> DataFrame:
    """(blk, shard, c): counts over all blocks of each word that a block has, in the order of
    its hashes. A row of block -1 for each shard has two sums: of counts, and of words with one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def totals() -> pa.RecordBatch:
            h = np.concatenate([np.frombuffer(x, np.uint64) for _, x, _ in rows])
            n = np.concatenate([np.frombuffer(x, np.int64) for _, _, x in rows])
            order = np.argsort(h, kind="stable")
            first = np.concatenate(([True], h[order[1:]] != h[order[:-1]]))
            word = np.empty(len(h), np.int64)
            word[order] = np.cumsum(first) - 1
            c = np.bincount(word, n).astype(np.int64)
            ends = np.cumsum([len(x) // 8 for _, x, _ in rows])
            each = [x.tobytes() for x in np.split(c[word], ends[:-1])]
            stats = np.array([c.sum(), np.count_nonzero(c)], np.int64).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([-1, *(b for b, _, _ in rows)], pa.int32()), pa.array([at] * (len(rows) + 1), pa.int32()), pa.array([stats, *each], pa.binary())], names=["blk", "shard", "c"])

        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at and rows:
                    yield totals()
                    rows = []
                at = shard
                rows.append(row)
        if rows:
            yield totals()

    words = gathered.where("part = 'words'").select("shard", "blk", "h", "n")
    return in_batches(words.repartition("shard").sortWithinPartitions("shard"), run, "blk int, shard int, c binary")


def id_counts(gathered: DataFrame) -> np.ndarray:
    """Training counts of ids, added up where they are: one row for each task of at most END + 1 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(END + 1, np.int64)
        for batch in batches:
            for h, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n[np.frombuffer(h, np.int64)] += np.frombuffer(c, np.int64)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["i", "n"])

    got = gathered.where("part = 'ids'").select("h", "n").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(END + 1)
    counts[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return counts


class Vocabulary:
    """Slot of each id and its log share in the slot, from counts of ids."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.of = np.zeros(len(counts), np.int64)
        self.of[order[:OWN]] = np.arange(OWN)
        rest = order[OWN:]
        mass = np.cumsum(counts[rest] + 1.0)
        self.of[rest] = OWN + np.minimum((mass - 1e-9) / mass[-1] * SHARED, SHARED - 1).astype(np.int64)
        total = np.bincount(self.of, counts + 1.0, SLOTS)
        self.share = np.log(counts + 1.0) - np.log(np.maximum(total, 1e-9)[self.of])
        self.log_slot = np.log(np.maximum(total, 1e-9) / total.sum()).astype(np.float32)


SHAPES = {"E": (SLOTS, WIDTH), "P": (WINDOW, WIDTH), "M": (WIDTH, WIDTH), "N": (WIDTH, WIDTH), "U": (WIDTH, GROUPS), "b": (GROUPS,), "V": (WIDTH, SLOTS), "c": (SLOTS,)}


def start_weights(log_slot: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights whose outputs are the slots' probabilities, whatever the window."""
    rng = np.random.default_rng(seed)
    group = np.log(np.add.reduceat(np.exp(log_slot.astype(np.float64)), FIRST))
    scale = {"E": 0.3, "P": 0.1, "M": WIDTH**-1.0, "N": WIDTH**-0.5, "U": 0.0, "V": 0.0}
    parts = [group if k == "b" else log_slot - group[GROUP_OF] if k == "c" else rng.normal(0, 1, s) * scale[k] for k, s in SHAPES.items()]
    return np.concatenate([np.asarray(p, np.float32).ravel() for p in parts])


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = math.prod(s)
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def times(X: np.ndarray, M: np.ndarray) -> np.ndarray:
    """The last axis of X times M, in one product."""
    return (X.reshape(-1, X.shape[-1]) @ M).reshape(*X.shape[:-1], M.shape[1])


def attend(w: dict, x: np.ndarray, skip: int = 0) -> tuple:
    """Masked attention over windows of slots (N, L), for the places from ``skip`` on: inputs,
    queries, attention before division by its sums, the sums, mixed inputs, outputs."""
    n = x.shape[1]
    X = w["E"].take(x, axis=0)
    X += w["P"][:n]
    own = X[:, skip:]
    Q = times(own, w["M"])
    A = Q @ X.transpose(0, 2, 1)
    np.clip(A, -60, 60, out=A)
    np.exp(A, out=A)
    A *= _SEEN[skip:n, :n]
    s = times(A, np.ones((n, 1), A.dtype))
    Z = A @ X
    Z /= s
    return X, Q, A, s, Z, own + times(Z, w["N"])


def by_group(y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of targets by group, and (slots of the group, from, to) of each that occurs."""
    g = GROUP_OF[y]
    order = np.argsort(g, kind="stable")
    cuts = np.searchsorted(g[order], np.arange(GROUPS + 1)).tolist()
    return order, [(slice(FIRST[k], FIRST[k] + SIZES[k]), i, j) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if i < j]


def _log_softmax(H: np.ndarray, U: np.ndarray, b: np.ndarray, of: np.ndarray) -> np.ndarray:
    L = H @ U
    L += b
    if L.max() > 60:  # sums of exponentials would overflow
        L -= L.max(1, keepdims=True)
    got = L[np.arange(len(of)), of]
    return got - np.log(np.exp(L, out=L) @ np.ones(L.shape[1], L.dtype))


def log_prob(w: dict, H: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log probability of slot y after each output."""
    order, groups = by_group(y)
    H, y = H.take(order, axis=0), y.take(order)
    got = _log_softmax(H, w["U"], w["b"], GROUP_OF[y])
    for k, i, j in groups:
        got[i:j] += _log_softmax(H[i:j], w["V"][:, k], w["c"][k], MEMBER_OF[y[i:j]])
    out = np.empty(len(y), np.float64)
    out[order] = got
    return out


def gradient(flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gradient of the mean loss of target slots y (-1: none) after slots x, both (N, L)."""
    w = unpack(flat)
    X, Q, A, s, Z, out = attend(w, x)
    rows = np.flatnonzero(y.ravel() >= 0)
    targets = y.ravel()[rows]
    order, groups = by_group(targets)
    rows, targets = rows[order], targets[order]
    H = out.reshape(-1, WIDTH).take(rows, axis=0)
    weight = flat.dtype.type(1 / max(1, len(rows)))

    def softmax(L: np.ndarray, of: np.ndarray) -> np.ndarray:
        if L.max() > 60:
            L -= L.max(1, keepdims=True)
        np.exp(L, out=L)
        L *= (weight / (L @ np.ones(L.shape[1], L.dtype)))[:, None]
        L[np.arange(len(L)), of] -= weight
        return L

    g = {k: np.zeros(shape, flat.dtype) for k, shape in SHAPES.items() if k in "Vc"}
    ones = np.ones(len(rows), flat.dtype)
    D = softmax(H @ w["U"] + w["b"], GROUP_OF[targets])
    g["U"], g["b"] = H.T @ D, ones[: len(D)] @ D
    dH = D @ w["U"].T
    for k, i, j in groups:
        D = softmax(H[i:j] @ w["V"][:, k] + w["c"][k], MEMBER_OF[targets[i:j]])
        g["V"][:, k], g["c"][k] = H[i:j].T @ D, ones[: len(D)] @ D
        dH[i:j] += D @ w["V"][:, k].T
    dO = np.zeros((x.size, WIDTH), flat.dtype)
    dO[rows] = dH
    g["N"] = Z.reshape(-1, WIDTH).T @ dO
    dO = dO.reshape(X.shape)
    dZ = times(dO, w["N"].T)
    dZ /= s
    dX = A.transpose(0, 2, 1) @ dZ
    dX += dO
    dA = dZ @ X.transpose(0, 2, 1)
    dA -= times(dZ * Z, np.ones((WIDTH, 1), Z.dtype))
    dA *= A
    dQ = dA @ X
    dX += dA.transpose(0, 2, 1) @ Q
    dX += times(dQ, w["M"].T)
    g["M"] = X.reshape(-1, WIDTH).T @ dQ.reshape(-1, WIDTH)
    g["P"] = np.zeros(SHAPES["P"], flat.dtype)
    g["P"][: x.shape[1]] = dX.sum(0)
    g["E"] = np.zeros(SHAPES["E"], flat.dtype)
    slot = x.ravel().astype(np.uint16)
    order = np.argsort(slot, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], slot[order[1:]] != slot[order[:-1]])))
    g["E"][slot[order[first]]] = np.add.reduceat(dX.reshape(-1, WIDTH).take(order, axis=0), first, axis=0)
    return np.concatenate([g[k].ravel() for k in SHAPES]).astype(flat.dtype)


class Adam:
    """Weights with the state of their steps."""

    def __init__(self, flat: np.ndarray, rate: float = RATE):
        self.flat, self.m, self.v, self.t, self.rate = flat, np.zeros_like(flat), np.zeros_like(flat), 0, rate

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        self.t += 1
        g = gradient(self.flat, x, y)
        self.m *= np.float32(0.9)
        self.m += np.float32(0.1) * g
        g *= g
        self.v *= np.float32(0.99)
        self.v += np.float32(0.01) * g
        root = np.sqrt(self.v)
        root += np.float32(1e-6)
        self.flat = self.flat - np.float32(self.rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)) * self.m / root


def views(c: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows from each place of a run of texts' slots: of the slots before, and of the slots.
    Before a text's first slot comes the END of the text before it."""
    padded = np.concatenate((np.array([end], c.dtype), c, np.zeros(WINDOW, c.dtype)))
    at = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    return at[:-1], at[1:]


def pass_over(adam: Adam, ids: np.ndarray, of: np.ndarray, number: int, seed: int) -> int:
    """Steps over share ``number`` of the windows of a block's texts; how many windows."""
    left, length = windows_of(ids)
    before, c = views(of.astype(np.uint16).take(ids), of[END])
    order = np.random.default_rng(seed).permutation(len(left))
    order = order[len(order) * number // ROUNDS : len(order) * (number + 1) // ROUNDS]
    for at in range(0, len(order), BATCH):
        pick = order[at : at + BATCH]
        adam.step(before[left[pick]], np.where(np.arange(WINDOW) < length[pick][:, None], c[left[pick]].astype(np.int32), -1))
    return len(order)


def train(windows: DataFrame, vocabulary: Vocabulary, n_blocks: int) -> np.ndarray:
    """Weights after all rounds over rows (blk, ids), one for each block."""
    flat = start_weights(vocabulary.log_slot)
    for r in range(ROUNDS):
        start, of, number, rate = flat, vocabulary.of, r, RATE * (1 - 0.8 * r / ROUNDS)

        def run(batches: Iterator[pa.RecordBatch], start=start, of=of, number=number, rate=rate) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for blk, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    adam = Adam(start, rate)
                    n = pass_over(adam, np.frombuffer(ids.as_buffer(), np.uint16), of, number, blk)
                    if n:
                        yield _weights(blk, n, adam.flat.astype(np.float64) * n)

        got = in_batches(windows, run, "blk int, n long, w binary")
        flat = average(materialize(got, "lm-round"), n_blocks, flat)
    return flat


def _weights(blk: int, n: int, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([blk], pa.int32()), pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["blk", "n", "w"])


def add_up(rows: list[tuple[int, int, bytes]]) -> tuple[int, np.ndarray]:
    """Sums of n and of w of rows (blk, n, w), in the order of blocks."""
    n, w = 0, 0.0
    for _, m, x in sorted(rows, key=lambda r: r[0]):
        n, w = n + m, w + np.frombuffer(x, np.float64)
    return n, w


def average(sums: DataFrame, n_blocks: int, otherwise: np.ndarray) -> np.ndarray:
    """Mean weights from rows (blk, n, w), FAN neighbours at a time."""

    def merge(table: pa.Table) -> pa.Table:
        rows = list(zip(*(c.to_pylist() for c in table.columns), strict=True))
        return pa.Table.from_batches([_weights(rows[0][0] // FAN, *add_up(rows))])

    while n_blocks > FAN:
        sums = sums.groupBy(F.expr(f"blk div {FAN}")).applyInArrow(merge, "blk int, n long, w binary")
        n_blocks = -(-n_blocks // FAN)
    rows = [(r.blk, r.n, bytes(r.w)) for r in sums.collect()]
    if not rows:
        return otherwise
    n, w = add_up(rows)
    return (w / n).astype(np.float32)


def log10_scores(ids: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary, flat: np.ndarray) -> np.ndarray:
    """log10 probability of each text from its ids; windows of equal shape go in batches."""
    w = unpack(flat)
    ends = np.cumsum(sizes)
    begin = ends - sizes
    before, c = views(vocabulary.of.astype(np.uint16).take(ids), vocabulary.of[END])
    out = np.add.reduceat(vocabulary.share[ids], begin) if len(ids) else np.zeros(0)  # no text is without an END
    # a text's first window scores all its ids; the k-th starts at k * STRIDE and scores those after the first window's end
    extra = np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
    later = np.repeat(np.arange(len(sizes)), extra)
    k = np.arange(len(later)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    for doc, left, skip in ((np.arange(len(sizes)), begin, 0), (later, begin[later] + k * STRIDE, WINDOW - STRIDE)):
        length = np.minimum(WINDOW, ends[doc] - left)
        order = np.argsort(length, kind="stable")
        for at in range(0, len(order), SCORED):
            pick = order[at : at + SCORED]
            wide = int(length[pick].max())
            x = before[left[pick], :wide]
            if not skip:
                x[:, 0] = vocabulary.of[END]
            H = attend(w, x, skip)[-1]
            use = np.arange(skip, wide) < length[pick][:, None]
            scored = np.flatnonzero(use)
            got = log_prob(w, H.reshape(-1, WIDTH).take(scored, axis=0), c[left[pick], skip:wide].ravel().take(scored))
            out += np.bincount(np.repeat(doc[pick], use.sum(1)), got, len(sizes))
    return out / math.log(10)


def block_scores(ids: np.ndarray, vocabulary: Vocabulary, flat: np.ndarray) -> np.ndarray:
    """log10 probability of each text of a block from their ids, RUN_IDS of them at a time."""
    ends = np.flatnonzero(ids == END) + 1
    if not len(ends):
        return np.zeros(0)
    cuts = [0, *(np.flatnonzero(np.diff(ends // RUN_IDS)) + 1).tolist(), len(ends)]
    out = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        begin = int(ends[i - 1]) if i else 0
        out.append(log10_scores(ids[begin : ends[j - 1]], np.diff(ends[i:j], prepend=begin), vocabulary, flat))
    return np.concatenate(out)


def score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of each row."""
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"), F.col(f"`{text_col}`").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks, shards = max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // SHARD_BYTES))
    docs = docs.withColumn("blk", F.pmod(F.xxhash64("id", "th"), F.lit(n_blocks)).cast("int"))
    gathered = materialize(docs.groupBy("blk").applyInArrow(lambda t: gather(t, shards, path), parts(kind)), "lm", "part")
    answers = materialize(word_totals(gathered), "lm-words")
    stats = [np.frombuffer(r.c, np.int64) for r in answers.where("blk < 0").select("c").toLocalIterator()]
    total, distinct = (int(sum(s[i] for s in stats)) for i in (0, 1))
    vocabulary = Vocabulary(id_counts(gathered))
    flat = train(gathered.where("part = 'windows'").select("blk", F.col("h").alias("ids")), vocabulary, n_blocks)

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [block_scores(np.frombuffer(ids.as_buffer(), np.uint16), vocabulary, flat).tobytes() for ids in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *batch.columns[3:], pa.array(got, pa.binary())], names=["part", "blk", "n", "sizes", "id", "full"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = {r["part"].as_py(): r for r in (dict(zip(left.column_names, row, strict=True)) for row in zip(*left.columns, strict=True))}
        texts = got["texts"]
        ids = texts["id"].values
        sizes = np.frombuffer(texts["sizes"].as_buffer(), np.int64)
        places = np.frombuffer(pa.decompress(texts["n"].as_buffer(), 4 * int(sizes.sum()), "zstd"), np.uint32)
        held = held_out(ids.to_pylist())
        full = np.empty(len(held))
        full[held], full[~held] = (np.frombuffer(got[part]["full"].as_buffer(), float) for part in ("texts", "windows"))
        right = right.sort_by("shard")
        c = np.concatenate([np.frombuffer(x, np.int64) for x in right.column("c").to_pylist()])
        unit, end = math.log10(total + distinct + 1), int(c[-1])
        of = np.repeat(np.arange(len(sizes)), sizes)
        known = np.bincount(of, (c > 0)[places], len(sizes)).astype(np.int64) + (end > 0)
        base = np.bincount(of, np.log10(c + 1.0)[places], len(sizes)) + math.log10(end + 1) - (sizes + 1) * unit
        give_back()
        return pa.table({id_col: ids, "held_out": held, "n_tokens": sizes + 1, "n_known": known, "train_tokens": np.full(len(sizes), total, np.int64), "base_score": base, "score": full})

    texts = gathered.where("part IN ('windows', 'texts')").select("part", "blk", "h", "n", "sizes", "id")
    scored = in_batches(texts, model, f"part string, blk int, n binary, sizes binary, id array<{kind}>, full binary")
    schema = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return scored.groupBy("blk").cogroup(answers.where("blk >= 0").groupBy("blk")).applyInArrow(run, schema)


def op6_causal_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
