"""Byte-pair encoding and decoding with an index of pair occurrences.

A batch of rows is one partition of work. The distinct new pieces of its texts become
one array of symbols, linked to their neighbours. An index maps the rank of each
adjacent pair to all its positions; a heap hands out the active ranks in ascending
order; one step merges a pair at all its positions together and files the pairs that
arise there under their own ranks. A pair made by a merge never has been merged before
the pairs it is made of, and if it ranks lower, the heap hands it out next, so that
every piece is merged as it would be alone.

A worker keeps what it has encoded in two generations of ``CACHE_PIECES`` each: frequent
pieces stay, rare ones go. Memory is that of a batch of rows and the cache.

Defined results: null text encodes as empty: no tokens, decoded to an empty text; text
of any length is encoded whole; repeated rows give equal results; an empty table gives
an empty result; other columns of the table, whatever their names, are not read by
``encode``.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches

CACHE_PIECES = 60_000
ROWS = 1000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes for themselves, the others from U+0100 in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class PairIndexEncoder:
    """A word-end BPE vocabulary file (JSON of the tokenizers library: NFC, white space
    to one space, lower case; a splitting pattern; byte letters; a word-end suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.special_re = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.piece_re = regex.compile(split["pattern"]["Regex"])
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        self.width = max(self.token) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.left = (keys // self.width).astype(np.int32)
        self.right = (keys % self.width).astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.cache: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is none."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the end of each piece's ids."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        sym = self.first[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        nxt = np.arange(1, n + 1, dtype=np.int64)
        nxt[ends - 1] = n  # sentinel: no right neighbour
        prv = np.arange(-1, n - 1, dtype=np.int64)
        prv[ends[:-1]] = -1
        alive = np.ones(n + 1, bool)
        sym = np.append(sym, -1)
        alive[n] = False
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def file(at: np.ndarray) -> None:
            """Add the pairs that start at these positions to the index."""
            at = at[nxt[at] < n]
            r = self.ranks(sym[at], sym[nxt[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for rank, group in zip(r[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if rank in index:
                    index[rank].append(group)
                else:
                    index[rank] = [group]
                    heapq.heappush(active, rank)

        file(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            a, b, c = self.left[rank], self.right[rank], self.made[rank]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[alive[at] & (sym[at] == a)]
            at = at[sym[nxt[at]] == b]  # the sentinel's symbol is none
            if not len(at):
                continue
            if a == b and len(at) > 1:  # in a run of one symbol, merge from the left, each symbol once
                at = np.sort(at)
                joined = nxt[at[:-1]] == at[1:]
                start = np.flatnonzero(np.append(True, ~joined))
                place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
                at = at[place % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = c
            alive[gone] = False
            nxt[at] = after
            inner = after < n
            prv[after[inner]] = at[inner]
            before = prv[at]
            file(np.unique(np.concatenate([before[before >= 0], at])))
        kept = np.flatnonzero(alive[:n])
        return sym[kept], np.searchsorted(kept, ends)

    def learn(self, chunks: list[str]) -> None:
        """Put the ids of each chunk (text without white space), as decimal text, into the cache."""
        parts = [self.piece_re.findall(c) for c in chunks]
        distinct = list(dict.fromkeys(p for x in parts for p in x))
        ids: dict[str, str] = {}
        if distinct:
            got, ends = self.merge([p.encode("utf-8", "surrogatepass") for p in distinct])
            texts = list(map(str, got.tolist()))
            start = 0
            for p, e in zip(distinct, ends.tolist(), strict=True):
                ids[p] = " ".join(texts[start:e])
                start = e
        self.cache.update((c, " ".join([ids[p] for p in x])) for c, x in zip(chunks, parts, strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[str]:
        """The ids of each text, in decimal, joined by one space."""
        docs: list[list] = []  # of each text: lists of chunks, and ids of special tokens
        for text in texts:
            parts: list = []
            if text:
                at = 0
                for m in self.special_re.finditer(text) if self.special_re and "<|" in text else ():
                    parts += [self.chunks(text[at : m.start()]), str(self.special[m[0]])]
                    at = m.end()
                parts.append(self.chunks(text[at:] if at else text))
            docs.append(parts)
        wanted: set[str] = set()
        for parts in docs:
            for p in parts:
                if type(p) is list:
                    wanted.update(p)
        if len(self.cache) > CACHE_PIECES:
            self.cache, self.older = {}, self.cache
        cache, older = self.cache, self.older
        fresh = []
        for w in wanted.difference(cache):
            if w in older:
                cache[w] = older[w]
            else:
                fresh.append(w)
        if fresh:
            self.learn(fresh)
        get = self.cache.__getitem__
        return [" ".join(filter(None, [p if type(p) is str else " ".join(filter(None, map(get, p))) for p in parts])) for parts in docs]

    @staticmethod
    def chunks(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower gives it another form at a word's end
                text = text.replace("Σ", "σ")
        return [x for x in SPACE_RE.split(text.lower()) if x] if ODD_SPACE_RE.search(text) else text.lower().split()

    def decode(self, ids: str) -> str:
        """Tokens of decimal ids; the file has no decoder, so that they are joined by one space."""
        return " ".join([self.token[int(i)] for i in ids.split()])

    def decode_batch(self, batch: list[str]) -> list[str]:
        names = self.names
        return [" ".join(map(names.__getitem__, ids.split(" "))) if ids else "" for ids in batch]

    @property
    def names(self) -> dict[str, str]:
        if not hasattr(self, "_names"):
            self._names = {str(i): t for i, t in self.token.items()}
        return self._names


#: White space of the vocabulary's pattern, and what str.split() splits at beyond that.
SPACE_RE = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD_SPACE_RE = regex.compile("[\x1c-\x1f]")


@lru_cache(maxsize=4)
def encoder(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids``
    (array of int) of each row. ``path`` must be readable on the executors; by default
    it is looked up there."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or default_path())
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = enc.encode_batch(part.column(1).to_pylist())
                cols = [
                    part.column(0),
                    pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()),
                    pa.array([sha(x) for x in ids], pa.string()),
                    pa.array([sha(x) for x in enc.decode_batch(ids)], pa.string()),
                ]
                if with_ids:
                    cols.append(pa.array([np.array(x.split(), np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return in_batches(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), run, schema)


def op5_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
