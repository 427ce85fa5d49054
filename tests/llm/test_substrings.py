"""Repeated windows against a count of all windows as word tuples."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.llm import substrings
from tabulon.llm.shingles import window_hashes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, size):
    """(number of words, kept words, removed places) of each text."""
    words = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), " ".join(x for j, x in enumerate(w) if j not in gone), gone))
    return out


def planted(seed, n=120):
    """Texts with passages, lines and whole texts in common, and texts that repeat themselves."""
    rng = random.Random(seed)
    some = lambda k: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(k)]
    passages, texts = [some(rng.randrange(20, 80)) for _ in range(6)], []
    for i in range(n):
        w = some(rng.randrange(0, 90))
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(w) + 1), rng.choice(passages)
            w[at:at] = p[: rng.randrange(len(p))]
        if i % 10 == 0:
            w = (w[:9] or ["x"]) * 8 + w
        texts.append(rng.choice([" ", "\n", " \t"]).join(w))
    return [*texts, *texts[:9], texts[3].upper(), "x " * 3000, None, "", " \n"]


def compare(spark, texts, size, parts=7):
    rows = [(i if i % 11 else None, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block string, n long").repartition(parts)
    got = sorted(((r.n_words, r.text, tuple(j for s in r.removed for j in range(s.start, s.start + s.length))) for r in substrings.remove_repeats(df, size=size).collect()), key=repr)
    assert got == sorted(((n, kept, tuple(sorted(gone))) for n, kept, gone in brute(texts, size)), key=repr)


@pytest.mark.parametrize("size", [35, 5, 1])
def test_removed_words(spark, size):
    compare(spark, planted(size), size)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """Cells that all windows share only send more windows to the exact pass."""
    plain = substrings.Sizes.__init__

    def small(self, size, tasks):
        plain(self, size, tasks)
        self.cell_bits, self.shard_bits = 3, 1

    monkeypatch.setattr(substrings.Sizes, "__init__", small)
    compare(spark, planted(77), 12)


def test_estimates_are_never_low():
    texts = [t.encode() for t in planted(5) if t]
    block = substrings.Block(pa.chunked_array([[t.decode() for t in texts]]), 20)
    counts = collections.Counter(block.anchors.tolist())
    words, sizes = word_hashes(texts, fold=False)
    at, _ = substrings.anchors(words, sizes, 20)
    start = np.flatnonzero(at)
    windows = collections.Counter(tuple(words[s : s + 20].tolist()) for s in start)
    assert all(counts[at[s]] >= windows[tuple(words[s : s + 20].tolist())] for s in start.tolist())
    assert len(block.anchors) < len(start) / 2


def test_window_hashes():
    words, _ = word_hashes([b"a b c d e a b c d e a b c d f A"], fold=False)
    high, low = window_hashes(words, np.arange(12), 5)
    assert len(set(high.tolist())) == len(set(low.tolist())) == 7
    assert words[0] != words[-1]


def test_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in substrings.op12_count_min_windows(spark, "/root/testdata/sf0.001").collect())
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = [(i, n, len(gone), hashlib.sha256(kept.encode()).hexdigest()) for (i, _), (n, kept, gone) in zip(rows, brute([t for _, t in rows], 35))]
    assert got == want and any(r[2] for r in got)


def test_odd_rows_and_empty_table(spark, odd_docs):
    rows = substrings.remove_repeats(odd_docs.withColumn("removed", F.lit(1))).collect()
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert len(rows) == odd_docs.count()
    assert by_id[7][0].n_words == 30000 and by_id[7][0].text == ""
    assert all(r.text == "" for r in by_id[4])
    assert by_id[None][0].text == "short text"
    assert substrings.remove_repeats(odd_docs.limit(0)).collect() == []
