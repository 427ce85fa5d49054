"""Periodic runs against a comparison of all words at all periods."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tabulon.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least):
    """(start, length, period) of all runs, by trying every period."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        start = None
        for i in range(len(w) - p + 1):
            if i < len(w) - p and w[i] == w[i + p]:
                start = i if start is None else start
            elif start is not None:
                if i - start + p >= max(least, 2 * p):
                    found.setdefault((start, i - start + p), p)
                start = None
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_text(w, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_words(letters):
    rng = random.Random(letters)
    for k in range(400):
        w = [rng.randrange(letters) for _ in range(rng.randrange(0, 70))]
        if k % 3 == 0 and w:
            cut = rng.randrange(1, len(w) + 1)
            w = (w[:cut] * 5)[: rng.randrange(1, 90)] + w
        for least in (2, 5, 12):
            assert runs.runs_of(w, least) == brute(w, least), (w, least)


@pytest.mark.parametrize("w", [thue_morse(700), fibonacci(700), [7] * 500, list(range(300)) * 3, (list(range(9)) * 4 + [99]) * 6, [0] * 90 + [1] + [0] * 90])
def test_runs_of_known_words(w):
    assert runs.runs_of(w, 2) == brute(w, 2)
    assert runs.runs_of(w, 12) == brute(w, 12)


def test_factors_are_longest_earlier_stretches():
    rng = random.Random(3)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(40)]
        at = 0
        for start, size, source in runs.factors(w):
            earlier = [next((k for k in range(start) if w[k : k + n] == w[start : start + n]), None) for n in range(1, len(w) - start + 1)]
            longest = sum(1 for e in earlier if e is not None)
            assert start == at and size == max(1, longest)
            assert source == (earlier[longest - 1] if longest else -1)
            at += size
        assert at == len(w)


def test_cutting_loses_no_run():
    rng = random.Random(5)
    texts = []
    for _ in range(150):
        w = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(w) + 1), rng.randrange(1, 20)
            w[at:at] = ([rng.choice("xyz") for _ in range(p)] * 6)[: rng.randrange(2, 70)]
        texts.append(" ".join(w))
    for least in (2, 7, 12):
        for t, (w, found) in zip(texts, runs.text_runs([t.encode() for t in texts], least)):
            assert w == t.encode().split() and found == brute(w, least)


def test_whole_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = [(10**6 + i, " ".join(f"w{(j * j) % (40 + i)}" for j in range(3000)), "en", "s", 1) for i in range(4)]
    odd = spark.createDataFrame([*long, (None, "a b c", "en", "s", 1), (None, None, None, None, None), (5, "", "en", "s", 0), (5, "", "en", "s", 0), (7, "x " * 20 + "\x0b y", "en", "s", 0), (8, " \t\n", "en", "s", 0)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(runs.op11_periodic_runs(spark, str(tmp_path)).collect(), key=repr)
    want = []
    for r in docs.unionByName(odd).collect():
        w = WORD.findall(r.text or "")
        n = len(w)
        if r.doc_id is not None and n and (h := zlib.crc32(str(r.doc_id).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
        found = brute(w, 12)
        best = min(((-m, s, p) for s, m, p in found), default=None)
        listed = "".join(f"{s},{m},{p}\n" for s, m, p in found)
        numbers = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want.append((r.doc_id, len(found), *numbers, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, brute_text(w, found)))))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(1 for r in got if r.n_runs) > 10


def test_other_columns_and_empty_table(spark, odd_docs):
    df = odd_docs.withColumn("runs", F.lit(1)).withColumn("id", F.lit("x"))
    rows = runs.find_runs(df).collect()
    assert len(rows) == odd_docs.count()
    assert {len(r.runs) for r in rows if r.doc_id == 7} == {1}
    assert runs.find_runs(odd_docs.limit(0)).collect() == []
