"""Vector codes against a full search in plain integers."""

import hashlib
import math

import numpy as np
import pytest

from tabulon.llm import vectorcodes


def brute(vectors, parts=16, entries=64, rounds=2):
    """vectors: integer lists in order of id. Codes, errors and codebooks by full search."""
    wide = len(vectors[0]) // parts
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for v in vectors]
    books = [[cut[e][p] for e in range(min(entries, len(cut)))] for p in range(parts)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p])) for p, x in enumerate(row)] for row in cut]

    for _ in range(rounds):
        found = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut[i][p] for i in range(len(cut)) if found[i][p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = assigned()
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [("".join("%02x" % e for _, e in r), sum(d for d, _ in r)) for r in found], digest


def by_operator(df, **kw):
    coded, books = vectorcodes.encode(df, **kw)
    rows = vectorcodes.with_label_errors(coded).collect()
    return rows, vectorcodes.books_digest(books)


def test_codes_of_all_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(5)
    given = sorted((r.vec_id, r.embedding, r.label) for r in df.collect())
    codes, digest = brute([[math.floor(256 * x) for x in v] for _, v, _ in given])
    rows, found = by_operator(df)
    assert found == digest
    assert {r.id: (bytes(r.code).hex(), r.error) for r in rows} == {g[0]: c for g, c in zip(given, codes)}
    sums = {}
    for g, c in zip(given, codes):
        sums[g[2]] = sums.get(g[2], 0) + c[1]
    assert all(r.label_error == sums[r.label] for r in rows)


@pytest.mark.parametrize("spread", [2, 40])
def test_search_equals_a_full_search(spread):
    rng = np.random.default_rng(spread)
    for _ in range(20):
        x, entries = rng.integers(-spread, spread, (300, 3)), rng.integers(-spread, spread, (17, 3))
        gap = ((x[:, None] - entries[None]) ** 2).sum(2)
        best, dist = vectorcodes.Book(entries).search(x, rng.integers(0, 17, 300))
        assert (best == gap.argmin(1)).all() and (dist == gap.min(1)).all()  # argmin: ties to the lower index


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    flat = [0.5, -0.25] * 16
    rows = [(1, None, "a"), (2, [0.0] * 31 + [None], "a"), (3, [nan] * 32, "a"), (4, [inf] + flat[1:], "a"), (5, flat, None), (5, flat, None), (None, [-0.001] * 32, "a"), (7, [], "b"), (8, [1.0] * 40, "b"), (9, [1e30] * 32, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label string, code int, error string")
    got, digest = by_operator(df)
    pad = lambda v: v + [0] * (48 - len(v))
    order = [pad([128, -64] * 16), pad([128, -64] * 16), pad([]), pad([256] * 40), pad([1 << 25] * 32), pad([-1] * 32)]
    codes, want = brute(order)
    assert digest == want
    ids = [5, 5, 7, 8, 9, None]
    assert sorted(((r.id is None, r.id or 0), bytes(r.code).hex(), r.error) for r in got) == sorted(((i is None, i or 0), *c) for i, c in zip(ids, codes))
    assert all(r.label_error == sum(s.error for s in got if s.label == r.label) for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    rows, digest = by_operator(df)
    assert rows == [] and digest == hashlib.sha256(b"").hexdigest()
    all_null = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    assert by_operator(all_null)[0] == []


def test_more_labels_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vectorcodes, "BROADCAST_ROWS", 1)
    df = spark.createDataFrame([(i, [float(i)] * 16, i % 3 or None) for i in range(30)], "vec_id long, embedding array<float>, label int")
    rows, _ = by_operator(df, entries=4)
    assert len(rows) == 30 and all(r.label_error == sum(s.error for s in rows if s.label == r.label) for r in rows)
