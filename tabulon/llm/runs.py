"""Periodic runs: stretches of words that repeat with a period.

A run is a maximal stretch whose words ``period`` apart are equal, at least two periods and
``least`` words long; its period is the smallest such. All runs of a text are found by the
method of Kolpakov and Kucherov:

* the words are cut into factors, each a word not seen before or the longest stretch that
  also starts earlier, found by walking the suffix automaton of the words, whose states know
  where they first ended;
* a run that starts in an earlier factor than it ends, or touches a factor's border, is found at that border
  by Main's algorithm. There its period is less than the two factors together, and it begins
  less than twice the former factor and once the latter before the border, so that the work is linear;
* a run strictly inside a factor is a copy of one in the factor's earlier occurrence.

Before that, a text is cut where no run can be. Each word of a run lies in ``(least + 1) // 2`` words
of it that occur again in it, one period away. So words in no such repeated stretch are in no
run, and what lies between them is judged alone; this is repeated until nothing more is cut.
Stretches are compared by hashes for all texts of a batch at once: equal ones have equal
hashes, so that no run is lost, and what is left is compared by words.

Defined results: null and empty texts have no words and no runs. Runs are ordered by start, then
period. The collapsed text keeps the first period of each run: a word is dropped if any run
has it after its first ``period`` words; kept words are joined by one space. Each row is judged
alone, so repeated rows and null ids give a row each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, let, words
from .shingles import mix, shingle_hashes

LEAST = 12
#: Borders of factors that are together so short are compared word by word.
SHORT = 12


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of an earlier occurrence or -1) of the factors of ``w``."""
    after, link, length, first = [{}], [-1], [0], [-1]  # a state's first occurrence ends at ``first``
    last = 0
    for i, c in enumerate(w):
        new = len(after)
        after.append({})
        length.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p != -1 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p != -1:
            q = after[p][c]
            if length[q] != length[p] + 1:
                split = len(after)
                after.append(after[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = split
                while p != -1 and after[p].get(c) == q:
                    after[p][c] = split
                    p = link[p]
                q = split
            link[new] = q
        last = new
    out, start, n = [], 0, len(w)
    while start < n:
        state, end = 0, start
        while end < n:
            to = after[state][w[end]]
            if first[to] >= end:  # occurs here for the first time
                break
            state, end = to, end + 1
        if end == start:
            out.append((start, 1, -1))
            start += 1
        else:
            out.append((start, end - start, first[state] - (end - start) + 1))
            start = end
    return out


def prefix_lengths(s: list[int]) -> list[int]:
    """For each place, how many elements from there on equal those from the start on."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = z[i - left] if i < right else 0
        if i + k >= right:
            k = right - i if i < right else 0
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def at_border(w: list[int], b: int, before: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of stretches over or at the border before word ``b``, between factors of
    ``before`` and ``size`` words, that end in the latter and go no further either way."""
    stop, n = b + size, len(w)
    reach = min(b, 2 * before + size)
    low = b - reach
    if before + size > SHORT:
        t, u = w[low:b], w[b:stop]
        back = prefix_lengths([*t[::-1], -1, *u[::-1], *t[::-1]])
        on = prefix_lengths([*u, -1, *t, *u])
    else:
        back = on = None
    for p in range(1, before + size + 1):
        if p <= size:  # a whole period right of the border
            if back is not None:
                left, right = back[reach + 1 + size - p], on[p] if p < size else 0
            else:
                left = right = 0
                while left < reach and w[b - 1 - left] == w[b + p - 1 - left]:
                    left += 1
                while b + p + right < stop and w[b + right] == w[b + p + right]:
                    right += 1
            if left + right >= p and not (left == reach and low):
                end = b + p + right - 1
                if end + 1 < stop or stop == n or w[stop] != w[stop - p]:
                    yield b - left, end, p
        if p <= reach:  # a whole period left of it
            if back is not None:
                left, right = back[p] if p < reach else 0, on[size + 1 + reach - p]
            else:
                left = right = 0
                while left < reach - p and w[b - 1 - left] == w[b - p - 1 - left]:
                    left += 1
                while b + right < stop and w[b + right] == w[b + right - p]:
                    right += 1
            right = min(right, size)
            if left + right >= p and not (p + left == reach and low):
                end = b + right - 1
                if end + 1 < stop or stop == n or w[stop] != w[stop - p]:
                    yield b - p - left, end, p


def runs_of(w: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``w``, by start and period."""
    found: dict[int, dict[int, int]] = {}  # start: {end: period}
    before = 0
    for b, size, source in [*factors(w), (len(w), 0, -1)]:
        for start, end, p in at_border(w, b, before, size):
            if end - start + 1 >= max(least, 2 * p):
                ends = found.setdefault(start, {})
                ends[end] = min(p, ends.get(end, p))
        if source >= 0 and found:
            shift, stop = b - source, b + size - 1
            for start in range(b + 1, stop):
                for end, p in found.get(start - shift, {}).items():
                    if end + shift < stop:
                        found.setdefault(start, {})[end + shift] = p
        before = size
    return sorted((s, e - s + 1, p) for s, ends in found.items() for e, p in ends.items())


def stretches(ids: np.ndarray, part: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of the stretches of ``ids`` that can hold runs. ``part`` numbers the
    text of each word; runs don't reach over texts."""
    k = (least + 1) // 2
    at = np.arange(len(ids))
    while True:
        n = len(at)
        keys = shingle_hashes(mix(ids[at].astype(np.uint64) + (part.astype(np.uint64) << np.uint64(32))), k)
        order = np.argsort(keys)
        same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
        change = np.zeros(n + 1, np.int64)
        twice = np.unique(np.concatenate((order[same], order[same + 1])))
        np.add.at(change, twice, 1)
        np.add.at(change, twice + k, -1)
        inside = np.cumsum(change[:-1]) > 0
        # a new part where the text or the stretch changes; parts that are too short go
        head = np.ones(n, bool)
        head[1:] = (part[1:] != part[:-1]) | (inside[1:] != inside[:-1])
        number = np.cumsum(head) - 1
        keep = inside & (np.bincount(number, minlength=1)[number] >= least) if n else inside
        at, part = at[keep], number[keep]
        if len(at) == n or not len(at):
            break
    if not len(at):
        return at, at
    edge = np.flatnonzero(part[1:] != part[:-1])
    return at[np.concatenate(([0], edge + 1))], at[np.concatenate((edge, [len(at) - 1]))] + 1


def text_runs(texts: list[bytes], least: int = LEAST) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text."""
    cut, ids = [t.split() for t in texts], []
    for w in cut:
        seen: dict[bytes, int] = {}
        ids.append(np.fromiter((seen.setdefault(x, len(seen)) for x in w), np.int64, len(w)))
    sizes = np.array([len(w) for w in cut], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    out: list = [(w, []) for w in cut]
    every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    for start, end in zip(*(x.tolist() for x in stretches(every, np.repeat(np.arange(len(cut)), sizes), least)), strict=True):
        t = int(np.searchsorted(first, start, "right")) - 1
        shift = start - int(first[t])
        out[t][1].extend((s + shift, n, p) for s, n, p in runs_of(every[start:end].tolist(), least))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def find_runs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Rows (id, n_words, runs as an array of (start, length, period), collapsed): the runs of at least
    ``least`` words of each text, and the text without what they repeat."""
    least = max(2, least)
    kind = df.schema[id_col].dataType.simpleString()
    of_run = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_runs([(t or "").encode() for t in batch.column(1).to_pylist()], least)
            runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for _, r in found]
            n_words = pa.array([len(w) for w, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_words, pa.array(runs, of_run), pa.array([collapse(*f).decode() for f in found], pa.string())], names=["id", "n_words", "runs", "collapsed"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = in_batches(rows, run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def with_planted_period(doc_id: Column, text: Column) -> Column:
    """The text, of which in a tenth of the documents (by the CRC of the id) a tail repeats a stretch."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " "))

    return F.when(h % 10 == 0, let(words(text), tail)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_runs(docs.select("doc_id", with_planted_period(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    out = found.withColumn("longest", longest).select("*", (-F.col("longest.l")).alias("length"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.s").alias("start"), "length", F.col("longest.p").alias("period"),
        F.floor(1000 * F.col("length") / F.col("longest.p")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
