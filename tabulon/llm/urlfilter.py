"""URL filter: host and path rules, then two character language models.

Rules decide the URLs they fit. They also label them, and two variable-order Markov
models learn from these labels: one of accepted, one of rejected URLs. A model backs
off from ``ORDER`` characters of context to none by Witten-Bell weights. A URL that no
rule fits is blocked when the difference of the two log-likelihoods, divided by its
length, exceeds a threshold calibrated on the labelled URLs.

Counts cover all labelled URLs. They are made where the rows are and only sums over
(label, context, character) go to the driver: characters map to ``len(SYMBOLS) + 1``
symbols, so that there are at most ``4 * 42 ** 4`` sums, however many URLs there are.
For calibration each half of the labelled URLs, dealt by their CRC-32, is scored by
models of the other half.

Defined results: a URL that is null or has no ``://`` has an empty host and path, no
rule and verdict allow, as there is nothing to score; if either label has no URL, all
URLs without a rule are allowed; repeated rows give equal results; an empty table
gives an empty result; only the id and URL columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-_?=&#:%~+@"
ORDER = 3
BASE = len(SYMBOLS) + 2  # the last two: any other character, and the edge
BINS = 2001
SPAN = 8.0  # nats for each character; calibrated differences lie within


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path (with its slash) of a URL; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null without one. Of equally
    long rules the first listed wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


_CODE = np.full(256, len(SYMBOLS), np.int64)
for _i, _c in enumerate(SYMBOLS):
    _CODE[ord(_c)] = _i
    _CODE[ord(_c.upper())] = _i


def _symbols(urls: list) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all URLs, each after ORDER edges and before one; URL number of each symbol."""
    raw = [u.encode() for u in urls]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    out = np.full(int(sizes.sum()) + len(raw) * (ORDER + 1), BASE - 1, np.int64)
    owner = np.repeat(np.arange(len(raw)), sizes + ORDER + 1)
    start = np.cumsum(sizes + ORDER + 1) - sizes - 1
    place = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    out[place] = _CODE[np.frombuffer(b"".join(raw), np.uint8)]
    return out, owner


def _cells(sym: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context of ORDER symbols and next symbol) as one number for each scored symbol; its URL."""
    at = np.arange(ORDER, len(sym))
    at = at[owner[at] == owner[at - ORDER]]
    cell = np.zeros(len(at), np.int64)
    for k in range(ORDER, -1, -1):
        cell = cell * BASE + sym[at - k]
    return cell, owner[at]


class MarkovModel:
    """Witten-Bell interpolated model from sums of full-order cells."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray):
        self.tables = []
        for order in range(ORDER + 1):
            key = cells % BASE ** (order + 1)
            keys, inverse = np.unique(key, return_inverse=True)
            n = np.bincount(inverse, counts, len(keys))
            contexts, of = np.unique(keys // BASE, return_inverse=True)
            self.tables.append((keys, n, contexts, np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(float)))

    @staticmethod
    def _get(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], 0.0)

    def log_prob(self, cells: np.ndarray) -> np.ndarray:
        p = np.full(len(cells), 1.0 / BASE)
        for order, (keys, n, contexts, total, kinds) in enumerate(self.tables):
            key = cells % BASE ** (order + 1)
            t = self._get(contexts, total, key // BASE)
            d = self._get(contexts, kinds, key // BASE)
            p = np.where(t > 0, (self._get(keys, n, key) + d * p) / np.maximum(t + d, 1), p)
        return np.log(p)


def scores(urls: list, models: dict) -> np.ndarray:
    """Log-likelihood under "block" minus "allow" for each URL, over its scored symbols."""
    if not urls:
        return np.zeros(0)
    cell, owner = _cells(*_symbols(urls))
    diff = models["block"].log_prob(cell) - models["allow"].log_prob(cell)
    return np.bincount(owner, diff, len(urls)) / np.maximum(np.bincount(owner, minlength=len(urls)), 1)


def _halves(urls: list) -> np.ndarray:
    return np.fromiter((zlib.crc32(u.encode()) % 2 for u in urls), np.int64, len(urls))


def fit(labelled: DataFrame) -> tuple[dict, float] | None:
    """Models and threshold from a table (url, verdict); None if a label has no URL."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, said = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            if urls:
                cell, owner = _cells(*_symbols(urls))
                keys, n = np.unique(cell * 4 + (2 * (said == "block") + _halves(urls))[owner], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys // 4), pa.array(keys % 4), pa.array(n)], names=["cell", "part", "n"])

    sums = labelled.mapInArrow(count, "cell long, part long, n long").groupBy("cell", "part").agg(F.sum("n").alias("n")).toArrow()
    cell, part, n = (sums.column(i).to_numpy() for i in range(3))
    blocked, half = part >= 2, part % 2
    if not blocked.any() or blocked.all():
        return None

    def models_of(m: np.ndarray) -> dict:
        return {k: MarkovModel(cell[m & w], n[m & w].astype(float)) for k, w in (("block", blocked), ("allow", ~blocked))}

    models = models_of(half >= 0)
    halves = [models_of(half != h) if (blocked & (half != h)).any() and (~blocked & (half != h)).any() else models for h in (0, 1)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((2, BINS), np.int64)
        for batch in batches:
            urls = batch.column(0).to_pylist()
            h = _halves(urls)
            s = np.zeros(len(urls))
            for i in (0, 1):
                s[h == i] = scores([u for u, x in zip(urls, h.tolist(), strict=True) if x == i], halves[i])
            side = np.array(batch.column(1).to_pylist(), object) == "block"
            bins = np.clip(np.round((s + SPAN) / (2 * SPAN) * (BINS - 1)), 0, BINS - 1).astype(int)
            np.add.at(hist, (side.astype(int), bins), 1)
        side, bins = np.nonzero(hist)
        yield pa.RecordBatch.from_arrays([pa.array(side), pa.array(bins), pa.array(hist[side, bins])], names=["side", "bin", "n"])

    got = labelled.mapInArrow(spread, "side long, bin long, n long").groupBy("side", "bin").agg(F.sum("n").alias("n")).collect()
    hist = np.zeros((2, BINS))
    for side, place, n_ in got:
        hist[side, place] = n_
    # the least sum of the two error rates; of equally good thresholds the middle one
    error = np.cumsum(hist[1]) / hist[1].sum() + 1 - np.cumsum(hist[0]) / hist[0].sum()
    best = np.flatnonzero(error <= error.min() + 1e-12)
    place = (best[0] + best[-1]) / 2 + 0.5
    return models, float(place / (BINS - 1) * 2 * SPAN - SPAN)


def judge(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (null where none is needed)."""
    host, path = split_url(F.col("url"))
    base = df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").alias("url"))
    rule, said = match_rule(F.col("host"), F.col("path"), rules)
    ruled = base.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("said", said)
    fitted = fit(ruled.where("said is not null").select("url", "said"))
    kind = base.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, hosts, paths, names, said_ = batch.columns
            text, verdict = urls.to_pylist(), said_.to_pylist()
            score: list = [None] * len(text)
            todo = [i for i, v in enumerate(verdict) if v is None]
            for i in todo:
                verdict[i] = "allow"
            todo = [i for i in todo if text[i] and "://" in text[i]]
            if fitted and todo:
                for i, s in zip(todo, scores([text[i] for i in todo], fitted[0]).tolist(), strict=True):
                    score[i] = s
                    if s > fitted[1]:
                        verdict[i] = "block"
            yield pa.RecordBatch.from_arrays([ids, hosts, paths, names, pa.array(verdict, pa.string()), pa.array(score, pa.float64())], names=[id_col, "host", "path", "rule", "verdict", "score"])

    return ruled.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, score double")


def op10_character_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).drop("score")
