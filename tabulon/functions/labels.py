"""Roles of column labels: exact aliases first, character trigrams second."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import maybe_known, normalize_label

# Aliases and prototypes of the five column roles.
ALIASES = {
    "name": ("наименование", "наименование товара", "наименование работ", "наименование услуг", "товар", "услуга", "работы", "описание", "product", "item", "name", "description"),
    "quantity": ("количество", "кол во", "кол-во", "количество товара", "объем", "объём", "шт", "qty", "quantity"),
    "unit": ("ед изм", "единица измерения", "единица", "ед", "unit", "uom"),
    "unitPrice": ("цена", "цена ед", "цена за ед", "цена за единицу", "стоимость единицы", "стоимость 1 ед", "тариф", "unitprice", "unit price", "unit cost", "price"),
    "lineTotal": ("сумма", "сумма позиции", "общая сумма", "всего", "стоимость", "итого", "linetotal", "line total", "total", "amount"),
}
PROTOTYPES = {
    "name": ("название продукции", "описание позиции", "product description"),
    "quantity": ("объем поставки", "число единиц", "quantity of goods"),
    "unit": ("мера товара", "единицы поставки", "measurement unit"),
    "unitPrice": ("стоимость за единицу продукции", "тариф за одну единицу", "price per item"),
    "lineTotal": ("полная стоимость позиции", "итог по строке", "total amount"),
}
HIGH, LOW = 0.82, 0.68
#: Numbers with or without a currency code. Of their trigrams known labels share " 1 " and those of a code's end, which is less than half of any label,
#: so that no cosine reaches ``LOW``.
NO_LABEL = r"^[^\p{L}]*(?:RUB|USD|EUR|KZT|TRY)?\z"


def may_name(text: Column) -> Column:
    """Whether a text may be near a known label: it has letters other than a currency code at its end."""
    return ~text.rlike(NO_LABEL)


def may_be_alias(text: Column) -> Column:
    """Whether a text may be an alias: it opens with the first word of one, or has characters that aliases do not have."""
    return maybe_known(text, [label for labels in ALIASES.values() for label in labels])


def vocabulary(spark: SparkSession) -> DataFrame:
    """(role, label, alias): about 70 rows, whatever the input."""
    rows = [(role, label, source is ALIASES) for source in (ALIASES, PROTOTYPES) for role, labels in source.items() for label in labels]
    return spark.createDataFrame(rows, "role string, label string, alias boolean").select("role", normalize_label(F.col("label")).alias("label"), "alias")


def trigrams(label: str) -> list[str]:
    """The grams of a normalised label, padded by two spaces."""
    padded = f"  {label}  "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class Likeness:
    """Trigram cosines with known labels (role, label). The known grams are few and fixed, so that a label's counts of them
    are a row of a small matrix and no gram is shuffled; labels pass in slices of so many characters at most."""

    SLICE = 1 << 18

    def __init__(self, known: list[tuple[str, str]]):
        self.roles = sorted({role for role, _ in known})
        counts = [Counter(trigrams(label)) for _, label in known]
        self.grams = np.unique(np.array([self._code(np.frombuffer(g.encode("utf-32-le"), np.uint32))[0] for c in counts for g in c], np.int64))
        self.weights = np.zeros((len(self.grams), len(known)))
        for i, c in enumerate(counts):
            for g, n in c.items():
                self.weights[np.searchsorted(self.grams, self._code(np.frombuffer(g.encode("utf-32-le"), np.uint32))[0]), i] = n
        self.norms = (self.weights**2).sum(axis=0)
        self.of = [np.flatnonzero([r == role for r, _ in known]) for role in self.roles]

    @staticmethod
    def _code(points: np.ndarray) -> np.ndarray:
        p = points.astype(np.int64)
        return p[:-2] << 42 | p[1:-1] << 21 | p[2:]

    def scores(self, labels: list[str]) -> np.ndarray:
        """The best cosine of each label with each role, in the order of ``roles``; 0 where no gram is common."""
        out, at = [np.zeros((0, len(self.roles)))], 0
        while at < len(labels):
            end, size = at, 0
            while end < len(labels) and (end == at or size + len(labels[end]) + 4 <= self.SLICE):
                size, end = size + len(labels[end]) + 4, end + 1
            out.append(self._slice(labels[at:end]))
            at = end
        return np.concatenate(out)

    def _slice(self, labels: list[str]) -> np.ndarray:
        n = len(labels)
        sizes = np.fromiter(map(len, labels), np.int64, n) + 4
        owner = np.repeat(np.arange(n), sizes)
        code = self._code(np.frombuffer("".join([f"  {x}  " for x in labels]).encode("utf-32-le"), np.uint32))
        own = owner[:-2] == owner[2:]
        code, owner = code[own], owner[:-2][own]
        _, gram = np.unique(code, return_inverse=True)
        kinds = int(gram.max()) + 1
        key, times = np.unique(owner * kinds + gram, return_counts=True)
        squares = np.bincount(key // kinds, times.astype(float) ** 2, n)
        place = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        hit = self.grams[place] == code
        counts = np.bincount(owner[hit] * len(self.grams) + place[hit], minlength=n * len(self.grams)).reshape(n, -1)
        cosine = (counts.astype(float) @ self.weights) / np.sqrt(squares[:, None] * self.norms[None, :])
        return np.stack([cosine[:, i].max(axis=1) for i in self.of], axis=1)


def likened(df: DataFrame, known: DataFrame) -> DataFrame:
    """``df`` with ``scores``: the best cosine of its ``label`` with each role of ``known`` (role, label), as an array of (score, role)
    without those that are 0. The vocabulary is fixed and small, so that it may go to all tasks."""
    like = Likeness([(r["role"], r["label"]) for r in known.select("role", "label").collect()])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = like.scores(batch.column("label").to_pylist())
            row, role = np.nonzero(best > 0)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(best)))]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(best[row, role]), pa.array([like.roles[i] for i in role.tolist()], pa.string())], names=["score", "role"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pairs)], names=[*names, "scores"])

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", scores array<struct<score:double,role:string>>")


def cosines(labels: DataFrame, known: DataFrame) -> DataFrame:
    """(label, role, score): the best cosine of each label with each role's known labels."""
    return likened(labels.select("label").distinct(), known).select("label", F.explode("scores").alias("s")).select("label", "s.role", "s.score")


def classify(labels: DataFrame, column: str = "label") -> DataFrame:
    """(label, role, score, method) of each distinct text of ``column``. Texts are
    classified once each, however often they occur, where the shuffle of distinct texts has put them."""
    known = vocabulary(labels.sparkSession)
    distinct = labels.select(F.col(column).alias("text")).where("text is not null").distinct()
    # a label may be an alias of one role only
    alias = known.where("alias").groupBy("label").agg(F.min("role").alias("alias"))
    c = likened(distinct.withColumn("label", normalize_label(F.col("text"))), known).withColumn("best", F.array_max("scores")).join(F.broadcast(alias), "label", "left")
    score = F.coalesce(F.col("best.score"), F.lit(0.0))
    return c.select(
        "text",
        "label",
        F.when(F.col("alias").isNotNull(), F.col("alias")).when(score >= LOW, F.col("best.role")).alias("role"),
        F.when(F.col("alias").isNotNull(), F.lit(0.99)).when(score >= HIGH, F.least(F.lit(0.97), F.round(score, 3))).otherwise(F.round(score, 3)).alias("score"),
        F.when(F.col("alias").isNotNull(), "alias").when(score >= HIGH, "semantic").when(score >= LOW, "review").otherwise("unknown").alias("method"),
    )
