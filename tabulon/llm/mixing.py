"""Mixing sources to target weights by temperature.

A source's weight is its token count to the power of an exponent, normalised. The
exponent is bisected: as near to 1 (natural shares) as the wanted entropy of the
weights allows, and no lower than the limit on repetitions allows. The weights, times
the budget, are realised as block permutations: a seeded hash orders each source's
documents, its leading bits name ``BLOCKS`` blocks of that order; whole passes over a
source come first, then the longest head of the permutation that fits the rest of its
budget.

Neither sources nor documents reach the driver. Sums by source and block are small;
bisection passes evaluate all midpoints that ``DEEP`` bisections can reach in one
aggregation; where a source's head ends is found inside one block, and every document
then compares its own key with that end, so that texts are never shuffled.

Defined results: tokens are words; null text has none; null sources form one source;
a source without tokens keeps each document once; equal ids are ordered by text;
repeated rows count and are dealt one by one; an empty table gives an empty result;
``mix`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, words

BLOCK_BITS = 12
DEEP, PASSES = 6, 8


@dataclass(frozen=True)
class Target:
    #: Entropy of the weights, as a share of the most that the sources allow.
    entropy_share: float = 0.95
    #: No source is repeated more often than this on average.
    max_repeats: float = 4.0
    #: Tokens of the mix; None: as many as the corpus has.
    budget: int | None = None
    #: The budget at which the largest source appears exactly once, in place of ``budget``.
    whole: bool = False
    seed: int = 17


def _key(doc_id: Column, seed: int) -> Column:
    """A hash of 32 bits that SQL engines share: the head of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("long")


def exponent(totals: DataFrame, target: Target) -> dict:
    """Exponent and normalisers, from a table (source, tokens) without empty sources."""
    top = totals.agg(F.max("tokens").alias("top"), F.min("tokens").alias("low"), F.sum("tokens").alias("all"), F.count("*").alias("n")).first()
    if not top["n"]:
        return {"alpha": 1.0, "z": 1.0, "top": 1, "budget": 0.0}
    x_low = top["low"] / top["top"]
    want = target.entropy_share * math.log(top["n"])

    def sums(alphas: list[float]) -> dict:
        grid = totals.select((F.col("tokens") / F.lit(top["top"])).alias("x"), F.explode(F.array(*map(F.lit, alphas))).alias("a"))
        rows = grid.groupBy("a").agg(F.sum(F.pow("x", "a")).alias("z"), F.sum(F.pow("x", "a") * F.log("x")).alias("s")).collect()
        return {r["a"]: (r["z"], r["s"]) for r in rows}

    def budget(z: float) -> float:
        return top["top"] * z if target.whole else float(target.budget if target.budget is not None else top["all"])

    def even(a: float, z: float, s: float) -> bool:
        return math.log(z) - a * s / z >= want

    def scarce(a: float, z: float, s: float) -> bool:
        return x_low ** (a - 1) * budget(z) / (top["top"] * z) <= target.max_repeats

    def bisect(left: bool, holds) -> float:
        lo, hi = 0.0, 1.0
        ends = sums([0.0, 1.0])
        if left and holds(1.0, *ends[1.0]) or not left and not holds(1.0, *ends[1.0]):
            return 1.0
        if left and not holds(0.0, *ends[0.0]) or not left and holds(0.0, *ends[0.0]):
            return 0.0
        for _ in range(PASSES):
            step = (hi - lo) / 2**DEEP
            got = sums([lo + i * step for i in range(1, 2**DEEP)])
            points = sorted(got)
            a, b = 0, 2**DEEP
            while b - a > 1:
                mid = (a + b) // 2
                if holds(points[mid - 1], *got[points[mid - 1]]) == left:
                    a = mid
                else:
                    b = mid
            lo, hi = lo + a * step, lo + b * step
        return lo if left else hi

    alpha = max(bisect(True, even), bisect(False, scarce))
    z = sums([alpha])[alpha][0]
    return {"alpha": alpha, "z": z, "top": top["top"], "budget": budget(z)}


def plan(df: DataFrame, target: Target, *, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, Column, Column, Column, Column]:
    """A table with a row for each source (weight, passes, end of its head), and the
    columns of ``df`` that it is compared with: source, tokens, block, key."""
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    tokens = F.size(words(F.col(f"`{text_col}`"))).cast("long")
    hashed = _key(F.col(f"`{id_col}`"), target.seed)
    block = F.shiftright(hashed, 32 - BLOCK_BITS).cast("int")
    key = F.struct(hashed.alias("h"), F.col(f"`{id_col}`").alias("i"), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")).alias("t"))
    blocks = materialize(df.select(source.alias("source"), block.alias("block"), tokens.alias("n")).groupBy("source", "block").agg(F.sum("n").alias("n")), "mixing-blocks")
    totals = blocks.groupBy("source").agg(F.sum("n").alias("tokens"))
    full = materialize(totals.where("tokens > 0"), "mixing-sources")
    got = exponent(full, target)
    weight = F.pow(F.col("tokens") / F.lit(got["top"]), F.lit(got["alpha"])) / F.lit(got["z"])
    quota = F.floor(weight * F.lit(float(got["budget"])) + F.lit(1e-6)).cast("long")
    shares = full.withColumn("weight", weight).withColumn("quota", quota)
    shares = shares.withColumn("passes", F.expr("quota div tokens")).withColumn("rest", F.expr("quota % tokens"))
    # the block in which the head ends: the first whose end lies beyond the rest
    ends = blocks.join(shares, "source").withColumn("end", F.sum("n").over(Window.partitionBy("source").orderBy("block")))
    edge = ends.where("end > rest").groupBy("source").agg(F.min_by(F.struct(F.col("block"), (F.col("rest") - F.col("end") + F.col("n")).alias("left")), "block").alias("e")).select("source", F.col("e.block").alias("edge"), F.col("e.left").alias("left"))
    edge = materialize(edge, "mixing-edges")
    inside = df.select(source.alias("source"), tokens.alias("n"), block.alias("block"), key.alias("key")).join(edge.withColumnRenamed("edge", "block"), ["source", "block"])
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("so_far", so_far).where("so_far <= left").groupBy("source").agg(F.max("key").alias("last"))
    table = materialize(shares.join(edge.select("source", "edge"), "source", "left").join(last, "source", "left"), "mixing-plan")
    return table, source, tokens, block, key


def copies_of(df: DataFrame, target: Target, *, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Rows (row, source, n_tokens, block, weight, copies): ``row`` holds the columns of ``df``."""
    table, source, tokens, block, key = plan(df, target, id_col=id_col, text_col=text_col, source_col=source_col)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), source.alias("source"), tokens.alias("n_tokens"), block.alias("block"), key.alias("key"))
    joined = rows.join(table.select("source", "weight", "passes", "edge", "last"), "source", "left")
    head = (F.col("block") < F.col("edge")) | ((F.col("block") == F.col("edge")) & (F.col("key") <= F.col("last")))
    copies = F.when(F.col("passes").isNull(), F.lit(1)).otherwise(F.col("passes") + F.coalesce(head, F.lit(False)).cast("int")).cast("long")
    return joined.select("row", "source", "n_tokens", "block", "weight", copies.alias("copies"))


def mix(df: DataFrame, target: Target = Target(), *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the mix has it."""
    found = copies_of(df, target, id_col=id_col, text_col=text_col, source_col=source_col).where("copies > 0")
    return found.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = copies_of(docs, Target(), id_col="doc_id", text_col="text", source_col="source")
    return out.select("row.doc_id", "source", "n_tokens", F.col("block").cast("long").alias("block"), "copies")


#: The same rows in DuckDB.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, md5(coalesce(text, '')) AS t,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_tokens,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0),
x AS (SELECT source, tokens, tokens / (SELECT max(tokens) FROM s)::DOUBLE AS x FROM s),
k AS (SELECT count(*) AS n, sum(tokens)::DOUBLE AS budget, max(tokens)::DOUBLE AS top, min(x) AS low FROM x),
e AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END
  FROM (SELECT i, lo, hi, (SELECT ln(sum(pow(x, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(x, (lo + hi) / 2) * ln(x)) / sum(pow(x, (lo + hi) / 2)) FROM x)
               >= 0.95 * (SELECT ln(n) FROM k) AS ok FROM e WHERE i < 48)),
r AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, (SELECT pow(min(low), (lo + hi) / 2 - 1) * min(budget) / min(top) FROM k) / (SELECT sum(pow(x, (lo + hi) / 2)) FROM x) <= 4.0 AS ok FROM r WHERE i < 48)),
a AS (SELECT greatest(
   (SELECT CASE WHEN (SELECT ln(sum(x)) - sum(x * ln(x)) / sum(x) FROM x) >= 0.95 * (SELECT ln(n) FROM k) THEN 1.0 ELSE (SELECT lo FROM e WHERE i = 48) END),
   (SELECT CASE WHEN (SELECT n * 0 + pow(low, -1) * budget / top / n <= 4.0 FROM k) THEN 0.0 ELSE (SELECT hi FROM r WHERE i = 48) END)) AS alpha),
q AS (SELECT source, tokens, floor(pow(x, alpha) / (SELECT sum(pow(x, alpha)) FROM x, a) * budget + 1e-6)::BIGINT AS quota FROM x, a, k),
p AS (SELECT d.*, tokens, quota, sum(n_tokens) OVER (PARTITION BY d.source ORDER BY h, doc_id, t ROWS UNBOUNDED PRECEDING) AS so_far FROM d LEFT JOIN q ON d.source = q.source)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, (h >> 20)::BIGINT AS block,
       (CASE WHEN tokens IS NULL THEN 1 ELSE quota // tokens + (so_far <= quota % tokens)::INT END)::BIGINT AS copies
FROM p
"""
