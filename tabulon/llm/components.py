"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of each node of ``edges`` (a, b); the component is its least node.

    Each round sends every node's greater neighbours, then its smaller ones, to the least
    neighbour; the rounds, logarithmic in number, end when the edges stay as they are.
    Least neighbours are summed before they are shuffled and written before they are
    joined, so that both sides of the join are plain exchanges, which Spark splits where
    one node has very many edges. Null ends and loops are ignored; no edge, no row."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, name)
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, name)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), name)
        # each smaller neighbour, and the node itself, goes to the least one
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        e = materialize(small, name)
        now = _state(e)
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]
