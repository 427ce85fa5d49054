"""Annotations that a model gives in pieces: fields quoted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import REQUISITES


def collect_quotes(quotes: DataFrame) -> DataFrame:
    """(doc_id, field, value, cell, conflict) of quotes (doc_id, batch, place, field, value, cell): the first one by batch and place
    counts, and any other value is a conflict. The state of a field is one quote and two values, so that
    the same aggregation runs over a table and, with its state kept by Spark, over a stream."""
    first = F.min_by(F.struct("value", "cell"), F.struct("batch", "place"))
    found = quotes.groupBy("doc_id", "field").agg(first.alias("first"), F.min("value").alias("least"), F.max("value").alias("most"))
    return found.select("doc_id", "field", F.col("first.value").alias("value"), F.col("first.cell").alias("cell"), (F.col("least") != F.col("most")).alias("conflict"))


def annotate(documents: DataFrame, collected: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(doc_id, field, state, value, cell) of every known field of each document (doc_id): ``pending`` where its quotes differ, ``found``,
    or ``missing``. ``explicit`` fields (doc_id, field, value, cell), that stand in the source by rule, fill in where there is no quote. Quotes of
    fields that nobody knows are reported by ``unknown_quotes`` and are no fields."""
    q = collected.where(F.col("field").isin(*REQUISITES)).withColumn("rank", F.lit(0))
    if explicit is not None:
        q = q.unionByName(explicit.select("doc_id", "field", "value", "cell", F.lit(False).alias("conflict"), F.lit(1).alias("rank")))
    best = q.groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "cell", "conflict"), "rank").alias("q"))
    every = documents.select("doc_id", F.explode(F.array(*map(F.lit, REQUISITES))).alias("field")).join(best, ["doc_id", "field"], "left")
    state = F.when(F.col("q").isNull(), "missing").when(F.col("q.conflict"), "pending").otherwise("found")
    kept = state == "found"
    return every.select("doc_id", "field", state.alias("state"), F.when(kept, F.col("q.value")).alias("value"), F.when(kept, F.col("q.cell")).alias("cell"))


def unknown_quotes(quotes: DataFrame) -> DataFrame:
    """Quotes of fields outside the fixed list: their document breaks the schema."""
    return quotes.where(~F.coalesce(F.col("field").isin(*REQUISITES), F.lit(False)))


def annotation_issues(fields: DataFrame) -> DataFrame:
    """(doc_id, issues) of annotated fields: a conflict is one issue however many fields have it."""
    return fields.groupBy("doc_id").agg(F.when(F.bool_or(F.col("state") == "pending"), F.array(F.lit("E_FIELD_CONFLICT"))).otherwise(F.array().cast("array<string>")).alias("issues"))
