"""Evaluation, usage and latency metrics. Ratios come with exact numerators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(a: Column, b: Column) -> Column:
    """Ratio to four decimals; null without a denominator."""
    return F.when(b != 0, F.round(a / b, 4))


def row_overlap(first1: Column, last1: Column, first2: Column, last2: Column) -> Column:
    """Common rows of two ranges."""
    return F.greatest(F.lit(0), F.least(last1, last2) - F.greatest(first1, first2) + 1)


def latency(df: DataFrame, key: str, value: str) -> DataFrame:
    """Median to two decimals, and the discrete 95th percentile: the value at place
    ``max(1, int(0.95 n))`` in order. Values are counted before they are ordered, so that
    one key's many rows never meet in one task's memory."""
    c = df.groupBy(key, value).agg(F.count("*").alias("n"))
    up = Window.partitionBy(key).orderBy(value)
    c = c.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy(key)))
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col(value)))
    n = F.col("all")
    return c.groupBy(key).agg(
        F.max("all").alias("n"),
        F.round((at(F.expr("(all + 1) div 2")) + at(F.expr("(all + 2) div 2"))) / 2, 2).alias("p50"),
        at(F.greatest(F.floor(n * 95 / 100), F.lit(1))).alias("p95"),
    )


def usage_cost(df: DataFrame, key: str, input_rate: int, cached_rate: int, output_rate: int) -> DataFrame:
    """Cost of calls in millionths of a hundredth-rate unit; null if a call is not reported.
    Cached tokens are part of the input, and no more than it."""
    cached = F.least("cached", "input")
    cost = (F.col("input") - cached) * input_rate + cached * cached_rate + F.col("output") * output_rate
    return df.groupBy(key).agg(F.count("*").alias("calls"), F.sum("input").alias("input"), F.sum(cached).alias("cached"), F.sum("output").alias("output"), F.when(F.count("output") == F.count("*"), F.sum(cost)).alias("cost"))


def concurrency(df: DataFrame, start: str, end: str) -> DataFrame:
    """(at, running): how many spans run from each moment on at which that changes."""
    marks = df.select(F.col(start).alias("at"), F.lit(1).alias("d")).unionByName(df.select(F.col(end).alias("at"), F.lit(-1).alias("d"))).groupBy("at").agg(F.sum("d").alias("d"))
    # moments are summed by day first; the running total over days is a short window
    marks = marks.withColumn("day", F.date_trunc("day", "at"))
    days = marks.groupBy("day").agg(F.sum("d").alias("s"))
    before = days.withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("day", "before")
    run = F.sum("d").over(Window.partitionBy("day").orderBy("at"))
    return marks.withColumn("run", run).join(before, "day").select("at", (F.col("before") + F.col("run")).cast("long").alias("running"))


def sessions(df: DataFrame, key: str, ts: str, gap_s: int) -> DataFrame:
    """Spans of activity of each key, ended by ``gap_s`` seconds of silence."""
    w = Window.partitionBy(key).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(w) > gap_s * 1_000_000).cast("long"), F.lit(0))
    d = df.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return d.groupBy(key, "session").agg(F.min(ts).alias("began"), F.max(ts).alias("ended"), F.count("*").alias("n"))


def error_class(message: Column) -> Column:
    """Code of a failure by its message."""
    m = F.upper(message)
    return F.when(m.contains("TIMEOUT") | m.contains("TIMED OUT"), "timeout").when(m.contains("CERTIFICATE"), "certificate").when(m.contains("SSL") | m.contains("TLS") | m.contains("EOF"), "tls").when(m.contains("NAME OR SERVICE") | m.contains("DNS"), "dns").when(m.contains("QUOTA"), "quota").when(m.contains("429"), "rate").otherwise("connection")
