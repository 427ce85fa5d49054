"""Evaluation and release: flat values, audits, reports, exports, routing and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_cell
from .cells import ROW


def flatten(df: DataFrame, key: str, fields: tuple) -> DataFrame:
    """(key, path, value) of the fields that are not null, values as text."""
    each = F.array(*[F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias("value"))) for f in fields])
    return df.select(key, F.explode(F.array_compact(each)).alias("leaf")).select(key, "leaf.path", "leaf.value")


def format_audit(expected: DataFrame, actual: DataFrame, key: str, group: str) -> DataFrame:
    """Expected values (key, group, path, value) against actual ones (key, path, value; one
    for each path): by group, how many are right, different and absent."""
    a = actual.select(key, "path", F.col("value").alias("got"), F.lit(True).alias("found"))
    j = expected.join(a, [key, "path"], "left")
    right = F.col("found") & F.col("value").eqNullSafe(F.col("got"))
    return j.groupBy(group).agg(F.count("*").alias("fields"), F.count_if(right).alias("correct"), F.count_if(F.col("found") & ~right).alias("different"), F.count_if(F.col("found").isNull()).alias("absent"))


def document_report(results: DataFrame, group: str) -> DataFrame:
    """Results (group, valid, predicted, grounded, ms) by group: share of valid documents, share
    of predicted fields without a source, mean seconds. Fields of invalid ones do not count."""
    r = results.groupBy(group).agg(F.count("*").alias("documents"), F.count_if(~F.col("valid")).alias("invalid"), F.sum(F.when(F.col("valid"), F.col("predicted"))).alias("p"), F.sum(F.when(F.col("valid"), F.col("grounded"))).alias("g"), F.avg("ms").alias("ms"))
    return r.select(group, "documents", "invalid", F.round(1 - F.col("invalid") / F.col("documents"), 6).alias("valid_rate"), F.round(1 - F.try_divide("g", "p"), 6).alias("unsupported_rate"), F.round(F.col("ms") / 1000, 6).alias("mean_seconds"))


def export_labels(auto: DataFrame, reviewed: DataFrame, partition: DataFrame, excluded: DataFrame, key: str, fields: tuple) -> DataFrame:
    """Labels for training: a human's value replaces the automatic one, excluded documents and
    those without a split are left out, and each row says where it comes from."""
    h = reviewed.select(key, *[F.col(f).alias(f"__human_{f}") for f in fields], F.lit(True).alias("__human"))
    j = auto.select(key, *fields).join(h, key, "full_outer").join(partition.select(key, "split"), key).join(excluded.select(key), key, "left_anti")
    human = F.col("__human").isNotNull()
    return j.select(key, "split", *[F.when(human, F.col(f"__human_{f}")).otherwise(F.col(f)).alias(f) for f in fields], F.when(human, "human").otherwise("auto").alias("origin"))


def unchanged(items: DataFrame, original: DataFrame, fields: tuple) -> DataFrame:
    """``items`` with ``unchanged``: whether the original has a row of the same values, nulls
    and components (as JSON) included."""
    text = lambda df, f: F.to_json(F.col(f)) if df.schema[f].dataType.typeName() in ("array", "struct", "map") else F.col(f)
    o = original.select(*[text(original, f).alias(f"__o{i}") for i, f in enumerate(fields)]).distinct().withColumn("__seen", F.lit(True))
    same = [text(items, f).eqNullSafe(F.col(f"__o{i}")) for i, f in enumerate(fields)]
    return items.join(o, same, "left").select(*[F.col(f"`{c}`") for c in items.columns], F.col("__seen").isNotNull().alias("unchanged"))


def corpus_fingerprint(df: DataFrame, key: str, *groups: str) -> DataFrame:
    """A digest of the distinct ids, whatever their order and layout: their number and the
    exclusive or of 120 bits of each id's SHA-256, folded before the shuffle."""
    h = F.sha2(F.col(key).cast("string"), 256)
    part = lambda at: F.bit_xor(F.conv(F.substring(h, at, 15), 16, 10).cast("long"))
    return df.select(key, *groups).distinct().groupBy(*groups).agg(F.count("*").alias("n"), part(1).alias("high"), part(16).alias("low"))


def frozen_changes(frozen: DataFrame, now: DataFrame, *groups: str) -> DataFrame:
    """Groups whose fingerprint is not the frozen one, new and lost groups included."""
    digest = F.struct("n", "high", "low")
    none = F.lit(None).cast("struct<n:bigint,high:bigint,low:bigint>")
    both = frozen.select(*groups, digest.alias("was"), none.alias("is")).unionByName(now.select(*groups, none.alias("was"), digest.alias("is")))
    return both.groupBy(*groups).agg(F.max("was").alias("was"), F.max("is").alias("is")).where(~F.col("was").eqNullSafe(F.col("is"))).drop("was", "is")


def item_issues(name: Column, numbers: dict[str, Column], conflict: Column) -> Column:
    """What keeps an item from being saved: a blank name, a number that is negative or
    not finite, an open conflict."""
    bad = lambda v: F.coalesce(F.isnan(v) | (v < 0) | (v == F.lit(float("inf"))), F.lit(False))
    each = [F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "name")] + [F.when(bad(v.cast("double")), k) for k, v in numbers.items()]
    return F.array_compact(F.array(*each, F.when(conflict, "conflict")))


def path_inside(path: Column) -> Column:
    """Whether a relative path cannot leave its folder: not blank or absolute, no drive, no
    parent segment, no control character. (Links are for the store to resolve.)"""
    return F.coalesce((path != "") & ~path.rlike(r"^(?:[/\\]|[A-Za-z]:)|(?:^|[/\\])\.\.(?:[/\\]|$)|[\x00-\x1f]"), F.lit(False))


def library(df: DataFrame, name: str, part: str, status: str | None = None) -> DataFrame:
    """Rows whose name has ``part`` in any case, and the status if one is given."""
    found = df.where(F.contains(F.lower(name), F.lit(part.lower())))
    return found if status is None else found.where(F.col("status") == status)


def missing_pages(requested: Column, processed: Column) -> Column:
    return F.array_except(F.coalesce(requested, F.array()), F.coalesce(processed, F.array()))


# When a page's text layer is not enough.
SPARSE, WIDE, ROWS, CHUNKS, FEW, DIGITS = 20, 6, 3, 6, 3, 4


def page_routes(cells: DataFrame) -> DataFrame:
    """(doc_id, reasons): why a document needs to be seen and not only read, comma-joined."""
    text = clean_cell(F.col("text"))
    rows = cells.groupBy(*ROW).agg(
        F.count("*").alias("n"), F.count_if(text.rlike("[0-9]")).alias("digits"), F.sum(F.length(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}]", ""))).alias("alnum"),
        F.bool_or(F.contains(text, F.lit("\ufffd"))).alias("damaged"), F.bool_or(F.col("kind") == "table").alias("table"),
    )
    d = rows.groupBy("doc_id").agg(
        F.sum("alnum").alias("alnum"), F.bool_or("damaged").alias("damaged"), F.count_distinct(F.when(F.col("table"), F.col("block"))).alias("tables"), F.bool_or(F.col("table") & (F.col("n") > WIDE)).alias("wide"),
        F.count_if(F.col("n") >= CHUNKS).alias("long"), F.count_if(F.col("n") >= FEW).alias("some"), F.sum(F.when(F.col("n") >= FEW, F.col("digits")).otherwise(0)).alias("digits"),
    )
    why = {"sparse": F.col("alnum") < SPARSE, "damaged": F.col("damaged"), "tables": F.col("tables") > 1, "wide": F.col("wide"), "chunks": F.col("long") >= ROWS, "figures": (F.col("some") >= ROWS) & (F.col("digits") >= DIGITS)}
    return d.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(v, k) for k, v in why.items()])), ",").alias("reasons"))


def accepted_blocks(cells: DataFrame) -> DataFrame:
    """(doc_id, has_text, has_table, n_mixed, accepted): whether a document has text and table blocks, and how many blocks have cells of both kinds; a mixed document is
    accepted if it has both and no block is shared. Cells of a null kind are of neither. Two aggregations of which the first is on a refinement of the second's key."""
    b = cells.groupBy("doc_id", "block").agg(F.count_if(F.col("kind") == "text").alias("t"), F.count_if(F.col("kind") == "table").alias("g"))
    text, grid = F.coalesce(F.bool_or(F.col("t") > 0), F.lit(False)), F.coalesce(F.bool_or(F.col("g") > 0), F.lit(False))
    d = b.groupBy("doc_id").agg(text.alias("has_text"), grid.alias("has_table"), F.count_if((F.col("t") > 0) & (F.col("g") > 0)).alias("n_mixed"))
    return d.withColumn("accepted", F.col("has_text") & F.col("has_table") & (F.col("n_mixed") == 0))
