"""Rule extraction: header mappings, items, requisites, cost matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import matrix_number, numeric_quote, parse_number, strip
from ..functions.text import currency_code, label_value, maybe_known, normalize_label
from .cells import REQUISITES, ROW, SUMMARY, cell_roles, spread

ROLES = ("name", "quantity", "unit", "unitPrice", "lineTotal")
VARIANT = r"(?iu)вариант|опция|variant|option"
HEADER = "name_col is not null and (quantity_col is not null or unitPrice_col is not null or lineTotal_col is not null)"


def header_mapping(cells: DataFrame) -> DataFrame:
    """(doc_id, block, row, <role>_col ...) of header rows: a name column and one of
    quantity, price or total. Of several columns with one role the first counts."""
    roles = cell_roles(cells)
    c = cells.where("kind = 'table'").join(roles, "text")
    rows = c.groupBy(*ROW).agg(*[F.min(F.when(F.col("role") == r, F.col("col"))).alias(f"{r}_col") for r in ROLES])
    return rows.where(HEADER)


def ruled_rows(cells: DataFrame, mapping: DataFrame | None = None, roles: DataFrame | None = None, placed: bool = False) -> DataFrame:
    """Rows (doc_id, block, row, cells, <role>_col ...) with the mapping that rules them: the last header above, unless a total
    row ended it. Cells are gathered to rows once; headers and totals are found where the rows are. ``roles`` are the ``cell_roles``, if they are there already; cells that are
    ``placed`` lie by ``doc_id`` and stay there."""
    c = cells.select(*ROW, "col", "text", "kind")
    c = (c if placed else spread(c)).withColumn("total", strip(F.col("text")).rlike(SUMMARY))
    found = []
    if mapping is None:
        c = c.join(cell_roles(cells) if roles is None else roles, "text", "left")
        found = [F.min(F.when((F.col("kind") == "table") & (F.col("role") == r), F.col("col"))).alias(f"{r}_col") for r in ROLES]
    rows = c.groupBy(*ROW).agg(F.bool_or("total").alias("total"), F.collect_list(F.struct("col", "text")).alias("cells"), *found)
    if mapping is None:
        rows = rows.withColumn("header", F.when(F.expr(HEADER), F.col("row")))
    else:
        rows = rows.join(mapping.withColumn("header", F.col("row")), list(ROW), "left")
    order = Window.partitionBy("doc_id", "block").orderBy("row")
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("last_header", F.last("header", ignorenulls=True).over(up)).withColumn("last_total", F.last(F.when(F.col("total") & F.col("header").isNull(), F.col("row")), ignorenulls=True).over(up))
    own = F.when(F.col("header").isNotNull(), F.struct(*[f"{r}_col" for r in ROLES]))
    rows = rows.withColumn("ruled", F.last(own, ignorenulls=True).over(up))
    live = F.col("last_header").isNotNull() & F.col("header").isNull() & (F.col("last_total").isNull() | (F.col("last_total") < F.col("last_header")))
    return rows.where(live).select(*ROW, "cells", "ruled.*")


def item_rows(cells: DataFrame, mapping: DataFrame | None = None, roles: DataFrame | None = None, placed: bool = False) -> DataFrame:
    """Items: each ruled row's texts are looked up by its mapping, and numbers are null
    where a text is none."""
    at = lambda r: F.array_max(F.transform(F.filter("cells", lambda c: c["col"] == F.col(f"{r}_col")), lambda c: c["text"]))
    rows = ruled_rows(cells, mapping, roles, placed).select(*ROW, *[at(r).alias(r) for r in ROLES])
    rows = rows.where(F.col("name").isNotNull() & (strip(F.col("name")) != "") & parse_number(F.col("name")).isNull())
    return rows.select(*ROW, "name", "unit", parse_number(F.col("quantity")).alias("quantity"), parse_number(F.col("unitPrice")).alias("unit_price"), parse_number(F.col("lineTotal")).alias("line_total"))


def requisites(cells: DataFrame) -> DataFrame:
    """(doc_id, field, value, row, col): labelled values, in one cell or in its right
    neighbour. The longest label wins in a cell."""
    order = Window.partitionBy(*ROW).orderBy("col")
    # of three cells in a row each sees two others at least
    c = cells.select(*ROW, "col", "text").withColumn("next", F.lead("text").over(order)).withColumn("narrow", F.count("*").over(order.rowsBetween(-2, 2)) <= 2)
    # a fixed vocabulary of some 45 rows; of two fields with one label the longer word decides
    rows = [(f, n.lower(), len(n)) for f, v in REQUISITES.items() for n in v]
    names = cells.sparkSession.createDataFrame(rows, "field string, name string, n int").select("field", "n", normalize_label(F.col("name")).alias("key"))
    names = names.groupBy("key").agg(F.max_by("field", F.struct("n", "field")).alias("field"))
    c = c.where(maybe_known(F.col("text"), [n for _, n, _ in rows]))
    label, value = label_value(F.col("text"))
    c = c.withColumn("label", label).withColumn("own", value).withColumn("key", normalize_label(F.coalesce("label", "text")))
    c = c.join(F.broadcast(names), "key").withColumn("value", strip(F.coalesce("own", F.when(F.col("label").isNull() & F.col("narrow"), F.col("next")))))
    return c.where("value <> ''").select("doc_id", "field", "value", "block", "row", "col")


def first_values(fields: DataFrame) -> DataFrame:
    """One row for each field: the first value in document order, and how many differ."""
    place = F.struct("block", "row", "col")
    return fields.groupBy("doc_id", "field").agg(F.min_by("value", place).alias("value"), F.count_distinct(F.lower(F.trim("value"))).alias("n_values"))


def unknown_fields(cells: DataFrame, limit: int = 100) -> DataFrame:
    """Labelled values under no known label, at most ``limit`` a document, each pair once."""
    label, value = label_value(F.col("text"))
    known = [n for v in REQUISITES.values() for n in v]
    c = cells.where("kind = 'text'").select("doc_id", "block", "row", "col", label.alias("label"), value.alias("value"))
    c = c.where("label is not null and value is not null").where(~normalize_label(F.col("label")).isin(*[n.lower().replace("-", " ") for n in known]))
    c = c.where((F.length("value") <= 2000) & parse_number(F.col("label")).isNull() & ~F.col("label").rlike(r"^\s*[0-9]"))
    c = c.where(F.size(F.split("label", ",")) < 3).where(~F.contains("label", F.lit(",")) | (F.size(F.split("label", r"\s+")) < 4))
    c = c.groupBy("doc_id", "label", "value").agg(F.min(F.struct("block", "row", "col")).alias("at"))
    return c.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).where(F.col("n") <= limit).select("doc_id", "label", "value", F.col("n").cast("long").alias("n"))


def header_paths(headers: DataFrame) -> DataFrame:
    """(doc_id, block, col, path) from header cells (doc_id, block, row, col, colspan, text):
    the texts above each column, from the top, each once; a variant's text also stands for
    the blank cells to its right until another text. Header cells are shuffled once, by document."""
    spread = headers.repartition("doc_id").select("doc_id", "block", "row", F.explode(F.expr("sequence(col, col + greatest(colspan, 1) - 1)")).alias("col"), strip(F.col("text")).alias("text"))
    order = Window.partitionBy(*ROW).orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("text") != "", F.col("text")), ignorenulls=True).over(order)
    spread = spread.withColumn("text", F.when(F.col("text") != "", F.col("text")).when(seen.rlike(VARIANT), seen))
    return spread.where("text is not null").groupBy("doc_id", "block", "col").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("row", "text"))), lambda x: x["text"])), " / ").alias("path"))


def price_matrix(cells: DataFrame, paths: DataFrame, first_row: int = 2) -> DataFrame:
    """One component for each numeric cell beyond the first column, labelled by its header path. Numbers and names are gathered to
    rows once, and paths meet them by document."""
    col, t = F.col("col"), strip(F.col("text"))
    value = F.when((F.col("row") >= first_row) & (col > 1), matrix_number(F.col("text")))
    c = cells.dropna(subset=list(ROW)).select(*ROW, "col", value.alias("value"), F.when(col == 1, t).alias("name"))
    c = c.where(F.col("value").isNotNull() | ((F.col("name") != "") & ~F.col("name").rlike(SUMMARY)))
    # a window, as an aggregate would pack and unpack each list
    rows = c.withColumn("names", F.collect_list("name").over(Window.partitionBy(*ROW))).where("value is not null and size(names) > 0")
    above = paths.groupBy("doc_id").agg(F.collect_list(F.struct("block", "col", "path")).alias("above"))
    j = rows.drop("name").join(above, "doc_id").select(*ROW, "col", F.explode("names").alias("name"), "value", "above")
    here = F.filter("above", lambda p: (p["block"] == F.col("block")) & (p["col"] == F.col("col")))
    return j.select(*ROW, "col", "name", F.explode(here).alias("p"), "value").select(*ROW, "col", "name", F.col("p.path").alias("component"), "value")


def variant_totals(cells: DataFrame, paths: DataFrame) -> DataFrame:
    """Totals of each variant: the numeric cells of the best total row of a block - grand
    totals before totals before other summaries, then the lowest."""
    t = strip(F.lower(F.col("text")))
    rank = F.when(t.rlike("^(?:итого к оплате|всего к оплате|grand total)"), 3).when(t.rlike("^(?:итого|всего|total)"), 2).when(t.rlike(SUMMARY), 1)
    rows = cells.groupBy(*ROW).agg(F.max(rank).alias("rank")).where("rank is not null")
    best = rows.groupBy("doc_id", "block").agg(F.max_by("row", F.struct("rank", "row")).alias("row"))
    return cells.join(best, list(ROW)).withColumn("value", matrix_number(F.col("text"))).where("value is not null").join(paths, ["doc_id", "block", "col"]).select(*ROW, "col", F.col("path").alias("variant"), "value")


def alternatives(header: Column) -> Column:
    """Whether a header offers alternatives: a variant, several currencies, or prices with and without VAT."""
    codes = F.array_distinct(F.transform(F.regexp_extract_all(header, F.lit(r"(?iu)(₽|руб|rub|₸|тенге|kzt|\$|usd|€|eur)"), F.lit(1)), lambda m: currency_code(m)))
    low = F.lower(header)
    return header.rlike(VARIANT) | (F.size(codes) > 1) | (low.rlike("с ндс|including vat") & low.rlike("без ндс|excluding vat"))


def price_on_request(text: Column) -> Column:
    """Whether a text says that a price is not fixed yet."""
    return text.rlike(r"(?iu)(?:цена|стоимость|price|cost)[^\n]{0,60}(?:по запросу|договорн|уточня|on request|negotiable|tbd)")


def execute_plan(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """Items by a given plan (doc_id, block, first, last, name_col, quantity_col, price_col,
    total_col; 0: absent) over all rows of its ranges. Rows without a name are left out."""
    hit = (cells.doc_id == plan.doc_id) & (cells.block == plan.block) & cells.row.between(plan["first"], plan["last"])
    c = cells.join(plan.select("doc_id", "block", "first", "last", "name_col", "quantity_col", "price_col", "total_col"), hit).select(cells.doc_id, cells.block, "row", "col", "text", "name_col", "quantity_col", "price_col", "total_col")
    pick = lambda name: F.max(F.when(F.col("col") == F.col(name), F.col("text")))
    rows = c.groupBy(*ROW).agg(pick("name_col").alias("name"), pick("quantity_col").alias("q"), pick("price_col").alias("p"), pick("total_col").alias("t"))
    rows = rows.where(F.col("name").isNotNull() & (strip(F.col("name")) != "") & numeric_quote(F.col("name")).isNull() & ~strip(F.col("name")).rlike(SUMMARY))
    return rows.select(*ROW, "name", numeric_quote(F.col("q")).alias("quantity"), numeric_quote(F.col("p")).alias("unit_price"), numeric_quote(F.col("t")).alias("line_total"))


def merge_items(rules: DataFrame, plan: DataFrame) -> DataFrame:
    """Rule and plan items by row: blanks of the plan are filled, its value wins a
    disagreement, which is flagged; rows of one side stay."""
    r, p = rules.alias("r"), plan.alias("p")
    same = [F.col(f"r.{k}") == F.col(f"p.{k}") for k in ROW]
    j = r.join(p, same, "full_outer")
    nums = ("quantity", "unit_price", "line_total")
    conflict = F.lit(False)
    for n in nums:
        conflict = conflict | F.coalesce(F.col(f"r.{n}") != F.col(f"p.{n}"), F.lit(False))
    origin = F.when(F.col("p.doc_id").isNull(), "rules").when(F.col("r.doc_id").isNull(), "plan").otherwise("both")
    return j.select(*[F.coalesce(f"p.{k}", f"r.{k}").alias(k) for k in (*ROW, "name", *nums)], conflict.alias("conflict"), origin.alias("origin"))
