"""Checks of what a model claims: typed fields, totals, headers, plans and whole answers.

Claims are rows, and each check adds a state; nothing is repaired. Peers of a cell are the
texts of its row, gathered once for each row that has a claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ALIASES
from ..functions.numbers import numeric_quote, strip
from ..functions.text import normalize_label
from .cells import REQUISITES, ROW, SUMMARY
from .evidence import populated_paths, without_evidence
from .validate import LINE, PER_ITEM, component_conflict, label_tolerance, strict_sum

CELL = (*ROW, "col")
# Legal forms, and names that no item has.
LEGAL = r"(?iu)(?U)\b(?:тоо|ооо|ао|ип|пао|зао|llp|ltd|inc|corp|gmbh|company)\b"
NO_ITEM = r"(?iu)(?U)^(?:итого|всего|ндс|скидка|total|наименование)\b"


def with_peers(claims: DataFrame, cells: DataFrame) -> DataFrame:
    """Claims on a cell with its ``text`` and ``kind`` (null: no such cell) and ``peers``. Cells are shuffled once, to the rows that have a claim; of
    several in one place the first by text counts."""
    one = F.collect_list(F.struct("col", "text", "kind"))
    rows = cells.join(claims.select(*ROW).distinct(), list(ROW), "left_semi").groupBy(*ROW).agg(one.alias("__row"))
    j = claims.join(rows, list(ROW), "left").withColumn("__own", F.array_min(F.filter("__row", lambda c: c["col"] == F.col("col"))))
    peers = F.filter(F.transform("__row", lambda c: c["text"]), lambda t: t.isNotNull())
    return j.select(*claims.columns, F.col("__own.text").alias("text"), F.col("__own.kind").alias("kind"), peers.alias("peers"))


def _opens(text: Column, field: str) -> Column:
    return text.rlike("(?iu)^(?:" + "|".join(REQUISITES[field]) + r")(?:\s*[:=]|\s+|$)")


def fits() -> Column:
    """Whether a claim ``with_peers`` has its field's form. A party must not stand in a row labelled as the other one, and needs a
    label of its own or a legal form; a number must not be an amount without its label."""
    v, peers = strip(F.col("value")), F.col("peers")
    labels = F.array(*[normalize_label(F.lit(x)) for x in REQUISITES["documentNumber"]])
    labelled = F.exists(peers, lambda p: F.array_contains(labels, normalize_label(F.regexp_replace(p, ":+$", ""))))
    number = (F.length(v) <= 64) & v.rlike("[0-9]") & v.rlike(r"(?U)^[\w№/.-]+$") & (numeric_quote(F.col("text")).isNull() | labelled)

    def party(own: str, other: str) -> Column:
        role = F.exists(peers, lambda p: _opens(p, own)) | F.col("value").rlike(LEGAL)
        return ~F.exists(peers, lambda p: _opens(p, other)) & (F.length(v) <= 250) & role

    f = F.col("field")
    form = F.when(f == "documentDate", v.rlike(r"^[0-9]{2}[./-][0-9]{2}[./-][0-9]{4}$")).when(f == "documentNumber", number).when(f == "supplier", party("supplier", "client")).when(f == "client", party("client", "supplier")).otherwise(F.lit(True))
    return F.col("text").isNotNull() & F.coalesce(form, F.lit(False))


def typed_fields(claims: DataFrame, cells: DataFrame) -> DataFrame:
    """Claims (doc_id, block, row, col, field, value) with ``fits``."""
    return with_peers(claims, cells).select(*claims.columns, fits().alias("fits"))


def total_state() -> Column:
    """ok, or why a claim ``with_peers`` and ``alternatives`` is rejected as the document's total."""
    v, whole = numeric_quote(F.col("value")), numeric_quote(F.col("text"))
    in_summary = F.exists("peers", lambda p: strip(p).rlike(SUMMARY))
    return F.when(F.col("text").isNull(), "unknown cell").when(F.col("alternatives"), "alternatives").when(v.isNull() | (v < 0), "no number").when(whole != v, "part of a number").when((F.col("kind") == "table") & ~in_summary, "item row").otherwise("ok")


def document_totals(claims: DataFrame, cells: DataFrame) -> DataFrame:
    """Claims (doc_id, block, row, col, value, alternatives) of the document's total with their state."""
    return with_peers(claims, cells).select(*claims.columns, total_state().alias("state"))


def grounded_headers(claims: DataFrame, headers: DataFrame, paths: DataFrame) -> DataFrame:
    """Labels (doc_id, block, row, col, label, columns) of mapped columns with ``grounded``:
    the label cell exists, spans a mapped column, and says the label - or each part of it
    is a header above one of the columns. A number is no label."""
    h = claims.join(headers.select(*CELL, "colspan", "text"), list(CELL), "left")
    above = paths.groupBy("doc_id", "block").agg(F.map_from_entries(F.collect_list(F.struct("col", F.split("path", " / ")))).alias("above"))
    h = h.join(above, ["doc_id", "block"], "left")
    spans = F.exists("columns", lambda c: c.between(F.col("col"), F.col("col") + F.greatest(F.col("colspan"), F.lit(1)) - 1))
    names = F.transform(F.flatten(F.transform("columns", lambda c: F.coalesce(F.col("above")[c], F.array()))), normalize_label)
    parts = F.array_remove(F.transform(F.split("label", "/"), lambda p: strip(p)), "")
    said = F.contains("text", F.col("label")) | (F.size(parts) > 0) & F.forall(parts, lambda p: F.array_contains(names, normalize_label(p)))
    ok = F.col("text").isNotNull() & (strip(F.col("label")) != "") & numeric_quote(F.col("label")).isNull() & spans & said
    return h.select(*claims.columns, F.coalesce(ok, F.lit(False)).alias("grounded"))


def mapping_state(mapped: Column, reserved: Column, width: Column) -> Column:
    """Whether a plan's columns (arrays; 0: absent) are within the width, distinct, and
    name first of the reserved ones."""
    used = F.filter(F.concat(reserved, mapped), lambda c: c > 0)
    return (reserved[0] >= 1) & (F.array_max(used) <= width) & (F.size(F.array_distinct(used)) == F.size(used))


def explicit_fields(cells: DataFrame) -> DataFrame:
    """(doc_id, field, value): values that stand behind a known label and a colon in one
    cell, unless a document has different ones. A total must be a number."""
    rx = r"^([^:\n]{1,60}):\s*(\S[^\n]*)$"
    names = [(f, x) for f, v in REQUISITES.items() for x in v]
    names = cells.sparkSession.createDataFrame(names, "field string, x string").select("field", normalize_label(F.col("x")).alias("key"))
    names = names.groupBy("key").agg(F.max("field").alias("field"))  # about 45 fixed rows
    c = cells.where(F.col("text").rlike(rx)).select("doc_id", normalize_label(F.regexp_extract("text", rx, 1)).alias("key"), strip(F.regexp_extract("text", rx, 2)).alias("value"))
    c = c.join(F.broadcast(names), "key").where((F.col("field") != "documentTotal") | numeric_quote(F.col("value")).isNotNull())
    return c.groupBy("doc_id", "field").agg(F.min("value").alias("value"), F.max("value").alias("last")).where("value = last").drop("last")


def label_report(plan: DataFrame, cells: DataFrame) -> DataFrame:
    """Quality of labelled tables (doc_id, block, first, last, name_col, quantity_col, price_col,
    total_col; 0: absent; one table a document): reasons against training on it, comma-joined
    in order, and counts. Documents without a table are not reported."""
    roles = (("name", "name_col"), ("quantity", "quantity_col"), ("unitPrice", "price_col"), ("lineTotal", "total_col"))
    p = plan.select("doc_id", F.col("block").alias("table"), "first", "last", *[c for _, c in roles])
    c = cells.select(*CELL, "text", numeric_quote(F.col("text")).alias("number")).join(p, "doc_id")
    own = F.col("block") == F.col("table")
    inside = own & F.col("row").between(F.col("first"), F.col("last"))
    head = own & (F.col("row") < F.col("first"))
    alias = {r: F.array(*[normalize_label(F.lit(x)) for x in ALIASES[r]]) for r, _ in roles}
    named = [F.bool_or(head & (F.col("col") == F.col(k)) & F.array_contains(alias[r], normalize_label(F.col("text")))).alias(f"{r}_named") for r, k in roles]
    at = lambda k, v: F.max(F.when(F.col("col") == F.col(k), F.col(v)))
    rows = c.groupBy(*ROW, *[k for _, k in roles]).agg(
        F.bool_or(inside).alias("inside"), *named, at("name_col", "text").alias("name"), at("name_col", "number").alias("name_number"), at("quantity_col", "number").alias("q"), at("price_col", "number").alias("p"), at("total_col", "number").alias("t"),
        F.count("*").alias("n"), F.count("number").alias("numbers"), F.count_if((F.col("text") != "") & F.col("number").isNull()).alias("words"),
    )
    item = F.coalesce((F.col("name") != "") & F.col("name_number").isNull() & ~F.col("name").rlike(NO_ITEM), F.lit(False))
    hole = ((F.col("quantity_col") > 0) & (F.col("q").isNull() | (F.col("q") < 0))) | ((F.col("price_col") > 0) & F.col("p").isNull()) | ((F.col("total_col") > 0) & F.col("t").isNull())
    full = F.col("inside") & item & F.col("q").isNotNull() & F.col("p").isNotNull() & F.col("t").isNotNull()
    off = full & (F.abs(F.col("q") * F.col("p") - F.col("t")) > label_tolerance(F.col("q")))
    bare = [(F.first(k) > 0) & ~F.bool_or(f"{r}_named") for r, k in roles]
    any_ = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    d = rows.groupBy("doc_id").agg(
        any_(off).alias("E_ARITHMETIC"), (bare[0] | bare[1] | bare[2] | bare[3]).alias("E_COLUMNS"), any_(~F.col("inside") & (F.col("n") >= 3) & (F.col("numbers") >= 2) & (F.col("words") >= 1)).alias("E_COVERAGE"),
        (F.count_if(F.col("inside") & item) == 0).alias("E_NO_ITEMS"), any_(F.col("inside") & (~item | hole)).alias("E_ROWS"), F.count_if(F.col("inside") & item).alias("item_rows"), F.count_if(full).alias("arithmetic_checked"),
    )
    codes = ("E_ARITHMETIC", "E_COLUMNS", "E_COVERAGE", "E_NO_ITEMS", "E_ROWS")
    return d.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(F.col(k), k) for k in codes])), ",").alias("reasons"), "item_rows", "arithmetic_checked")


def answer_report(answers: DataFrame, items: DataFrame, grounded: DataFrame, fields: tuple, item_fields: tuple) -> DataFrame:
    """Whole answers (doc_id, said_complete, n_warnings, document_total, vat, discount,
    delivery, ...) with items (doc_id, item, quantity, unit_price, line_total, ...) and grounded
    evidence (doc_id, field, state): issues by kind, and whether an answer counts as complete.
    The stated total is compared only where no VAT, discount or delivery can explain it."""
    off = component_conflict(F.col("quantity"), F.col("unit_price"), F.col("line_total"))
    i = items.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.count_if(off).alias("n_arithmetic"), strict_sum(F.col("line_total")).alias("sum"))
    bad = grounded.groupBy("doc_id").agg(F.count_if(F.col("state") != "ok").alias("n_bad_quotes"))
    paths = populated_paths(answers, items, fields, item_fields)
    bare = without_evidence(paths, grounded).groupBy("doc_id").agg(F.count("*").alias("n_unproven"))
    d = answers.join(i, "doc_id", "left").join(bad, "doc_id", "left").join(bare, "doc_id", "left").na.fill(0, ["n_items", "n_arithmetic", "n_bad_quotes", "n_unproven"])
    plain = F.forall(F.array("vat", "discount", "delivery"), lambda x: F.coalesce(x, F.lit("")) == "")
    total = F.coalesce(plain & (F.abs(F.col("sum") - F.col("document_total")) > LINE + F.col("n_items") * PER_ITEM), F.lit(False))
    done = F.col("said_complete") & (F.col("n_warnings") == 0) & (F.col("n_arithmetic") == 0) & ~total & (F.col("n_bad_quotes") == 0) & (F.col("n_unproven") == 0)
    return d.select("doc_id", "n_items", "n_arithmetic", total.alias("total_differs"), "n_bad_quotes", "n_unproven", done.alias("complete"))
