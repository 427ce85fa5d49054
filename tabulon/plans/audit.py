"""Queries of evaluation, exports and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..sources import offers as O
from .queries import query, table

_FIELDS = ("title", "client", "supplier", "items")


@query(f"WITH {O.CTE}, e AS (SELECT doc_id, 'f' || doc_id % 3 AS format, s_name IS NOT NULL AS s, doc_id % 5 = 0 AS t, doc_id % 7 = 0 AS c, doc_id % 9 = 0 AS i FROM heads) SELECT format, (3 * count(*) + count(*) FILTER (s))::BIGINT AS fields, (count(*) FILTER (NOT t) + count(*) FILTER (NOT c) + count(*) FILTER (s) + count(*) FILTER (NOT i))::BIGINT AS correct, (count(*) FILTER (t) + count(*) FILTER (i))::BIGINT AS different, count(*) FILTER (c) AS absent FROM e GROUP BY format")
def format_audit(spark, sf_dir):
    d = F.col("doc_id")
    h = O.offer_heads(spark, sf_dir).select("doc_id", "title", F.col("c_name").alias("client"), F.col("s_name").alias("supplier"), F.col("n").alias("items"))
    seen = h.select("doc_id", F.when(d % 5 == 0, F.upper("title")).otherwise(F.col("title")).alias("title"), F.when(d % 7 != 0, F.col("client")).alias("client"), "supplier", F.when(d % 9 == 0, F.col("items") + 1).otherwise(F.col("items")).alias("items"))
    expected = A.flatten(h, "doc_id", _FIELDS).withColumn("format", F.concat(F.lit("f"), (d % 3).cast("string")))
    return A.format_audit(expected, A.flatten(seen, "doc_id", _FIELDS), "doc_id", "format")


@query("SELECT variant, count(*) AS documents, count(*) FILTER (NOT valid) AS invalid, round(1 - count(*) FILTER (NOT valid) / count(*)::DOUBLE, 6) AS valid_rate, round(1 - sum(g) FILTER (valid)::DOUBLE / sum(p) FILTER (valid), 6) AS unsupported_rate, round(avg(ms) / 1000, 6) AS mean_seconds FROM (SELECT o_orderpriority AS variant, o_orderkey % 10 <> 0 AS valid, 5 + o_orderkey % 3 AS p, 5 + o_orderkey % 3 - CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS g, o_orderkey % 1000 AS ms FROM orders) GROUP BY variant")
def document_report(spark, sf_dir):
    k = F.col("o_orderkey")
    r = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variant"), (k % 10 != 0).alias("valid"), (5 + k % 3).alias("predicted"), (5 + k % 3 - F.when(k % 4 == 0, 1).otherwise(0)).alias("grounded"), (k % 1000).alias("ms"))
    return A.document_report(r, "variant")


@query("SELECT l.doc_id, CASE WHEN l.doc_id % 10 < 8 THEN 'train' WHEN l.doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, CASE WHEN l.doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality, CASE WHEN l.doc_id % 3 = 0 THEN 'human' ELSE 'auto' END AS origin FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE source IS DISTINCT FROM 'src3'")
def export_labels(spark, sf_dir):
    labels, docs, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), F.col("doc_id") % 10
    parts = docs.select("doc_id", F.when(d < 8, "train").when(d == 8, "val").otherwise("test").alias("split"))
    human = labels.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"))
    return A.export_labels(labels, human, parts, docs.where("source = 'src3'"), "doc_id", ("quality",))


@query(f"WITH {O.CTE} SELECT doc_id, item, (doc_id + item) % 6 <> 0 AS unchanged FROM items")
def unchanged_items(spark, sf_dir):
    i = O.offer_items(spark, sf_dir).select("doc_id", "item", "name", F.when(F.col("qty_text") != "", F.col("qty")).alias("quantity"), F.array(F.col("unit"), F.col("total")).alias("components"))
    edited = i.withColumn("components", F.when((F.col("doc_id") + F.col("item")) % 6 == 0, F.array(F.col("components")[0])).otherwise(F.col("components")))
    return A.unchanged(edited, i, ("doc_id", "item", "name", "quantity", "components")).select("doc_id", "item", "unchanged")


_SHA = "sha256(CAST(doc_id AS VARCHAR))"
_XOR = ", ".join(f"bit_xor(CAST(concat('0x', substr({_SHA}, {at}, 15)) AS UBIGINT)::BIGINT) AS {name}" for at, name in ((1, "high"), (16, "low")))


@query(f"SELECT source, count(*) AS n, {_XOR} FROM (SELECT DISTINCT doc_id, source FROM documents) GROUP BY source")
def corpus_fingerprint(spark, sf_dir):
    return A.corpus_fingerprint(table(spark, sf_dir, "documents"), "doc_id", "source")


@query("SELECT DISTINCT source FROM documents WHERE doc_id % 400 = 7")
def frozen_changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    frozen = A.corpus_fingerprint(d, "doc_id", "source")
    return A.frozen_changes(frozen, A.corpus_fingerprint(d.where("doc_id % 400 <> 7"), "doc_id", "source"), "source")


@query(f"WITH {O.CTE} SELECT doc_id, item, array_to_string(list_filter([CASE WHEN item % 4 = 3 THEN 'name' END, CASE WHEN doc_id % 5 = 1 THEN 'quantity' END, CASE WHEN doc_id % 7 < 2 THEN 'price' END, CASE WHEN item = 2 THEN 'conflict' END], lambda x: x IS NOT NULL), ',') AS issues FROM items")
def item_issues(spark, sf_dir):
    d, i = F.col("doc_id"), F.col("item")
    price = F.when(d % 7 == 0, float("nan")).when(d % 7 == 1, float("inf")).when(d % 7 != 2, F.col("unit") / 100)
    issues = A.item_issues(F.when(i % 4 == 3, " ").otherwise(F.col("name")), {"quantity": F.when(d % 5 == 1, -1).otherwise(F.col("qty")), "price": price}, i == 2)
    return O.offer_items(spark, sf_dir).select("doc_id", "item", F.array_join(issues, ",").alias("issues"))


@query("SELECT p_partkey, p_partkey % 8 < 3 AS inside FROM part")
def path_inside(spark, sf_dir):
    forms = ("docs/{}", "a..b/{}", "..{}", "/{}", "a/../{}", "C:\\{}", "{}\\..", "a\n{}")
    path = F.get(F.array(*[F.concat(F.lit(x.split("{}")[0]), F.col("p_name"), F.lit(x.split("{}")[1])) for x in forms]), (F.col("p_partkey") % 8).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", A.path_inside(path).alias("inside"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e') AND p_size % 2 = 0")
def library_filter(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("status", F.when(F.col("p_size") % 2 == 0, "reviewed").otherwise("draft"))
    return A.library(p, "p_name", "E", "reviewed").select("p_partkey", "p_name")


@query("SELECT o_orderkey, array_to_string(list_filter([1, 2, 3, 4, 5], lambda p: p % (2 + o_orderkey % 4) <> 0), ',') AS missing FROM orders")
def missing_pages(spark, sf_dir):
    pages = F.array(*map(F.lit, range(1, 6)))
    done = F.filter(pages, lambda p: p % (2 + F.col("o_orderkey") % 4) == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(A.missing_pages(pages, done).cast("array<string>"), ",").alias("missing"))


_ROUTED = "doc_id % 4 <> 0 OR (block = 0 AND (row = 4 OR (row = 1 AND doc_id % 8 = 0)))"


@query(rf"""WITH {O.CTE}, r AS (SELECT doc_id, block, row, count(*) AS n, count(*) FILTER (regexp_matches(text, '[0-9]')) AS digits, sum(length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g'))) AS alnum, bool_or(kind = 'table') AS tab FROM cells WHERE {_ROUTED} GROUP BY ALL),
d AS (SELECT doc_id, sum(alnum) < 20 AS a, count(DISTINCT CASE WHEN tab THEN block END) > 1 AS t, count(*) FILTER (n >= 3) >= 3 AND sum(digits) FILTER (n >= 3) >= 4 AS f FROM r GROUP BY doc_id)
SELECT doc_id, array_to_string(list_filter([CASE WHEN a THEN 'sparse' END, CASE WHEN t THEN 'tables' END, CASE WHEN f THEN 'figures' END], lambda x: x IS NOT NULL), ',') AS reasons FROM d""")
def page_routes(spark, sf_dir):
    return A.page_routes(O.offer_cells(spark, sf_dir).where(_ROUTED))


@query(f"WITH {O.CTE}, m AS (SELECT doc_id, block, CASE WHEN doc_id % 8 = 0 AND block = 1 AND row > 3 THEN 'text' WHEN doc_id % 9 = 0 THEN 'table' ELSE kind END AS kind FROM cells), b AS (SELECT doc_id, block, bool_or(kind = 'text') AS t, bool_or(kind = 'table') AS g FROM m GROUP BY ALL) SELECT doc_id, bool_or(t) AS has_text, bool_or(g) AS has_table, count(*) FILTER (t AND g) AS n_mixed, bool_or(t) AND bool_or(g) AND NOT bool_or(t AND g) AS accepted FROM b GROUP BY doc_id")
def accepted_blocks(spark, sf_dir):
    """Whether text and tables of each offer lie in blocks of their own; in some offers rows of the item table are text, or all is table."""
    d = F.col("doc_id")
    kind = F.when((d % 8 == 0) & (F.col("block") == 1) & (F.col("row") > 3), "text").when(d % 9 == 0, "table").otherwise(F.col("kind"))
    return A.accepted_blocks(O.offer_cells(spark, sf_dir).withColumn("kind", kind))
