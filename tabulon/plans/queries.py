"""Queries over the shared tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from ..functions import numbers as N
from ..functions import text as X
from ..operators import answers as A
from ..operators import cells as C
from ..operators import dataset as D
from ..operators import dedup as U
from ..operators import evidence as E
from ..operators import fusion as G
from ..operators import metrics as M
from ..operators import partition as P
from ..operators import rules as R
from ..operators import validate as V
from ..sources import offers as O
from ..sources import store as K
from ..sources.files import html_grid as html_table
from . import oracle as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- numbers and texts

_TEXTS = ("qty_text", "unit_text", "total_text")


@query(f"WITH {O.CTE} SELECT doc_id, item, {', '.join(f'{Q.cents(Q.number(t))} AS {t[:-5]}_cents' for t in _TEXTS)} FROM items")
def number_parse(spark, sf_dir):
    i = O.offer_items(spark, sf_dir)
    return i.select("doc_id", "item", *[N.cents(N.parse_number(F.col(t))).alias(f"{t[:-5]}_cents") for t in _TEXTS])


@query(f"WITH {O.CTE} SELECT doc_id, item, {', '.join(f'CAST(round({Q.quote(t)} * 1000000) AS BIGINT) AS {t[:-5]}_micro' for t in _TEXTS)} FROM items")
def number_quote(spark, sf_dir):
    i = O.offer_items(spark, sf_dir)
    return i.select("doc_id", "item", *[F.round(N.numeric_quote(F.col(t)) * 1000000).cast("long").alias(f"{t[:-5]}_micro") for t in _TEXTS])


_SPACED = "regexp_replace(total_text, '^([^0-9]*[0-9])([0-9])', '\\1 \\2')"


@query(f"WITH {O.CTE} SELECT doc_id, item, {Q.cents(Q.matrix(_SPACED))} AS total_cents FROM items")
def matrix_number(spark, sf_dir):
    t = F.regexp_replace("total_text", "^([^0-9]*[0-9])([0-9])", "$1 $2")
    return O.offer_items(spark, sf_dir).select("doc_id", "item", N.cents(N.matrix_number(t)).alias("total_cents"))


@query(f"SELECT p_partkey, {Q.label('p_name')} AS label FROM part")
def label_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.normalize_label(F.col("p_name")).alias("label"))


@query(Q.COSINE)
def label_trigram_cosine(spark, sf_dir):
    labels = table(spark, sf_dir, "part").select(X.normalize_label(F.col("p_name")).alias("label")).distinct()
    return L.cosines(labels, L.vocabulary(spark)).select("label", "role", F.round("score", 6).alias("score"))


@query(Q.CLASSIFY)
def label_classify(spark, sf_dir):
    cells = O.offer_cells(spark, sf_dir).where("row = 1 or block = 0")
    return L.classify(cells, "text").select("text", "label", "role", F.round("score", 3).alias("score"), "method")


@query(r"SELECT doc_id, regexp_extract(title, '(?i)от\s+(\d{2}[./-]\d{2}[./-]\d{4})', 1) AS written, CAST(try_strptime(regexp_extract(title, '(?i)от\s+(\d{2}[./-]\d{2}[./-]\d{4})', 1), '%d.%m.%Y') AS DATE) AS dated, regexp_extract(title, '№\s*([\w/.-]+)', 1) AS number FROM heads".replace("SELECT", f"WITH {O.CTE} SELECT", 1))
def date_and_number(spark, sf_dir):
    h = O.offer_heads(spark, sf_dir)
    return h.select("doc_id", X.document_date(F.col("title")).alias("written"), X.calendar_date(X.document_date(F.col("title"))).alias("dated"), X.document_number(F.col("title")).alias("number"))


_VALID = r"regexp_extract(text, '(\d{2}[./-]\d{2}[./-]\d{4})', 1)"


@query(f"WITH {O.CTE} SELECT doc_id, {_VALID} AS written, CAST(try_strptime({_VALID}, '%d.%m.%Y') AS DATE) IS NULL AS impossible FROM cells WHERE block = 0 AND row = 9")
def calendar_validity(spark, sf_dir):
    c = O.offer_cells(spark, sf_dir).where("block = 0 and row = 9")
    written = F.regexp_extract("text", r"(\d{2}[./-]\d{2}[./-]\d{4})", 1)
    return c.select("doc_id", written.alias("written"), X.calendar_date(written).isNull().alias("impossible"))


@query(f"WITH {O.CTE} SELECT doc_id, CASE lower(regexp_extract(text, '(?i)(₽|руб|rub|₸|тенге|тг|kzt|\\$|usd|€|eur)', 1)) WHEN '₽' THEN 'RUB' WHEN 'тенге' THEN 'KZT' WHEN 'kzt' THEN 'KZT' WHEN 'usd' THEN 'USD' END AS code FROM cells WHERE block = 0 AND row = 4")
def currency_map(spark, sf_dir):
    return O.offer_cells(spark, sf_dir).where("block = 0 and row = 4").select("doc_id", X.currency_code(F.col("text")).alias("code"))


@query(f"WITH {O.CTE} SELECT doc_id, row, regexp_extract(text, '^([^:\\n]{{2,100}}):\\s*(\\S[^\\n]*)$', 1) AS label, regexp_extract(text, '^([^:\\n]{{2,100}}):\\s*(\\S[^\\n]*)$', 2) AS value FROM cells WHERE block = 0 AND regexp_matches(text, '^([^:\\n]{{2,100}}):\\s*(\\S[^\\n]*)$')")
def kv_fields(spark, sf_dir):
    label, value = X.label_value(F.col("text"))
    return O.offer_cells(spark, sf_dir).where("block = 0").select("doc_id", "row", label.alias("label"), value.alias("value")).where("label is not null")


@query("SELECT c_custkey, b AS bucket, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS split FROM (SELECT c_custkey, CAST(concat('0x', substr(sha256(lower(trim(c_name))), 1, 8)) AS UBIGINT)::BIGINT % 100 AS b FROM customer)")
def hash_split(spark, sf_dir):
    b = X.hash_bucket(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", b.alias("bucket"), X.split_of(b).alias("split"))


@query("SELECT split, count(*) AS documents, count(DISTINCT c_mktsegment) AS groups FROM (SELECT c_mktsegment, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS split FROM (SELECT c_mktsegment, CAST(concat('0x', substr(sha256(lower(trim(c_name))), 1, 8)) AS UBIGINT)::BIGINT % 100 AS b FROM customer)) GROUP BY split")
def split_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("split", X.split_of(X.hash_bucket(F.col("c_name"))))
    return c.groupBy("split").agg(F.count("*").alias("documents"), F.count_distinct("c_mktsegment").alias("groups"))


_CONF = "least(greatest(CASE WHEN event_id % 2 = 0 THEN 900 ELSE 760 END + CASE WHEN event_id % 3 = 0 THEN 30 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 0 ELSE 20 END + CASE event_id % 4 WHEN 0 THEN 40 WHEN 1 THEN -180 ELSE 0 END, 0), 990)"


@query(f"SELECT event_id, CAST({_CONF} AS BIGINT) AS thousandths FROM events")
def confidence_score(spark, sf_dir):
    e = F.col("event_id")
    agreement = F.when(e % 4 == 0, True).when(e % 4 == 1, False)
    return table(spark, sf_dir, "events").select("event_id", X.confidence(e % 2 == 0, e % 3 == 0, e % 5 == 0, agreement).alias("thousandths"))


@query("SELECT event_id, CAST(least(greatest(coalesce(CASE WHEN event_id % 3 = 0 THEN (event_id % 20) * 1000 END, 500 * pow(2, event_id % 6)), 100), 8000) AS BIGINT) AS delay_ms FROM events")
def retry_delay(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", X.retry_delay_ms(F.when(e % 3 == 0, e % 20), e % 6).alias("delay_ms"))


_MESSAGES = ("connection timed out", "certificate verify failed", "SSL: UNEXPECTED_EOF", "Name or service not known", "quota exceeded", "HTTP 429", "reset by peer")


@query("SELECT CASE event_id % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'certificate' WHEN 2 THEN 'tls' WHEN 3 THEN 'dns' WHEN 4 THEN 'quota' WHEN 5 THEN 'rate' ELSE 'connection' END AS code, count(*) AS n FROM events GROUP BY code")
def error_taxonomy(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, _MESSAGES)), (F.col("event_id") % 7).cast("int"))
    return table(spark, sf_dir, "events").select(M.error_class(said).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, concat('"', replace(CASE WHEN regexp_matches(t, '^\\s*[=+@-]') THEN concat('''', t) ELSE t END, '"', '""'), '"') AS field FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('=', text) WHEN 1 THEN concat('"', text, '"') ELSE text END AS t FROM documents)""")
def csv_guard(spark, sf_dir):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('"'), "text", F.lit('"'))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.spreadsheet_safe(t).alias("field"))


@query(r"SELECT page_id, length(html) > 0 AND NOT contains(html, chr(65533)) AND regexp_matches(html, '[\p{L}\p{N}]') AND 20 * length(regexp_replace(html, '[^\p{Cc}\p{Cf}\p{Co}\p{Cs}]', '', 'g')) < length(html) AS readable FROM pages")
def page_quality(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.text_quality(F.col("html")).alias("readable"))


@query("SELECT a.doc_id, coalesce(list_sort(regexp_extract_all(a.text, '[0-9]')) = list_sort(regexp_extract_all(b.text, '[0-9]')), false) AS agree, len(regexp_extract_all(a.text, '[0-9]')) AS n_digits FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1")
def digit_multiset(spark, sf_dir):
    """Whether two readings have the same digits: of each document and the next one."""
    d = F.sort_array(F.regexp_extract_all("text", F.lit("([0-9])"), F.lit(1)))
    found = table(spark, sf_dir, "documents").select("doc_id", d.alias("digits"))
    after = found.select((F.col("doc_id") - 1).alias("doc_id"), F.col("digits").alias("other"))
    return found.join(after, "doc_id", "left").select("doc_id", F.coalesce(F.col("digits") == F.col("other"), F.lit(False)).alias("agree"), F.size("digits").cast("long").alias("n_digits"))


# ---- cells and rows


def _cells(spark, sf_dir) -> DataFrame:
    """The cell table, written once for queries that read it several times."""
    return K.stage(O.offer_cells(spark, sf_dir), "cells")


@query(Q.TEXT_CELLS)
def text_cells(spark, sf_dir):
    return C.text_cells(table(spark, sf_dir, "documents"))


@query(f"WITH {O.CTE} SELECT doc_id, block, row, count(*) AS n, string_agg(text, '|' ORDER BY col) AS texts FROM cells GROUP BY ALL")
def row_groups(spark, sf_dir):
    g = C.row_groups(O.offer_cells(spark, sf_dir))
    return g.select("doc_id", "block", "row", F.size("cells").cast("long").alias("n"), F.array_join(F.transform("cells", lambda x: x["text"]), "|").alias("texts"))


_EXCLUDED = "(summaries > 0 OR footers > 0 OR (names > 0 AND (roles >= 2 OR numbers = 0)) OR (filled <= 2 AND labels > 0))"


@query(f"WITH {Q.FACTS} SELECT doc_id, block, row, {_EXCLUDED} AS excluded FROM facts")
def row_exclusion(spark, sf_dir):
    return C.row_facts(_cells(spark, sf_dir)).select("doc_id", "block", "row", C.excluded().alias("excluded"))


@query(f"WITH {Q.FACTS} SELECT doc_id, block, row FROM facts WHERE NOT {_EXCLUDED} AND filled >= 2 AND numbers >= 1 AND words >= 1 AND NOT (block = 1 AND row % 2 = 0)")
def candidate_rows(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    covered = cells.where("block = 1 and row % 2 = 0").select("doc_id", "block", "row").distinct()
    return C.candidates(C.row_facts(cells), covered)


@query(f"WITH {O.CTE} SELECT c.doc_id, c.block, c.row, c.col, c.text FROM cells c WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h.n > 0 AND h.doc_id = c.doc_id AND c.block = 1 AND c.row BETWEEN 2 AND h.n + 1)")
def metadata_range_anti(spark, sf_dir):
    cells = O.offer_cells(spark, sf_dir)
    ranges = O.offer_heads(spark, sf_dir).where("n > 0").select("doc_id", F.lit(1).cast("long").alias("block"), F.lit(2).alias("first"), (F.col("n") + 1).alias("last"))
    return C.outside(cells, ranges).select("doc_id", "block", "row", "col", "text")


@query(Q.CATALOG)
def block_catalog(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return C.block_catalog(cells, C.row_facts(cells))


# ---- rules, plans, validation


@query(f"WITH {Q.MAPPING} SELECT * FROM mapping")
def header_mapping(spark, sf_dir):
    return R.header_mapping(_cells(spark, sf_dir))


def _items(spark, sf_dir) -> DataFrame:
    """Items by rule. Cells are rendered once for the roles of their texts and once more for the items, which are found where the
    rendering has put their offer: no cell is written or shuffled again."""
    cells = O.offer_cells(spark, sf_dir)
    return R.item_rows(cells, roles=C.cell_roles(cells), placed=True)


@query(f"WITH {Q.ITEMS} SELECT doc_id, block, row, name, unit, quantity, unit_price, line_total FROM found")
def item_pivot(spark, sf_dir):
    return _items(spark, sf_dir)


_STATE = "CASE WHEN quantity IS NULL OR unit_price IS NULL THEN 'unpriced' WHEN line_total IS NULL THEN 'open' WHEN abs(quantity * unit_price - line_total) > 0.02 THEN 'conflict' ELSE 'ok' END"


@query(f"WITH {Q.ITEMS} SELECT doc_id, count(*) AS n_items, count(*) FILTER ({_STATE} = 'ok') AS n_ok, count(*) FILTER ({_STATE} = 'conflict') AS n_conflict, count(*) FILTER ({_STATE} = 'unpriced') AS n_unpriced, count(*) FILTER ({_STATE} = 'open') AS n_open FROM found GROUP BY doc_id")
def line_arithmetic(spark, sf_dir):
    i = _items(spark, sf_dir)
    state = V.line_state(F.col("quantity"), F.col("unit_price"), F.col("line_total"))
    return i.withColumn("state", state).groupBy("doc_id").agg(F.count("*").alias("n_items"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("ok", "conflict", "unpriced", "open")])


@query(f"WITH {O.CTE} SELECT doc_id, CASE WHEN count(v) = count(*) THEN sum(v)::BIGINT END AS total FROM (SELECT doc_id, CASE WHEN (doc_id + item) % 23 <> 0 THEN total END AS v FROM items) GROUP BY doc_id")
def null_strict_sum(spark, sf_dir):
    i = O.offer_items(spark, sf_dir).withColumn("v", F.when((F.col("doc_id") + F.col("item")) % 23 != 0, F.col("total")))
    return i.groupBy("doc_id").agg(V.strict_sum(F.col("v")).alias("total"))


@query(f"WITH {O.CTE}, parts AS (SELECT doc_id, item, total, (total // 2) + (total - total // 2) + CASE WHEN item % 4 = 0 THEN 10 ELSE 0 END AS s, item % 5 = 0 AS alt, item % 6 = 0 AS hole FROM items) SELECT doc_id, item, 2::BIGINT AS n, NOT hole AND NOT alt AND abs(s - total) / 100.0 > 0.03 AS conflict FROM parts")
def component_sum(spark, sf_dir):
    i = O.offer_items(spark, sf_dir)
    items = i.select("doc_id", "item", (F.col("total") / 100).alias("line_total"))
    half = F.expr("total div 2")
    two = F.array(half, F.when(F.col("item") % 6 != 0, F.col("total") - half + F.when(F.col("item") % 4 == 0, 10).otherwise(0)))
    parts = i.select("doc_id", "item", F.when(F.col("item") % 5 == 0, "alternative").otherwise("additive").alias("mode"), F.explode(two).alias("c")).select("doc_id", "item", "mode", (F.col("c") / 100).alias("line_total"))
    return V.component_sums(items, parts).select("doc_id", "item", "n", "conflict")


@query(Q.TOTALS)
def document_total_candidates(spark, sf_dir):
    h = O.offer_heads(spark, sf_dir).where("n > 0")
    d = F.col("doc_id")
    raw = F.col("sum_total") / 100
    discount = F.when(d % 19 == 0, F.lit(5.0))
    fixed = F.when(d % 23 == 0, F.lit(100.0))
    vat = F.when(d % 17 == 0, F.lit(12.0))
    delivery = F.when(d % 29 == 0, F.lit(50.0))
    many = V.total_candidates(raw, discount, fixed, vat, d % 34 != 0, delivery)
    stated = F.round(raw * F.when(d % 19 == 0, 0.95).otherwise(1.0) * F.when(d % 34 == 0, 1.12).otherwise(1.0), 2) + F.when(d % 5 == 0, 1.0).otherwise(0.0)
    return h.select("doc_id", "n", F.size(many).cast("long").alias("n_candidates"), V.total_agrees(stated, many, F.col("n")).alias("agrees"))


@query(Q.FIELDS + " SELECT doc_id, field, arg_min(value, (block, row, col)) AS value, count(DISTINCT lower(trim(value))) AS n_values FROM fields GROUP BY doc_id, field")
def field_conflicts(spark, sf_dir):
    return R.first_values(R.requisites(O.offer_cells(spark, sf_dir)))


def _headers(spark, sf_dir) -> DataFrame:
    """Two-layer headers over two variants for each order with items."""
    d = O.offer_heads(spark, sf_dir).where("n > 0").select("doc_id")
    rows = [(1, 1, 1, "Наименование"), (1, 2, 1, "Вариант A"), (1, 3, 1, ""), (1, 4, 1, "Примечание"), (1, 5, 1, ""), (2, 2, 1, "Цена"), (2, 3, 1, "Сумма"), (2, 4, 2, "Цена")]
    heads = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("row", "col", "colspan"), r[:3], strict=True)], F.lit(r[3]).alias("text")) for r in rows]))
    return d.select("doc_id", F.lit(1).cast("long").alias("block"), heads.alias("h")).select("doc_id", "block", "h.*")


_PATHS = "(VALUES (1, 'Наименование'), (2, 'Вариант A / Цена'), (3, 'Вариант A / Сумма'), (4, 'Примечание / Цена'), (5, 'Цена')) p(col, path)"


@query(f"WITH {O.CTE} SELECT doc_id, 1::BIGINT AS block, col::BIGINT AS col, path FROM heads, {_PATHS} WHERE n > 0")
def header_paths(spark, sf_dir):
    return R.header_paths(_headers(spark, sf_dir))


# each step of the number's grammar once, over the cells that can be components
_MATRIX = rf"""m0 AS MATERIALIZED (SELECT *, {Q.strip('text')} AS s FROM cells WHERE block = 1 AND row >= 2 AND col > 1 AND regexp_matches(text, '[0-9]')), m1 AS (SELECT *, {Q.strip(f"regexp_replace(s, '(?i)(?:{N.CURRENCY})', '', 'g')")} AS raw FROM m0), m2 AS MATERIALIZED (SELECT *, regexp_replace(raw, '{Q.GAP}', '', 'g') AS bare FROM m1),
m3 AS (SELECT *, CASE WHEN regexp_matches(raw, '^[+-]?[0-9]') AND (NOT regexp_matches(raw, '[0-9]{Q.GAP}+[0-9]') OR regexp_matches(raw, '^[+-]?[0-9]{{1,3}}(?:{Q.GAP}+[0-9]{{3}})+(?:[,.][0-9]{{1,2}})?$')) THEN CASE WHEN regexp_matches(bare, '^[+-]?[0-9]+$') THEN bare WHEN regexp_matches(bare, '^[+-]?[0-9]+[.,][0-9]{{1,2}}$') THEN replace(bare, ',', '.') WHEN regexp_matches(bare, '^[+-]?[0-9]{{1,3}}(\.[0-9]{{3}})+,[0-9]{{1,2}}$') THEN replace(replace(bare, '.', ''), ',', '.') WHEN regexp_matches(bare, '^[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+\.[0-9]{{1,2}}$') THEN replace(bare, ',', '') END WHEN regexp_matches(s, '^[0-9](?:[0-9]|{Q.GAP})*[,.][0-9]{{2}}$') THEN replace(regexp_replace(s, '{Q.GAP}', '', 'g'), ',', '.') END AS plain FROM m2)"""


@query(f"WITH {O.CTE}, {_MATRIX}, v AS (SELECT *, try_cast(plain AS DOUBLE) AS value FROM m3 WHERE plain IS NOT NULL) SELECT v.doc_id, v.block, v.row, v.col, trim(a.text) AS name, path AS component, {Q.cents('value')} AS cents FROM v JOIN cells a ON a.doc_id = v.doc_id AND a.block = 1 AND a.row = v.row AND a.col = 1 JOIN {_PATHS} ON p.col = v.col WHERE trim(a.text) <> '' AND NOT regexp_matches(trim(a.text), {Q.SUMMARY})")
def price_matrix(spark, sf_dir):
    m = R.price_matrix(O.offer_cells(spark, sf_dir).where("block = 1"), R.header_paths(_headers(spark, sf_dir)))
    return m.select("doc_id", "block", "row", "col", "name", "component", N.cents(F.col("value")).alias("cents"))


@query(f"WITH {O.CTE} SELECT c.doc_id, c.block, c.row, c.col, path AS variant, {Q.cents(Q.matrix('c.text'))} AS cents FROM cells c JOIN heads h USING (doc_id) JOIN {_PATHS} ON p.col = c.col WHERE c.block = 1 AND h.n > 0 AND c.doc_id % 3 = 0 AND c.row = h.n + 2 AND {Q.matrix('c.text')} IS NOT NULL")
def variant_totals(spark, sf_dir):
    cells = O.offer_cells(spark, sf_dir).where("block = 1 and row > 1")
    v = R.variant_totals(cells, R.header_paths(_headers(spark, sf_dir)))
    return v.select("doc_id", "block", "row", "col", "variant", N.cents(F.col("value")).alias("cents"))


def _plan(spark, sf_dir) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    col = lambda a, b: F.when(even, a).otherwise(b).cast("long")
    return O.offer_heads(spark, sf_dir).where("n > 0 and doc_id % 4 <> 3").select("doc_id", F.lit(1).cast("long").alias("block"), F.lit(2).cast("long").alias("first"), (F.col("n") + 2).alias("last"), col(1, 3).alias("name_col"), col(2, 5).alias("quantity_col"), col(4, 4).alias("price_col"), col(5, 1).alias("total_col"))


@query(f"WITH {Q.PLANNED} SELECT * FROM planned")
def plan_execute(spark, sf_dir):
    return R.execute_plan(O.offer_cells(spark, sf_dir), _plan(spark, sf_dir))


@query(Q.MERGED)
def rule_plan_merge(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    rules = R.item_rows(cells).drop("unit").where("(doc_id + row) % 10 <> 0")
    return R.merge_items(rules, R.execute_plan(cells, _plan(spark, sf_dir)))


# notes under names of their own beside the requisites: known labels, numbers and long lists are no fields
_NOTE = "CASE item % 5 WHEN 0 THEN 'Параметр' WHEN 1 THEN 'Клиент' WHEN 2 THEN '1 позиция' WHEN 3 THEN 'вес, цвет, размер' ELSE 'Цвет, вес' END"


@query(f"WITH {O.CTE}, notes AS (SELECT doc_id, {_NOTE} AS label, name AS value, item FROM items), k AS (SELECT doc_id, label, value, min(item) AS first_ FROM notes WHERE item % 5 IN (0, 4) GROUP BY ALL) SELECT doc_id, label, value, row_number() OVER (PARTITION BY doc_id ORDER BY first_) AS n FROM k")
def unknown_fields(spark, sf_dir):
    """Labelled values under names that are no requisites."""
    i = O.offer_items(spark, sf_dir)
    label = F.get(F.array(*map(F.lit, ("Параметр", "Клиент", "1 позиция", "вес, цвет, размер", "Цвет, вес"))), (F.col("item") % 5).cast("int"))
    notes = i.select("doc_id", F.lit(2).cast("long").alias("block"), F.col("item").alias("row"), F.lit(1).cast("long").alias("col"), F.concat(label, F.lit(": "), "name").alias("text"), F.lit("text").alias("kind"))
    return R.unknown_fields(O.offer_cells(spark, sf_dir).where("block <> 0").unionByName(notes))


# ---- evidence, outcome, merging


def _evidence(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    cells = O.offer_cells(spark, sf_dir).withColumn("id", F.concat_ws(".", "block", "row", "col"))
    at = (F.col("doc_id") + F.col("row")) % 7
    quoted = F.when(at == 0, F.concat("text", F.lit("!"))).when(at == 1, F.lit(" ")).when(at == 2, F.lit("неразборчиво")).otherwise(F.col("text"))
    cell = F.when(at == 3, F.concat("id", F.lit(".9"))).otherwise(F.col("id"))
    e = cells.where("block = 0").select("doc_id", F.concat(F.lit("f"), "row").alias("field"), cell.alias("cell"), quoted.alias("excerpt"))
    return e, cells


_GROUNDED = f"""{O.CTE}, e AS (SELECT doc_id, concat('f', row) AS field, concat(block, '.', row, '.', col) AS id, text, (doc_id + row) % 7 AS m7 FROM cells WHERE block = 0),
grounded AS (SELECT doc_id, field, CASE WHEN m7 = 3 THEN concat(id, '.9') ELSE id END AS cell, CASE m7 WHEN 0 THEN concat(text, '!') WHEN 1 THEN ' ' WHEN 2 THEN 'неразборчиво' ELSE text END AS excerpt, CASE m7 WHEN 0 THEN 'not in cell' WHEN 1 THEN 'blank' WHEN 2 THEN 'illegible' WHEN 3 THEN 'unknown cell' ELSE 'ok' END AS state FROM e)"""


@query(f"WITH {_GROUNDED} SELECT doc_id, field, cell, excerpt, state FROM grounded")
def evidence_grounding(spark, sf_dir):
    return E.ground(*_evidence(spark, sf_dir))


@query(f"WITH {_GROUNDED} SELECT DISTINCT doc_id, path FROM (SELECT doc_id, unnest(list_filter(['f1', 'f2', 'f3', 'f4'], lambda x: true)) AS path FROM heads) p WHERE NOT EXISTS (SELECT 1 FROM grounded g WHERE g.doc_id = p.doc_id AND g.field = p.path AND g.state = 'ok')")
def missing_evidence(spark, sf_dir):
    paths = O.offer_heads(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.lit(f"f{i}") for i in range(1, 5)])).alias("path"))
    return E.without_evidence(paths, E.ground(*_evidence(spark, sf_dir)))


@query(f"WITH {Q.ITEMS}, s AS (SELECT doc_id, count(*) AS n_items, count(*) FILTER (quantity IS NULL OR unit_price IS NULL OR line_total IS NULL) AS n_missing, count(*) FILTER ({_STATE} = 'conflict') AS n_issues FROM found GROUP BY doc_id) SELECT doc_id, coalesce(n_items, 0) AS n_items, coalesce(n_missing, 0) AS n_missing, coalesce(n_issues, 0) AS n_issues, CASE WHEN coalesce(n_items, 0) = 0 AND doc_id % 2 = 0 THEN 'unavailable' WHEN coalesce(n_missing, 0) > 0 OR coalesce(n_issues, 0) > 0 OR coalesce(n_items, 0) = 0 THEN 'partial' ELSE 'complete' END AS state FROM heads LEFT JOIN s USING (doc_id)")
def outcome_state(spark, sf_dir):
    i = _items(spark, sf_dir)
    state = V.line_state(F.col("quantity"), F.col("unit_price"), F.col("line_total"))
    hole = F.col("quantity").isNull() | F.col("unit_price").isNull() | F.col("line_total").isNull()
    s = i.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.count_if(hole).alias("n_missing"), F.count_if(state == "conflict").alias("n_issues"))
    docs = O.offer_heads(spark, sf_dir).select("doc_id", (F.col("doc_id") % 2).alias("n_values")).join(s, "doc_id", "left").na.fill(0)
    return E.outcome(docs).drop("n_values")


@query("SELECT user_id, CASE max(CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 1 ELSE 2 END) WHEN 3 THEN 'unreadable' WHEN 2 THEN 'unverified' ELSE 'absent' END AS reason FROM events GROUP BY user_id")
def missing_reason(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("reason", E.missing_reason(F.col("event_type") == "click", F.col("event_type") == "view"))
    order = F.when(F.col("reason") == "unreadable", 3).when(F.col("reason") == "unverified", 2).otherwise(1)
    return e.groupBy("user_id").agg(F.max_by("reason", order).alias("reason"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS priority, count(DISTINCT lower(trim(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END))) > 1 AS priority_conflict, arg_min(o_orderstatus, o_orderkey) AS status, count(DISTINCT lower(trim(o_orderstatus))) > 1 AS status_conflict FROM orders GROUP BY o_custkey")
def multi_doc_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("priority"), F.col("o_orderstatus").alias("status"))
    return E.first_nonblank(o, ("o_custkey",), ("priority", "status"), ("o_orderkey",))


@query(f"WITH {O.CTE} SELECT doc_id, item, row_number() OVER (PARTITION BY doc_id, lower(trim(name)) ORDER BY item) > 1 AS repeat FROM items")
def duplicate_items(spark, sf_dir):
    i = O.offer_items(spark, sf_dir).select("doc_id", "item", "name")
    return E.repeated_names(i, ("doc_id",), "name", ("item",)).select("doc_id", "item", "repeat")


# ---- duplicates, partitions, datasets


@query("SELECT sha256(coalesce(text, '')) AS hash, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1")
def exact_dedup(spark, sf_dir):
    return U.exact_groups(table(spark, sf_dir, "documents"))


@query(f"WITH {Q.SHINGLES} SELECT id AS doc_id, count(*) AS n_shingles, min(shingle) AS least FROM shingles GROUP BY id")
def shingle_signature(spark, sf_dir):
    return U.shingles(table(spark, sf_dir, "documents")).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_shingles"), F.lower(F.hex(F.min("shingle"))).alias("least"))


@query(f"WITH {Q.PAIRS} SELECT * FROM pairs")
def near_dup_edges(spark, sf_dir):
    return U.similar_pairs(U.shingles(table(spark, sf_dir, "documents")))


@query(f"WITH RECURSIVE {Q.PAIRS}, same AS (SELECT doc_id AS b, min(doc_id) OVER (PARTITION BY {Q.label('text')}) AS a FROM documents), g AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT a, b FROM same UNION SELECT b, a FROM same), reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT g.b, reach.root FROM reach JOIN g ON g.a = reach.id) SELECT id AS doc_id, min(root) AS root FROM reach GROUP BY id")
def similarity_components(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pairs = U.similar_pairs(U.shingles(docs))
    edges = pairs.select("a", "b").unionByName(U.same_texts(docs))
    return U.connected(edges, docs.select(F.col("doc_id").alias("id"))).select(F.col("id").alias("doc_id"), "root")


@query()
def grouped_partition(spark, sf_dir):
    """Splits without leaks: a group of similar or equal documents is in one split."""
    docs = table(spark, sf_dir, "documents")
    pairs = U.similar_pairs(U.shingles(docs))
    return P.partition(docs.select("doc_id"), pairs.select("a", "b").unionByName(U.same_texts(docs)))


_SPLIT = "CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END"
_MANIFEST = f"m AS (SELECT o_orderkey AS id, {_SPLIT} AS split, count FROM (SELECT o_orderkey, CAST(concat('0x', substr(sha256(lower(trim(o_orderpriority || o_custkey))), 1, 8)) AS UBIGINT)::BIGINT % 100 AS b, (o_orderkey % 5)::BIGINT AS count FROM orders)), starts AS (SELECT *, coalesce(sum(count) OVER (PARTITION BY split ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM m)"


def _manifest(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    group = F.concat("o_orderpriority", F.col("o_custkey").cast("string"))
    m = o.select(F.col("o_orderkey").alias("id"), X.split_of(X.hash_bucket(group)).alias("split"), (F.col("o_orderkey") % 5).alias("count"))
    return D.offsets(m, "split", "id", "count")


@query(f"WITH {_MANIFEST} SELECT id, split, count, start FROM starts")
def manifest_offsets(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query(f"WITH {_MANIFEST}, kept AS (SELECT * FROM starts WHERE id % 50 <> 7), due AS (SELECT *, coalesce(lag(start + count) OVER (PARTITION BY split ORDER BY id), 0)::BIGINT AS due FROM kept) SELECT id, split, count, start, due FROM due WHERE start <> due")
def manifest_check(spark, sf_dir):
    return D.manifest_gaps(_manifest(spark, sf_dir).where("id % 50 <> 7"), "split", "id")


@query(f"WITH {_MANIFEST}, kept AS (SELECT id, split, count FROM m WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')) SELECT id, split, count, coalesce(sum(count) OVER (PARTITION BY split ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM kept")
def quarantine_filter(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return D.offsets(D.without(_manifest(spark, sf_dir).drop("start"), gone, "id"), "split", "id", "count")


@query("SELECT count(*) AS n_excluded, count(*) = 0 AS allowed FROM orders WHERE o_orderstatus = 'P'")
def training_gate(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return D.gate(_manifest(spark, sf_dir), gone, "id")


@query(f"WITH {Q.ITEMS}, s AS (SELECT doc_id, bool_or(line_total IS NULL) AS a, bool_or(unit_price IS NULL AND quantity IS NOT NULL) AS p, bool_or({_STATE} = 'conflict') AS c FROM found GROUP BY doc_id) SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN s.doc_id IS NULL THEN 'E_PARSE' END, CASE WHEN a THEN 'E_ITEM_INCOMPLETE' END, CASE WHEN p THEN 'E_PRICE_UNAVAILABLE' END, CASE WHEN c THEN 'E_ARITHMETIC' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM heads LEFT JOIN s USING (doc_id)")
def quarantine_reasons(spark, sf_dir):
    i = _items(spark, sf_dir)
    state = V.line_state(F.col("quantity"), F.col("unit_price"), F.col("line_total"))
    s = i.groupBy("doc_id").agg(F.bool_or(F.col("line_total").isNull()).alias("a"), F.bool_or(F.col("unit_price").isNull() & F.col("quantity").isNotNull()).alias("p"), F.bool_or(state == "conflict").alias("c"), F.lit(True).alias("seen"))
    j = O.offer_heads(spark, sf_dir).select("doc_id").join(s, "doc_id", "left")
    why = F.array(F.when(F.col("seen").isNull(), "E_PARSE"), F.when(F.col("a"), "E_ITEM_INCOMPLETE"), F.when(F.col("p"), "E_PRICE_UNAVAILABLE"), F.when(F.col("c"), "E_ARITHMETIC"))
    return j.select("doc_id", F.array_join(F.sort_array(F.array_compact(why)), ",").alias("reasons"))


@query("WITH b AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split, o_orderpriority AS p, o_orderstatus AS s FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY split, p, s ORDER BY id) AS round FROM b), t AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round, p, s, id) AS turn FROM r), q AS (SELECT *, row_number() OVER (ORDER BY turn, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END) AS place FROM t WHERE turn <= 200) SELECT id, split, place FROM q WHERE place <= 200")
def review_queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "train").when(F.col("o_orderkey") % 3 == 1, "val").otherwise("test").alias("split"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    return D.review_queue(o, "split", ("p", "s"), "id", ("train", "val", "test"), 200).select("id", "split", "place")


@query("SELECT event_id AS id, user_id, coalesce(o.old, n.fresh) AS kept, coalesce(o.old, n.fresh) <> event_id AS duplicate FROM events LEFT JOIN (SELECT user_id, min(event_id) AS old FROM events WHERE event_id % 10 = 0 GROUP BY 1) o USING (user_id) JOIN (SELECT user_id, min(event_id) AS fresh FROM events WHERE event_id % 10 <> 0 GROUP BY 1) n USING (user_id) WHERE event_id % 10 <> 0")
def idempotent_insert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id")
    return K.insert_once(e.where("id % 10 = 0"), e.where("id % 10 <> 0"), "user_id", "id")


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, event_id, event_id % 4 + 1 AS revision, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
w AS (SELECT user_id, n, 1::BIGINT AS now_, revision, event_id FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, w.now_ + CASE WHEN w.revision = w.now_ THEN 1 ELSE 0 END, o.revision, o.event_id FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
SELECT user_id, event_id, revision, revision = now_ AS accepted FROM w""")
def revision_update(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 4 + 1).alias("revision"))
    return K.apply_revisions(e, "user_id", "event_id")


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS questions, count(*) FILTER (role = 'assistant') AS answers, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn, role, text) AS dialogue FROM conversations GROUP BY conv_id")
def sft_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    lines = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    said = F.transform(lines, lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("questions"), F.count_if(F.col("role") == "assistant").alias("answers"), F.array_join(said, "\n").alias("dialogue"))


@query(f"""WITH RECURSIVE {O.CTE}, o AS MATERIALIZED (SELECT doc_id, item, length(name) AS size, row_number() OVER (PARTITION BY doc_id ORDER BY item) AS n FROM items),
w AS (SELECT doc_id, item, n, size AS used, 0::BIGINT AS batch FROM o WHERE n = 1 UNION ALL SELECT o.doc_id, o.item, o.n, CASE WHEN w.used + o.size > 100 THEN o.size ELSE w.used + o.size END, w.batch + CASE WHEN w.used + o.size > 100 THEN 1 ELSE 0 END FROM w JOIN o ON o.doc_id = w.doc_id AND o.n = w.n + 1)
SELECT doc_id, item, batch FROM w""")
def size_batches(spark, sf_dir):
    i = O.offer_items(spark, sf_dir).select("doc_id", "item", F.length("name").cast("long").alias("size"))
    return D.size_batches(i, "doc_id", "item", "size", 100)


# ---- metrics and runs


@query("SELECT count(*) AS labelled, count(*) FILTER (p) AS predicted, count(*) FILTER (p AND quality = 1) AS correct, round(count(*) FILTER (p AND quality = 1) / count(*) FILTER (p)::DOUBLE, 4) AS precision_, round(count(*) FILTER (p AND quality = 1) / count(*) FILTER (quality = 1)::DOUBLE, 4) AS recall_ FROM (SELECT l.quality, d.n_chars > 500 AS p FROM labels l JOIN documents d USING (doc_id))")
def field_metrics(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("p", F.col("n_chars") > 500)
    a = j.agg(F.count("*").alias("labelled"), F.count_if("p").alias("predicted"), F.count_if(F.col("p") & (F.col("quality") == 1)).alias("correct"), F.count_if(F.col("quality") == 1).alias("good"))
    return a.select("labelled", "predicted", "correct", M.ratio(F.col("correct"), F.col("predicted")).alias("precision_"), M.ratio(F.col("correct"), F.col("good")).alias("recall_"))


@query(f"WITH {O.CTE} SELECT doc_id, greatest(0, least(n + 1, n + doc_id % 3) - greatest(2, 1 + doc_id % 4) + 1)::BIGINT AS common, n AS expected FROM heads WHERE n > 0")
def row_overlap_metrics(spark, sf_dir):
    h = O.offer_heads(spark, sf_dir).where("n > 0")
    d = F.col("doc_id")
    return h.select("doc_id", M.row_overlap(F.lit(2), F.col("n") + 1, 1 + d % 4, F.col("n") + d % 3).cast("long").alias("common"), F.col("n").alias("expected"))


@query("SELECT CASE WHEN user_id % 10 < 8 THEN 'train' WHEN user_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def diagnostics_crosstab(spark, sf_dir):
    u = F.col("user_id") % 10
    e = table(spark, sf_dir, "events").withColumn("split", F.when(u < 8, "train").when(u == 8, "val").otherwise("test"))
    return e.groupBy("split", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


_CALLS = "(SELECT event_type, (event_id % 1000)::BIGINT AS input, (event_id % 1300)::BIGINT AS cached, CASE WHEN event_type <> 'view' OR event_id % 100 <> 3 THEN (event_id % 200)::BIGINT END AS output FROM events)"


@query(f"SELECT event_type, count(*) AS calls, sum(input)::BIGINT AS input, sum(least(cached, input))::BIGINT AS cached, sum(output)::BIGINT AS output, CASE WHEN count(output) = count(*) THEN sum((input - least(cached, input)) * 250 + least(cached, input) * 25 + output * 2000)::BIGINT END AS cost FROM {_CALLS} GROUP BY event_type")
def usage_cost(spark, sf_dir):
    e = F.col("event_id")
    calls = table(spark, sf_dir, "events").select("event_type", (e % 1000).alias("input"), (e % 1300).alias("cached"), F.when((F.col("event_type") != "view") | (e % 100 != 3), e % 200).alias("output"))
    return M.usage_cost(calls, "event_type", 250, 25, 2000)


@query("WITH r AS (SELECT event_type, event_id % 977 AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 977) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(n) AS n, round((max(v) FILTER (k = (n + 1) // 2) + max(v) FILTER (k = (n + 2) // 2)) / 2.0::DOUBLE, 2) AS p50, max(v) FILTER (k = greatest(n * 95 // 100, 1)) AS p95 FROM r GROUP BY event_type")
def latency_p50_p95(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 977).alias("ms"))
    return M.latency(e, "event_type", "ms")


@query("WITH m AS (SELECT ts AS moment, 1 AS d FROM events UNION ALL SELECT ts + to_seconds(90 * (1 + event_id % 4)), -1 FROM events), s AS (SELECT moment, sum(d) AS d FROM m GROUP BY moment) SELECT moment, (sum(d) OVER (ORDER BY moment))::BIGINT AS running FROM s")
def inflight_concurrency(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", F.expr("ts + make_dt_interval(0, 0, 0, 90 * (1 + event_id % 4))").alias("done"))
    return M.concurrency(e, "ts", "done").withColumnRenamed("at", "moment")


@query("WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 900000000 THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY ts))::BIGINT AS session FROM g) SELECT user_id, session, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session")
def idle_sessions(spark, sf_dir):
    return M.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 900)


@query("SELECT user_id, event_type, min(event_id) AS first, count(*) AS coalesced FROM events GROUP BY user_id, event_type, time_bucket(INTERVAL 10 MINUTE, ts)")
def coalesce_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type", F.window("ts", "10 minutes")).agg(F.min("event_id").alias("first"), F.count("*").alias("coalesced")).drop("window")





# ---- geometry, structure, plans and stores


_BOX = "(event_id % 100)::DOUBLE AS x0, (event_id % 70)::DOUBLE AS y0, (event_id % 100 + 5 + event_id % 9)::DOUBLE AS x1, (event_id % 70 + 4)::DOUBLE AS y1"


def _boxes(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", (e % 100).cast("double").alias("x0"), (e % 70).cast("double").alias("y0"), (e % 100 + 5 + e % 9).cast("double").alias("x1"), (e % 70 + 4).cast("double").alias("y1"))


@query(f"SELECT user_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM (SELECT user_id, {_BOX} FROM events) GROUP BY user_id")
def box_union(spark, sf_dir):
    b = _boxes(spark, sf_dir).groupBy("user_id").agg(G.union_box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("b"))
    return b.select("user_id", *[F.col("b")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(f"SELECT event_id, (x0 + x1) / 2 BETWEEN 19.5 AND 60.5 AND (y0 + y1) / 2 BETWEEN 9.5 AND 50.5 AS inside, CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN greatest(0, least(x1, 60) - greatest(x0, 20)) * greatest(0, least(y1, 50) - greatest(y0, 10)) / least((x1 - x0) * (y1 - y0), 1600) ELSE 0 END AS shared FROM (SELECT event_id, {_BOX} FROM events)")
def box_relations(spark, sf_dir):
    frame = F.array(*map(F.lit, (20.0, 10.0, 60.0, 50.0)))
    own = F.array("x0", "y0", "x1", "y1")
    return _boxes(spark, sf_dir).select("event_id", G.holds_centre(frame, own).alias("inside"), G.overlap(own, frame).alias("shared"))


@query("WITH w AS (SELECT user_id, event_id, (event_id % 997 * 3)::BIGINT AS x, 2 + event_id % 5 AS wd FROM events), g AS (SELECT *, CASE WHEN x - lag(x + wd) OVER (PARTITION BY user_id ORDER BY x, event_id) > 12 THEN 1 ELSE 0 END AS new FROM w) SELECT user_id, event_id, (sum(new) OVER (PARTITION BY user_id ORDER BY x, event_id))::BIGINT AS line FROM g")
def word_lines(spark, sf_dir):
    e = F.col("event_id")
    w = table(spark, sf_dir, "events").select("user_id", "event_id", (e % 997 * 3).alias("x"), (2 + e % 5).alias("wd"))
    return G.lines_of_words(w, ("user_id",), "x", "wd", 12, "event_id").select("user_id", "event_id", "line")


@query(f"WITH {O.CTE}, nat AS (SELECT doc_id, row, col, text, lower(regexp_replace(text, '[\\s­]+', '', 'g')) AS k FROM cells WHERE block = 1 AND (doc_id + row + col) % 3 <> 0), vis AS (SELECT doc_id, row, col, CASE WHEN (row + col) % 2 = 0 THEN upper(text) ELSE text END AS text FROM cells WHERE block = 1), once AS (SELECT doc_id, k, max(text) AS by_text FROM nat GROUP BY doc_id, k HAVING count(*) = 1), nd AS (SELECT doc_id, max(row) AS h, max(col) AS w FROM nat GROUP BY doc_id), vd AS (SELECT doc_id, max(row) AS h, max(col) AS w FROM vis GROUP BY doc_id), same AS (SELECT nat.* FROM nat JOIN nd USING (doc_id) JOIN vd USING (doc_id) WHERE nd.h = vd.h AND nd.w = vd.w) SELECT v.doc_id, v.row, v.col, coalesce(n.text, o.by_text, v.text) AS text, CASE WHEN n.text IS NOT NULL THEN 'place' WHEN o.by_text IS NOT NULL THEN 'text' ELSE 'visual' END AS origin FROM vis v LEFT JOIN same n ON n.doc_id = v.doc_id AND n.row = v.row AND n.col = v.col LEFT JOIN once o ON o.doc_id = v.doc_id AND o.k = lower(regexp_replace(v.text, '[\\s­]+', '', 'g'))")
def native_visual_fusion(spark, sf_dir):
    c = O.offer_cells(spark, sf_dir).where("block = 1").select("doc_id", "row", "col", "text")
    twice = F.when(F.expr("(doc_id + row + col) % 3 <> 0"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    c = c.withColumn("native", F.explode(twice))
    return G.fuse_readings(c.withColumn("text", F.when(~F.col("native") & ((F.col("row") + F.col("col")) % 2 == 0), F.upper("text")).otherwise(F.col("text"))))


@query()
def reading_agreement(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit("x"))).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.lit(" ")).alias("seen"))
    return G.agreement(p, "p_name", "seen").select("p_partkey", "agrees")


@query()
def html_grid(spark, sf_dir):
    """Item tables of offers as HTML, scanned back to a grid by the table function."""
    c = O.offer_cells(spark, sf_dir).where("block = 1")
    cell = F.concat(F.lit("<td>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>"))
    rows = c.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("col", cell.alias("h")))).alias("l"))
    rows = rows.select("doc_id", "row", F.concat(F.lit("<tr>"), F.array_join(F.transform("l", lambda x: x["h"]), ""), F.lit("</tr>")).alias("h"))
    pages = rows.groupBy("doc_id").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "h"))), lambda x: x["h"]), ""), F.lit("</table>")).alias("html"))
    html_table(spark)
    return spark.sql("SELECT doc_id, g.row, g.col, g.text FROM {pages}, LATERAL html_grid(html) g", pages=pages)


@query(f"WITH {O.CTE} SELECT doc_id, string_agg(line, chr(10) ORDER BY block, row) AS text FROM (SELECT doc_id, block, row, string_agg(text, chr(9) ORDER BY col) AS line FROM cells GROUP BY ALL) GROUP BY doc_id")
def transcription_text(spark, sf_dir):
    rows = C.row_groups(O.offer_cells(spark, sf_dir)).select("doc_id", "block", "row", F.array_join(F.transform("cells", lambda x: x["text"]), "\t").alias("line"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "row", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query(f"WITH {O.CTE} SELECT doc_id, block, count(*) AS n_cells, count(DISTINCT row) AS n_rows, max(col) AS width, sum(length(text))::BIGINT AS chars FROM cells GROUP BY doc_id, block")
def block_hierarchy(spark, sf_dir):
    return O.offer_cells(spark, sf_dir).groupBy("doc_id", "block").agg(F.count("*").alias("n_cells"), F.count_distinct("row").alias("n_rows"), F.max("col").alias("width"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {O.CTE} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block, row, col) AS place, block, row, col FROM cells")
def reading_order(spark, sf_dir):
    c = O.offer_cells(spark, sf_dir)
    return c.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("block", "row", "col")).cast("long").alias("place"), "block", "row", "col")


@query(f"WITH {O.CTE} SELECT h.doc_id, unnest(list_filter(['title', CASE WHEN s_name IS NOT NULL THEN 's_name' END, 'n'], lambda x: x IS NOT NULL)) AS path FROM heads h UNION ALL SELECT doc_id, unnest(list_filter(['items.' || item || '.name', CASE WHEN qty_text <> '' THEN 'items.' || item || '.qty_text' END, CASE WHEN unit_text <> '' THEN 'items.' || item || '.unit_text' END], lambda x: x IS NOT NULL)) FROM items")
def populated_paths(spark, sf_dir):
    return E.populated_paths(O.offer_heads(spark, sf_dir), O.offer_items(spark, sf_dir), ("title", "s_name", "n"), ("name", "qty_text", "unit_text"))


@query("SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS line, cols_ok, range_ok FROM (SELECT l_orderkey, l_partkey, l_linenumber, c1 <= 9 AND c2 <= 9 AND c3 <= 9 AND c1 >= 1 AND c1 <> c2 AND c1 <> c3 AND (c2 <> c3 OR c2 = 0) AS cols_ok, l_linenumber + l_suppkey % 3 - 1 >= l_linenumber AS range_ok FROM (SELECT *, l_partkey % 10 AS c1, l_suppkey % 11 AS c2, l_orderkey % 10 AS c3 FROM lineitem))")
def mapping_validity(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    ok = A.mapping_state(F.array(F.col("l_suppkey") % 11, F.col("l_orderkey") % 10), F.array(F.col("l_partkey") % 10), F.lit(9))
    return i.select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("line"), ok.alias("cols_ok"), (F.col("l_suppkey") % 3 >= 1).alias("range_ok"))


@query("SELECT p_partkey, p_partkey % 4 <> 3 AS alternatives FROM part")
def alternative_headers(spark, sf_dir):
    k = F.col("p_partkey") % 4
    head = F.when(k == 0, F.concat(F.lit("Вариант "), F.col("p_size").cast("string"))).when(k == 1, "Цена USD / Цена KZT").when(k == 2, "Цена с НДС, Цена без НДС").otherwise("Цена KZT")
    return table(spark, sf_dir, "part").select("p_partkey", R.alternatives(head).alias("alternatives"))


@query(f"WITH {O.CTE} SELECT doc_id, item, CASE WHEN unit_text = '' THEN item % 2 = 0 ELSE false END AS unspecified FROM items")
def unknown_price(spark, sf_dir):
    i = O.offer_items(spark, sf_dir)
    said = F.when(F.col("unit_text") == "", F.when(F.col("item") % 2 == 0, "Цена: по запросу").otherwise("Цена:")).otherwise(F.concat(F.lit("Цена "), F.col("unit_text")))
    return i.select("doc_id", "item", R.price_on_request(said).alias("unspecified"))


@query(f"WITH {O.CTE}, v AS (SELECT doc_id, c_name AS value FROM heads), c AS (SELECT doc_id, concat(block, '.', row, '.', col) AS id, text FROM cells WHERE block = 0), f AS (SELECT v.doc_id, v.value, count(*) AS n, max(id) AS cell FROM v JOIN c ON c.doc_id = v.doc_id AND contains(c.text, v.value) GROUP BY ALL) SELECT v.doc_id, v.value, CASE WHEN n = 1 THEN cell END AS cell FROM v LEFT JOIN f USING (doc_id, value)")
def unique_source(spark, sf_dir):
    cells = O.offer_cells(spark, sf_dir).where("block = 0").select("doc_id", F.concat_ws(".", "block", "row", "col").alias("id"), "text")
    return E.unique_source(O.offer_heads(spark, sf_dir).select("doc_id", F.col("c_name").alias("value")), cells)


@query("SELECT event_id, abs(q * p - t) > greatest(0.02, abs(q) * 0.005 + 0.01) AS mismatch FROM (SELECT event_id, (event_id % 50)::DOUBLE AS q, (event_id % 90) / 10.0::DOUBLE AS p, (event_id % 50) * (event_id % 90) / 10.0::DOUBLE + (event_id % 3) / 10.0::DOUBLE AS t FROM events)")
def label_check(spark, sf_dir):
    e = F.col("event_id")
    q, p = (e % 50).cast("double"), (e % 90) / 10
    return table(spark, sf_dir, "events").select("event_id", (F.abs(q * p - ((e % 50) * (e % 90) / 10 + (e % 3) / 10)) > V.label_tolerance(q)).alias("mismatch"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 10.0::DOUBLE ELSE least(50.0::DOUBLE, greatest(5.0::DOUBLE, (event_id % 97)::DOUBLE)) END AS setting FROM events")
def bounded_setting(spark, sf_dir):
    e = F.col("event_id")
    text = F.when(e % 4 == 0, "many").when(e % 4 == 1, "NaN").otherwise((e % 97).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", X.bounded_setting(text, 10, 5, 50).alias("setting"))


@query(f"WITH {O.CTE} SELECT doc_id, try_cast(nullif(regexp_extract(text, '([0-9]+(?:[.,][0-9]+)?)\\s*%', 1), '') AS DOUBLE) AS percent, contains(text, 'включ') AS inside FROM cells WHERE block = 0 AND row IN (6, 7)")
def percent_parse(spark, sf_dir):
    c = O.offer_cells(spark, sf_dir).where("block = 0 and row in (6, 7)")
    return c.select("doc_id", X.percent(F.col("text")).alias("percent"), X.vat_is_inside(F.col("text")).alias("inside"))


@query("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, 0.0, 'excluded' FROM customer WHERE c_custkey % 5 = 0")
def exclusion_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return K.upsert(c, c.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.lit(0.0)).withColumn("c_mktsegment", F.lit("excluded")), "c_custkey")


@query("SELECT user_id, row_number() OVER (ORDER BY max(event_id) DESC) <= 12 AS cached FROM events GROUP BY user_id")
def cache_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last"))
    kept = e.orderBy(F.desc("last")).limit(12).select("user_id", F.lit(True).alias("kept"))
    return e.join(kept, "user_id", "left").select("user_id", F.coalesce("kept", F.lit(False)).alias("cached"))


@query("SELECT doc_id, lang, n_chars, quality, x.doc_id IS NOT NULL AS quarantined FROM documents LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT doc_id FROM documents WHERE source = 'src3') x USING (doc_id)")
def annotation_list(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    gone = d.where("source = 'src3'").select("doc_id", F.lit(True).alias("gone"))
    return d.drop("source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").join(gone, "doc_id", "left").select("doc_id", "lang", "n_chars", "quality", F.coalesce("gone", F.lit(False)).alias("quarantined"))


@query("SELECT arg_max(event_type, (-round(m, 6), event_type)) AS chosen, count(*) AS candidates FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type)")
def checkpoint_selection(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    return m.agg(F.max_by("event_type", F.struct(-F.round("m", 6), "event_type")).alias("chosen"), F.count("*").alias("candidates"))


@query("SELECT count(*) FILTER (s = 'train') >= 20 AND count(*) FILTER (s = 'val') >= 5 AND count(*) FILTER (s = 'test') >= 5 AS ready, count(*) AS documents FROM (SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END AS s FROM labels)")
def training_ready(spark, sf_dir):
    d = F.col("doc_id") % 10
    s = table(spark, sf_dir, "labels").select(F.when(d < 8, "train").when(d == 8, "val").otherwise("test").alias("s"))
    ready = (F.count_if(F.col("s") == "train") >= 20) & (F.count_if(F.col("s") == "val") >= 5) & (F.count_if(F.col("s") == "test") >= 5)
    return s.agg(ready.alias("ready"), F.count("*").alias("documents"))


@query("SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars, sum(length(text)) <= 2000 AS kept FROM conversations GROUP BY conv_id")
def context_guard(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), (F.sum(F.length("text")) <= 2000).alias("kept"))
