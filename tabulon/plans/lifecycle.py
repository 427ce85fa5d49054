"""Queries of evidence trees, growing partitions, quarantine, published datasets and collected quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import numeric_quote
from ..functions.text import hash_bucket, label_value, normalize_label, split_of
from ..operators import drafts as T
from ..operators import evidence as E
from ..operators import partition as P
from ..operators import quarantine as H
from ..operators import review as W
from ..operators.cells import REQUISITES
from ..operators.dedup import connected, content_hash
from ..sources import intake as I
from ..sources import offers as O
from ..sources import sinks as S
from ..sources import store as K
from . import oracle as Q
from .queries import query, table

# Each offer's total is calculated from its items, each item from a list, and the list quotes two cells; some quotes
# are altered or name no cell, some lists are empty.
_TREES = f"""{O.CTE}, nd AS MATERIALIZED (SELECT doc_id, 'total' AS node, NULL AS parent, 'calculated' AS kind, NULL AS cell, NULL AS excerpt FROM heads WHERE n > 0
UNION ALL SELECT doc_id, 'i' || item, 'total', 'calculated', NULL, NULL FROM items UNION ALL SELECT doc_id, 'l' || item, 'i' || item, 'list', NULL, NULL FROM items
UNION ALL SELECT doc_id, 'q' || item, 'l' || item, 'quote', concat('1.', item + 1, '.', CASE WHEN (doc_id + item) % 23 = 0 THEN 9 WHEN doc_id % 2 = 0 THEN 2 ELSE 5 END), qty_text FROM items WHERE (doc_id + item) % 31 <> 0
UNION ALL SELECT doc_id, 'u' || item, 'l' || item, 'quote', concat('1.', item + 1, '.4'), CASE WHEN (doc_id + item) % 17 = 0 THEN concat(unit_text, '?') ELSE unit_text END FROM items WHERE (doc_id + item) % 31 <> 0)"""


@query(f"""WITH RECURSIVE {_TREES}, ids AS (SELECT doc_id, concat(block, '.', row, '.', col) AS cell, text FROM cells WHERE block = 1),
bad AS (SELECT nd.doc_id, node, parent FROM nd LEFT JOIN ids ON ids.doc_id = nd.doc_id AND ids.cell = nd.cell WHERE (kind = 'quote' AND (text IS NULL OR text <> excerpt)) OR (kind <> 'quote' AND NOT EXISTS (SELECT 1 FROM nd s WHERE s.doc_id = nd.doc_id AND s.parent = nd.node))
  UNION SELECT nd.doc_id, nd.node, nd.parent FROM nd JOIN bad ON bad.doc_id = nd.doc_id AND bad.parent = nd.node)
SELECT doc_id, node, parent, NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id = nd.doc_id AND bad.node = nd.node) AS valid FROM nd""")
def evidence_trees(spark, sf_dir):
    """Whether calculated values stand on whole quotes, however deep: every entry of all offers."""
    i = O.offer_items(spark, sf_dir)
    n, at, d = F.col("item").cast("string"), F.col("doc_id") + F.col("item"), F.col("doc_id")
    row = lambda node, parent, kind, cell=None, excerpt=None: F.struct(node.alias("node"), parent.alias("parent"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if cell is None else cell).alias("cell"), (F.lit(None).cast("string") if excerpt is None else excerpt).alias("excerpt"))
    name = lambda k: F.concat(F.lit(k), n)
    place = lambda c: F.concat_ws(".", F.lit("1"), F.col("item") + 1, c)
    col = F.when(at % 23 == 0, 9).when(d % 2 == 0, 2).otherwise(5)
    shown = at % 31 != 0
    four = F.array(
        row(name("i"), F.lit("total"), "calculated"),
        row(name("l"), name("i"), "list"),
        F.when(shown, row(name("q"), name("l"), "quote", place(col), F.col("qty_text"))),
        F.when(shown, row(name("u"), name("l"), "quote", place(F.lit(4)), F.when(at % 17 == 0, F.concat("unit_text", F.lit("?"))).otherwise(F.col("unit_text")))),
    )
    nodes = i.select("doc_id", F.explode(F.array_compact(four)).alias("entry")).select("doc_id", "entry.*")
    roots = O.offer_heads(spark, sf_dir).where("n > 0").select("doc_id", row(F.lit("total"), F.lit(None).cast("string"), "calculated").alias("entry")).select("doc_id", "entry.*")
    cells = O.offer_cells(spark, sf_dir).where("block = 1").select("doc_id", F.concat_ws(".", "block", "row", "col").alias("id"), "text")
    return E.evidence_trees(nodes.unionByName(roots), cells)


# Offers of one customer and year are linked, and those of one first supplier and day; a fifth of them came later.
_KEYS = "k AS (SELECT o_orderkey AS id, concat(o_custkey, '/', year(o_orderdate)) AS a, s || '/' || o_orderdate AS b FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL) f ON l_orderkey = o_orderkey)"
_LINKS = f"""{_KEYS}, lk AS MATERIALIZED (SELECT min(id) OVER (PARTITION BY a) AS a, id AS b FROM k UNION SELECT min(id) OVER (PARTITION BY b), id FROM k WHERE b IS NOT NULL),
fz AS (SELECT a, b FROM lk WHERE a <> b AND a % 5 <> 0 AND b % 5 <> 0), fr AS (SELECT o_orderkey AS id, o_orderkey AS root FROM orders WHERE o_orderkey % 5 <> 0 UNION SELECT g.y, fr.root FROM fr JOIN (SELECT a AS x, b AS y FROM fz UNION SELECT b, a FROM fz) g ON g.x = fr.id),
old AS MATERIALIZED (SELECT id, root, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END AS split FROM (SELECT id, min(root) AS root, CAST(concat('0x', substr(sha256(min(root)::VARCHAR), 1, 8)) AS UBIGINT)::BIGINT % 100 AS b FROM fr GROUP BY id))"""


def _links(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    k = table(spark, sf_dir, "orders").join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    k = k.select(F.col("o_orderkey").alias("id"), F.concat_ws("/", "o_custkey", F.year("o_orderdate")).alias("x"), F.when(F.col("s").isNotNull(), F.concat_ws("/", "s", "o_orderdate")).alias("y"))
    star = lambda key: k.where(F.col(key).isNotNull()).join(k.groupBy(key).agg(F.min("id").alias("a")), key).select("a", F.col("id").alias("b"))
    return K.stage(star("x").unionByName(star("y")).where("a <> b").distinct(), "links")


def _frozen(spark, sf_dir, links):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).where("id % 5 <> 0")
    found = connected(links.where("a % 5 <> 0 and b % 5 <> 0"), ids)
    return found.select(F.col("id").alias("doc_id"), "root", split_of(hash_bucket(F.col("root").cast("string"))).alias("split"))


@query(f"""WITH RECURSIVE {_LINKS}, node AS MATERIALIZED (SELECT id, root AS n FROM old UNION ALL SELECT o_orderkey, o_orderkey + 1000000000000 FROM orders WHERE o_orderkey % 5 = 0),
e AS (SELECT p.n AS x, q.n AS y FROM lk JOIN node p ON p.id = lk.a JOIN node q ON q.id = lk.b WHERE lk.a <> lk.b AND (lk.a % 5 = 0 OR lk.b % 5 = 0)),
rc AS (SELECT DISTINCT n, n AS c FROM node UNION SELECT g.y, rc.c FROM rc JOIN (SELECT x, y FROM e UNION SELECT y, x FROM e) g ON g.x = rc.n),
cm AS (SELECT n, min(c) AS c FROM rc GROUP BY n), mt AS (SELECT c, min(root) AS root, count(DISTINCT split) AS k, min(split) AS split FROM cm JOIN (SELECT DISTINCT root, split FROM old) o ON o.root = cm.n GROUP BY c)
SELECT id AS doc_id, root, split, 'frozen' AS state FROM old UNION ALL
SELECT o_orderkey, CASE WHEN k IS NULL THEN cm.c - 1000000000000 WHEN k = 1 THEN mt.root END, CASE WHEN k IS NULL THEN CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'val' ELSE 'test' END WHEN k = 1 THEN split END, CASE WHEN k IS NULL THEN 'new group' WHEN k = 1 THEN 'joined' ELSE 'held' END
FROM (SELECT *, CAST(concat('0x', substr(sha256((cm.c - 1000000000000)::VARCHAR), 1, 8)) AS UBIGINT)::BIGINT % 100 AS b FROM orders JOIN cm ON cm.n = o_orderkey + 1000000000000 WHERE o_orderkey % 5 = 0) cm LEFT JOIN mt ON mt.c = cm.c""")
def partition_growth(spark, sf_dir):
    """A frozen partition after its corpus has grown by a quarter."""
    links = _links(spark, sf_dir)
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return P.grow(K.stage(_frozen(spark, sf_dir, links), "frozen"), docs, links)[0]


@query(f"WITH RECURSIVE {_LINKS} SELECT a, b, split_a, split_b FROM (SELECT lk.a, lk.b, p.split AS split_a, CASE WHEN lk.b % 3 = 0 AND q.split = 'train' THEN 'val' ELSE q.split END AS split_b, p.id % 3 AS z, p.split AS ps FROM lk JOIN old p ON p.id = lk.a JOIN old q ON q.id = lk.b WHERE lk.a <> lk.b) WHERE CASE WHEN z = 0 AND ps = 'train' THEN 'val' ELSE split_a END <> split_b".replace("SELECT a, b, split_a, split_b FROM (", "SELECT a, b, CASE WHEN z = 0 AND ps = 'train' THEN 'val' ELSE split_a END AS split_a, split_b FROM ("))
def partition_conflicts(spark, sf_dir):
    """Links between documents that are frozen in different splits: some documents were moved by hand before."""
    links = _links(spark, sf_dir)
    moved = F.when((F.col("doc_id") % 3 == 0) & (F.col("split") == "train"), "val").otherwise(F.col("split"))
    frozen = K.stage(_frozen(spark, sf_dir, links).withColumn("split", moved), "frozen")
    return P.grow(frozen, frozen.select("doc_id"), links)[1]


@query("SELECT user_id AS doc_id, CASE WHEN a = 'apply' THEN 'quarantined' ELSE 'restored' END AS state, digest, reason FROM (SELECT user_id, arg_max(CASE WHEN event_id % 3 = 0 THEN 'restore' ELSE 'apply' END, event_id) AS a, sha256(user_id::VARCHAR) AS digest, arg_max(event_type, event_id) AS reason FROM events GROUP BY user_id)")
def quarantine_state(spark, sf_dir):
    """Which documents are in quarantine after a log of actions."""
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("doc_id"), F.when(F.col("event_id") % 3 == 0, "restore").otherwise("apply").alias("action"), F.sha2(F.col("user_id").cast("string"), 256).alias("digest"), F.array("event_type").alias("reasons"))
    return H.states(log).select("doc_id", "state", "digest", F.get("reasons", F.lit(0)).alias("reason"))


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE sha256(coalesce(text, '')) END AS digest, text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0)
SELECT doc_id, digest, CASE WHEN doc_id % 3 <> 0 AND digest <> sha256(coalesce(text, '')) THEN 'source changed' WHEN doc_id % 5 = 0 AND digest <> sha256(concat(text, CASE WHEN doc_id % 2 = 0 THEN '!' ELSE '' END)) THEN 'target conflict' WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 'source missing' WHEN doc_id % 5 = 0 THEN 'held' ELSE 'ready' END AS state FROM p""")
def quarantine_preflight(spark, sf_dir):
    """What forbids a planned quarantine: changed or missing documents, copies that differ."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    bad = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0").select("doc_id")
    plan = d.join(bad, "doc_id").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(content_hash(F.col("text"))).alias("digest"))
    active = d.where("doc_id % 3 <> 0").select("doc_id", F.col("text").alias("content"))
    held = d.where("doc_id % 5 = 0").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 2 == 0, "!").otherwise("")).alias("content"))
    return H.preflight(plan, active, held)


@query("SELECT concat(d.source, '/', d.doc_id) AS path, c.doc_id, digest, 'quality' AS reason FROM (SELECT doc_id, sha256(coalesce(CASE WHEN doc_id % 4 = 0 THEN reverse(text) ELSE text END, '')) AS digest FROM documents JOIN labels USING (doc_id) WHERE quality = 0) c JOIN documents d ON sha256(coalesce(d.text, '')) = digest")
def quarantine_plan(spark, sf_dir):
    """Files to quarantine: those with the content of a candidate, wherever they lie; candidates without a file drop out."""
    d = table(spark, sf_dir, "documents")
    c = d.join(table(spark, sf_dir, "labels").where("quality = 0").select("doc_id"), "doc_id")
    c = c.select("doc_id", content_hash(F.when(F.col("doc_id") % 4 == 0, F.reverse("text")).otherwise(F.col("text"))).alias("digest"), F.array(F.lit("quality")).alias("reasons"))
    found = H.audit_plan(c, d.select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("text").alias("content")))
    return found.select("path", "doc_id", "digest", F.get("reasons", F.lit(0)).alias("reason"))


@query("""WITH e AS (SELECT conv_id AS doc_id, turn, text, CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN conv_id % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM conversations), p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id, turn) - 1 AS position FROM e)
SELECT doc_id, split, min(position) AS start, count(*) AS count, arg_min(text, turn) AS first_text FROM p GROUP BY doc_id, split""")
def dataset_roundtrip(spark, sf_dir):
    """A dataset is written and published; each document's first example is then found by its manifest alone."""
    c, m = table(spark, sf_dir, "conversations"), F.col("conv_id") % 10
    examples = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("place"), "text", F.when(m < 8, "train").when(m == 8, "val").otherwise("test").alias("split"))
    path = K.new_path(spark, "dataset")
    S.write_dataset(examples, path)
    kinds = ", ".join(f"{n} {t}" for n, t in examples.dtypes if n != "split")
    rows = S.read_examples(spark, path, kinds).select("split", F.col("position").alias("start"), F.col("text").alias("first_text"))
    return S.read_manifest(spark, path).join(rows, ["split", "start"]).select("doc_id", "split", "start", "count", "first_text")


_LABEL = "lower(regexp_extract(text, '^([^:\\n]{2,100}):\\s*(\\S[^\\n]*)$', 1))"
_FIELD = "CASE l WHEN 'клиент' THEN 'client' WHEN 'заказчик' THEN 'client' WHEN 'валюта' THEN 'currency' WHEN 'ндс' THEN 'vat' WHEN 'скидка' THEN 'discount' WHEN 'итого к оплате' THEN 'documentTotal' WHEN 'действительно до' THEN 'validUntil' END"


@query(f"""WITH {O.CTE}, q AS (SELECT doc_id, row, col, {_FIELD} AS field, v FROM (SELECT doc_id, row, col, {_LABEL} AS l, regexp_extract(text, '^([^:\\n]{{2,100}}):\\s*(\\S[^\\n]*)$', 2) AS v FROM cells WHERE block = 0)),
c AS (SELECT doc_id, field, arg_min(v, row) AS v, arg_min(concat('0.', row, '.', col), row) AS cell, count(DISTINCT v) > 1 AS torn FROM q WHERE field IS NOT NULL AND NOT (field = 'currency' AND doc_id % 3 = 0) GROUP BY ALL),
x AS (SELECT doc_id, field, min(v) AS v, min(concat('0.', row, '.', col)) AS cell FROM q WHERE field IS NOT NULL AND (field <> 'documentTotal' OR {Q.quote('v')} IS NOT NULL) GROUP BY ALL HAVING count(DISTINCT v) = 1)
SELECT h.doc_id, k.field, CASE WHEN c.v IS NULL AND x.v IS NULL THEN 'missing' WHEN c.torn THEN 'pending' ELSE 'found' END AS state, CASE WHEN NOT coalesce(c.torn, false) THEN coalesce(c.v, x.v) END AS value, CASE WHEN NOT coalesce(c.torn, false) THEN coalesce(c.cell, x.cell) END AS cell
FROM heads h, (VALUES {', '.join(f"('{f}')" for f in REQUISITES)}) k(field) LEFT JOIN c ON c.doc_id = h.doc_id AND c.field = k.field LEFT JOIN x ON x.doc_id = h.doc_id AND x.field = k.field""")
def annotated_fields(spark, sf_dir):
    """Fields of all offers from quotes in batches of a row, with the rules' own fields where no batch quoted one."""
    label, value = label_value(F.col("text"))
    rows = [(f, n) for f, v in REQUISITES.items() for n in v]
    names = spark.createDataFrame(rows, "field string, n string").select("field", normalize_label(F.col("n")).alias("key")).groupBy("key").agg(F.max("field").alias("field"))
    c = O.offer_cells(spark, sf_dir).where("block = 0").withColumn("key", normalize_label(label)).withColumn("value", value)
    q = c.join(F.broadcast(names), "key").select("doc_id", F.col("row").alias("batch"), F.col("col").alias("place"), "field", "value", F.concat_ws(".", "block", "row", "col").alias("cell"))
    given = q.where("not (field = 'currency' and doc_id % 3 = 0)")
    rule = q.where((F.col("field") != "documentTotal") | numeric_quote(F.col("value")).isNotNull())
    rule = rule.groupBy("doc_id", "field").agg(F.min("value").alias("value"), F.max("value").alias("most"), F.min("cell").alias("cell")).where("value = most").drop("most")
    return T.annotate(O.offer_heads(spark, sf_dir), T.collect_quotes(given), rule)


_TEXT_CELLS = Q.TEXT_CELLS.replace("FROM documents", "FROM (SELECT text AS doc_id, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL))")


@query(f"WITH cl AS ({_TEXT_CELLS}), n AS (SELECT sha256(doc_id) AS digest, count(*) AS k FROM cl GROUP BY ALL), f AS (SELECT sha256(text) AS digest, min(concat(source, '/', doc_id, CASE WHEN doc_id % 9 = 0 THEN '.pdf' ELSE '.txt' END)) AS path, any_value(octet_length(encode(text))) AS size, any_value(length(text)) AS chars FROM documents WHERE text IS NOT NULL AND source <> 'src3' GROUP BY ALL), s AS (SELECT f.*, coalesce(k, 0) AS k, path LIKE '%.pdf' OR size = 0 OR coalesce(k, 0) > 30000 AS bad FROM f LEFT JOIN n USING (digest)) SELECT digest, path, CASE WHEN bad THEN 'given up' ELSE 'parsed' END AS status, CASE WHEN bad THEN 2 ELSE 1 END::INT AS attempts, CASE WHEN bad THEN 0 ELSE k END AS n_cells FROM s WHERE digest NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src3' AND text IS NOT NULL)")
def intake_records(spark, sf_dir):
    """All documents taken in as files, three times over: contents once, broken ones twice and no more; those of one source are excluded."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    name = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 0, ".pdf").otherwise(".txt"))
    files = d.where("source <> 'src3'").select(name.alias("path"), F.col("text").cast("binary").alias("content"))
    gone = d.where("source = 'src3'").select(content_hash(F.col("text")).alias("digest")).distinct()
    box = I.Intake(spark, K.new_path(spark, "intake"))
    for _ in range(3):
        box.add(files, gone)
    return box.records().select("digest", "path", "status", "attempts", "n_cells")


# Drafts with reasons by the labels; stored ones of every third document, of which some were touched.
_DRAFTS = """SELECT d.doc_id, CASE d.doc_id % 5 WHEN 0 THEN 'val' WHEN 1 THEN 'test' WHEN 2 THEN 'review_only' WHEN 3 THEN 'other' ELSE 'train' END AS split, coalesce(source, '') AS format,
  list_filter([CASE WHEN toxic = 1 THEN 'E_OCR' END, CASE WHEN quality = 0 THEN 'E_COVERAGE' END, CASE WHEN d.doc_id % 6 = 0 THEN 'E_NEW' END], lambda x: x IS NOT NULL) AS reasons, ['Возможно пропущена таблица или товарные строки.', 'прочее', 'прочее'] AS warnings
  FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN labels USING (doc_id)"""
_SAID = "list_transform(reasons, lambda x: CASE x WHEN 'E_OCR' THEN 'Проверьте качество OCR и полноту извлечения.' WHEN 'E_COVERAGE' THEN 'Возможно пропущена таблица или товарные строки.' ELSE 'Требуется проверка.' END)"


@query(f"""WITH dr AS ({_DRAFTS}), ok AS (SELECT * FROM dr WHERE split <> 'other' AND doc_id % 11 <> 0),
st AS (SELECT doc_id, 1 + (doc_id % 4 = 0)::BIGINT AS revision, CASE WHEN doc_id % 7 = 0 THEN 'approved' ELSE 'draft' END AS status, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS reviewed FROM dr WHERE doc_id % 3 = 0),
kept AS (SELECT * FROM st WHERE NOT coalesce(revision = 1 AND status = 'draft' AND NOT reviewed AND doc_id IN (SELECT doc_id FROM ok), false)),
r AS (SELECT *, row_number() OVER (PARTITION BY split, format, reasons ORDER BY doc_id) AS round FROM ok), t AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round, format, reasons, doc_id) AS turn FROM r),
q AS (SELECT *, row_number() OVER (ORDER BY turn, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 WHEN 'test' THEN 3 ELSE 4 END) AS place FROM t),
n AS (SELECT *, {_SAID} AS issues FROM q WHERE place <= 300 AND doc_id NOT IN (SELECT doc_id FROM kept))
SELECT doc_id, revision, status, reviewed AS human_reviewed, NULL::VARCHAR AS split, NULL::VARCHAR AS reasons, NULL::VARCHAR AS issues, NULL::VARCHAR AS warnings, 'found' AS state, true AS reviewed FROM kept
UNION ALL SELECT doc_id, 1, 'draft', false, split, array_to_string(reasons, ','), array_to_string(issues, '|'), array_to_string(list_filter(['Возможно пропущена таблица или товарные строки.', 'прочее', 'Проверьте качество OCR и полноту извлечения.', 'Требуется проверка.'], lambda x: x IN ('Возможно пропущена таблица или товарные строки.', 'прочее') OR list_contains(issues, x)), '|'), 'pending', false FROM n""")
def review_import(spark, sf_dir):
    """The annotation table after an import of 300 machine drafts that puts untouched ones anew."""
    i = F.col("doc_id")
    why = F.array_compact(F.array(F.when(F.col("toxic") == 1, "E_OCR"), F.when(F.col("quality") == 0, "E_COVERAGE"), F.when(i % 6 == 0, "E_NEW")))
    split = F.when(i % 5 == 0, "val").when(i % 5 == 1, "test").when(i % 5 == 2, "review_only").when(i % 5 == 3, "other").otherwise("train")
    fields, tables = F.array(F.struct(F.lit("currency").alias("field"), F.lit("found").alias("state"))), F.array(F.struct(F.lit(1).alias("block"), F.lit(True).alias("reviewed")))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").distinct().join(table(spark, sf_dir, "labels"), "doc_id")
    warnings = F.array(F.lit(W.MESSAGES["E_COVERAGE"]), F.lit("прочее"), F.lit("прочее"))
    d = d.select("doc_id", split.alias("split"), F.coalesce("source", F.lit("")).alias("format"), F.lit(None).cast("string").alias("label_status"), why.alias("reasons"), warnings.alias("warnings"), fields.alias("fields"), tables.alias("tables"))
    old = d.where("doc_id % 3 = 0").withColumns({"revision": F.when(i % 4 == 0, 2).otherwise(1).cast("long"), "status": F.when(i % 7 == 0, "approved").otherwise("draft"), "human_reviewed": F.when(i % 9 != 0, i % 2 == 0)})
    gone = {c: F.lit(None).cast(t) for c, t in (("split", "string"), ("reasons", "array<string>"), ("issues", "array<string>"), ("warnings", "array<string>"))}
    old = old.withColumns(gone).drop("format")
    got = W.import_review(old, d, d.where("doc_id % 11 = 0").select("doc_id"), 300, rebalance=True)
    line = lambda c, by: F.array_join(c, by).alias(c)
    return got.select("doc_id", "revision", "status", "human_reviewed", "split", line("reasons", ","), line("issues", "|"), line("warnings", "|"), F.col("fields")[0]["state"].alias("state"), F.col("tables")[0]["reviewed"].alias("reviewed"))


@query("SELECT DISTINCT doc_id FROM labels WHERE (toxic = 1 OR quality = 0) AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND doc_id % 4 <> 0)")
def unregistered_exclusions(spark, sf_dir):
    """Excluded documents that the registry lacks; training may not start while there are any."""
    bad = table(spark, sf_dir, "labels").where("toxic = 1 or quality = 0")
    return H.unregistered(bad, table(spark, sf_dir, "documents").where("doc_id % 4 <> 0"))
