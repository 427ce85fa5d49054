"""What keeps the work in proportion: plans that shuffle once, and caps on what meets."""

import re

from pyspark.sql import functions as F

from tabulon.functions import labels, numbers, text
from tabulon.operators import dedup
from tabulon.operators import labelling as L
from tabulon.operators.cells import cell_roles


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


CELLS = "doc_id long, block long, row long, col long, text string, kind string"


def test_labels_are_shuffled_once(spark):
    df = spark.range(100).select(F.concat(F.lit("цена "), F.col("id").cast("string")).alias("text"))
    assert shuffles(labels.classify(df, "text")) == 2  # of the texts, and of the fixed aliases


def test_likeness_of_odd_labels(spark):
    known = [("a", "аб"), ("b", "бв"), ("b", "аб")]
    like = labels.Likeness(known)
    like.SLICE = 10  # a slice for each label
    got = like.scores(["аб", "", "бвбв", "\U0001f600", "xyz"])
    # "  а", " аб", "аб ", "б  " once each: four grams of four
    assert got[0].tolist() == [1.0, 1.0] and got[1].tolist() == [0.0, 0.0] and got[3].tolist() == got[4].tolist() == [0.0, 0.0]
    # "  б", " бв", "бвб", "вбв", "бв ", "в  ": four of its six are those of "бв"
    assert abs(got[2][1] - 4 / (6 * 4) ** 0.5) < 1e-12
    assert labels.Likeness(known).scores([]).shape == (0, 2)


def test_numbers_with_guards_are_those_of_the_grammar(spark):
    said = ["12", "12.5", "12.555", "007", "12.", " 12.50 ", "руб 5", "5 К", "KZT 1 234,56", "№ 5", "1/2", "тг. 3", "١", "5Kzt", "1 2 3,456789", ""]
    got = [tuple(r) for r in spark.createDataFrame([(x,) for x in said], "t string").select(numbers.parse_number(F.col("t")), numbers.numeric_quote(F.col("t")), numbers.matrix_number(F.col("t"))).collect()]
    want = {"12": 12.0, "12.5": 12.5, "007": 7.0, " 12.50 ": 12.5, "руб 5": 5.0, "KZT 1 234,56": 1234.56, "тг. 3": 3.0, "5Kzt": 5.0}
    assert [g[0] for g in got] == [want.get(x) for x in said]
    assert got[said.index("1 2 3,456789")] == (None, 123.456789, None) and got[said.index("12.555")] == (None, None, None)


def test_odd_labels_are_normalised(spark):
    said = ["ＡＢ：ｃ", "Ёж", "ﬁн", "a–b", "x y", "ЦЕНА / ед.:"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in said], "t string").select(text.normalize_label(F.col("t"))).collect()]
    assert got == ["ab c", "еж", "fiн", "a b", "x y", "цена ед"]


def test_rule_tables_shuffle_cells_once(spark):
    rows = [(1, 1, 1, 1, "Наименование", "table"), (1, 1, 1, 2, "Сумма", "table"), (1, 1, 2, 1, "болт", "table"), (1, 1, 2, 2, "5", "table"), (1, 1, 3, 1, "Итого", "table"), (1, 1, 3, 2, "5", "table")]
    t = L.rule_tables(spark.createDataFrame(rows, CELLS))
    assert shuffles(t) == 1
    assert [(r["first"], r["last"], r["is_items"], r["name_col"]) for r in t.collect()] == [(2, 2, True, 1)]


def test_cells_of_one_place_count_once(spark):
    rows = [(1, 1, 1, 2, "товар", "table"), (1, 1, 1, 2, "Сумма", "table"), (1, 1, 1, 1, "7", "table"), (1, 1, 1, 1, "8", "table"), (1, 1, 1, 3, "цена", "table"), (1, 1, 1, 4, "Цена", "table")]
    r = L.row_maps(spark.createDataFrame(rows, CELLS)).first()
    assert {k: v["text"] for k, v in r["at"].items()} == {1: "7", 2: "Сумма", 3: "цена", 4: "Цена"}
    assert (r["name"], r["lineTotal"], r["unitPrice"]) == ([], [2], [3, 4])


def test_roles_are_written_before_cells_are_joined(spark):
    rows = [(1, 1, 1, 1, "Цена", "table"), (1, 1, 1, 2, "шт", "table"), (1, 1, 1, 3, "12", "table")]
    roles = cell_roles(spark.createDataFrame(rows, CELLS))
    assert shuffles(roles) == 0 and {r["text"]: r["role"] for r in roles.collect()} == {"Цена": "unitPrice", "шт": "quantity"}


def test_shingles_of_one_document_go_no_further(spark, monkeypatch):
    from tabulon.sources import store

    kept, stage = {}, store.stage
    monkeypatch.setattr(store, "stage", lambda df, name: kept.setdefault(name, stage(df, name)))
    words = lambda a, n: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(a, a + n))
    rows = [(1, words(0, 40)), (2, words(0, 40) + " end"), (3, words(100, 60)), (4, words(200, 10) + " " + words(100, 9)), (5, words(0, 40))]
    got = dedup.similar_pairs(dedup.shingles(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 36, 37, 36), (1, 5, 36, 36, 36)]
    assert {r["id"] for r in kept["shared"].collect()} == {1, 2}


def test_items_shuffle_cells_once(spark, monkeypatch):
    """Cells are gathered to rows with one shuffle, headers and items included; a second header and a total row rule as before."""
    from tabulon.operators import cells as C
    from tabulon.operators import rules as R

    texts = {1: ("Наименование", "Кол-во", "Сумма"), 2: ("болт", "2", "10"), 3: ("Итого", "", "10"), 4: ("гайка", "1", "5"), 5: ("Сумма", "Кол-во", "Наименование"), 6: ("7,50", "3", "шайба")}
    rows = [(d, 1, r, i + 1, t, "table") for d in (1, 2) for r, ts in texts.items() for i, t in enumerate(ts)]
    cells = spark.createDataFrame(rows, CELLS).repartition(3)
    items = R.item_rows(cells)
    # of the cells; the fixture's own is round robin
    assert shuffles(items) == 1
    want = [(d, *x) for d in (1, 2) for x in ((2, "болт", 2.0, 10.0), (6, "шайба", 3.0, 7.5))]
    assert sorted((r.doc_id, r.row, r.name, r.quantity, r.line_total) for r in items.collect()) == want
    # a mapping of its own gives the same
    assert sorted(map(tuple, R.item_rows(cells, R.header_mapping(cells)).collect())) == sorted(map(tuple, items.collect()))
    # parts grow with the number of cells
    monkeypatch.setattr(C, "CELLS_A_TASK", 2)
    assert C.spread(cells).rdd.getNumPartitions() == len(rows) // 2
    assert sorted(map(tuple, R.item_rows(cells).collect())) == sorted(map(tuple, items.collect()))


def test_a_plan_makes_what_is_asked(spark, monkeypatch):
    """Fields of a plan need no items, and facts come with the rows in one shuffle."""
    from tabulon.operators import planning as P
    from tabulon.operators.cells import FACTS, row_facts

    made = []
    stage = P.stage
    monkeypatch.setattr(P, "stage", lambda df, name: made.append(name) or stage(df, name))
    rows = [(1, 1, 1, 1, "Наименование", "table"), (1, 1, 1, 2, "Сумма", "table"), (1, 1, 2, 1, "болт", "table"), (1, 1, 2, 2, "5", "table")]
    cells = spark.createDataFrame(rows, CELLS)
    headers = cells.where("row = 1").withColumn("colspan", F.lit(1).cast("long"))
    t = spark.createDataFrame([(1, 1, 1, 2, 2, 1, 0, 0, 0, 2, [], [])], f"doc_id long, n long, block long, first long, last long, name_col long, quantity_col long, unit_col long, price_col long, total_col long, components array<{L.COMPONENT}>, extras array<{L.EXTRA}>")
    fields = spark.createDataFrame([(1, 1, "client", 1, 2, 1, "болт")], "doc_id long, n long, field string, block long, row long, col long, value string")
    applied = P.apply_plan(cells, t, fields, headers)
    assert [(r.field, r.value) for r in applied.fields.collect()] == [("client", "болт")] and "items" not in made
    assert [(r.row, r.name, r.line_total) for r in applied.items.collect()] == [(2, "болт", 5.0)]
    columns = ("doc_id", "block", "row", *FACTS)
    assert shuffles(L.row_maps(cells, facts=True)) == 1
    assert sorted(map(tuple, applied.rows.select(*columns).collect())) == sorted(map(tuple, row_facts(cells).select(*columns).collect()))


def test_documents_are_gathered_with_one_shuffle(spark):
    """Rows and blocks are gathered where their document's cells are."""
    from tabulon.operators import structure as N

    rows = [(d, b, r, c, f"{d}.{b}.{r}.{c}", "table" if b else "text") for d in (1, 2) for b in (0, 1) for r in (2, 1) for c in (2, 1)]
    n = N.nested(spark.createDataFrame(rows, CELLS))
    assert shuffles(n) == 1
    assert sorted(map(tuple, N.flattened(n).select("doc_id", "block", "row", "col", "text", "kind").collect())) == sorted(rows)
    assert [(r.n_cells, r.n_tables, [b["block"] for b in r.blocks]) for r in n.collect()] == [(8, 1, [0, 1])] * 2


def test_payloads_shuffle_cells_once(spark):
    """Facts, samples and tables of a payload are found where the cells of a document are, and header paths where those of a block are."""
    from tabulon.operators import rules as R
    from tabulon.operators import structure as N

    rows = [(1, 0, 1, 1, "Оплата: 5 дней", "text"), (1, 1, 1, 1, "Наименование", "table"), (1, 1, 1, 2, "Сумма", "table"), (1, 1, 2, 1, "болт", "table"), (1, 1, 2, 2, "5", "table"), (2, 3, 1, 1, "a", "table")]
    cells = spark.createDataFrame(rows, CELLS)
    heads = spark.createDataFrame([(1, 1, 1, 1, 1, "Имя"), (1, 1, 1, 2, 1, "Вариант"), (1, 1, 1, 3, 1, ""), (1, 1, 2, 2, 2, "Цена")], "doc_id long, block long, row long, col long, colspan long, text string")
    assert shuffles(R.header_paths(heads)) == 1
    paths = spark.createDataFrame(R.header_paths(heads).collect(), "doc_id long, block long, col long, path string")
    assert sorted(map(tuple, paths.collect())) == [(1, 1, 1, "Имя"), (1, 1, 2, "Вариант / Цена"), (1, 1, 3, "Вариант / Цена")]
    p = N.plan_payload(cells, paths)
    # of the cells, and of the paths by block and by document
    assert shuffles(p) == 3
    got = {r["doc_id"]: r for r in p.collect()}
    row = lambda r, *t: '{"row":%d,"cells":[%s]}' % (r, ",".join('{"col":%d,"text":"%s"}' % (i + 1, x) for i, x in enumerate(t)))
    head = row(1, "Наименование", "Сумма")
    columns = ",".join('{"col":%d,"path":"%s"}' % (i + 1, x) for i, x in enumerate(("Имя", "Вариант / Цена", "Вариант / Цена")))
    table = '{"block":1,"n_rows":2,"first_row":1,"last_row":2,"headers":[%s],"samples":[%s,%s],"columns":[%s]}' % (head, head, row(2, "болт", "5"), columns)
    assert got[1]["payload"] == '{"metadata":[{"block":0,"rows":[%s]},{"block":1,"rows":[%s]}],"tables":[%s]}' % (row(1, "Оплата: 5 дней"), head, table)
    assert (got[1]["n_tables"], got[1]["n_metadata"], got[2]["n_tables"]) == (1, 2, 1) and '"columns":[]' in got[2]["payload"]


def test_claims_meet_cells_once(spark):
    """A claim's cell and row come from one shuffle of cells, and two cells in one place are not two claims."""
    from tabulon.operators import answers as A
    from tabulon.operators import planning as P

    rows = [(1, 0, 1, 1, "Клиент: ТОО Рога", "text"), (1, 0, 2, 1, "Итого: 5", "text"), (1, 0, 2, 1, "Итого: 7", "text"), (1, 0, 3, 1, "Менеджер", "table"), (1, 0, 3, 2, "Петров", "table")]
    cells = spark.createDataFrame(rows, CELLS)
    said = [(1, 1, "client", 0, 1, 1, "ТОО Рога"), (1, 2, "client", 0, 1, 1, "Рога"), (1, 3, "Менеджер", 0, 3, 2, "Петров"), (1, 4, "Адрес", 0, 3, 2, "Петров"), (1, 5, "documentTotal", 0, 2, 1, "5"), (1, 6, "title", 0, 9, 1, "x")]
    fields = spark.createDataFrame(said, "doc_id long, n long, field string, block long, row long, col long, value string")
    fit = A.typed_fields(fields, cells)
    # of cells, of claims by row, and of the rows that have a claim
    assert shuffles(fit) <= 3
    assert sorted((r.n, r.fits) for r in fit.collect()) == [(1, True), (2, True), (3, True), (4, True), (5, True), (6, False)]
    found = P.field_states(fields, cells, spark.createDataFrame([], "doc_id long, block long"))
    assert shuffles(found) <= 7
    assert sorted((r.n, r.state) for r in found.collect()) == [(1, "ok"), (2, "conflict"), (3, "extra"), (4, "no label"), (5, "ok"), (6, "no quote")]


def test_examples_carry_their_fields(spark):
    """Batches carry cells and fields: nothing is joined to them after they are cut."""
    from tabulon.operators import examples as T

    rows = [(1, 0, r, 1, f"поле {r}", "text") for r in range(1, 5)] + [(1, 1, 1, 1, "Наименование", "table"), (1, 1, 2, 1, "болт", "table"), (1, 0, 9, 1, "", "text")]
    cells = spark.createDataFrame(rows, CELLS)
    t = spark.createDataFrame([(1, 1, True, 2, 2, 1, 0, 0, [], [])], f"doc_id long, block long, is_items boolean, first long, last long, name_col long, quantity_col long, unit_col long, components array<{L.COMPONENT}>, extras array<{L.EXTRA}>")
    fields = spark.createDataFrame([(1, "client", "found", 0, 2, 1, "2"), (1, "title", "found", 0, 2, 1, "поле"), (1, "vat", "missing", 0, 1, 1, "1"), (1, "discount", "found", 1, 2, 1, "болт")], "doc_id long, field string, state string, row_block long, row long, col long, value string")
    catalog = spark.createDataFrame([(1, 1, "1,2")], "doc_id long, block long, sample string")
    e = T.training_examples(cells, catalog, t, fields, limit=60)
    assert shuffles(e) <= 11
    got = {(r.task, r.place): (r.n_cells, r.answer) for r in e.collect()}
    quote = lambda f, v: '{"field":"%s","block":0,"row":2,"col":1,"value":"%s"}' % (f, v)
    assert got[("Requisites", 0)] == (2, '{"fields":[%s,%s]}' % (quote("client", "2"), quote("title", "поле")))
    assert got[("Requisites", 1)] == (2, '{"fields":[]}') and got[("Requisites", 2)] == (1, '{"fields":[]}') and got[("Layout", 1)][0] == 2


def scans(df, name: str) -> int:
    import re

    return len(re.findall(rf"(?:FileScan|Scan) parquet[^\n]*/{name}\.parquet", df._jdf.queryExecution().executedPlan().toString()))


SF = "/root/testdata/sf0.001"


def test_offers_are_rendered_in_one_pass(spark, monkeypatch, tmp_path):
    """Lines and heads are shuffled together once, and tasks grow in number with the lines; lines without a part and repeated parts count as in SQL."""
    from tabulon.sources import offers as O

    cells = O.offer_cells(spark, SF)
    assert scans(cells, "lineitem") == 1
    by_row = cells.groupBy("doc_id", "block", "row").count()
    assert shuffles(by_row) == shuffles(cells)  # they lie by document
    want = sorted(map(tuple, cells.collect()))
    monkeypatch.setattr(O, "LINES_A_TASK", 100)
    many = O.offer_cells(spark, SF)
    assert many.rdd.getNumPartitions() == spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100
    assert sorted(map(tuple, many.collect())) == want
    part = spark.read.parquet(f"{SF}/part.parquet")
    part.where("p_partkey % 7 <> 0").unionByName(part.where("p_partkey % 5 = 0").withColumn("p_name", F.lit(None).cast("string"))).write.parquet(f"{tmp_path}/part.parquet")
    tables = ["lineitem", "orders", "customer", "supplier"]
    for t in tables:
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    frames = O.tables(spark, str(tmp_path), *tables, "part")
    sql = lambda text, **more: spark.sql(__import__("re").sub(r"(FROM|JOIN) (lineitem|part|orders|customer|supplier|items|heads)\b", r"\1 {\2}", text), **more)
    items = sql(O.items_sql(O.SPARK), lineitem=frames["lineitem"], part=frames["part"])
    heads = sql(O.heads_sql(O.SPARK), items=items, **{t: frames[t] for t in tables[1:]})
    told = lambda df: sorted(map(str, df.collect()))
    assert told(O.offer_items(spark, str(tmp_path)).select(items.columns)) == told(items)
    assert told(O.offer_heads(spark, str(tmp_path)).select(heads.columns)) == told(heads)


def test_readings_are_fused_in_one_pass(spark):
    """Offers are rendered once for both readings; repeated places, odd texts and nulls meet as before."""
    from tabulon.operators import fusion as G
    from tabulon.plans import queries as Q

    assert scans(Q.QUERIES["native_visual_fusion"](spark, SF), "lineitem") == 1
    kind = "doc_id long, row long, col long, text string"
    native = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 1, "b"), (1, 2, 2, None), (2, 1, 1, "x"), (2, 1, 2, "Y y"), (2, 1, 3, "x"), (None, 1, 1, "n")], kind)
    visual = spark.createDataFrame([(1, 1, 1, "A"), (1, 2, 2, "c"), (1, None, 1, "b"), (2, 5, 5, "X"), (2, 1, 2, "yY"), (3, 1, 1, "z"), (None, 1, 1, "n")], kind)
    got = G.fuse_grids(native, visual)
    assert shuffles(got) == 1
    want = [(1, 1, 1, "a", "place"), (1, 1, 1, "b", "place"), (1, 2, 2, "c", "visual"), (1, None, 1, "b", "text"), (2, 5, 5, "X", "visual"), (2, 1, 2, "Y y", "text"), (3, 1, 1, "z", "visual"), (None, 1, 1, "n", "visual")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_evidence_is_climbed_in_its_document(spark):
    """No level is shuffled or written; documents longer than a batch, circles, repeated and nameless entries end as by the rules."""
    from tabulon.operators import evidence as E

    kind = "doc_id long, node string, parent string, kind string, cell string, excerpt string"
    rows = [(1, "t", None, "calculated", None, None)] + [(1, f"c{i}", f"c{i - 1}" if i else "t", "list", None, None) for i in range(300)] + [(1, "q", "c299", "quote", "1", "b")]
    rows += [(2, "t", None, "calculated", None, None), (2, "a", "b", "list", None, None), (2, "b", "a", "list", None, None), (2, "q", "t", "quote", "1", "a"), (2, None, "t", "quote", "2", "z")]
    rows += [(3, "x", "p", "quote", "1", "a"), (3, "x", "r", "quote", "9", "a"), (3, "p", None, "list", None, None), (3, "r", None, "list", None, None), (None, "o", None, "list", None, None)]
    cells = spark.createDataFrame([(1, "1", "a"), (2, "1", "a"), (2, "2", "z"), (2, "2", None), (3, "1", "a"), (3, None, "a")], "doc_id long, id string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = E.evidence_trees(spark.createDataFrame(rows, kind).repartition(3), cells)
        assert shuffles(df) == 1
        bad = {(r.doc_id, r.node) for r in df.collect() if not r.valid}
        assert df.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert bad == {(1, "t"), (1, "q"), *((1, f"c{i}") for i in range(300)), (2, "t"), (3, "x"), (3, "r")}


def test_requisites_of_odd_cells(spark):
    """Only what may be a label is read further."""
    from tabulon.operators import rules as R

    texts = [("  ﬁл", "1"), ("Клиент:  А ", None), ("«Ｃlient»", "Б"), ("К ОПЛАТЕ", "5"), ("№ документа", "7"), ("E–mail: x", None), ("12,50", "3"), ("_Клиент", "В")]
    rows = [(1, 0, r, c, t, "text") for r, pair in enumerate(texts) for c, t in enumerate(pair, 1) if t is not None] + [(1, 0, 20, 1, "Клиент", "text"), (1, 0, 20, 2, "Г", "text"), (1, 0, 20, 3, "Д", "text")]
    cells = spark.createDataFrame(rows, CELLS)
    assert sorted((r.row, r.field, r.value) for r in R.requisites(cells).collect()) == [(1, "client", "А"), (2, "client", "Б"), (3, "documentTotal", "5"), (4, "documentNumber", "7"), (5, "clientContact", "x")]
    plan = R.requisites(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert sum(x.lstrip(" +-:").startswith("Window ") for x in plan.splitlines()) == 1  # widths and neighbours are told in one go


def test_prices_shuffle_cells_once(spark):
    """Several names of a row each have its prices; cells and paths are shuffled once each, rows once more to meet paths by document."""
    from tabulon.operators import rules as R

    body = spark.createDataFrame([(1, 1, 2, 1, "болт", "table"), (1, 1, 2, 1, " винт", "table"), (1, 1, 2, 2, "5", "table"), (1, 1, 3, 1, "Итого", "table"), (1, 1, 3, 2, "5", "table"), (1, 1, 4, 2, "5", "table"), (1, 2, 2, 1, "x", "table"), (1, 2, 2, 2, "1", "table")], CELLS)
    paths = spark.createDataFrame([(1, 1, 2, "Цена"), (1, 2, 3, "Сумма")], "doc_id long, block long, col long, path string")
    assert sorted(tuple(r) for r in R.price_matrix(body, paths).collect()) == [(1, 1, 2, 2, "болт", "Цена", 5.0), (1, 1, 2, 2, "винт", "Цена", 5.0)]
    assert shuffles(R.price_matrix(body, paths)) <= 3


def test_numbers_with_a_currency_are_no_labels(spark):
    """They are neither classified nor normalised, and whatever could be near a label still is; white space is looked for at the ends only."""
    said = ["1 234,56 KZT", "12", "1 1 1 USD", "TRY", "Цена", "Цена KZT", "Ёд", "«Ед.изм»", "", None]
    df = spark.createDataFrame([(x,) for x in said], "text string")
    assert [r[0] for r in df.where(labels.may_name(F.col("text"))).collect()] == ["Цена", "Цена KZT", "Ёд", "«Ед.изм»"]
    assert [r[0] for r in df.where(labels.may_be_alias(F.col("text"))).collect()] == ["Цена", "Цена KZT", "Ёд", "«Ед.изм»"]
    near = labels.classify(df.where(~labels.may_name(F.col("text"))), "text")
    assert {r.method for r in near.collect()} == {"unknown"}
    cells = spark.createDataFrame([(1, 1, 1, i, x, "table") for i, x in enumerate(said)], CELLS)
    plan = cells.select(numbers.strip(F.col("text")).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
    assert spark.createDataFrame([(" \u0085  а　б\x1c\n",)], "t string").select(numbers.strip(F.col("t"))).first()[0] == "а　б\x1c"


def test_claims_meet_cells_of_their_places(spark):
    """Cells elsewhere are not shuffled; several cells of one place are all met, and a place without a cell is null."""
    cells = spark.createDataFrame([(1, 0, 1, 1, "a", "text"), (1, 0, 1, 1, "b", "text"), (1, 0, 9, 1, "x", "text"), (2, 0, 1, 1, "c", "text"), (None, 0, 1, 1, "z", "text")], CELLS)
    claims = spark.createDataFrame([(1, 0, 1, 1, "v"), (2, 0, 1, 2, "w"), (2, None, 1, 1, "n"), (None, 0, 1, 1, "o")], "doc_id long, block long, row long, col long, value string")
    got = L.texts_at(claims, cells)
    assert sorted((r.value, r.text or "") for r in got.collect()) == [("n", ""), ("o", ""), ("v", "a"), ("v", "b"), ("w", "")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftOuter") < plan.index("LeftSemi")


def test_fields_of_a_report_are_gathered_by_document(spark):
    """One shuffle of fields tells repeated and unknown ones and what drafts say otherwise."""
    docs = spark.createDataFrame([(i, False, False) for i in range(1, 7)], "doc_id long, parse_error boolean, incomplete boolean")
    kind = "doc_id long, field string, state string, row_block long, row long, col long, value string"
    said = [(1, "client", "found", "a"), (1, "client", "missing", None), (2, "nope", "missing", None), (3, "client", "found", "b"), (4, "client", "pending", "b"), (5, None, "missing", None), (5, None, "missing", None)]
    fields = spark.createDataFrame([(d, f, s, 0, 1, 1, v) for d, f, s, v in said], kind)
    drafts = spark.createDataFrame([(1, "client", "a"), (2, "client", ""), (3, "client", "b"), (4, "client", "b"), (6, "client", "b")], "doc_id long, field string, value string")
    cells = spark.createDataFrame([(i, 0, 1, 1, "a b", "text") for i in range(1, 7)], CELLS)
    tables = L.rule_tables(cells)
    report = L.annotation_report(docs, cells, tables, fields, drafts)
    got = {r.doc_id: set(r.reasons) - {"E_NO_ITEMS"} for r in report.collect()}
    assert got == {1: {"E_SCHEMA"}, 2: {"E_SCHEMA"}, 3: set(), 4: {"E_FIELD_CONFLICT"}, 5: {"E_SCHEMA"}, 6: {"E_FIELD_CONFLICT"}}
    plan = re.sub(r"#\d+L?", "", report._jdf.queryExecution().executedPlan().toString())
    assert "hashpartitioning(doc_id, field" not in plan


def test_placed_cells_stay_where_they_lie(spark):
    """Cells by document are neither shuffled nor written for items and rows, and give the same; a rendered text is made once however often it is used."""
    from tabulon.operators import rules as R
    from tabulon.sources import offers as O

    rows = [(1, 1, 1, 1, "Наименование", "table"), (1, 1, 1, 2, "Сумма", "table"), (1, 1, 2, 1, "болт", "table"), (1, 1, 2, 2, "5", "table"), (1, 1, 3, 1, "Итого", "table"), (1, 1, 3, 2, "5", "table"), (2, 1, 1, 1, "x", "table")]
    df = spark.createDataFrame(rows, CELLS)
    placed, roles = df.repartition("doc_id"), cell_roles(df)
    items = R.item_rows(placed, roles=roles, placed=True)
    assert shuffles(items) == 1 and sorted(items.collect()) == sorted(R.item_rows(df).collect()) and items.count() == 1
    maps = L.row_maps(placed, placed=True)
    assert shuffles(maps) == 1 and {(r.doc_id, r.row, len(r.at)) for r in maps.collect()} == {(1, 1, 2), (1, 2, 2), (1, 3, 2), (2, 1, 1)}
    cells = O.offer_cells(spark, "/root/testdata/sf0.001")
    twice = cells.where(F.length("text") > 3).select(F.upper("text"), F.lower("text"))
    assert twice._jdf.queryExecution().optimizedPlan().toString().count("Действительно до") == cells._jdf.queryExecution().optimizedPlan().toString().count("Действительно до")
