"""Odd input of the answer checks."""

import glob

from pyspark.sql import functions as F

from tabulon.operators import answers as A
from tabulon.operators import audit as U
from tabulon.operators import dataset as D
from tabulon.operators import dedup, examples

CELLS = "doc_id long, block long, row long, col long, text string, kind string, extra int"


def test_claims_on_absent_and_null_cells(spark):
    cells = spark.createDataFrame([(1, 0, 1, 1, None, "text", 0), (1, 0, 2, 1, "Поставщик", "table", 0), (1, 0, 2, 2, "ТОО Клиент", "table", 0)], CELLS)
    rows = [(1, 0, 1, 1, "supplier", "ТОО А"), (1, 0, 2, 2, "supplier", "Клиент"), (1, 0, 2, 2, "client", "ТОО Клиент"), (1, 0, 2, 2, "supplier", None), (1, 7, 1, 1, "title", "x"), (None, 0, 1, 1, "title", "x")]
    claims = spark.createDataFrame(rows, "doc_id long, block long, row long, col long, field string, value string")
    got = {(r.block, r.row, r.field, r.value): r.fits for r in A.typed_fields(claims, cells).collect()}
    assert len(got) == 6 and [k for k, v in got.items() if v] == [(0, 2, "supplier", "Клиент")]
    assert A.typed_fields(claims.limit(0), cells.limit(0)).count() == 0
    totals = A.document_totals(claims.withColumn("alternatives", F.lit(False)), cells.limit(0))
    assert {r.state for r in totals.collect()} == {"unknown cell"}
    assert A.explicit_fields(cells).count() == 0


def test_mapping_state(spark):
    rows = [([2, 0], [1, 0], 2, True), ([3], [1], 2, False), ([1], [1], 2, False), ([2], [0], 2, False), ([0], [1], 1, True)]
    df = spark.createDataFrame(rows, "mapped array<int>, reserved array<int>, width int, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", A.mapping_state(F.col("mapped"), F.col("reserved"), F.col("width"))).collect())


def test_offsets_over_many_ranges(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4500, "train").otherwise("val").alias("split"), (F.col("id") % 7).alias("count"))
    got = {r.id: r.start for r in D.offsets(df, "split", "id", "count").collect()}
    start = {"train": 0, "val": 0}
    for i in range(5000):
        s = "train" if i < 4500 else "val"
        assert got[i] == start[s]
        start[s] += i % 7
    manifest = D.offsets(df, "split", "id", "count")
    assert D.manifest_gaps(manifest, "split", "id").count() == 0
    assert {r.id for r in D.manifest_gaps(manifest.where("id <> 2001"), "split", "id").collect()} == {2002}
    assert D.offsets(df.limit(0), "split", "id", "count").count() == 0


def test_equal_sets_are_one_class(spark):
    a, b = "one two three four five six seven eight nine ten", "one two three four five six seven eight nine eleven"
    df = spark.createDataFrame([(i, a) for i in range(200)] + [(900, b), (901, None), (902, "short")], "doc_id long, text string")
    pairs = [(r.a, r.b, r.common) for r in dedup.similar_pairs(dedup.shingles(df), percent=70).collect()]
    assert len(pairs) == 200 and (0, 900, 5) in pairs  # 199 copies hang on the first, one pair of different sets
    assert all(x[0] == 0 for x in pairs)


def test_empty_tables_and_nulls(spark):
    cells = spark.createDataFrame([], CELLS)
    assert U.page_routes(cells).count() == examples.html_preview(cells).count() == examples.prepare_tables(cells).count() == 0
    odd = spark.createDataFrame([(1, 0, 1, 1, None, "text", 0), (1, 0, 1, 2, "<&>", None, 0)], CELLS)
    assert examples.html_preview(odd).first().html == "<p>&lt;&amp;&gt;</p>" and U.page_routes(odd).first().reasons == "sparse"
    states = spark.createDataFrame([(None,), ("",), ("{",), ("{}",)], "j string").select(examples.page_state(F.col("j"), F.lit(1)).alias("s"))
    assert {r.s for r in states.collect()} == {"wrong keys"}
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "id long, v string")
    assert [r.unchanged for r in U.unchanged(df, df, ("id", "v")).collect()] == [True] * 3
    assert U.frozen_changes(U.corpus_fingerprint(df, "id"), U.corpus_fingerprint(df.orderBy(F.desc("id")), "id")).count() == 0


def test_staged_tables_are_released(spark):
    from tabulon.sources import store

    other = spark.newSession()
    path = store.stage(other.range(3).toDF("x"), "gone").inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert glob.glob(path + "/*.parquet")
    store.release(other)
    assert not glob.glob(path) and not [x for x in store._staged if x[0] is other]


def test_accepted_blocks(spark):
    rows = [(1, 0, "text"), (1, 1, "table"), (2, 0, "text"), (2, 0, "table"), (2, 1, "table"), (3, 0, "text"), (4, 0, "table"), (4, 0, "table"), (5, 0, None)]
    cells = spark.createDataFrame(rows, "doc_id long, block long, kind string")
    got = {r.doc_id: tuple(r)[1:] for r in U.accepted_blocks(cells).collect()}
    assert got == {1: (True, True, 0, True), 2: (True, True, 1, False), 3: (True, False, 0, False), 4: (False, True, 0, False), 5: (False, False, 0, False)}
    assert U.accepted_blocks(cells.limit(0)).count() == 0
