"""Near duplicates of rows whose ids are texts."""

from pyspark.sql import functions as F

from tabulon.llm import jaccard


def test_ids_of_any_type(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    numbers = jaccard.near_duplicates(docs).collect()
    name = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    named = jaccard.near_duplicates(docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.concat(F.lit("d"), name)))).collect()
    text = lambda i: None if i in (None, 0) else f"d{i:09}"
    # the document without an id, and its copies if any, answer to another least id
    zero = {r.component_id for r in numbers if r.doc_id == 0} | {0}
    want = sorted((text(r.doc_id), r.n_shingles, text(r.component_id)) for r in numbers if r.component_id not in zero)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in named if r.doc_id is not None and r.doc_id in {w[0] for w in want})
    assert got == want and len({w[2] for w in want}) < len(want)
    kept = jaccard.keep_one(docs.where("doc_id > 0").withColumn("doc_id", F.concat(F.lit("d"), name)), size=5, percent=80)
    plain = jaccard.keep_one(docs.where("doc_id > 0"), size=5, percent=80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(text(r.doc_id) for r in plain.collect())
    dates = docs.limit(20).withColumn("doc_id", F.date_add(F.lit("2026-01-01").cast("date"), F.col("doc_id").cast("int")))
    assert jaccard.near_duplicates(dates).count() == 20
