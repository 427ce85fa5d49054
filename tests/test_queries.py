"""Every query with SQL gives that SQL's rows on the smallest tables; the entry works without the optional parts."""

import os
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from tabulon.plans import answers, audit, examples, labelling, lifecycle, pages, planning  # noqa: F401 - they register their queries
from tabulon.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    cur = con.execute(plans.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(r[names.index(c)] for c in df.columns) for r in cur.fetchall())
    assert Counter(tuple(r) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_partition_has_no_leaks(spark):
    rows = plans.QUERIES["grouped_partition"](spark, SF).collect()
    split = {}
    for r in rows:
        assert split.setdefault(r.root, r.split) == r.split
    assert {"train", "val", "test"} == set(split.values())


def test_partition_keeps_short_copies_together(spark, tmp_path):
    rows = [(1, "ab cd"), (2, ""), (3, "AB  cd."), (4, None), (5, "ab ce"), (6, "n 12"), (7, "n 13"), (8, "n 12")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.root for r in plans.QUERIES["grouped_partition"](spark, str(tmp_path)).collect()}
    assert got == {1: 1, 3: 1, 2: 2, 4: 2, 5: 5, 6: 6, 8: 6, 7: 7}


def test_size_batches_and_revisions(spark):
    got = {(r.doc_id, r.item): r.batch for r in plans.QUERIES["size_batches"](spark, SF).collect()}
    from tabulon.sources.offers import offer_items

    sizes = {}
    for r in offer_items(spark, SF).select("doc_id", "item", "name").collect():
        sizes.setdefault(r.doc_id, []).append((r.item, len(r.name)))
    for doc, items in sizes.items():
        used = batch = 0
        for item, n in sorted(items):
            if used and used + n > 100:
                used, batch = 0, batch + 1
            used += n
            assert got[doc, item] == batch
    done = {}
    for r in sorted(plans.QUERIES["revision_update"](spark, SF).collect(), key=lambda r: (r.user_id, r.event_id)):
        now = done.get(r.user_id, 1)
        assert r.accepted == (r.revision == now)
        done[r.user_id] = now + r.accepted


def test_entry_without_optional_parts(tmp_path):
    """The package imports and lists its queries where the training-data folders are gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "tabulon", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "tabulon")
    for name in os.listdir(f"{root}/tabulon"):
        if name != "llm":
            os.symlink(f"{root}/tabulon/{name}", tmp_path / "tabulon" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'line_arithmetic' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
