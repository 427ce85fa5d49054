"""Intake of files: once each, two attempts, across runs and streams."""

import io
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from tabulon.operators.cells import text_cells
from tabulon.sources import files
from tabulon.sources.intake import Intake, content_digest

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1"><v>7</v></c><c r="B1"><f>A1*2</f>{}</c></row></sheetData></worksheet>'


def workbook(value):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET.format(value))
    return out.getvalue()


def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.txt").write_text("x\t1\nline")
    (at / "copy of a.txt").write_text("x\t1\nline")
    (at / "whole.xlsx").write_bytes(workbook("<v>14</v>"))
    (at / "open.xlsx").write_bytes(workbook(""))
    (at / "broken.xlsx").write_bytes(b"no archive")
    (at / "gone.txt").write_text("excluded")
    (at / "blank.txt").write_text(" \n")
    return at


def by_name(box):
    return {r.path.rpartition("/")[2]: r for r in box.records().collect()}


def test_a_restarted_stream_reads_nothing_twice(spark, tmp_path):
    at, box = folder(tmp_path), Intake(spark, f"{tmp_path}/store")
    gone = spark.createDataFrame([(content_digest(b"excluded"),)], "digest string")

    def run():
        q = box.stream(str(at), gone)
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    got = by_name(box)
    assert set(got) == {"a.txt", "whole.xlsx", "open.xlsx", "broken.xlsx", "blank.txt"}
    assert {k: (r.status, r.attempts, r.n_cells) for k, r in got.items()} == {"a.txt": ("parsed", 1, 3), "whole.xlsx": ("parsed", 1, 2), "open.xlsx": ("parsed", 1, 1), "broken.xlsx": ("failed", 1, 0), "blank.txt": ("parsed", 1, 0)}
    assert got["open.xlsx"].incomplete and not got["whole.xlsx"].incomplete
    n = box.attempts().count()
    run()
    assert box.attempts().count() == n
    (at / "new.txt").write_text("new")
    shutil.copy(at / "broken.xlsx", at / "broken again.xlsx")  # the same content once more: its second attempt
    shutil.copy(at / "a.txt", at / "a again.txt")
    run()
    got = by_name(box)
    assert got["new.txt"].status == "parsed" and got["a.txt"].attempts == 1
    broken = next(r for k, r in got.items() if k.startswith("broken"))
    assert (broken.status, broken.attempts) == ("given up", 2)
    shutil.copy(at / "broken.xlsx", at / "broken third.xlsx")
    n = box.attempts().count()
    run()
    assert box.attempts().count() == n
    docs = {r.digest: r for r in box.documents().collect()}
    assert docs[got["a.txt"].digest].cell_count == 3 and docs[got["blank.txt"].digest].cell_count == 0
    assert {(r.format, r.status): r.documents for r in box.report().collect()} == {("txt", "parsed"): 3, ("xlsx", "parsed"): 2, ("xlsx", "given up"): 1}


def test_a_run_that_dies_counts_as_an_attempt(spark, tmp_path, monkeypatch):
    box = Intake(spark, f"{tmp_path}/store")
    df = spark.createDataFrame([("a.txt", b"one"), ("b.txt", b"two")], "path string, content binary")
    from tabulon.sources import intake

    with monkeypatch.context() as m:
        m.setattr(intake, "_parsed", lambda _: (_ for _ in ()).throw(RuntimeError("lost")))
        for _ in range(1):
            with pytest.raises(RuntimeError):
                box.add(df)
    assert {r.status for r in box.records().collect()} == {"pending"} and box.cells().count() == 0
    box.add(df)
    assert {(r.status, r.attempts) for r in box.records().collect()} == {("parsed", 2)} and box.cells().count() == 2


def test_text_files_and_text_columns_have_the_same_cells(spark):
    texts = ["a\tb|c\r\nplain line\n\n x  y \rz", "", "\n\n", "one", "a | b\na  b\nc"]
    got = text_cells(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        own = sorted((r.block, r.row, r.col, r.text, r.kind) for r in got if r.doc_id == i)
        assert own == sorted(r[:5] for r in files.text_rows(t))


def test_no_files(spark, tmp_path):
    box = Intake(spark, f"{tmp_path}/store")
    box.add(spark.createDataFrame([], "path string, content binary"))
    assert box.records().count() == 0 and box.documents().count() == 0 and box.report().agg(F.sum("documents")).first()[0] is None
