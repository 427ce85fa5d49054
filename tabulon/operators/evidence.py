"""Grounding of values in cells, and what is missing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ILLEGIBLE = "(?iu)неразборчив|illegible"


def ground(evidence: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, field, cell, excerpt) with ``state``: ok, unknown cell, blank, illegible or
    not in the cell's text."""
    e = evidence.join(cells.select("doc_id", F.col("id").alias("cell"), "text"), ["doc_id", "cell"], "left")
    state = F.when(F.col("text").isNull(), "unknown cell").when(F.trim("excerpt") == "", "blank").when(F.col("excerpt").rlike(ILLEGIBLE), "illegible").when(F.contains("text", F.col("excerpt")), "ok").otherwise("not in cell")
    return e.select("doc_id", "field", "cell", "excerpt", state.alias("state"))


def without_evidence(paths: DataFrame, grounded: DataFrame) -> DataFrame:
    """Populated paths that no grounded evidence supports."""
    return paths.join(grounded.where("state = 'ok'").select("doc_id", F.col("field").alias("path")).distinct(), ["doc_id", "path"], "left_anti")


def unique_source(values: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, value, cell): the only cell of the document that contains the value, else null."""
    hit = (values.doc_id == cells.doc_id) & F.contains(cells.text, values.value)
    found = values.join(cells, hit).groupBy(values.doc_id, values.value).agg(F.count("*").alias("n"), F.max(cells.id).alias("cell"))
    return values.join(found, ["doc_id", "value"], "left").select("doc_id", "value", F.when(F.col("n") == 1, F.col("cell")).alias("cell"))


def populated_paths(heads: DataFrame, items: DataFrame, fields: tuple, item_fields: tuple) -> DataFrame:
    """(doc_id, path) of all values that are neither null nor blank; 0 counts."""
    set_ = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    a = heads.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(set_(c), F.lit(c)) for c in fields]))).alias("path"))
    b = items.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(set_(c), F.concat(F.lit("items."), F.col("item").cast("string"), F.lit("." + c))) for c in item_fields]))).alias("path"))
    return a.unionByName(b)


def missing_reason(unreadable, absent):
    return F.when(unreadable, "unreadable").when(absent, "absent").otherwise("unverified")


def outcome(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, n_items, n_missing, n_issues) with their state."""
    state = F.when((F.col("n_items") == 0) & (F.col("n_values") == 0), "unavailable").when((F.col("n_missing") > 0) | (F.col("n_issues") > 0) | (F.col("n_items") == 0), "partial").otherwise("complete")
    return docs.withColumn("state", state)


def first_nonblank(rows: DataFrame, keys: tuple, fields: tuple, order: tuple) -> DataFrame:
    """Of several documents merged by ``keys``: the first value that is not blank of each
    field, and whether differing ones exist."""
    out = []
    for f in fields:
        v = F.when(F.trim(F.col(f).cast("string")) != "", F.col(f))
        out += [F.min_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(f), (F.count_distinct(F.lower(F.trim(v.cast("string")))) > 1).alias(f"{f}_conflict")]
    return rows.groupBy(*keys).agg(*out)


def repeated_names(items: DataFrame, keys: tuple, name: str, order: tuple) -> DataFrame:
    """Items whose name, but for case and outer spaces, came earlier."""
    w = Window.partitionBy(*keys, F.lower(F.trim(name))).orderBy(*order)
    return items.withColumn("repeat", F.row_number().over(w) > 1)


def evidence_trees(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, node, valid) of evidence in trees of any depth, given as rows (doc_id, node, parent, kind, cell, excerpt).

    A ``quote`` is valid if its excerpt is its cell's whole text; a ``list`` and a ``calculated`` entry are if they have sources
    and all of them are. So an entry is invalid just when a bad quote or an entry without sources is below
    it. Entries and cells lie by document: quotes meet their cells there, and a document's entries are climbed from the
    bad ones up where they are, so that nothing is shuffled or written for a level. A task holds a document's entries."""
    none = F.lit(None).cast("string")
    n = nodes.select("doc_id", "node", "parent", "kind", "cell", "excerpt", none.alias("text"), F.lit(False).alias("said"))
    c = cells.select("doc_id", none.alias("node"), none.alias("parent"), none.alias("kind"), F.col("id").alias("cell"), none.alias("excerpt"), "text", F.lit(True).alias("said"))
    doc, at = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "cell")
    own = F.col("said")
    both = n.unionByName(c).withColumn("n", F.count_if(~own).over(doc))
    # of several cells in one place each has to say it; null places are none
    whole = (F.count("text").over(at) == F.count_if(own).over(at)) & (F.min("text").over(at) == F.col("excerpt")) & (F.max("text").over(at) == F.col("excerpt"))
    both = both.withColumn("whole", whole & F.col("cell").isNotNull() & F.col("doc_id").isNotNull()).where(~own)
    wrong = F.coalesce((F.col("kind") == "quote") & ~F.coalesce("whole", F.lit(False)), F.lit(False))
    rows = both.select("doc_id", "node", "parent", wrong.alias("wrong"), F.coalesce(F.col("kind") != "quote", F.lit(False)).alias("entry"), "n")
    kinds = dict(nodes.dtypes)
    return rows.mapInArrow(_climbed, ", ".join(f"{k} {kinds[k]}" for k in ("doc_id", "node", "parent")) + ", valid boolean")


def _climbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, node, parent, wrong, entry, n), n of them one after another for each document, with ``valid``."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None or not held.num_rows else pa.concat_tables([held, new])
        sizes, at, n = [], 0, held.column("n")
        while at < held.num_rows and at + n[at].as_py() <= held.num_rows:
            sizes.append(n[at].as_py())
            at += sizes[-1]
        if sizes:
            t = held.slice(0, at).combine_chunks()
            valid = pa.array(_valid(t, np.array(sizes)))
            yield from pa.table([t.column("doc_id"), t.column("node"), t.column("parent"), valid], names=["doc_id", "node", "parent", "valid"]).to_batches()
            held = held.slice(at)


def _valid(t: pa.Table, sizes: np.ndarray) -> np.ndarray:
    flag = lambda c: t.column(c).to_numpy().astype(bool)
    names = pa.concat_arrays([x for c in ("node", "parent") for x in t.column(c).chunks]).dictionary_encode()
    code = names.indices.fill_null(-1).to_numpy().astype(np.int64)
    doc = np.tile(np.repeat(np.arange(len(sizes)), sizes), 2)
    known = (code >= 0) & np.tile(~t.column("doc_id").is_null().to_numpy(), 2)
    ids = np.full(len(code), -1)
    distinct, ids[known] = np.unique((doc * (len(names.dictionary) + 1) + code)[known], return_inverse=True)
    own, up = np.split(ids, 2)
    used, bad, climbed = (np.zeros(len(distinct) + 1, bool) for _ in range(3))  # the last stands for no name
    used[up[up >= 0]] = True
    order = np.argsort(own, kind="stable")
    first, last = (np.searchsorted(own[order], np.arange(len(distinct)), side) for side in ("left", "right"))
    rows = np.flatnonzero(flag("wrong") | (flag("entry") & ~used[own]))
    while len(rows):
        bad[own[rows]] = True
        above = np.unique(up[rows])
        above = above[above >= 0]
        above = above[~climbed[above]]
        climbed[above] = True
        k = last[above] - first[above]
        rows = order[np.repeat(first[above] - np.cumsum(k) + k, k) + np.arange(k.sum())]
    bad[-1] = False
    return ~bad[own]
