"""Sinks: training datasets and reports as versions that appear whole, and spreadsheets.

A version is written to a folder of its own, and then one rename makes ``CURRENT`` name it: readers
see the version before or the new one, never a part, and a write that dies leaves the old one."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import spreadsheet_safe

#: Examples in a shard.
SHARD = 10_000


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, old: str, new: str, replace: bool) -> None:
    """Rename in one step; an existing ``new`` is replaced or an error."""
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, old).makeQualified(_files(spark, old).getUri(), _path(spark, "/")).toUri(), spark._jsc.hadoopConfiguration())
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE if replace else kinds.NONE
    context.rename(_path(spark, old), _path(spark, new), how)


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill the folder of a new version, and make it the current one. Returns the folder."""
    name = f"version-{uuid.uuid4().hex}"
    write(f"{path}/{name}")
    pointer = f"{path}/.pointer-{name}"
    stream = _files(spark, path).create(_path(spark, pointer))
    stream.write(bytearray(name.encode()))
    stream.close()
    _rename(spark, pointer, f"{path}/CURRENT", True)
    return f"{path}/{name}"


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the current version; None before the first."""
    if not _files(spark, path).exists(_path(spark, f"{path}/CURRENT")):
        return None
    return f"{path}/{spark.read.text(f'{path}/CURRENT').first()[0]}"


def append_batch(df: DataFrame, path: str) -> None:
    """Add ``df`` to an append-only table as a batch that appears whole."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/.new-{name}")
    _rename(spark, f"{path}/.new-{name}", f"{path}/batch-{name}", False)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All whole batches of an append-only table."""
    found = _files(spark, path).globStatus(_path(spark, f"{path}/batch-*"))
    return spark.read.schema(schema).parquet(f"{path}/batch-*") if found else spark.createDataFrame([], schema)


def write_dataset(examples: DataFrame, path: str, *, order: tuple = ("doc_id", "place"), shard: int = SHARD) -> str:
    """Examples (split, doc_id, place, ...) as JSON lines, the manifest (doc_id, split, start, count) that
    addresses them, and the numbers of documents and examples of each split.

    Each example carries its ``position`` in its split, by ``order``. Files are ranges of positions: a folder for each split and shard of as
    many, so that the examples of a document are read from one folder or two."""
    from ..operators.dataset import positions

    spark = examples.sparkSession
    placed = positions(examples, "split", order).withColumn("shard", F.floor(F.col("position") / shard))

    def write(at: str) -> None:
        rows = placed.repartition("split", "shard").sortWithinPartitions("split", "shard", "position")
        rows.write.partitionBy("split", "shard").json(f"{at}/examples")
        manifest = spark.read.schema("doc_id " + examples.schema["doc_id"].dataType.simpleString() + ", position long, split string").json(f"{at}/examples")
        manifest = manifest.groupBy("doc_id", "split").agg(F.min("position").alias("start"), F.count("*").alias("count"))
        manifest.write.parquet(f"{at}/manifest")
        kept = spark.read.parquet(f"{at}/manifest")
        kept.groupBy("split").agg(F.count("*").alias("documents"), F.sum("count").alias("examples")).coalesce(1).write.json(f"{at}/dataset_info")

    return publish(spark, path, write)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{current(spark, path)}/manifest")


def read_examples(spark: SparkSession, path: str, schema: str, *, split: str | None = None, start: int = 0, count: int | None = None, shard: int = SHARD) -> DataFrame:
    """Examples of the current version, of one split from ``start`` on; other shards are not read."""
    rows = spark.read.schema(schema + ", position long, split string, shard long").json(f"{current(spark, path)}/examples")
    if split is not None:
        rows = rows.where(F.col("split") == split)
    if start or count is not None:
        rows = rows.where((F.col("shard") >= start // shard) & (F.col("position") >= start))
    if count is not None:
        rows = rows.where((F.col("shard") <= (start + count) // shard) & (F.col("position") < start + count))
    return rows.drop("shard")


def write_spreadsheet(df: DataFrame, path: str, separator: str = ";") -> None:
    """CSV files for spreadsheets: a byte order mark and a header in each, all fields quoted with doubled quotes,
    and texts that a spreadsheet would run as formulas behind an apostrophe."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    plain = lambda c: F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))
    fields = [spreadsheet_safe(text(F.col(f"`{n}`"))) if t == "string" else plain(F.col(f"`{n}`")) for n, t in df.dtypes]
    names = ['"' + n.replace('"', '""') + '"' for n in df.columns]
    head = "\ufeff" + separator.join(names)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, names=["value"])

    df.select(F.concat_ws(separator, *fields).alias("value")).mapInArrow(headed, "value string").write.text(path)


def write_report(report: DataFrame, path: str) -> str:
    """A small report as JSON and as CSV, both of one version."""

    def write(at: str) -> None:
        report.coalesce(1).write.json(f"{at}/json")
        report.coalesce(1).write.option("header", True).csv(f"{at}/csv")

    return publish(report.sparkSession, path, write)
