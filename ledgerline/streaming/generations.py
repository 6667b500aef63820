"""Folders that a stream adds to batch by batch, and their compaction.

A folder holds ``batch=<id>`` parts, one per micro-batch (a replayed batch
overwrites its own), and generations: ``gen=<id>`` is what all batches up to
that id come to. A generation counts once its ``_SUCCESS`` marker is there;
readers take the newest one and the batches after it, so a compaction that dies
half-way changes nothing. Batches and generations behind the newest but one
are removed; that one stays for readers that have already listed it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _listed(spark: SparkSession, folder: str):
    """({batch id: path}, {generation id: path}) of what is complete."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[str, dict[int, str]] = {"batch": {}, "gen": {}}
    if fs.exists(root):
        for status in fs.listStatus(root):
            kind, _, number = status.getPath().getName().partition("=")
            if kind in found and number.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found[kind][int(number)] = status.getPath().toString()
    return fs, found["batch"], found["gen"]


def _read(spark: SparkSession, schema: str, paths: dict[int, str], last: int, generation: str | None) -> DataFrame:
    """Batches with their ids, and a generation's rows with the ids that they were written under."""
    plain = schema.rpartition(", batch long")[0]
    rows = spark.createDataFrame([], schema)
    if generation is not None:
        rows = spark.read.schema(schema).parquet(generation)
    new = [path for number, path in sorted(paths.items()) if number > last]
    if new:
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=([0-9]+)/", 1).cast("long").alias("batch")
        rows = rows.unionByName(spark.read.schema(plain).parquet(*new).select("*", number))
    return rows


def read_generations(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows of the newest generation and of the batches after it; ``schema`` ends with ``batch long``."""
    _, batches, generations = _listed(spark, folder)
    last = max(generations, default=-1)
    return _read(spark, schema, batches, last, generations.get(last))


def compact_folder(spark: SparkSession, folder: str, schema: str, merge: Callable[[DataFrame], DataFrame]) -> int | None:
    """Write ``merge`` of all rows as a generation and remove what it replaces; returns its id, or None if nothing is new."""
    fs, batches, generations = _listed(spark, folder)
    last, newest = max(generations, default=-1), max(batches, default=-1)
    if newest <= last:
        return None
    merge(_read(spark, schema, batches, last, generations.get(last))).write.mode("overwrite").parquet(f"{folder}/gen={newest}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for number, old in {**batches}.items():
        if number <= last:
            fs.delete(path(old), True)
    for number, old in generations.items():
        if number < last:
            fs.delete(path(old), True)
    return newest
