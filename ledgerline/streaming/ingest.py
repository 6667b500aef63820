"""Continuous ingest with Structured Streaming.

``start_ingest``: a file stream over a landing directory of immutable JSONL
files -> per micro-batch (``foreachBatch``) line numbering, decoding and the
idempotent load (first-wins + anti join + append; stored keys are looked up in
the table's key index, not in its key columns). A replayed micro-batch
finds its keys already loaded and inserts nothing, so the at-least-once
``foreachBatch`` contract gives exactly-once rows. ``trigger='30 seconds'``
polls like a watcher; ``available_now=True`` is the one-shot scan.

``start_dedup``: the stateless variant - decode on the stream and drop
repeated (source, dedup_key) with streaming deduplication into a Parquet
sink. Its files come through ``growing.SnapshotReader``, whose offsets don't
grow with their number, and its keys lie in RocksDB. Without a watermark the key state grows with the key count; with
``within`` set, ``dropDuplicatesWithinWatermark`` bounds it to that lateness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.functions.timecols import raw_file_path
from ledgerline.operators.load import insert_events
from ledgerline.sources.lines import number_splits
from ledgerline.schema import USAGE_COLUMNS
from ledgerline.streaming.counters import STATE_STORE
from ledgerline.streaming.growing import growing_lines

Decoder = Callable[[DataFrame], DataFrame]


def line_stream(spark: SparkSession, landing: str, glob: str = "*", files_per_trigger: int | None = None) -> DataFrame:
    reader = (
        spark.readStream.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
    )
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(landing).select(
        raw_file_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").alias("line"),
    )


def number_lines(batch: DataFrame) -> DataFrame:
    """(path, ln, line) for a static micro-batch of (path, block, line) rows (split-parallel numbering)."""
    numbered = number_splits(batch.withColumn("pos", F.monotonically_increasing_id()))
    return numbered.select("path", (F.col("ln0") + F.col("local_ln")).cast("bigint").alias("ln"), "line")


def start_ingest(spark: SparkSession, landing: str, decoder: Decoder, table_path: str, checkpoint: str,
                 glob: str = "*", available_now: bool = False, interval: str = "30 seconds",
                 files_per_trigger: int | None = None) -> StreamingQuery:
    def load_batch(batch: DataFrame, epoch_id: int) -> None:
        insert_events(batch.sparkSession, decoder(number_lines(batch)), table_path, key_index=True)

    writer = line_stream(spark, landing, glob, files_per_trigger).writeStream.foreachBatch(load_batch).option(
        "checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def start_dedup(spark: SparkSession, landing: str, decoder: Decoder, out_path: str, checkpoint: str,
                glob: str = "*", within: str | None = None, available_now: bool = True) -> StreamingQuery:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    lines = growing_lines(spark, landing, glob, checkpoint, whole="true")
    events = decoder(lines).select(*USAGE_COLUMNS)
    if within:
        events = events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["source", "dedup_key"])
    else:
        events = events.dropDuplicates(["source", "dedup_key"])
    writer = events.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.outputMode("append").start()
