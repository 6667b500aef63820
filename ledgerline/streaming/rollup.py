"""Streaming daily rollup of usage that accepts data of any lateness.

Every micro-batch is reduced to its own sums per (day, tool) and written under
its batch id; the current rollup adds these partial sums up, and ``compact``
merges them into one generation now and then, so that a read doesn't grow with
the number of batches. There is no
watermark, so no late event is lost, and no state in memory. A replayed
micro-batch overwrites its own folder (exactly-once effect).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.schema import USAGE
from ledgerline.streaming.generations import compact_folder, read_generations

SUMS = "day date, source string, total long, events long, batch long"


def usage_stream(spark: SparkSession, landing: str) -> DataFrame:
    return spark.readStream.schema(USAGE).parquet(landing)


def daily_sums(usage: DataFrame) -> DataFrame:
    tokens = F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write") + F.col("reasoning")
    return usage.groupBy(F.to_date("ts").alias("day"), "source").agg(
        F.sum(tokens).alias("total"), F.count(F.lit(1)).alias("events"))


def start_daily(spark: SparkSession, landing: str, sums_path: str, checkpoint: str,
                available_now: bool = True) -> StreamingQuery:
    def add(batch: DataFrame, batch_id: int) -> None:
        daily_sums(batch).write.mode("overwrite").parquet(f"{sums_path}/batch={batch_id}")

    writer = usage_stream(spark, landing).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy("day", "source").agg(F.sum("total").alias("total"), F.sum("events").alias("events"),
                                             F.max("batch").alias("batch"))


def current_rollup(spark: SparkSession, sums_path: str) -> DataFrame:
    """The sums over all batches so far."""
    return _added(read_generations(spark, sums_path, SUMS)).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "source", "total", "events")


def compact(spark: SparkSession, sums_path: str) -> int | None:
    """Merge the sums of all batches so far into one generation; returns its last batch."""
    return compact_folder(spark, sums_path, SUMS, _added)
