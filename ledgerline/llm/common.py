"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.session import written

WS_CHARS = " \t\n\x0b\f\r"
WS_RUN = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space, in order (JVM side)."""
    trimmed = F.trim(text, F.lit(WS_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RUN))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def prefix_sums(rows: DataFrame, order: list[Column], value: str, out: str, name: str) -> DataFrame:
    """``rows`` plus ``out``: the sum of ``value`` over all rows before each one in ``order``.

    Rows are range-partitioned by the order columns (sampled bounds, so no key
    gets a task of its own unless all order columns tie), numbered by their
    partition and written to the shared folder, which fixes the partition of
    each row. Totals per partition (one row each, a few bytes) give the
    offsets; within a partition a running sum does the rest. Nothing but the
    table of partition totals passes through one task.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    rows = rows.withColumns(dict(zip(keys, order, strict=True)))
    dealt = written(rows.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys])
                    .withColumn("__part", F.spark_partition_id()), name)
    totals = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = (Window.partitionBy("__part").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
              .rowsBetween(Window.unboundedPreceding, -1))
    return (dealt.join(F.broadcast(totals), "__part")  # one row per partition of the range shuffle
            .withColumn(out, F.col("__base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("__part", "__base", *keys))


def row_digest(docs: DataFrame) -> Column:
    """SHA-256 of the words of the text, joined by one blank."""
    return F.unhex(F.sha2(F.array_join(words_of(text_of(docs)), " ").cast("binary"), 256))


def id_key(doc_id: Column) -> Column:
    """A key that also tells null ids, and that joins and windows hash alike."""
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def rows_that_stay(docs: DataFrame, digest: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, digest) is in ``kept``, with all columns; of repeated rows one.

    Join and row number share one shuffle of the rows.
    """
    keys = kept.select(id_key(F.col("doc_id")).alias("__key"), F.col("digest").alias("__digest")).distinct()
    rows = docs.withColumns({"__key": id_key(docs["doc_id"]), "__digest": digest})
    one = Window.partitionBy("__key", "__digest").orderBy("__digest")
    return (rows.join(keys, ["__key", "__digest"], "left_semi")
            .withColumn("__copy", F.row_number().over(one)).where("__copy = 1").select(*docs.columns))


def salt_of(doc_id: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int")


def expand_salts(groups: DataFrame, salts: int) -> DataFrame:
    """A row of ``groups`` for each salt that its bit mask ``salts`` has; the column ``salt`` takes its place."""
    each = F.explode(F.expr(f"filter(sequence(0, {salts - 1}), s -> (salts & shiftleft(1L, s)) != 0)"))
    return groups.withColumn("salt", each).drop("salts")


def connected(edges: DataFrame, name: str) -> DataFrame:
    """Components of ``edges`` (a, b): one row per node, with the smallest node of its component as ``root``.

    Rounds of large-star and small-star: every node's neighbours are linked to
    the smallest of them, until a round changes nothing. Minima are aggregates
    and are joined back, so a node with many edges is never a list. Each round
    is written to the shared folder, which cuts the lineage.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if large else pairs
        both = both.toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        if large:
            joined = both.where("v > u").join(least, "u")
            return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        joined = both.join(least, "u")
        return (joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
                .union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a != b").distinct())

    def mark(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    pairs = written(pairs, name)
    last = mark(pairs)
    while last[0]:
        pairs = written(star(star(pairs, True), False), name)
        now = mark(pairs)
        if tuple(now) == tuple(last):
            break
        last = now
    found = pairs.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return found.union(found.select("root", "root").distinct())
