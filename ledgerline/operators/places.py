"""Places in a global order without a single task: a range shuffle, totals carried over its partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import written


def with_places(rows: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """``rows`` plus their place in ``order``, from 1; rows that tie in all of it get places in any order.

    Rows are range-partitioned by the order and written with their partition
    and a running number in it; the totals of the partitions (a row each)
    give what is added.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        "__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()})
    dealt = written(dealt, "places")
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1  # the id counts from 0 in each partition
    totals = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return (dealt.join(F.broadcast(base), "__part")  # one row per partition of the range shuffle
            .withColumn(out, F.col("__base") + inside).drop("__part", "__id", "__base"))
