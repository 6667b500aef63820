"""Calendar operators: zero-filled day series, trend levels, streaks, heatmap, cards.

The day series is a calendar of a requested length (known on the driver,
e.g. 30 or 119 days) left-joined with per-day totals. Windows over the
series run on at most that many rows, independent of data volume; the
per-day totals come from one partially-aggregated ``groupBy(day)``.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.bounds import local_date, local_midnight
from ledgerline.functions.timecols import in_zone
from ledgerline.operators.aggregate import window

TREND_DAYS = 30
STREAK_WEEKS = 17
TREND_LEVELS = 7 * 8  # chart height x eighth-blocks
HEAT_LEVELS = 4


def calendar_days(spark: SparkSession, first_day: str, days: int) -> DataFrame:
    """(i, day) for ``days`` consecutive calendar dates from ``first_day``."""
    return spark.range(days).select(
        F.col("id").cast("int").alias("i"),
        F.date_format(F.date_add(F.lit(first_day).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("day"),
    )


def daily_totals(usage: DataFrame, since: datetime | None = None, tz: str = "UTC") -> DataFrame:
    """(day, total, events) per local day with events at/after ``since``."""
    tokens = F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_write") + F.col("reasoning")
    # Grouped by the date (a fixed-width key); the text is made for the few result rows.
    days = window(usage, since).groupBy(F.to_date(in_zone("ts", tz)).alias("day")).agg(
        F.sum(tokens).alias("total"), F.count(F.lit(1)).alias("events"))
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "events")


def day_series(usage: DataFrame | None, now: datetime, days: int, tz: str = "UTC",
               totals: DataFrame | None = None) -> DataFrame:
    """(i, day, total) for the ``days`` calendar days ending today, 0 when idle.

    ``totals``: precomputed (day, total) rows (e.g. report lines by day,
    shared by several panels) instead of aggregating ``usage`` again.
    """
    spark = (usage if usage is not None else totals).sparkSession
    first_date = local_date(now, tz) - timedelta(days=days - 1)
    first = local_midnight(first_date, tz)
    cal = calendar_days(spark, first_date.isoformat(), days)
    if totals is None:
        totals = daily_totals(usage, first, tz)
    else:
        totals = totals.filter(F.col("day") >= F.lit(first_date.isoformat())).select("day", "total")
    # The calendar keeps every day; the per-day totals are the build side
    # (at most one row per day at/after ``first``), broadcast by AQE when small.
    return cal.join(totals, "day", "left").select(
        "i", "day", F.coalesce(F.col("total"), F.lit(0)).cast("bigint").alias("total")
    )


def trend(usage: DataFrame | None, now: datetime, days: int = TREND_DAYS, tz: str = "UTC",
          totals: DataFrame | None = None) -> DataFrame:
    """Trend bars: (i, day, total, level) with level = int(total/max*56), >= 1 when total > 0."""
    series = day_series(usage, now, days, tz, totals)
    peak = series.select(F.max("total")).scalar()
    raw = F.floor(F.col("total").cast("double") / peak.cast("double") * F.lit(float(TREND_LEVELS)))
    level = F.when(peak == 0, F.lit(0)).when((F.col("total") > 0) & (raw == 0), F.lit(1)).otherwise(raw)
    return series.withColumn("level", level.cast("int"))


def streak_stats(usage: DataFrame | None, now: datetime, weeks: int = STREAK_WEEKS, tz: str = "UTC",
                 totals: DataFrame | None = None, days: int | None = None) -> DataFrame:
    """One row: days, active_days, active_pct, longest, current, peak over the last weeks*7 days.

    Gaps-and-islands: a running count of idle days is the island id of each
    active day; the longest island is the longest run; the island of the last
    day is the current run (0 when the last day is idle).
    """
    series = day_series(usage, now, days or weeks * 7, tz, totals)
    w = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = (F.col("total") > 0).cast("int")
    marked = series.withColumn("active", active).withColumn("island", F.sum(1 - F.col("active")).over(w))
    runs = marked.filter(F.col("active") == 1).groupBy("island").agg(F.count(F.lit(1)).alias("run"))
    last_island = marked.select(F.max("island")).scalar()
    stats = marked.agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("active").cast("bigint").alias("active_days"),
        F.max("total").alias("peak"),
    )
    run_stats = runs.agg(
        F.coalesce(F.max("run"), F.lit(0)).alias("longest"),
        F.coalesce(F.max(F.when(F.col("island") == last_island, F.col("run"))), F.lit(0)).alias("current"),
    )
    return stats.select(
        "days",
        "active_days",
        F.floor(F.col("active_days") * 100 / F.col("days")).cast("bigint").alias("active_pct"),
        run_stats.select("longest").scalar().cast("bigint").alias("longest"),
        run_stats.select("current").scalar().cast("bigint").alias("current"),
        "peak",
    )


def heatmap_grid(usage: DataFrame | None, now: datetime, weeks: int = STREAK_WEEKS, tz: str = "UTC",
                 totals: DataFrame | None = None, days: int | None = None) -> DataFrame:
    """Per day: weekday row (Mon=0), week column, intensity 0..3 (NULL when idle)."""
    series = day_series(usage, now, days or weeks * 7, tz, totals)
    first_dow = series.filter(F.col("i") == 0).select(
        ((F.dayofweek(F.col("day").cast("date")) + 5) % 7).alias("pad")
    ).scalar()
    peak = series.select(F.max("total")).scalar()
    idx = F.col("i") + first_dow
    ci = F.floor(F.col("total").cast("double") / peak.cast("double") * F.lit(float(HEAT_LEVELS - 1)))
    return series.select(
        "day",
        "total",
        (idx % 7).cast("int").alias("row"),
        F.floor(idx / 7).cast("int").alias("col"),
        F.when(F.col("total") == 0, F.lit(None)).otherwise(F.least(ci, F.lit(HEAT_LEVELS - 1))).cast("int").alias(
            "intensity"
        ),
    )


def share_of_max(lines: DataFrame, measure: str = "total") -> DataFrame:
    """Adds ``share`` = measure / max(measure) (0 when the max is 0), via a scalar subquery."""
    peak = lines.select(F.max(measure)).scalar()
    return lines.withColumn(
        "share",
        F.when(peak > 0, F.round(F.col(measure).cast("double") / peak.cast("double"), 6)).otherwise(F.lit(0.0)),
    )
