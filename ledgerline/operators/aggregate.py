"""Usage-table filters and model-grain aggregates.

Every aggregate here is a single ``groupBy`` whose partial (map-side)
aggregation collapses each task's rows per key before the shuffle, so a
key holding a third of all events costs one row per task on the wire.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.timecols import day_key, ntz_lit
from ledgerline.schema import TOKEN_CLASSES

DIMENSIONS = ("tool", "model", "day", "project", "session")


def dimension(by: str, tz: str = "UTC") -> Column:
    """Report key for a grouping dimension; '' means tool."""
    if by in ("tool", ""):
        return F.col("source")
    if by == "model":
        return F.coalesce(F.col("model"), F.lit("unknown"))
    if by == "day":
        return day_key("ts", tz)
    if by == "project":
        return F.coalesce(F.col("project"), F.lit(""))
    if by == "session":
        return F.coalesce(F.col("session_id"), F.lit(""))
    raise ValueError(f"unknown grouping {by!r} (want tool|model|day|project|session)")


def window(usage: DataFrame, since: datetime | None = None, until: datetime | None = None,
           source: str | None = None) -> DataFrame:
    """Half-open ``[since, until)`` window (UTC, whole seconds) and tool filter.

    Bounds are literals, so Parquet min/max pruning and, on a table
    partitioned by day, partition pruning apply.
    """
    out = usage
    partitioned = "dt" in usage.columns  # stored table: prune day partitions too
    if since is not None:
        out = out.filter(F.col("ts") >= ntz_lit(_second(since)))
        if partitioned:
            out = out.filter(F.col("dt") >= F.lit(since.date()))
    if until is not None:
        out = out.filter(F.col("ts") < ntz_lit(_second(until)))
        if partitioned:
            out = out.filter(F.col("dt") <= F.lit(until.date()))
    if source:
        out = out.filter(F.col("source") == F.lit(source))
    return out


def _second(t: datetime) -> datetime:
    return t.replace(microsecond=0, tzinfo=None)


def usage_measures() -> list[Column]:
    """Token sums, counts and the raw/estimated split of one group."""
    sql = [f"sum({c}) AS {c}" for c in TOKEN_CLASSES]
    sql += ["count(1) AS events", "coalesce(sum(raw_cost), 0.0D) AS raw_cost", "count(raw_cost) AS n_raw"]
    sql += [f"sum(CASE WHEN raw_cost IS NULL THEN {c} ELSE 0 END) AS est_{c}" for c in TOKEN_CLASSES]
    sql.append("count(CASE WHEN raw_cost IS NULL THEN 1 END) AS est_events")
    return [F.expr(x) for x in sql]


def usage_aggregate(usage: DataFrame, by: str = "tool", tz: str = "UTC") -> DataFrame:
    """(key, model) rows with token sums, events and the raw/estimated split."""
    return usage.groupBy(
        dimension(by, tz).alias("key"), F.coalesce(F.col("model"), F.lit("unknown")).alias("model")
    ).agg(*usage_measures())


def session_aggregate(usage: DataFrame) -> DataFrame:
    """(session_id, source, model) rows of sessions with a non-empty id.

    Two steps keep the pass over events hash-based: a string ``max(project)``
    would force sort-based aggregation of every event, so events are first
    reduced by (session, source, model, project) - numeric buffers only, with
    map-side partial aggregation - and ``max(project)`` then runs over those
    few pre-aggregated rows (normally one per session and model).
    """
    keys = ["session_id", "source", "model"]
    per_project = (
        usage.filter(F.col("session_id").isNotNull() & (F.col("session_id") != F.lit("")))
        .groupBy("session_id", "source", F.coalesce(F.col("model"), F.lit("")).alias("model"),
                 F.coalesce(F.col("project"), F.lit("")).alias("project"))
        .agg(*usage_measures(), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )
    summed = [c for c in per_project.columns if c not in keys + ["project", "first_ts", "last_ts"]]
    return per_project.groupBy(*keys).agg(
        F.max("project").alias("project"),
        *[F.sum(c).alias(c) for c in summed],
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )


def source_stats(usage: DataFrame) -> DataFrame:
    """Per tool: event count, first and last instant."""
    return usage.groupBy("source").agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def earliest_event(usage: DataFrame) -> DataFrame:
    """One row: the earliest instant; NULL for an empty table or a zero (epoch) instant."""
    earliest = F.min("ts")
    return usage.agg(F.when(earliest != F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), earliest).alias("earliest_ts"))
