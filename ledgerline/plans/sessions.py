"""Session report: (session, tool, model) aggregate -> price -> roll-up per session.

Two shuffles: (session_id, source, model) with map-side partial aggregation,
then (session_id, source) over the already-small model-grain rows. A session
is never collected into one task; every step is an associative aggregate.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import fmt
from ledgerline.functions.timecols import ntz_epoch_seconds
from ledgerline.operators.aggregate import session_aggregate, window
from ledgerline.operators.pricing import attach_rates, price_rows
from ledgerline.plans.report import COST_DIGITS
from ledgerline.schema import TOKEN_CLASSES


def session_model_rows(usage: DataFrame, prices: DataFrame, since: datetime | None = None,
                       until: datetime | None = None, source: str | None = None) -> DataFrame:
    """Priced (session_id, source, model) rows."""
    return price_rows(attach_rates(session_aggregate(window(usage, since, until, source)), prices))


def build_sessions(usage: DataFrame, prices: DataFrame, since: datetime | None = None,
                   until: datetime | None = None, source: str | None = None,
                   digits: int | None = COST_DIGITS) -> DataFrame:
    """One line per (session_id, source), newest last activity first (``digits=None``: costs unrounded).

    ``project`` comes from the session's first model row in model order;
    ``models`` counts distinct models (rows are unique per model already).
    """
    rows = session_model_rows(usage, prices, since, until, source)
    lines = rows.groupBy("session_id", "source").agg(
        F.min_by("project", "model").alias("project"),
        F.count(F.lit(1)).alias("models"),
        *[F.sum(c).alias(c) for c in TOKEN_CLASSES],
        F.sum("events").alias("events"),
        F.sum("cost").alias("cost"),
        F.sum("unpriced_events").alias("unpriced_events"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    total = F.col(TOKEN_CLASSES[0])
    for c in TOKEN_CLASSES[1:]:
        total = total + F.col(c)
    return lines.select(
        "session_id", "source", "project", "models", *TOKEN_CLASSES,
        total.alias("total"), "events",
        F.col("cost") if digits is None else F.round("cost", digits).alias("cost"),
        F.col("unpriced_events").cast("bigint").alias("unpriced_events"),
        "first_ts", "last_ts",
        (ntz_epoch_seconds("last_ts") - ntz_epoch_seconds("first_ts")).alias("duration_s"),
    ).orderBy(F.desc("last_ts"), "session_id", "source")


# Fixed value: characters of a session id that listings show.
SHOWN_ID = 13


def sessions_display(sessions: DataFrame) -> DataFrame:
    """The listing as users see it: texts for the id, tokens, cost, duration and project of ``build_sessions`` rows."""
    return sessions.select(
        fmt.truncate_text("session_id", SHOWN_ID).alias("session"), "source",
        fmt.humanize(F.col("total")).alias("tokens"), fmt.cost_cell("cost", "unpriced_events").alias("cost"),
        "events", "models", fmt.duration_text("duration_s").alias("duration"),
        fmt.short_project("project").alias("project"))


def sessions_json(sessions: DataFrame) -> DataFrame:
    """(session_id, source, json): RFC 3339 instants, the duration in nanoseconds, zero unpriced_events left out."""
    instant = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    fields = ["session_id", "source", "project", "models", *TOKEN_CLASSES, "total", "events", "cost",
              F.when(F.col("unpriced_events") != 0, F.col("unpriced_events")).alias("unpriced_events"),
              instant("first_ts"), instant("last_ts"), (F.col("duration_s") * 1_000_000_000).alias("duration")]
    return sessions.select("session_id", "source", F.to_json(F.struct(*fields)).alias("json"))


def session_unpriced_models(usage: DataFrame, prices: DataFrame, since: datetime | None = None,
                            until: datetime | None = None, source: str | None = None) -> DataFrame:
    """Distinct models that left estimated events of listed sessions without a price, sorted."""
    rows = session_model_rows(usage, prices, since, until, source)
    return rows.filter(~F.col("priced") & (F.col("est_events") > 0)).select("model").distinct().orderBy("model")


def sessions_total(sessions: DataFrame) -> DataFrame:
    """The sessions listing's TOTAL line: sessions, tokens, events, cost, unpriced."""
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.sum("events"), F.lit(0)).cast("bigint").alias("events"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), COST_DIGITS).alias("cost"),
        F.coalesce(F.sum("unpriced_events"), F.lit(0)).cast("bigint").alias("unpriced_events"),
    )
