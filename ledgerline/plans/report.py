"""Grouped usage/cost report: A1 -> price lookup -> roll-up to the report key.

Plan shape: filtered scan -> partial/final HashAggregate on (key, model)
-> join with per-model rates (AQE-broadcast at runtime) -> HashAggregate on
key (small) -> sort. Cost is computed at query time from current prices.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.aggregate import usage_aggregate, window
from ledgerline.operators.pricing import attach_rates, price_rows
from ledgerline.schema import TOKEN_CLASSES

# Costs are reported in whole micro-dollars (the CSV export's precision).
COST_DIGITS = 6
TOTAL_KEY = "TOTAL"


def priced_model_rows(usage: DataFrame, prices: DataFrame, by: str = "tool", since: datetime | None = None,
                      until: datetime | None = None, source: str | None = None, tz: str = "UTC") -> DataFrame:
    """(key, model) aggregates with cost, priced flag and unpriced events."""
    agg = usage_aggregate(window(usage, since, until, source), by, tz)
    return price_rows(attach_rates(agg, prices))


def _line_measures() -> list:
    cols = [*TOKEN_CLASSES, "events", "raw_cost", "cost", "unpriced_events"]
    return [F.expr(f"sum({c}) AS {c}") for c in cols]


def _finish(lines: DataFrame, digits: int | None) -> DataFrame:
    shown = lambda c: f"{c} AS {c}" if digits is None else f"round({c}, {digits}) AS {c}"
    return lines.selectExpr(
        "key",
        *TOKEN_CLASSES,
        " + ".join(TOKEN_CLASSES) + " AS total",
        "events",
        shown("raw_cost"),
        shown("cost"),
        "CAST(unpriced_events AS BIGINT) AS unpriced_events",
    )


def finish_lines(rows: DataFrame, digits: int | None) -> DataFrame:
    """Report lines of priced (key, model) rows."""
    return _finish(rows.groupBy("key").agg(*_line_measures()), digits)


def sort_lines(lines: DataFrame, by: str) -> DataFrame:
    """Lines by key for ``by='day'``, else by total descending, then key."""
    return lines.orderBy("key") if by == "day" else lines.orderBy(F.desc("total"), "key")


def build_report(usage: DataFrame, prices: DataFrame, by: str = "tool", since: datetime | None = None,
                 until: datetime | None = None, source: str | None = None, tz: str = "UTC",
                 with_total: bool = False, digits: int | None = COST_DIGITS) -> DataFrame:
    """Report lines: key, 5 token classes, total, events, raw_cost, cost, unpriced_events.

    ``digits=None`` keeps costs unrounded, for plans that go on computing with them.

    Sorted by key for ``by='day'``, else by total descending then key. With
    ``with_total`` a final ``TOTAL`` line (a ROLLUP grand total) is added.
    """
    rows = priced_model_rows(usage, prices, by, since, until, source, tz)
    if with_total:
        grouped = rows.rollup("key").agg(*_line_measures(), F.grouping_id().alias("_gid"))
        grouped = grouped.withColumn("key", F.when(F.col("_gid") == 1, F.lit(TOTAL_KEY)).otherwise(F.col("key")))
        out = _finish(grouped, digits).withColumn("_is_total", F.col("key") == F.lit(TOTAL_KEY))
        order = ["key"] if by == "day" else [F.desc("total"), "key"]
        return out.orderBy("_is_total", *order).drop("_is_total")
    return sort_lines(finish_lines(rows, digits), by)


def unpriced_models(usage: DataFrame, prices: DataFrame, by: str = "tool", since: datetime | None = None,
                    until: datetime | None = None, source: str | None = None, tz: str = "UTC") -> DataFrame:
    """Distinct models that left estimated events without a price, sorted."""
    rows = priced_model_rows(usage, prices, by, since, until, source, tz)
    return (
        rows.filter(~F.col("priced") & (F.col("est_events") > 0))
        .select("model")
        .distinct()
        .orderBy("model")
    )


def report_by_cost(report: DataFrame) -> DataFrame:
    """Re-sort report lines by cost, then total, then key (all descending but key)."""
    return report.orderBy(F.desc("cost"), F.desc("total"), "key")

