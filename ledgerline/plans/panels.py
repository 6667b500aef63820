"""Several report panels from one scan of the facts.

``usage_grain`` reduces the events once, to sums per (tool, model, project,
day, inside the window or not): numeric buffers only, so a hash aggregate with
partial sums. ``panel_lines`` turns the grain into the (key, model) rows of all
panels with GROUPING SETS - Spark expands the few grain rows, not the events -
prices them together, and writes them once; a panel is a filter on ``panel``
and a small roll-up.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.timecols import ntz_lit
from ledgerline.operators.aggregate import dimension, usage_measures
from ledgerline.operators.pricing import attach_rates, price_rows
from ledgerline.plans.report import COST_DIGITS, finish_lines, sort_lines
from ledgerline.session import written

# Panels by the dimension of their key. The day lines cover all days, the others the window.
PANELS = ("tool", "model", "project", "day")


def usage_grain(usage: DataFrame, since: datetime | None = None, tz: str = "UTC") -> DataFrame:
    """One row per (tool, model, project, day, inside) with sums, counts and the raw/estimated split."""
    inside = F.lit(True) if since is None else F.col("ts") >= ntz_lit(since.replace(microsecond=0, tzinfo=None))
    keys = [dimension(d, tz).alias(d) for d in PANELS]
    return usage.groupBy(*keys, inside.alias("inside")).agg(*usage_measures())


def panel_lines(grain: DataFrame, prices: DataFrame, panels: tuple[str, ...] = PANELS) -> DataFrame:
    """(panel, key, model) rows of all ``panels`` with sums, cost and unpriced events, written once."""
    measures = [c for c in grain.columns if c not in (*PANELS, "inside")]
    sets = [list(dict.fromkeys([panel, "model", "inside"])) for panel in panels]
    keys = list(dict.fromkeys(c for s in sets for c in s))
    marks = {c: F.grouping(c) for c in keys}
    rows = grain.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(
        *[F.sum(c).alias(c) for c in measures], *[mark.alias(f"g_{c}") for c, mark in marks.items()])
    # A set is told by its panel's column; that of the models has no other.
    panel = F.lit("model")
    for name in panels:
        if name != "model":
            panel = F.when(F.col(f"g_{name}") == 0, F.lit(name)).otherwise(panel)
    rows = rows.withColumn("panel", panel)
    key = F.col("model")
    for name in panels:
        if name != "model":
            key = F.when(F.col("panel") == name, F.col(name)).otherwise(key)
    rows = rows.where((F.col("panel") == "day") | F.col("inside")).withColumn("key", key)
    sums = rows.groupBy("panel", "key", "model").agg(*[F.sum(c).alias(c) for c in measures])
    return written(price_rows(attach_rates(sums, prices)), "panel-lines")


def panel(lines: DataFrame, name: str, digits: int | None = COST_DIGITS) -> DataFrame:
    """The report lines of one panel, in its order."""
    return sort_lines(finish_lines(lines.where(F.col("panel") == name), digits), name)


def unpriced_of(lines: DataFrame) -> DataFrame:
    """Distinct models that left estimated events without a price, sorted."""
    return (lines.where((F.col("panel") == "model") & ~F.col("priced") & (F.col("est_events") > 0))
            .select("model").distinct().orderBy("model"))
