"""All dashboard panels from one scan of the facts.

The events are reduced once to (tool, model, project, day) sums
(``panels.usage_grain``, written to the shared folder); GROUPING SETS over
these few rows give the lines of the tool, model, project and day panels, which
are priced together. The day lines serve the daily list, the 30-day trend, the
streak statistics, the heatmap and the four summary cards (the card "all"
needs every day).
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.bounds import day_text, local_date
from ledgerline.operators import calendar as cal
from ledgerline.plans import insights as ins
from ledgerline.plans import panels
from ledgerline.plans.report import COST_DIGITS
from ledgerline.session import written


def dashboard(usage: DataFrame, prices: DataFrame, now: datetime, since: datetime | None = None,
              tool: str | None = None, tz: str = "UTC") -> dict[str, DataFrame]:
    """Panels by name. The streak begins with the first day of events (or ``since``, if that is earlier), but not
    before its usual window; ``tools`` lists the tools that have events, in order."""
    grain = written(panels.usage_grain(usage, since, tz), "dashboard-grain")
    lines = panels.panel_lines(grain if tool is None else grain.where(F.col("tool") == tool), prices)
    days = written(panels.panel(lines, "day", digits=None), "dashboard-days")
    totals = days.select(F.col("key").alias("day"), "total")
    today = local_date(now, tz)
    earliest = days.agg(F.min("key")).first()[0]
    streak_days = cal.STREAK_WEEKS * 7
    if since is not None:
        start = local_date(since, tz) if earliest is None else min(local_date(since, tz), date.fromisoformat(earliest))
        streak_days = max(1, min(streak_days, (today - start).days + 1))
    days_shown = days.withColumns({c: F.round(c, COST_DIGITS) for c in ("raw_cost", "cost")})
    return {
        "tools": grain.select(F.col("tool").alias("source")).distinct().orderBy("source"),
        "by_tool": panels.panel(lines, "tool"),
        "by_model": panels.panel(lines, "model"),
        "by_project": panels.panel(lines, "project"),
        "unpriced": panels.unpriced_of(lines),
        "daily": days_shown if since is None else days_shown.filter(F.col("key") >= F.lit(day_text(since, tz))),
        "trend": cal.trend(None, now, tz=tz, totals=totals),
        "streak": cal.streak_stats(None, now, tz=tz, totals=totals, days=streak_days),
        "heatmap": cal.heatmap_grid(None, now, tz=tz, totals=totals, days=streak_days),
        "cards": ins.summary_cards(None, None, now, tz=tz, days=days),
        "insights": ins.insights(None, None, lines=lines),
    }
