"""Derived views over report lines: statusline, efficiency, period comparison,
summary cards, insights, cost hint, run-rate, budget check, top models, tool status.

All of them are global aggregates over report lines (one row per report key)
or conditional aggregates over model-grain rows, so none adds a shuffle of
events beyond the report's own (key, model) aggregation.

Cost is linear in events once a model's price is fixed (raw cost where
reported, tokens x rates otherwise, 0 when unpriced), so costs of several
windows come out of ONE pass with per-window conditional sums.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.timecols import ntz_lit

from ledgerline.functions.bounds import day_text, local_date, local_midnight, parse_since, start_of_day
from ledgerline.functions.fmt import humanize, money
from ledgerline.operators.aggregate import window
from ledgerline.operators.joins import checked_broadcast
from ledgerline.operators.pricing import attach_rates, token_cost
from ledgerline.plans.report import COST_DIGITS, build_report
from ledgerline.schema import TOKEN_CLASSES

# The tools the engine knows how to decode; budget defaults (USD).
KNOWN_TOOLS = ["antigravity", "claude-code", "codex", "opencode"]
DEFAULT_BUDGETS = {"daily": 5.0, "weekly": 25.0, "monthly": 100.0}
CACHE_HINT_RATE = 0.01
HIGH_INPUT_TOKENS = 10_000_000


def _r(c: Column) -> Column:
    return F.round(c, COST_DIGITS)


def statusline(usage: DataFrame, prices: DataFrame, now: datetime, since: datetime | None = None,
               tz: str = "UTC") -> DataFrame:
    """One row over tools since ``since`` (default: local midnight of ``now``)."""
    since = since if since is not None else start_of_day(now, tz)
    lines = build_report(usage, prices, by="tool", since=since, tz=tz, digits=None)
    agg = lines.agg(
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), COST_DIGITS).alias("cost"),
        F.count(F.lit(1)).alias("tools"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total"),
        F.coalesce(F.sum("events"), F.lit(0)).cast("bigint").alias("events"),
        F.coalesce(F.max(F.col("unpriced_events") > 0), F.lit(False)).alias("has_unpriced"),
    )
    text = F.when(F.col("tools") == 0, F.lit("no data")).otherwise(
        F.format_string(
            "%s%s  ·  %d tools  ·  %s tok  ·  %d events",
            money(F.col("cost")),
            F.when(F.col("has_unpriced"), F.lit("*")).otherwise(F.lit("")),
            F.col("tools"),
            humanize(F.col("total")),
            F.col("events"),
        )
    )
    return agg.withColumn("text", text)


def efficiency(lines: DataFrame) -> DataFrame:
    """Totals, cost per 1M tokens, cache hit rate and its verdict."""
    agg = lines.agg(
        F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum("cache_read"), F.lit(0)).cast("bigint").alias("cache_read"),
    )
    tok = F.col("total_tokens").cast("double")
    rate = F.when(F.col("total_tokens") > 0, F.col("cache_read") / tok).otherwise(F.lit(0.0))
    return agg.select(
        "total_tokens",
        _r(F.col("cost")).alias("total_cost"),
        _r(F.when(F.col("total_tokens") > 0, F.col("cost") / tok * 1e6).otherwise(F.lit(0.0))).alias("cost_per_mtok"),
        _r(rate).alias("cache_hit_rate"),
        F.when(rate > 0.1, F.lit("saving")).when(rate > 0, F.lit("low")).otherwise(F.lit("")).alias("verdict"),
    )


def windowed_costs(usage: DataFrame, prices: DataFrame, windows: dict[str, tuple[datetime | None, datetime | None]]
                   ) -> DataFrame:
    """One row with ``cost_<name>`` per named [since, until) window, in one scan.

    Per model: conditional sums of raw cost and of estimated tokens per
    window; then price each window's tokens with the model's rates.
    """
    starts = [s for s, _ in windows.values()]
    ends = [e for _, e in windows.values()]
    u = window(usage, None if None in starts else min(starts), None if None in ends else max(ends))
    est = F.col("raw_cost").isNull()
    measures = []
    for name, (since, until) in windows.items():
        inside = F.lit(True)
        if since is not None:
            inside = inside & (F.col("ts") >= ntz_lit(since))
        if until is not None:
            inside = inside & (F.col("ts") < ntz_lit(until))
        measures.append(F.sum(F.when(inside, F.col("raw_cost"))).alias(f"{name}__raw"))
        for c in TOKEN_CLASSES:
            measures.append(F.sum(F.when(inside & est, F.col(c)).otherwise(F.lit(0))).alias(f"{name}__est_{c}"))
    per_model = u.groupBy(F.coalesce(F.col("model"), F.lit("unknown")).alias("model")).agg(*measures)
    priced = attach_rates(per_model, prices)
    sums = []
    for name in windows:
        est_cost = token_cost(f"{name}__est_")
        row_cost = F.coalesce(F.col(f"{name}__raw"), F.lit(0.0)) + F.when(
            F.col("price_key").isNotNull(), est_cost
        ).otherwise(F.lit(0.0))
        sums.append(F.coalesce(F.sum(row_cost), F.lit(0.0)).alias(f"cost_{name}"))
    return priced.agg(*sums)


def compare_periods(usage: DataFrame, prices: DataFrame, current_since: datetime | None,
                    previous_since: datetime | None, disjoint: bool = False) -> DataFrame:
    """Cost since A vs cost since B; ``disjoint`` makes the previous window [B, A)."""
    prev_until = current_since if disjoint else None
    costs = windowed_costs(usage, prices, {"cur": (current_since, None), "prev": (previous_since, prev_until)})
    cur, prev = F.col("cost_cur"), F.col("cost_prev")
    change = F.when(prev > 0, (cur - prev) / prev * 100).otherwise(F.lit(0.0))
    return costs.select(
        _r(cur).alias("current"),
        _r(prev).alias("previous"),
        _r(change).alias("change_pct"),
        F.when(change > 20, F.lit("increase")).when(change < -20, F.lit("decrease")).otherwise(F.lit("")).alias("band"),
        F.lit(day_text(current_since) if current_since else "all-time").alias("period"),
        F.lit(day_text(previous_since) if previous_since else "all-time").alias("prev_text"),
    )


def summary_cards(usage: DataFrame | None, prices: DataFrame | None, now: datetime, tz: str = "UTC",
                  days: DataFrame | None = None) -> DataFrame:
    """today / 7d / 30d / all: tokens, cost, unpriced flag over whole days from each start day."""
    starts = {
        "today": day_text(start_of_day(now, tz), tz),
        "7d": day_text(now - timedelta(days=7), tz),
        "30d": day_text(now - timedelta(days=30), tz),
        "all": day_text(None),
    }
    if days is None:
        days = build_report(usage, prices, by="day", tz=tz, digits=None)
    aggs = []
    for name, start in starts.items():
        inside = F.col("key") >= F.lit(start)
        aggs += [
            F.coalesce(F.sum(F.when(inside, F.col("total"))), F.lit(0)).cast("bigint").alias(f"t_{name}"),
            _r(F.coalesce(F.sum(F.when(inside, F.col("cost"))), F.lit(0.0))).alias(f"c_{name}"),
            F.coalesce(F.max(F.when(inside, F.col("unpriced_events") > 0)), F.lit(False)).alias(f"u_{name}"),
        ]
    wide = days.agg(*aggs)
    stack = ", ".join(f"'{n}', '{s}', t_{n}, c_{n}, u_{n}" for n, s in starts.items())
    return wide.selectExpr(f"stack({len(starts)}, {stack}) AS (card, start_day, total, cost, unpriced)")


def daily_from(usage: DataFrame, prices: DataFrame, since: datetime, tz: str = "UTC") -> DataFrame:
    """Day lines from the whole local day of ``since`` on (a day cut, not an instant cut)."""
    first = local_midnight(local_date(since, tz), tz)
    return build_report(usage, prices, by="day", since=first, tz=tz)


def insights(usage: DataFrame | None, prices: DataFrame | None, since: datetime | None = None, tz: str = "UTC",
             lines: DataFrame | None = None) -> DataFrame:
    """Top tool by tokens and its share, unpriced model count, cache share.

    ``lines``: priced lines of the tool and model panels (``panels.panel_lines``), if there are such already.
    """
    from ledgerline.plans import panels

    if lines is None:
        grain = panels.usage_grain(window(usage, since=since), tz=tz)
        lines = panels.panel_lines(grain, prices, ("tool", "model"))
    tools = panels.panel(lines, "tool", digits=None)
    n_unpriced = panels.unpriced_of(lines).select(F.count(F.lit(1))).scalar()
    agg = tools.agg(
        F.min_by("key", F.struct(-F.col("total"), F.col("key"))).alias("top_tool"),
        F.max("total").alias("top_total"),
        F.sum("total").alias("all_total"),
        F.sum("cache_read").alias("cache_read"),
        F.count(F.lit(1)).alias("tools"),
    )
    share = F.col("top_total").cast("double") / F.col("all_total").cast("double") * 100
    cache = F.col("cache_read").cast("double") / F.col("all_total").cast("double")
    return agg.select(
        F.when(F.col("top_total") > 0, F.col("top_tool")).alias("top_tool"),
        F.col("top_total").cast("bigint").alias("top_total"),
        F.when((F.col("tools") > 1) & (F.col("top_total") > 0), _r(share)).alias("share_pct"),
        n_unpriced.cast("bigint").alias("unpriced_models"),
        F.when((F.col("all_total") > 0) & (cache > CACHE_HINT_RATE), _r(cache * 100)).alias("cache_pct"),
    )


def cost_hint(model_lines: DataFrame) -> DataFrame:
    """Costliest key (cost > 0) and suggestions joined by '; ' (NULL when none)."""
    agg = model_lines.agg(
        F.min_by("key", F.struct(-F.col("cost"), F.col("key"))).alias("top_key"),
        F.max("cost").alias("top_cost"),
        F.sum("input").alias("input"),
    )
    top = F.when(F.col("top_cost") > 0, F.col("top_key"))
    swap = F.when(
        top.contains("Pro") | top.contains("Opus"),
        F.concat(F.lit("consider "), F.replace(top, F.lit("Pro"), F.lit("Haiku")), F.lit(" for simpler tasks")),
    )
    volume = F.when(F.col("input") > HIGH_INPUT_TOKENS, F.lit("batch requests or use smaller context windows"))
    hint = F.concat_ws("; ", swap, volume)
    return agg.select(
        top.alias("top_key"),
        _r(F.col("top_cost")).alias("top_cost"),
        F.when(hint != "", hint).alias("hint"),
    )


def run_rate(lines: DataFrame, since: datetime | None, now: datetime) -> DataFrame:
    """Monthly projection cost / hours * 24 * 30; total as-is without a usable start."""
    hours = (now - since).total_seconds() / 3600.0 if since is not None else 0.0
    cost = F.coalesce(F.sum("cost"), F.lit(0.0))
    agg = lines.agg(cost.alias("cost"))
    monthly = F.col("cost") / F.lit(hours) * 24 * 30 if hours > 0 else F.col("cost")
    return agg.select(
        _r(F.col("cost")).alias("cost"),
        F.lit(round(hours, 6)).alias("hours"),
        _r(monthly).alias("monthly"),
        (F.lit(hours > 0) & (monthly > F.col("cost"))).alias("rising"),
    )


def budget_period(since: datetime | None, now: datetime, tz: str = "UTC") -> str:
    """daily when since is today; weekly when older than 7 days; monthly otherwise."""
    if since is not None and local_date(since, tz) == local_date(now, tz):
        return "daily"
    if since is not None and since < now - timedelta(days=7):
        return "weekly"
    return "monthly"


def budget_check(usage: DataFrame, prices: DataFrame, now: datetime, specs: list[str],
                 budgets: DataFrame | None = None, tz: str = "UTC",
                 periods: dict[str, str] | None = None) -> DataFrame:
    """Per since-spec: period, cost, budget, exceeded, percent of budget.

    The period of a spec follows ``budget_period`` unless ``periods`` names it
    explicitly ({spec: 'daily' | 'weekly' | 'monthly'}); ``budgets`` is a
    (period, budget) table, the defaults otherwise.
    """
    spark = usage.sparkSession
    bounds = {f"w{i}": parse_since(s, now, tz) for i, s in enumerate(specs)}
    costs = windowed_costs(usage, prices, {k: (v, None) for k, v in bounds.items()})
    stack = ", ".join(
        f"'{s}', '{(periods or {}).get(s) or budget_period(bounds[f'w{i}'], now, tz)}', cost_w{i}"
        for i, s in enumerate(specs)
    )
    per_spec = costs.selectExpr(f"stack({len(specs)}, {stack}) AS (spec, period, cost)")
    if budgets is None:
        budgets = spark.createDataFrame(list(DEFAULT_BUDGETS.items()), "period string, budget double")
    joined = per_spec.join(checked_broadcast(budgets), "period", "left")
    return joined.select(
        "spec", "period", _r(F.col("cost")).alias("cost"), "budget",
        (F.col("cost") > F.col("budget")).alias("exceeded"),
        _r(F.col("cost") / F.col("budget") * 100).alias("pct"),
    )


def top_models(model_lines: DataFrame) -> DataFrame:
    """Argmax model by tokens and by cost (ties: smallest key)."""
    return model_lines.agg(
        F.min_by("key", F.struct(-F.col("total"), F.col("key"))).alias("top_by_tokens"),
        F.max("total").alias("tokens"),
        F.min_by("key", F.struct(-F.col("cost"), F.col("key"))).alias("top_by_cost"),
        _r(F.max("cost")).alias("cost"),
    )


def tool_status(usage: DataFrame, tools: list[str] | None = None, found: DataFrame | None = None) -> DataFrame:
    """Every known tool with its event count and first/last instant (0 / NULL when absent).

    ``found``: what discovery has found (``listing.detect``: source, detected);
    without it a tool counts as detected when it has events.
    """
    from ledgerline.operators.aggregate import source_stats

    spark = usage.sparkSession
    known = spark.createDataFrame([(t,) for t in (tools or KNOWN_TOOLS)], "source string")
    stats = source_stats(usage)
    rows = known.join(stats, "source", "left")
    detected = F.coalesce(F.col("events"), F.lit(0)) > 0
    if found is not None:
        rows = rows.join(found.select("source", F.col("detected").alias("listed")), "source", "left")
        detected = F.coalesce(F.col("listed"), F.lit(False))
    return (
        rows.select(
            F.col("source").alias("tool"),
            detected.alias("detected"),
            F.coalesce(F.col("events"), F.lit(0)).cast("bigint").alias("events"),
            "first_ts",
            "last_ts",
        )
        .orderBy("tool")
    )

