"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables (through the derived usage table or the
log lines built from ``events``) over their whole extent; the SQL statement
of the same name in ``ledgerline.oracle`` computes the expected answer.
Time-relative queries use the pinned clock ``NOW`` of the derived table.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.timecols import ntz_lit

from ledgerline.functions import fmt
from ledgerline.functions.bounds import parse_since, parse_until
from ledgerline.functions.names import model_candidates, normalize_model
from ledgerline.operators import aggregate as agg
from ledgerline.operators import calendar as cal
from ledgerline.operators.joins import checked_broadcast
from ledgerline.operators.places import with_places
from ledgerline.operators.pricing import attach_rates, norm_index, price_rows, resolve_models
from ledgerline.plans import insights as ins
from ledgerline.plans.report import build_report, report_by_cost, unpriced_models
from ledgerline.plans.sessions import (
    build_sessions, session_model_rows, session_unpriced_models, sessions_display, sessions_json, sessions_total)
from ledgerline.schema import TOKEN_CLASSES, USAGE_COLUMNS
from ledgerline.operators import load
from ledgerline.plans import export
from ledgerline.session import scratch_path, written
from ledgerline.sampledata import tool_logs as fixtures
from ledgerline.sources import antigravity, claude, codex, lines, listing, opencode
from ledgerline.sources.eventlog import NOW, usage_table
from ledgerline.sources.prices import read_price_list

Query = Callable[[SparkSession, str], DataFrame]

# Fixed parameters of the registered queries.
WINDOW_SINCE = NOW - timedelta(days=7)
WINDOW_UNTIL = NOW - timedelta(days=1)
PREV_SINCE = NOW - timedelta(days=14)
DAY_CUT = datetime(2024, 1, 20, 15, 30, 0)
STATUS_SINCE = NOW - timedelta(days=3)
BUDGET_SPECS = ["today", "24h", "7d", "30d"]
BOUND_SPECS = [("since", "today"), ("since", "36h"), ("since", "2w"), ("since", "1m"), ("since", "2024-01-15"),
               ("since", "all"), ("until", "2024-01-10"), ("until", "3d")]


def _inputs(spark: SparkSession, sf_dir: str):
    return usage_table(spark, sf_dir), read_price_list(spark)


def _report(by: str, **kw) -> Query:
    def run(spark, sf_dir):
        usage, prices = _inputs(spark, sf_dir)
        return build_report(usage, prices, by=by, **kw)

    return run


def _model_grain(by: str, source: str | None = None) -> Query:
    def run(spark, sf_dir):
        usage = usage_table(spark, sf_dir)
        rows = agg.usage_aggregate(agg.window(usage, source=source), by)
        return rows.select(
            "key", "model", *TOKEN_CLASSES, "events",
            F.round("raw_cost", 6).alias("raw_cost"),
            (F.col("n_raw") > 0).alias("has_raw_cost"),
            *[f"est_{c}" for c in TOKEN_CLASSES], "est_events",
        )

    return run


def q_report_model_by_cost(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return report_by_cost(build_report(usage, prices, by="model"))


def q_session_model(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    rows = session_model_rows(usage, prices)
    return rows.select(
        "session_id", "source", "model", "project", *TOKEN_CLASSES, "events",
        F.round("raw_cost", 6).alias("raw_cost"), "est_events",
        F.round("cost", 6).alias("cost"), F.col("unpriced_events").cast("bigint").alias("unpriced_events"),
        "first_ts", "last_ts",
    )


def q_sessions(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return build_sessions(usage, prices)


def q_sessions_total(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return sessions_total(build_sessions(usage, prices, digits=None))


def q_sessions_display(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return sessions_display(build_sessions(usage, prices))


def q_sessions_json(spark, sf_dir):
    """The sessions' JSON, written out and read back into typed columns."""
    usage, prices = _inputs(spark, sf_dir)
    out = scratch_path(spark, "sessions-json")
    sessions_json(build_sessions(usage, prices)).select("json").write.text(out)
    counts = ", ".join(f"{c} long" for c in ["models", *TOKEN_CLASSES, "total", "events"])
    return spark.read.schema(f"session_id string, source string, project string, {counts}, cost double, "
                             "unpriced_events long, first_ts string, last_ts string, duration long").json(out)


def q_session_unpriced(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return session_unpriced_models(usage, prices)


def _order(by: str, by_cost: bool = False) -> Query:
    """Keys of a report with their places, as the report's rows come (few rows: tools, models or days)."""
    def run(spark, sf_dir):
        usage, prices = _inputs(spark, sf_dir)
        lines = build_report(usage, prices, by=by)
        rows = (report_by_cost(lines) if by_cost else lines).select("key", F.monotonically_increasing_id().alias("at"))
        return rows.select("key", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))

    return run


def q_source_stats(spark, sf_dir):
    return agg.source_stats(usage_table(spark, sf_dir))


def q_earliest_event(spark, sf_dir):
    return agg.earliest_event(usage_table(spark, sf_dir))


def q_unpriced_models(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return unpriced_models(usage, prices, by="model")


def _distinct_models(spark, sf_dir) -> DataFrame:
    usage = usage_table(spark, sf_dir)
    return usage.select(F.coalesce(F.col("model"), F.lit("unknown")).alias("model")).distinct()


def q_price_resolve(spark, sf_dir):
    models = _distinct_models(spark, sf_dir)
    resolved = resolve_models(models, read_price_list(spark))
    return models.join(resolved, "model", "left").select("model", "price_key")


def q_price_norm_index(spark, sf_dir):
    """Normal form of every model, and the price key that the normalised index holds for it."""
    index = norm_index(read_price_list(spark)).withColumnRenamed("key", "norm_key")
    models = _distinct_models(spark, sf_dir).select("model", normalize_model("model").alias("norm"))
    return models.join(checked_broadcast(index), "norm", "left").select("model", "norm", "norm_key")


def q_price_candidates(spark, sf_dir):
    return _distinct_models(spark, sf_dir).select("model", F.posexplode(model_candidates("model")).alias("ord", "cand"))


def q_price_rows(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    rows = price_rows(attach_rates(agg.usage_aggregate(usage, "tool"), prices))
    return rows.select(
        "key", "model", "events", "est_events", "n_raw", "price_key",
        F.round("cost", 6).alias("cost"), "priced", F.col("unpriced_events").cast("bigint").alias("unpriced_events"),
    )


def q_statusline(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return ins.statusline(usage, prices, NOW, since=STATUS_SINCE)


def q_efficiency(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return ins.efficiency(build_report(usage, prices, by="tool", since=WINDOW_SINCE, digits=None))


def q_compare(disjoint: bool) -> Query:
    def run(spark, sf_dir):
        usage, prices = _inputs(spark, sf_dir)
        return ins.compare_periods(usage, prices, WINDOW_SINCE, PREV_SINCE, disjoint=disjoint)

    return run


def q_summary_cards(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return ins.summary_cards(usage, prices, NOW)


def q_insights(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return ins.insights(usage, prices)


def q_cost_hint(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return ins.cost_hint(build_report(usage, prices, by="model", digits=None))


def q_run_rate(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return ins.run_rate(build_report(usage, prices, by="tool", since=WINDOW_SINCE, digits=None), WINDOW_SINCE, NOW)


def q_budget_check(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return ins.budget_check(usage, prices, NOW, BUDGET_SPECS)


def q_top_models(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return ins.top_models(build_report(usage, prices, by="model", digits=None))


def q_tool_status(spark, sf_dir):
    """Tools as discovery finds them: one has log files, one an empty file only, two have no folder."""
    roots = {n: scratch_path(spark, f"status-{n}") for n in (claude.SOURCE, codex.SOURCE)}
    fixtures.land_lines(fixtures.claude_lines(_events(spark, sf_dir)), roots[claude.SOURCE])
    nothing = spark.createDataFrame([("/empty.jsonl", 0, "", True)], "path string, ln long, line string, torn boolean")
    fixtures.write_files(nothing, roots[codex.SOURCE])
    found = listing.list_files(spark, roots[claude.SOURCE], "*.txt", source=claude.SOURCE).unionByName(
        listing.list_files(spark, roots[codex.SOURCE], "*.jsonl", source=codex.SOURCE))
    return ins.tool_status(usage_table(spark, sf_dir), found=listing.detect(found))


def q_sessions_order(spark, sf_dir):
    """The session listing's order: newest first, then by id and tool."""
    usage, prices = _inputs(spark, sf_dir)
    placed = with_places(build_sessions(usage, prices).select("session_id", "source", "last_ts"),
                         [F.desc("last_ts"), F.asc("session_id"), F.asc("source")])
    return placed.select("session_id", "source", F.col("place").cast("long").alias("place"))


def q_dashboard_tools(spark, sf_dir):
    """The dashboard's list of tools with their places, as its rows come (few rows)."""
    from ledgerline.plans.dashboard import dashboard

    usage, prices = _inputs(spark, sf_dir)
    rows = dashboard(usage, prices, NOW)["tools"].select("source", F.monotonically_increasing_id().alias("at"))
    return rows.select("source", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


def q_dashboard_lines(spark, sf_dir):
    """The lines of the dashboard's tool, model, project and day panels, out of one scan."""
    from ledgerline.plans import panels

    usage, prices = _inputs(spark, sf_dir)
    lines = panels.panel_lines(panels.usage_grain(usage, WINDOW_SINCE), prices)
    found = [panels.panel(lines, name).withColumn("panel", F.lit(name)) for name in panels.PANELS]
    return reduce(lambda a, b: a.unionByName(b), found)


def q_daily_from(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return ins.daily_from(usage, prices, DAY_CUT)


def q_trend_30d(spark, sf_dir):
    return cal.trend(usage_table(spark, sf_dir), NOW)


def q_streak_days(spark, sf_dir):
    return cal.day_series(usage_table(spark, sf_dir), NOW, cal.STREAK_WEEKS * 7)


def q_streak_stats(spark, sf_dir):
    return cal.streak_stats(usage_table(spark, sf_dir), NOW)


def q_heatmap_grid(spark, sf_dir):
    return cal.heatmap_grid(usage_table(spark, sf_dir), NOW)


def q_share_of_max(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    return cal.share_of_max(build_report(usage, prices, by="tool"))


def q_fmt_report(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    lines = build_report(usage, prices, by="model")
    return lines.select(
        "key",
        *[fmt.humanize(F.col(c)).alias(f"{c}_text") for c in TOKEN_CLASSES + ["total"]],
        "events",
        fmt.cost_cell("cost", "unpriced_events").alias("cost_text"),
    )


def q_short_project(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    lines = build_report(usage, prices, by="project")
    return lines.select("key", fmt.short_project("key").alias("label"), "total")


def q_since_bounds(spark, sf_dir):
    """Events inside each parsed bound (one conditional-count pass)."""
    usage = usage_table(spark, sf_dir)
    bounds = [parse_since(spec, NOW) if kind == "since" else parse_until(spec, NOW) for kind, spec in BOUND_SPECS]
    counts = []
    for i, ((kind, _), bound) in enumerate(zip(BOUND_SPECS, bounds)):
        if bound is None:
            cond = F.lit(True)
        else:
            cond = (F.col("ts") >= ntz_lit(bound)) if kind == "since" else (F.col("ts") < ntz_lit(bound))
        counts.append(F.count(F.when(cond, F.lit(1))).alias(f"n{i}"))
    rows = ", ".join(
        f"'{kind}', '{spec}', CAST({_ts_literal(b)} AS TIMESTAMP_NTZ), n{i}"
        for i, ((kind, spec), b) in enumerate(zip(BOUND_SPECS, bounds))
    )
    return usage.agg(*counts).selectExpr(f"stack({len(BOUND_SPECS)}, {rows}) AS (kind, spec, bound, events)")


def _ts_literal(t: datetime | None) -> str:
    return "NULL" if t is None else f"TIMESTAMP_NTZ'{t:%Y-%m-%d %H:%M:%S}'"


def _events(spark, sf_dir):
    from ledgerline.sources.eventlog import read_events

    return read_events(spark, sf_dir)


def _strip(decoded: DataFrame) -> DataFrame:
    return decoded.select(*USAGE_COLUMNS)


def q_decode_claude(spark, sf_dir):
    return _strip(claude.decode(fixtures.claude_lines(_events(spark, sf_dir))))


def q_decode_codex(spark, sf_dir):
    return _strip(codex.decode(fixtures.codex_lines(_events(spark, sf_dir))))


def q_counter_diff(spark, sf_dir):
    """Previous and current cumulative totals, segment and deltas of every event from cumulative counters."""
    return codex.counter_diffs(fixtures.codex_lines(_events(spark, sf_dir)))


def q_decode_opencode(spark, sf_dir):
    return _strip(opencode.decode(fixtures.opencode_messages(_events(spark, sf_dir))))


def q_cursor_advance(spark, sf_dir):
    return opencode.advance_cursor(fixtures.opencode_messages(_events(spark, sf_dir)), NOW)


def q_decode_antigravity(spark, sf_dir):
    steps, names, traj = fixtures.antigravity_tables(_events(spark, sf_dir))
    return _strip(antigravity.decode(steps, names, traj))


def q_cursor_idx(spark, sf_dir):
    steps, _, _ = fixtures.antigravity_tables(_events(spark, sf_dir))
    return antigravity.advance_idx(steps)


LOAD_CUT = datetime(2024, 1, 15, 0, 0, 0)
PRUNE_BEFORE = datetime(2024, 1, 10, 12, 0, 0)


def _usage_ids(spark, sf_dir):
    from ledgerline.sources.eventlog import usage_from_events

    return usage_from_events(_events(spark, sf_dir), with_ids=True)


def q_dedup_first_wins(spark, sf_dir):
    """Three copies of every event; only the first by (path, ln) survives."""
    u = _usage_ids(spark, sf_dir)
    first = u.select(*USAGE_COLUMNS, F.lit("a").alias("path"), F.col("event_id").alias("ln"))
    later_file = u.select(*[(F.col(c) + 1000).alias(c) if c == "input" else F.col(c) for c in USAGE_COLUMNS],
                          F.lit("b").alias("path"), F.col("event_id").alias("ln"))
    later_line = u.select(*[(F.col(c) + 2000).alias(c) if c == "input" else F.col(c) for c in USAGE_COLUMNS],
                          F.lit("a").alias("path"), (F.col("event_id") + F.lit(10**12)).alias("ln"))
    batch = later_line.unionByName(later_file).unionByName(first)
    return load.first_wins(batch).select(*USAGE_COLUMNS)


def q_insert_ignore(spark, sf_dir):
    """Load events before the cut, then everything (plus repeats): only new keys go in."""
    u = usage_table(spark, sf_dir)
    table = scratch_path(spark, "usage-insert")
    first = load.insert_events(spark, u.filter(F.col("ts") < ntz_lit(LOAD_CUT)), table)
    second = load.insert_events(spark, u.unionByName(u), table)
    total = spark.read.parquet(table).groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    return (
        total.join(first.withColumnRenamed("inserted", "first_load"), "source", "left")
        .join(second.withColumnRenamed("inserted", "second_load"), "source", "left")
        .select("source", F.coalesce("first_load", F.lit(0)).cast("bigint").alias("first_load"),
                F.coalesce("second_load", F.lit(0)).cast("bigint").alias("second_load"), "total")
    )


def _file_listing(spark, sf_dir):
    """(path, source, size, mtime) and the manifest saved at LOAD_CUT, one file per user."""
    u = _usage_ids(spark, sf_dir)
    path = F.concat(F.lit("/logs/u"), F.col("user_id").cast("string"))
    before = F.col("ts") < ntz_lit(LOAD_CUT)
    per_user = u.groupBy(path.alias("path"), "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("ts").alias("mtime"),
        F.count(F.when(before, F.lit(1))).alias("n_before"), F.max(F.when(before, F.col("ts"))).alias("mtime_before"),
    )
    listing = per_user.select("path", F.lit("claude-code").alias("source"), (F.col("n") * 100).alias("size"), "mtime")
    old = per_user.filter(F.col("n_before") > 0).select(
        "path", F.lit("claude-code").alias("source"), (F.col("n_before") * 100).alias("size"),
        F.col("mtime_before").alias("mtime"),
        F.when(F.col("user_id") % 9 == 0, F.col("n") * 100 + 100).otherwise(F.col("n_before") * 100).alias("offset"),
        F.concat(F.lit('{"n":'), F.col("n_before").cast("string"), F.lit("}")).alias("state"),
        ntz_lit(LOAD_CUT).alias("updated_at"),
    )
    return listing, old


def q_changed_files(spark, sf_dir):
    listing, old = _file_listing(spark, sf_dir)
    return load.changed_files(listing, old)


def q_manifest_upsert(spark, sf_dir):
    listing, old = _file_listing(spark, sf_dir)
    plan = load.changed_files(listing, old).filter(F.col("action") != "skip")
    new = plan.select(
        "path", "source", "size", "mtime", F.col("size").alias("offset"),
        F.concat(F.lit('{"n":'), (F.col("size") / 100).cast("bigint").cast("string"), F.lit("}")).alias("state"),
        ntz_lit(NOW).alias("updated_at"),
    )
    return load.manifest_upsert(old, new)


def _pruned(spark, sf_dir):
    u = usage_table(spark, sf_dir)
    table = scratch_path(spark, "usage-prune")
    u.withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(table)
    deleted = load.prune(spark, table, PRUNE_BEFORE)
    return spark.read.parquet(table), deleted


def q_prune_keep(spark, sf_dir):
    table, _ = _pruned(spark, sf_dir)
    return table.groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt"), "source").agg(
        F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"))


def q_prune_deleted(spark, sf_dir):
    table, deleted = _pruned(spark, sf_dir)
    return table.agg(F.lit(deleted).cast("bigint").alias("deleted"), F.count(F.lit(1)).alias("remaining"),
                     F.min("ts").alias("earliest_ts"))


def _decoded_batches(spark, sf_dir):
    ev = _events(spark, sf_dir)
    c_lines, x_lines, msgs = fixtures.claude_lines(ev), fixtures.codex_lines(ev), fixtures.opencode_messages(ev)
    steps, names, traj = fixtures.antigravity_tables(ev)
    decoded = (
        claude.decode(c_lines)
        .unionByName(codex.decode(x_lines))
        .unionByName(opencode.decode(msgs))
        .unionByName(antigravity.decode(steps, names, traj))
    )
    files = (
        c_lines.select("path", F.lit(claude.SOURCE).alias("source"))
        .unionByName(x_lines.select("path", F.lit(codex.SOURCE).alias("source")))
        .unionByName(msgs.select("path", F.lit(opencode.SOURCE).alias("source")))
        .unionByName(steps.select("path", F.lit(antigravity.SOURCE).alias("source")))
        .distinct()
    )
    return decoded, files


def q_ingest_union(spark, sf_dir):
    decoded, _ = _decoded_batches(spark, sf_dir)
    return load.first_wins(decoded).select(*USAGE_COLUMNS)


def q_load_summary(spark, sf_dir):
    """One load of all four tools; one more file has an over-long line and one lies at the wrong depth."""
    from ledgerline.plans.ingest import load_logs

    roots = _land_all(spark, sf_dir)
    bad = _events(spark, sf_dir).agg(F.max("event_id").alias("ln")).select(
        F.lit("bad.jsonl").alias("path"), "ln", F.repeat(F.lit("x"), 1 << 16).alias("line"))
    fixtures.land_lines(bad, roots[claude.SOURCE])
    fixtures.land_lines(bad, f"{roots[claude.SOURCE]}/too/deep")
    summary, _ = load_logs(spark, roots, scratch_path(spark, "usage-load"), scratch_path(spark, "manifest"), NOW,
                           globs=TEXT_FILES, max_line=1 << 15)
    return summary


def q_export_csv(spark, sf_dir):
    usage, prices = _inputs(spark, sf_dir)
    out = scratch_path(spark, "report-csv")
    export.write_csv(build_report(usage, prices, by="project"), out)
    text = spark.read.options(**export.CSV_TEXT).schema(", ".join(f"{c} string" for c in export.CSV_COLUMNS)).csv(out)
    return text.fillna("", subset=["key"])  # CSV has no null: an empty field is the empty key


def q_export_json(spark, sf_dir):
    """The report's JSON, written out and read back into typed columns."""
    usage, prices = _inputs(spark, sf_dir)
    out = scratch_path(spark, "report-json")
    export.write_json(build_report(usage, prices, by="model"), out)
    counts = ", ".join(f"{c} long" for c in [*TOKEN_CLASSES, "total", "events"])
    return spark.read.schema(f"key string, {counts}, raw_cost double, cost double, unpriced_events long").json(out)


def q_tail_lines(spark, sf_dir):
    """Resume every file at its middle line; the last line of odd users' files has no newline."""
    in_file = Window.partitionBy("user_id").orderBy("event_id")
    raw = _events(spark, sf_dir).select(
        F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("path"),
        (F.row_number().over(in_file) - 1).cast("bigint").alias("ln"),
        F.concat(F.lit('{"event":'), F.col("event_id").cast("string"), F.lit(',"type":"'), F.col("event_type"),
                 F.lit('"}')).alias("line"))
    user = F.regexp_extract("path", r"/u([0-9]+)\.jsonl$", 1).cast("bigint")
    last = raw.groupBy("path").agg(F.max("ln").alias("last_ln"))
    marked = raw.join(last, "path").withColumn("is_last", F.col("ln") == F.col("last_ln")).withColumn(
        "line", F.when(F.col("is_last") & (user % 4 == 3), F.substring("line", 1, 8)).otherwise(F.col("line"))
    ).withColumn("terminated", ~(F.col("is_last") & (user % 2 == 1)))
    with_off = lines.with_offsets(marked.select("path", "ln", "line", "terminated"))
    mid = with_off.groupBy("path").agg(((F.min("ln") + F.max("ln")) / 2).alias("mid"))
    offsets = with_off.join(mid, "path").filter(F.col("ln") >= F.col("mid")).groupBy("path").agg(
        F.min("byte_off").alias("offset"))
    kept, _files = lines.tail(with_off, offsets)
    return kept


def q_source_listing(spark, sf_dir):
    raw = fixtures.claude_lines(_events(spark, sf_dir))
    root = scratch_path(spark, "claude-logs")
    fixtures.land_lines(raw, root)
    found = listing.list_files(spark, root, "*.txt", source=claude.SOURCE)
    return listing.detect(found).select("source", "detected", "files")


def _land_all(spark, sf_dir) -> dict[str, str]:
    """The four tools' logs as files and tables under fresh roots."""
    ev = _events(spark, sf_dir)
    roots = {n: scratch_path(spark, f"logs-{n}") for n in
             (claude.SOURCE, codex.SOURCE, opencode.SOURCE, antigravity.SOURCE)}
    fixtures.land_lines(fixtures.claude_lines(ev), roots[claude.SOURCE])
    fixtures.land_lines(fixtures.codex_lines(ev), f"{roots[codex.SOURCE]}/2024/01")
    written(fixtures.opencode_messages(ev), "messages", path=roots[opencode.SOURCE])
    for name, part in zip(("steps", "gen_metadata", "trajectory"), fixtures.antigravity_tables(ev), strict=True):
        written(part, name, path=f"{roots[antigravity.SOURCE]}/{name}")
    return roots


# A batch costs a second or two whatever it holds, so their number doesn't grow with the files.
BACKLOG_BATCHES = 24


def _per_trigger(files: int) -> int:
    return max(64, -(-files // BACKLOG_BATCHES))


TEXT_FILES = {claude.SOURCE: "*.txt", codex.SOURCE: "*.txt"}


def q_stream_ingest(spark, sf_dir):
    """Files that lie there when the stream starts come in batches of 64, of a larger backlog in ``BACKLOG_BATCHES``."""
    from ledgerline.streaming.ingest import start_ingest

    landing, table, ckpt = (scratch_path(spark, n) for n in ("landing-claude", "usage-stream", "ckpt-ingest"))
    files = fixtures.land_lines(fixtures.claude_lines(_events(spark, sf_dir)), landing)
    q = start_ingest(spark, landing, claude.decode, table, ckpt, glob="*.txt", available_now=True,
                     files_per_trigger=_per_trigger(files))
    q.awaitTermination()
    return spark.read.parquet(table).select(*USAGE_COLUMNS)


def q_stream_dedup(spark, sf_dir):
    from ledgerline.streaming.ingest import start_dedup

    landing, out, ckpt = (scratch_path(spark, n) for n in ("landing-dedup", "dedup-out", "ckpt-dedup"))
    fixtures.land_lines(fixtures.claude_lines(_events(spark, sf_dir)), landing)
    start_dedup(spark, landing, claude.decode, out, ckpt, glob="*.txt").awaitTermination()
    return spark.read.parquet(out).select(*USAGE_COLUMNS)


def q_stream_counter_diff(spark, sf_dir):
    """Counter files arrive in two chunks per file, the later chunk first, and the earlier one again."""
    from ledgerline.streaming.counters import current_events, start_decode

    raw = written(fixtures.codex_lines(_events(spark, sf_dir)), "counter-logs")
    half = raw.groupBy("path").agg((F.max("ln") / 2).alias("half"))
    chunked = written(raw.join(half, "path").withColumn("chunk", (F.col("ln") > F.col("half")).cast("int")), "counter-chunks")
    landing, state, ckpt = (scratch_path(spark, n) for n in ("landing-codex", "codex-state", "ckpt-codex"))
    for run, chunk in enumerate((1, 0, 0)):
        chunked.filter(F.col("chunk") == chunk).select("path", "ln", "line").write.parquet(f"{landing}/run={run}")
        stream = (spark.readStream.schema("path string, ln long, line string")
                  .option("recursiveFileLookup", "true").parquet(landing))
        start_decode(stream, state, ckpt).awaitTermination()
    return current_events(spark, state).select(*USAGE_COLUMNS)


def q_stream_daily(spark, sf_dir):
    from ledgerline.streaming.rollup import current_rollup, start_daily

    usage = usage_table(spark, sf_dir)
    landing, sums, ckpt = (scratch_path(spark, n) for n in ("landing-usage", "daily-sums", "ckpt-daily"))
    mid = ntz_lit(datetime(2024, 1, 16))
    usage.filter(F.col("ts") >= mid).write.parquet(f"{landing}/part=0")  # the later half lands first
    start_daily(spark, landing, sums, ckpt).awaitTermination()
    usage.filter(F.col("ts") < mid).write.parquet(f"{landing}/part=1")
    start_daily(spark, landing, sums, ckpt).awaitTermination()
    return current_rollup(spark, sums)


def q_incremental_load(spark, sf_dir):
    """Land per-request logs as files and load them; again, unchanged; then with the rest of each user's lines as
    new files, one of which has an over-long line and is reported without blocking the others."""
    from ledgerline.plans.ingest import load_logs

    root, table, manifest = (scratch_path(spark, n) for n in ("logs-claude", "usage-load", "manifest"))
    raw = fixtures.claude_lines(_events(spark, sf_dir))
    last = raw.groupBy("path").agg(F.max("ln").alias("last"))
    raw = raw.join(last, "path").withColumn("late", F.col("ln") * 2 > F.col("last"))
    least = raw.agg(F.min("path")).first()[0]
    long_line = raw.filter(F.col("path") == least).limit(1).select(
        F.lit(least).alias("path"), F.lit(1 << 40).alias("ln"), F.repeat(F.lit("x"), 1 << 16).alias("line"))
    runs = []
    for run, part in ((1, raw.filter(~F.col("late"))), (2, None), (3, raw.filter(F.col("late")))):
        if part is not None:
            part = part.select("path", "ln", "line")
            fixtures.land_lines(part if run == 1 else part.unionByName(long_line), root)
        summary, _ = load_logs(spark, {claude.SOURCE: root}, table, manifest, NOW, globs=TEXT_FILES,
                               max_line=1 << 15)
        runs.append(summary.withColumn("run", F.lit(run)))
    return reduce(lambda a, b: a.unionByName(b), runs).select("source", "run", "files", "new_events", "errors")


def _grown_logs(spark, sf_dir):
    """Per-request logs that grow over three states, the first with a torn last line, the third with cut files."""
    root = scratch_path(spark, "growing-claude")
    raw = written(fixtures.claude_lines(_events(spark, sf_dir)), "growing-lines")
    return f"{root}/logs/claude/projects", lambda part: fixtures.write_files(fixtures.grown(raw, part), root)


def q_growing_files_load(spark, sf_dir):
    """Load files to which bytes are appended, and of which some are cut: events that each load finds."""
    from ledgerline.plans.ingest import load_logs

    root, grow = _grown_logs(spark, sf_dir)
    table, manifest = scratch_path(spark, "usage-load"), scratch_path(spark, "manifest")
    runs = []
    for run in (1, 2, 3):
        grow(run)
        summary, _ = load_logs(spark, {claude.SOURCE: root}, table, manifest, NOW)
        runs.append(summary.withColumn("run", F.lit(run)))
    return reduce(lambda a, b: a.unionByName(b), runs).select("source", "run", "new_events", "errors")


def q_stream_growing_files(spark, sf_dir):
    """The same files as a stream: a batch has the bytes appended since the one before."""
    from ledgerline.streaming.growing import start_growing_ingest

    root, grow = _grown_logs(spark, sf_dir)
    table, ckpt = scratch_path(spark, "usage-growing"), scratch_path(spark, "ckpt-growing")
    for run in (1, 2, 3):
        grow(run)
        start_growing_ingest(spark, root, claude.decode, table, ckpt, glob="*.jsonl", available_now=True).awaitTermination()
    return spark.read.parquet(table).select(*USAGE_COLUMNS)


def q_load_all_sources(spark, sf_dir):
    """All four tools in one load with cursors in the manifest: first run, unchanged second run, and the manifest's cursors."""
    from ledgerline.plans.ingest import latest_manifest, load_logs

    roots = _land_all(spark, sf_dir)
    table, manifest = scratch_path(spark, "usage-load"), scratch_path(spark, "manifest")
    runs = []
    for run in (1, 2):
        summary, _ = load_logs(spark, roots, table, manifest, NOW,
                               globs=TEXT_FILES)
        runs.append(summary.withColumn("run", F.lit(run)))
    entries, _ = latest_manifest(spark, manifest)
    cursors = entries.groupBy("source").agg(F.count("state").alias("cursors"))
    both = runs[0].unionByName(runs[1]).join(cursors, "source")
    return both.select("source", "run", "files", "new_events", "errors", "cursors")


def q_price_list(spark, sf_dir):
    """Effective rates of every model present in the usage table (price-list scan + lookup)."""
    from ledgerline.operators.pricing import model_rates

    return model_rates(_distinct_models(spark, sf_dir), read_price_list(spark)).select(
        "model", "price_key", "input_rate", "output_rate", "cache_read_rate", "cache_write_rate", "reasoning_rate")


def registry() -> dict[str, Query]:
    return {
        "report_tool": _report("tool"),
        "report_model": _report("model"),
        "report_day": _report("day"),
        "report_project": _report("project"),
        "report_session": _report("session"),
        "report_total": _report("tool", with_total=True),
        "report_model_by_cost": q_report_model_by_cost,
        "usage_window": _report("tool", since=WINDOW_SINCE, until=WINDOW_UNTIL),
        "usage_by_model_one_source": _report("model", source="codex"),
        "agg_tool_model": _model_grain("tool"),
        "agg_day_model": _model_grain("day"),
        "raw_est_split": _model_grain("model"),
        "session_model": q_session_model,
        "sessions": q_sessions,
        "sessions_total": q_sessions_total,
        "sessions_display": q_sessions_display,
        "sessions_json": q_sessions_json,
        "session_unpriced": q_session_unpriced,
        "report_order_tool": _order("tool"),
        "report_order_day": _order("day"),
        "report_order_cost": _order("model", by_cost=True),
        "source_stats": q_source_stats,
        "earliest_event": q_earliest_event,
        "unpriced_models": q_unpriced_models,
        "price_resolve": q_price_resolve,
        "price_norm_index": q_price_norm_index,
        "price_candidates": q_price_candidates,
        "price_rows": q_price_rows,
        "statusline": q_statusline,
        "efficiency": q_efficiency,
        "compare_periods": q_compare(False),
        "compare_disjoint": q_compare(True),
        "summary_cards": q_summary_cards,
        "insights": q_insights,
        "cost_hint": q_cost_hint,
        "run_rate": q_run_rate,
        "budget_check": q_budget_check,
        "top_models": q_top_models,
        "tool_status": q_tool_status,
        "sessions_order": q_sessions_order,
        "dashboard_tools": q_dashboard_tools,
        "dashboard_lines": q_dashboard_lines,
        "daily_from": q_daily_from,
        "trend_30d": q_trend_30d,
        "streak_days": q_streak_days,
        "streak_stats": q_streak_stats,
        "heatmap_grid": q_heatmap_grid,
        "share_of_max": q_share_of_max,
        "fmt_report": q_fmt_report,
        "short_project": q_short_project,
        "since_bounds": q_since_bounds,
        "decode_claude": q_decode_claude,
        "decode_codex": q_decode_codex,
        "counter_diff": q_counter_diff,
        "decode_opencode": q_decode_opencode,
        "cursor_advance": q_cursor_advance,
        "decode_antigravity": q_decode_antigravity,
        "cursor_idx": q_cursor_idx,
        "dedup_first_wins": q_dedup_first_wins,
        "insert_ignore": q_insert_ignore,
        "changed_files": q_changed_files,
        "manifest_upsert": q_manifest_upsert,
        "prune_keep": q_prune_keep,
        "prune_deleted": q_prune_deleted,
        "ingest_union": q_ingest_union,
        "load_summary": q_load_summary,
        "export_csv": q_export_csv,
        "export_json": q_export_json,
        "tail_lines": q_tail_lines,
        "source_listing": q_source_listing,
        "stream_ingest": q_stream_ingest,
        "stream_dedup": q_stream_dedup,
        "stream_counter_diff": q_stream_counter_diff,
        "stream_daily": q_stream_daily,
        "incremental_load": q_incremental_load,
        "load_all_sources": q_load_all_sources,
        "growing_files_load": q_growing_files_load,
        "stream_growing_files": q_stream_growing_files,
        "price_list": q_price_list,
    }
