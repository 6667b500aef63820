"""Reports, formatting, time bounds, calendar statistics, line tailing and the driver entry."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from conftest import T0, prices_from, usage_rows

from ledgerline.functions import fmt
from ledgerline.functions.bounds import add_months, parse_since, parse_until
from ledgerline.operators import calendar as cal
from ledgerline.plans import insights as ins
from ledgerline.plans.report import build_report, unpriced_models

PRICES = {"gpt-5": {"input_cost_per_token": 1e-06, "output_cost_per_token": 1e-05}}


def sample(spark):
    return usage_rows(spark, [
        dict(source="codex", dedup_key="1", ts=T0, model="gpt-5", input=1000, output=100),
        dict(source="codex", dedup_key="2", ts=T0 + timedelta(days=1), model="mystery", input=50),
        dict(source="opencode", dedup_key="3", ts=T0, model="mystery", input=10, raw_cost=0.5),
        dict(source="opencode", dedup_key="4", ts=T0, model="gpt-5", input=100, raw_cost=0.0),
        dict(source="opencode", dedup_key="5", ts=T0, model="gpt-5", input=100),
    ])


def test_report_pricing_policy_and_total(spark):
    lines = {r.key: r for r in build_report(sample(spark), prices_from(spark, PRICES), by="tool",
                                            with_total=True).collect()}
    assert lines["codex"].cost == pytest.approx(0.002) and lines["codex"].unpriced_events == 1
    # reported cost wins; the estimate covers only rows without one
    assert lines["opencode"].cost == pytest.approx(0.5 + 0.0001) and lines["opencode"].unpriced_events == 0
    assert lines["opencode"].raw_cost == 0.5
    assert lines["TOTAL"].events == 5 and lines["TOTAL"].cost == pytest.approx(0.5021)
    order = [r.key for r in build_report(sample(spark), prices_from(spark, PRICES), with_total=True).collect()]
    assert order[-1] == "TOTAL" and order[0] == "codex"
    days = [r.key for r in build_report(sample(spark), prices_from(spark, PRICES), by="day").collect()]
    assert days == ["2026-07-01", "2026-07-02"]
    assert [r.model for r in unpriced_models(sample(spark), prices_from(spark, PRICES)).collect()] == ["mystery"]


def test_day_key_uses_the_local_zone(spark):
    usage = usage_rows(spark, [dict(source="a", dedup_key="1", ts=datetime(2026, 7, 1, 23, 30))])
    keys = [r.key for r in build_report(usage, prices_from(spark, PRICES), by="day", tz="Asia/Tokyo").collect()]
    assert keys == ["2026-07-02"]


def test_compare_and_budget(spark):
    usage, prices = sample(spark), prices_from(spark, PRICES)
    c = ins.compare_periods(usage, prices, T0 + timedelta(hours=12), T0).collect()[0]
    assert c.current == 0.0 and c.previous == pytest.approx(0.5021) and c.change_pct == -100.0
    now = T0 + timedelta(days=1, hours=2)
    b = {r.spec: r for r in ins.budget_check(usage, prices, now, ["today", "30d"]).collect()}
    assert b["today"].period == "daily" and b["30d"].period == "weekly"
    budgets = spark.createDataFrame([("monthly", 0.1)], "period string, budget double")
    m = ins.budget_check(usage, prices, now, ["30d"], budgets=budgets, periods={"30d": "monthly"}).collect()[0]
    assert (m.period, m.budget, m.exceeded) == ("monthly", 0.1, True) and m.pct == pytest.approx(502.1)


FORMAT_CASES = [(0, "0"), (999, "999"), (1000, "1K"), (1250, "1.2K"), (1350, "1.4K"), (1150, "1.1K"),
                (1_500_000, "1.5M"), (2_000_000_000, "2B"), (-5, "-5")]


def test_humanize_money_cost_cell(spark):
    df = spark.createDataFrame([(n,) for n, _ in FORMAT_CASES], "n long")
    assert [r.h for r in df.select(fmt.humanize("n").alias("h")).collect()] == [t for _, t in FORMAT_CASES]
    money = spark.createDataFrame([(v,) for v in (150.4, 12.345, 0.0005, 0.0, 1.0)], "v double")
    assert [r.m for r in money.select(fmt.money("v").alias("m")).collect()] == ["$150", "$12.35", "$0.001", "$0",
                                                                                  "$1.00"]
    cells = spark.createDataFrame([(0.0, 3), (1.5, 2), (1.5, 0)], "c double, u long")
    assert [r.x for r in cells.select(fmt.cost_cell("c", "u").alias("x")).collect()] == ["-*", "$1.50*", "$1.50"]


def test_short_project_truncate_duration(spark):
    df = spark.createDataFrame([("",), ("/tmp/x",), ("/home/u/org/proj/",), ("a/b",)], "p string")
    assert [r.s for r in df.select(fmt.short_project("p").alias("s")).collect()] == [
        "(unknown)", "/tmp/x", ".../org/proj", "a/b"]
    t = spark.createDataFrame([("abcdefghijklmnop",), ("short",)], "s string")
    assert [r.t for r in t.select(fmt.truncate_text("s", 13).alias("t")).collect()] == ["abcdefghijkl…", "short"]
    d = spark.createDataFrame([(42,), (300,), (3723,)], "s long")
    assert [r.d for r in d.select(fmt.duration_text("s").alias("d")).collect()] == ["42s", "5m0s", "1h2m3s"]


def test_since_until_bounds():
    now = datetime(2026, 3, 31, 15, 30)
    assert parse_since("all", now) is None and parse_since("", now) is None
    assert parse_since("today", now) == datetime(2026, 3, 31)
    assert parse_since("24h", now) == datetime(2026, 3, 30, 15, 30)
    assert parse_since("2w", now) == datetime(2026, 3, 17, 15, 30)
    assert parse_since("1m", now) == datetime(2026, 3, 3, 15, 30)  # Feb 31 carries into March
    assert parse_since("2026-03-01", now) == datetime(2026, 3, 1)
    assert parse_until("2026-03-01", now) == datetime(2026, 3, 2)
    assert add_months(datetime(2024, 1, 31), 1) == datetime(2024, 3, 2)
    for bad in ("yesterday", "7x", "2026-13-01"):
        with pytest.raises(ValueError):
            parse_since(bad, now)
    with pytest.raises(ValueError):
        parse_until("today", now)


def test_streak_stats_match_sequential_count(spark):
    rnd = random.Random(3)
    now = datetime(2026, 7, 20, 12)
    days = [now.date() - timedelta(days=i) for i in range(140)]
    active = [d for d in days if rnd.random() < 0.6]
    usage = usage_rows(spark, [dict(source="a", dedup_key=str(i), ts=datetime(d.year, d.month, d.day, 9), input=i + 1)
                               for i, d in enumerate(active)])
    got = cal.streak_stats(usage, now).collect()[0]
    window = [now.date() - timedelta(days=118 - i) for i in range(119)]
    flags = [d in set(active) for d in window]
    longest = run = 0
    for f in flags:
        run = run + 1 if f else 0
        longest = max(longest, run)
    current = 0
    for f in reversed(flags):
        if not f:
            break
        current += 1
    assert (got.days, got.active_days, got.longest, got.current) == (119, sum(flags), longest, current)
    assert got.active_pct == sum(flags) * 100 // 119
    grid = cal.heatmap_grid(usage, now).orderBy("day").collect()
    assert grid[0].row == (window[0].weekday()) and all(r.intensity is None for r in grid if r.total == 0)


def test_tail_resume_partial_and_oversized(spark):
    from ledgerline.sources.lines import MAX_LINE, tail, with_offsets

    rows = [("f", 0, '{"a":1}', True), ("f", 1, '{"a":2}', True), ("f", 2, '{"a":3}', False),
            ("g", 0, '{"b":1}', True), ("g", 1, '{"b"', False),
            ("h", 0, "x" * (MAX_LINE + 1), True)]
    lines = with_offsets(spark.createDataFrame(rows, "path string, ln long, line string, terminated boolean"))
    offsets = spark.createDataFrame([("f", 8)], "path string, offset long")
    kept, files = tail(lines, offsets)
    assert sorted((r.path, r.ln) for r in kept.collect()) == [("f", 1), ("f", 2), ("g", 0)]
    f = {r.path: r for r in files.collect()}
    assert f["f"].new_offset == 23  # the unterminated complete object is consumed
    assert f["g"].new_offset == 8  # the partial line is left for the next scan
    assert f["h"].new_offset == 0 and f["h"].error is not None


def test_read_lines_offsets_from_files(spark, scratch):
    from ledgerline.sources.lines import read_lines

    p = f"{scratch}/a.jsonl"
    with open(p, "w") as fh:
        fh.write('{"x":1}\n{"x":22}\n{"x":3}')
    got = sorted((r.ln, r.byte_off, r.terminated) for r in read_lines(spark, p).collect())
    assert got == [(0, 0, True), (1, 8, True), (2, 17, False)]


def test_exports(spark, scratch):
    from ledgerline.plans import export

    lines = build_report(sample(spark), prices_from(spark, PRICES), by="tool")
    export.write_csv(lines, f"{scratch}/csv")
    text = spark.read.text(f"{scratch}/csv").collect()
    assert text[0].value == "key,input,output,cache_read,cache_write,reasoning,total,events,cost,unpriced_events"
    js = {r.key: r.json for r in export.json_rows(lines).collect()}
    assert '"unpriced_events"' not in js["opencode"] and '"raw_cost"' not in js["codex"]


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "cost" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_read_lines_paths_match_the_listing(spark, scratch):
    import os

    from ledgerline.sources.lines import read_lines
    from ledgerline.sources.listing import list_files

    d = f"{scratch}/a b/p=%2Fx+y"
    os.makedirs(d)
    with open(f"{d}/f.jsonl", "w") as fh:
        fh.write('{"x":1}\n')
    listed = {r.path for r in list_files(spark, scratch, "*.jsonl").collect()}
    read = {r.path for r in read_lines(spark, scratch + "/a b/p=%2Fx+y/f.jsonl").collect()}
    assert listed == read and len(read) == 1


def test_dashboard_panels_match_standalone_operators(spark):
    from ledgerline.plans.dashboard import dashboard
    from ledgerline.sources.eventlog import NOW, usage_table
    from ledgerline.sources.prices import read_price_list

    usage, prices = usage_table(spark, "/root/testdata/sf0.001"), read_price_list(spark)
    panels = dashboard(usage, prices, NOW)

    def rows(df):
        return sorted(tuple(r) for r in df.collect())

    assert rows(panels["cards"]) == rows(ins.summary_cards(usage, prices, NOW))
    assert rows(panels["trend"]) == rows(cal.trend(usage, NOW))
    assert rows(panels["streak"]) == rows(cal.streak_stats(usage, NOW))
    assert rows(panels["heatmap"]) == rows(cal.heatmap_grid(usage, NOW))
    assert rows(panels["by_tool"]) == rows(build_report(usage, prices, by="tool"))
    assert rows(panels["by_model"]) == rows(build_report(usage, prices, by="model"))
    assert rows(panels["by_project"]) == rows(build_report(usage, prices, by="project"))
    assert rows(panels["insights"]) == rows(ins.insights(usage, prices))
    since = NOW - timedelta(days=9)
    one = dashboard(usage, prices, NOW, since=since, tool="codex", tz="Asia/Kolkata")
    want = lambda by: build_report(usage, prices, by=by, since=since, source="codex", tz="Asia/Kolkata")
    for by in ("tool", "model", "project"):
        assert [tuple(r) for r in one[f"by_{by}"].collect()] == [tuple(r) for r in want(by).collect()]
    codex = usage.where("source = 'codex'")
    assert rows(one["cards"]) == rows(ins.summary_cards(codex, prices, NOW, tz="Asia/Kolkata"))
    assert rows(one["insights"]) == rows(ins.insights(codex, prices, since=since, tz="Asia/Kolkata"))


def test_dashboard_and_insights_read_the_facts_once(spark):
    from ledgerline.plans.dashboard import dashboard
    from ledgerline.sources.eventlog import NOW, usage_table
    from ledgerline.sources.prices import read_price_list

    usage, prices = usage_table(spark, "/root/testdata/sf0.001"), read_price_list(spark)
    n, read = usage.count(), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    facts = usage.mapInArrow(counted, usage.schema)
    ins.insights(facts, prices).collect()
    assert read.value == n
    for panel in dashboard(facts, prices, NOW).values():
        panel.collect()
    assert read.value == 2 * n


def test_results_do_not_depend_on_the_session_time_zone(spark):
    from ledgerline.sources.eventlog import NOW, usage_table
    from ledgerline.sources.prices import read_price_list

    def run():
        usage, prices = usage_table(spark, "/root/testdata/sf0.001"), read_price_list(spark)
        a = build_report(usage, prices, by="day", since=NOW - timedelta(days=9), until=NOW - timedelta(days=2))
        b = ins.compare_periods(usage, prices, NOW - timedelta(days=7), NOW - timedelta(days=14))
        c = cal.streak_stats(usage, NOW)
        return [sorted(tuple(r) for r in df.collect()) for df in (a, b, c)]

    utc = run()
    previous = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert run() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", previous)


def test_stored_table_scan_prunes_partitions_and_columns(spark, scratch):
    from ledgerline.sources.eventlog import usage_table
    from ledgerline.sources.prices import read_price_list

    usage_table(spark, "/root/testdata/sf0.001").withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(
        f"{scratch}/usage")
    stored = spark.read.parquet(f"{scratch}/usage")
    report = build_report(stored, read_price_list(spark), by="model", since=datetime(2024, 1, 20, 6),
                          until=datetime(2024, 1, 25), source="codex")
    previous = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = report._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", previous)
    assert "dt#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "EqualTo(source,codex)" in pushed
    assert "session_id" not in plan.split("ReadSchema: ")[1].split("\n")[0]  # unused columns are not read


def test_dashboard_streak_window_and_tools(spark):
    from conftest import prices_from, usage_rows

    from ledgerline.plans.dashboard import dashboard

    now = datetime(2025, 11, 30, 12)
    rows = [dict(source=s, dedup_key=f"{s}{d}", ts=datetime(2025, 11, d, 9), input=1) for s in ("codex", "antigravity")
            for d in (20, 21, 30)]
    prices = prices_from(spark, {"gpt-5": {"input_cost_per_token": 1e-6}})
    usage = usage_rows(spark, rows)
    whole = dashboard(usage, prices, now)
    assert [r.source for r in whole["tools"].collect()] == ["antigravity", "codex"]
    assert whole["streak"].collect()[0].days == 119
    since = dashboard(usage, prices, now, since=datetime(2025, 11, 25))
    assert since["streak"].collect()[0].days == 11  # from the first event, which is earlier
    assert sorted(r.key for r in since["daily"].collect()) == ["2025-11-30"]


def test_csv_text_round_trips(spark, scratch):
    from ledgerline.plans import export

    keys = ["", " padded ", 'a "quoted" key', "comma, inside", "plain"]
    lines = spark.createDataFrame([(k, 1, 2, 3, 4, 5, 15, 1, 0.5, 0) for k in keys],
                                  "key string, input long, output long, cache_read long, cache_write long, reasoning long,"
                                  " total long, events long, cost double, unpriced_events long")
    export.write_csv(lines, f"{scratch}/csv", single_file=True)
    text = "".join(r.value + "\n" for r in spark.read.text(f"{scratch}/csv").collect())
    import csv
    import io

    rows = list(csv.DictReader(io.StringIO(text)))
    assert sorted(r["key"] for r in rows) == sorted(keys) and {r["cost"] for r in rows} == {"0.500000"}
