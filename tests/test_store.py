"""Idempotent load, aggregation, split, sessions, prune and manifest (store semantics)."""

import os
from datetime import timedelta

import pytest
from conftest import T0, prices_from, usage_rows
from pyspark.sql import functions as F

from ledgerline.operators import aggregate as agg
from ledgerline.operators import load
from ledgerline.plans.sessions import build_sessions, session_model_rows
from ledgerline.schema import USAGE_COLUMNS


def test_dedup_in_batch_across_batches_and_sources(spark, scratch):
    table = f"{scratch}/usage"
    first = usage_rows(spark, [
        dict(source="codex", dedup_key="k1", ts=T0, input=100),
        dict(source="codex", dedup_key="k2", ts=T0, input=200),
        dict(source="codex", dedup_key="k1", ts=T0, input=999),
    ]).withColumn("path", F.lit("f")).withColumn("ln", F.monotonically_increasing_id())
    counts = load.insert_events(spark, first, table)
    assert sum(r.inserted for r in counts.collect()) == 2
    stored = {r.dedup_key: r.input for r in spark.read.parquet(table).collect()}
    assert stored == {"k1": 100, "k2": 200}
    again = load.insert_events(spark, first, table)
    assert again.count() == 0
    other = usage_rows(spark, [dict(source="opencode", dedup_key="k1", ts=T0, input=5)])
    assert sum(r.inserted for r in load.insert_events(spark, other, table).collect()) == 1


def test_first_wins_is_by_file_then_line(spark):
    batch = usage_rows(spark, [
        dict(source="s", dedup_key="k", ts=T0, input=3),
        dict(source="s", dedup_key="k", ts=T0, input=1),
        dict(source="s", dedup_key="k", ts=T0, input=2),
    ])
    with_origin = batch.withColumn("path", F.when(F.col("input") == 3, "b").otherwise("a")).withColumn(
        "ln", F.when(F.col("input") == 1, 5).otherwise(9))
    assert load.first_wins(with_origin).collect()[0].input == 1


def test_aggregate_filters_and_bad_dimension(spark):
    usage = usage_rows(spark, [
        dict(source="codex", dedup_key="1", ts=T0, input=100, output=10),
        dict(source="codex", dedup_key="2", ts=T0 + timedelta(hours=1), input=50, output=5),
        dict(source="claude-code", dedup_key="3", ts=T0, input=30, output=3, raw_cost=0.5),
    ])
    rows = {r.key: r for r in agg.usage_aggregate(usage, "tool").collect()}
    assert (rows["codex"].input, rows["codex"].output, rows["codex"].events, rows["codex"].n_raw) == (150, 15, 2, 0)
    assert rows["claude-code"].raw_cost == 0.5 and rows["claude-code"].n_raw == 1
    win = agg.usage_aggregate(agg.window(usage, since=T0 + timedelta(minutes=30), source="codex"), "tool").collect()
    assert [(r.key, r.events, r.input) for r in win] == [("codex", 1, 50)]
    with pytest.raises(ValueError):
        agg.usage_aggregate(usage, "weekday")


def test_raw_and_estimated_split(spark):
    usage = usage_rows(spark, [
        dict(source="opencode", dedup_key="1", ts=T0, model="m", input=100, output=10, raw_cost=0.25),
        dict(source="opencode", dedup_key="2", ts=T0, model="m", input=200, output=20),
    ])
    r = agg.usage_aggregate(usage, "model").collect()[0]
    assert (r.raw_cost, r.n_raw, r.est_input, r.est_output, r.est_events) == (0.25, 1, 200, 20, 1)


def test_sessions_by_model_exclude_empty_session(spark):
    prices = prices_from(spark, {"gpt-5": {"input_cost_per_token": 1e-06, "output_cost_per_token": 1e-05}})
    usage = usage_rows(spark, [
        dict(source="codex", dedup_key="1", ts=T0, session_id="s1", model="gpt-5", project="/p/b", input=10),
        dict(source="codex", dedup_key="2", ts=T0 + timedelta(seconds=90), session_id="s1", model="gpt-5", input=10),
        dict(source="codex", dedup_key="3", ts=T0 + timedelta(hours=1, seconds=5), session_id="s1",
             model="gpt-5-mini", project="/p/a", input=10),
        dict(source="codex", dedup_key="4", ts=T0, session_id="", model="gpt-5", input=10),
    ])
    per_model = session_model_rows(usage, prices).collect()
    assert sorted(r.model for r in per_model) == ["gpt-5", "gpt-5-mini"]
    s = build_sessions(usage, prices).collect()
    assert len(s) == 1
    s = s[0]
    assert (s.session_id, s.models, s.events, s.duration_s) == ("s1", 2, 3, 3605)
    assert s.project == "/p/b"  # project of the first model row ("gpt-5" < "gpt-5-mini")
    assert s.unpriced_events == 1 and abs(s.cost - 0.00002) < 1e-12


def test_prune_and_earliest(spark, scratch):
    table = f"{scratch}/usage"
    usage = usage_rows(spark, [
        dict(source="codex", dedup_key="old", ts=T0),
        dict(source="codex", dedup_key="new", ts=T0 + timedelta(hours=48)),
    ])
    usage.withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(table)
    assert load.prune(spark, table, T0 + timedelta(hours=24)) == 1
    left = spark.read.parquet(table)
    assert [r.dedup_key for r in left.collect()] == ["new"]
    assert agg.earliest_event(left).collect()[0].earliest_ts == T0 + timedelta(hours=48)
    assert agg.earliest_event(left.filter("false")).collect()[0].earliest_ts is None


def test_prune_rewrites_the_boundary_day_only(spark, scratch):
    table = f"{scratch}/usage"
    day = T0.replace(hour=0)
    usage = usage_rows(spark, [
        dict(source="a", dedup_key=str(h), ts=day + timedelta(hours=h)) for h in range(0, 72, 6)
    ])
    usage.withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(table)
    cut = day + timedelta(days=1, hours=9)
    deleted = load.prune(spark, table, cut)
    left = spark.read.parquet(table).select(*USAGE_COLUMNS)
    assert deleted == 6 and left.count() == 6
    assert left.agg(F.min("ts")).collect()[0][0] == day + timedelta(days=1, hours=12)


def test_manifest_lookup_upsert_and_plan(spark):
    from ledgerline.schema import MANIFEST

    old = spark.createDataFrame([("/a", "codex", 100, T0, 100, '{"seq":1}', T0),
                                 ("/b", "codex", 50, T0, 50, None, T0),
                                 ("/c", "codex", 80, T0, 80, None, T0)], MANIFEST)
    new = spark.createDataFrame([("/a", "codex", 200, T0, 200, '{"seq":2}', T0)], MANIFEST)
    merged = {r.path: r for r in load.manifest_upsert(old, new).collect()}
    assert merged["/a"].offset == 200 and merged["/a"].state == '{"seq":2}' and merged["/b"].offset == 50
    listing = spark.createDataFrame([("/a", "codex", 100, T0), ("/b", "codex", 60, T0 + timedelta(1)),
                                     ("/c", "codex", 10, T0 + timedelta(1)), ("/d", "codex", 5, T0)],
                                    "path string, source string, size long, mtime timestamp_ntz")
    plan = {r.path: (r.action, r.offset) for r in load.changed_files(listing, old).collect()}
    assert plan == {"/a": ("skip", 0), "/b": ("resume", 50), "/c": ("reset", 0), "/d": ("new", 0)}
    always = {r.path: r.action for r in load.changed_files(listing, old, always_scan=("codex",)).collect()}
    assert always["/a"] == "resume"


def test_first_wins_with_one_hot_key(spark):
    """A third of the batch shares one (empty) key: one row survives, the earliest."""
    rows = [dict(source="s", dedup_key="" if i % 3 == 0 else str(i), ts=T0, input=i) for i in range(3000)]
    batch = usage_rows(spark, rows).withColumn("path", F.lit("f")).withColumn("ln", F.col("input"))
    out = load.first_wins(batch.repartition(8))
    assert out.count() == 2001
    assert out.filter("dedup_key = ''").collect()[0].input == 0


def test_checked_broadcast_falls_back_when_large(spark):
    from ledgerline.operators.joins import checked_broadcast, fits

    small = spark.range(10)
    assert fits(small)
    big = spark.range(1000)
    assert not fits(big, max_rows=100, max_bytes=8)
    plan = big.join(checked_broadcast(big, max_rows=100, max_bytes=8), "id")._jdf.queryExecution().toString()
    assert "broadcast" not in plan.lower().split("== physical plan ==")[0]


def test_key_horizon_prunes_days_and_keeps_dedup(spark, scratch):
    table = f"{scratch}/usage"
    old = usage_rows(spark, [dict(source="codex", dedup_key=f"k{i}", ts=T0 + timedelta(days=i)) for i in range(10)])
    load.insert_events(spark, old, table)
    again = usage_rows(spark, [dict(source="codex", dedup_key="k8", ts=T0 + timedelta(days=8)),
                               dict(source="codex", dedup_key="new", ts=T0 + timedelta(days=8))])
    stored = spark.read.parquet(table)
    fresh = load.not_loaded(again, stored, key_horizon_days=1)
    assert [r.dedup_key for r in fresh.collect()] == ["new"]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_prune_drops_a_boundary_day_with_no_survivors(spark, scratch):
    table = f"{scratch}/usage"
    day = T0.replace(hour=0)
    usage = usage_rows(spark, [dict(source="a", dedup_key="early", ts=day + timedelta(hours=1)),
                               dict(source="a", dedup_key="next", ts=day + timedelta(days=1, hours=1))])
    usage.withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(table)
    assert load.prune(spark, table, day + timedelta(hours=12)) == 1
    left = spark.read.parquet(table)
    assert [r.dedup_key for r in left.collect()] == ["next"]
    assert not any(n.startswith(f"dt={day.date()}") for n in os.listdir(table))
    assert load.prune(spark, table, day + timedelta(hours=12)) == 0  # idempotent
