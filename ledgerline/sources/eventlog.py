"""Usage events derived from the driver's ``events`` table.

The test tables hold no tool logs, so a deterministic usage table is derived
from ``events`` with integer arithmetic only (one narrow projection, no
shuffle). The same derivation exists as SQL text in ``ledgerline.oracle`` so
an independent engine can compute expected results from the same parquet.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import cached_handle


# Tool per event type, and one model name per user_id % 12
# chosen to exercise every path of the price lookup (exact key, date stamp,
# provider prefix, "." -> "-", "-" -> ".", "-latest", case, path suffix,
# normalised index, a miss, and the empty name).
TOOL_BY_EVENT_TYPE = {
    "view": "claude-code",
    "click": "codex",
    "purchase": "opencode",
    "signup": "antigravity",
    "error": "cursor",
}
MODEL_BY_USER_MOD = [
    "claude-sonnet-4-5",
    "claude-opus-4-1-20250805",
    "gemini-2.5-pro",
    "claude-3.5-haiku",
    "gpt-4-1",
    "gpt-4o-latest",
    "GPT-5-Mini",
    "gpt-5",
    "openrouter/anthropic/claude-sonnet-4-5",
    "grok-4",
    "mystery-model-9",
    "",
]
# Pinned clock for time-relative queries over the derived table.
NOW = datetime(2024, 1, 31, 12, 0, 0)


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _derivation_sql() -> list[str]:
    """The derivation as SQL expressions (one JVM parse instead of many py4j calls)."""
    tools = " ".join(f"WHEN {_lit(k)} THEN {_lit(v)}" for k, v in TOOL_BY_EVENT_TYPE.items())
    models = " ".join(f"WHEN {i} THEN {_lit(m)}" for i, m in enumerate(MODEL_BY_USER_MOD))
    epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    return [
        f"CASE event_type {tools} ELSE event_type END AS source",
        "CAST(event_id AS STRING) AS dedup_key",
        f"timestampadd(SECOND, timestampdiff(SECOND, {epoch}, CAST(ts AS TIMESTAMP_NTZ)), {epoch}) AS ts",
        f"CASE user_id % 12 {models} END AS model",
        "CASE WHEN user_id % 17 = 0 THEN '' ELSE concat('s', CAST(user_id AS STRING)) END AS session_id",
        "CASE WHEN user_id % 13 = 0 THEN '' WHEN user_id % 6 = 5 THEN '/tmp/scratch/' "
        "ELSE concat('/home/u/org/p', CAST(user_id % 6 AS STRING)) END AS project",
        "CAST(event_id % 1000 + 1 AS BIGINT) AS input",
        "CAST(user_id * 3 AS BIGINT) AS output",
        "CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) * 10 AS BIGINT) AS cache_read",
        "CAST(event_id % 50 AS BIGINT) AS cache_write",
        "CAST(event_id % 20 AS BIGINT) AS reasoning",
        "CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN value / 100.0D END AS raw_cost",
    ]


_IDS_SQL = ["event_id", "user_id", "CAST(ts AS TIMESTAMP_NTZ) AS event_ts"]


def usage_from_events(events: DataFrame, with_ids: bool = False) -> DataFrame:
    """Usage rows (USAGE columns); ``with_ids`` also keeps event_id, user_id and the raw ts."""
    return events.selectExpr(*_derivation_sql(), *(_IDS_SQL if with_ids else []))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    return cached_handle(spark, ("events", path), lambda: spark.read.parquet(path))


def usage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached_handle(spark, ("usage", f"{sf_dir.rstrip('/')}/events.parquet"),
                         lambda: usage_from_events(read_events(spark, sf_dir)))
