"""Independent SQL statements of the registered queries (DuckDB dialect).

Each statement reads only the driver's parquet views (``events`` ...) and
restates the expected result directly: the usage derivation is repeated in
SQL, and price resolution is NOT re-implemented - the expected model -> rate
pairs are listed by hand in ``RATES`` so the Spark lookup is checked against
an independent answer.
"""

from __future__ import annotations

# Mirror of ledgerline.sources.eventlog (tool per event type,
# model per user_id % 12) as SQL.
USAGE_CTE = """
usage AS (
  SELECT
    CASE event_type WHEN 'view' THEN 'claude-code' WHEN 'click' THEN 'codex'
      WHEN 'purchase' THEN 'opencode' WHEN 'signup' THEN 'antigravity'
      WHEN 'error' THEN 'cursor' ELSE event_type END AS source,
    CAST(event_id AS VARCHAR) AS dedup_key,
    date_trunc('second', ts) AS ts,
    CASE user_id % 12
      WHEN 0 THEN 'claude-sonnet-4-5' WHEN 1 THEN 'claude-opus-4-1-20250805'
      WHEN 2 THEN 'gemini-2.5-pro' WHEN 3 THEN 'claude-3.5-haiku' WHEN 4 THEN 'gpt-4-1'
      WHEN 5 THEN 'gpt-4o-latest' WHEN 6 THEN 'GPT-5-Mini' WHEN 7 THEN 'gpt-5'
      WHEN 8 THEN 'openrouter/anthropic/claude-sonnet-4-5' WHEN 9 THEN 'grok-4'
      WHEN 10 THEN 'mystery-model-9' WHEN 11 THEN '' END AS model,
    CASE WHEN user_id % 17 = 0 THEN '' ELSE 's' || CAST(user_id AS VARCHAR) END AS session_id,
    CASE WHEN user_id % 13 = 0 THEN '' WHEN user_id % 6 = 5 THEN '/tmp/scratch/'
      ELSE '/home/u/org/p' || CAST(user_id % 6 AS VARCHAR) END AS project,
    CAST(event_id % 1000 + 1 AS BIGINT) AS input,
    CAST(user_id * 3 AS BIGINT) AS output,
    CAST(CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) * 10 AS BIGINT) AS cache_read,
    CAST(event_id % 50 AS BIGINT) AS cache_write,
    CAST(event_id % 20 AS BIGINT) AS reasoning,
    CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN value / 100.0 END AS raw_cost,
    event_id, user_id, ts AS event_ts
  FROM events
)"""

# Expected resolution of each derived model name against the
# sample price list, with effective rates (reasoning falls back to output).
RATES_CTE = """
rates(model, price_key, input_rate, output_rate, cache_read_rate, cache_write_rate, reasoning_rate) AS (
  SELECT model, price_key, CAST(ir AS DOUBLE), CAST(orr AS DOUBLE), CAST(crr AS DOUBLE), CAST(cwr AS DOUBLE),
         CAST(rr AS DOUBLE)
  FROM (VALUES
    ('claude-sonnet-4-5', 'claude-sonnet-4-5', 3e-06, 1.5e-05, 1e-06, 4e-06, 1.5e-05),
    ('claude-opus-4-1-20250805', 'claude-opus-4-1', 1.5e-05, 7.5e-05, 2e-06, 1.9e-05, 7.5e-05),
    ('gemini-2.5-pro', 'gemini/gemini-2.5-pro', 1e-06, 1e-05, 1e-06, 0.0, 1e-05),
    ('claude-3.5-haiku', 'claude-3-5-haiku', 1e-06, 4e-06, 1e-06, 1e-06, 4e-06),
    ('gpt-4-1', 'gpt-4.1', 2e-06, 8e-06, 1e-06, 0.0, 8e-06),
    ('gpt-4o-latest', 'gpt-4o', 3e-06, 1e-05, 1e-06, 0.0, 1e-05),
    ('GPT-5-Mini', 'gpt-5-mini', 1e-06, 2e-06, 0.0, 0.0, 3e-06),
    ('gpt-5', 'openai/gpt-5', 1e-06, 1e-05, 1e-06, 0.0, 1e-05),
    ('openrouter/anthropic/claude-sonnet-4-5', 'anthropic/claude-sonnet-4-5', 4e-06, 1.6e-05, 1e-06, 5e-06, 1.6e-05),
    ('grok-4', 'grok-4-latest', 3e-06, 1.5e-05, 0.0, 0.0, 1.5e-05)
  ) AS v(model, price_key, ir, orr, crr, cwr, rr)
)"""

MEASURES = """
    CAST(SUM(input) AS BIGINT) AS input, CAST(SUM(output) AS BIGINT) AS output,
    CAST(SUM(cache_read) AS BIGINT) AS cache_read, CAST(SUM(cache_write) AS BIGINT) AS cache_write,
    CAST(SUM(reasoning) AS BIGINT) AS reasoning, COUNT(*) AS events,
    COALESCE(SUM(raw_cost), 0.0) AS raw_cost, COUNT(raw_cost) AS n_raw,
    CAST(SUM(CASE WHEN raw_cost IS NULL THEN input ELSE 0 END) AS BIGINT) AS est_input,
    CAST(SUM(CASE WHEN raw_cost IS NULL THEN output ELSE 0 END) AS BIGINT) AS est_output,
    CAST(SUM(CASE WHEN raw_cost IS NULL THEN cache_read ELSE 0 END) AS BIGINT) AS est_cache_read,
    CAST(SUM(CASE WHEN raw_cost IS NULL THEN cache_write ELSE 0 END) AS BIGINT) AS est_cache_write,
    CAST(SUM(CASE WHEN raw_cost IS NULL THEN reasoning ELSE 0 END) AS BIGINT) AS est_reasoning,
    COUNT(CASE WHEN raw_cost IS NULL THEN 1 END) AS est_events"""

# Row pricing: reported cost wins; the estimate covers only rows without one.
PRICED_SELECT = """
    a.*, r.price_key,
    CASE WHEN a.n_raw > 0 THEN a.raw_cost + CASE WHEN a.est_events > 0 AND r.price_key IS NOT NULL THEN
           a.est_input * r.input_rate + a.est_output * r.output_rate + a.est_cache_read * r.cache_read_rate
           + a.est_cache_write * r.cache_write_rate + a.est_reasoning * r.reasoning_rate ELSE 0.0 END
         WHEN r.price_key IS NOT NULL THEN
           a.est_input * r.input_rate + a.est_output * r.output_rate + a.est_cache_read * r.cache_read_rate
           + a.est_cache_write * r.cache_write_rate + a.est_reasoning * r.reasoning_rate
         ELSE 0.0 END AS cost,
    CASE WHEN a.n_raw > 0 THEN (a.est_events = 0 OR r.price_key IS NOT NULL)
         ELSE r.price_key IS NOT NULL END AS priced"""

DIMS = {
    "tool": "source",
    "model": "COALESCE(model, 'unknown')",
    "day": "strftime(ts, '%Y-%m-%d')",
    "project": "COALESCE(project, '')",
    "session": "COALESCE(session_id, '')",
}


def priced_rows(by: str, where: str = "TRUE") -> str:
    """CTE text 'km' (key x model aggregate) and 'pr' (priced rows)."""
    return f"""WITH {USAGE_CTE.strip()},
{RATES_CTE.strip()},
km AS (
  SELECT {DIMS[by]} AS key, COALESCE(model, 'unknown') AS model, {MEASURES}
  FROM usage WHERE {where} GROUP BY 1, 2
),
pr AS (SELECT {PRICED_SELECT} FROM km a LEFT JOIN rates r ON a.model = r.model)"""


LINE_SELECT = """
    CAST(SUM(input) AS BIGINT) AS input, CAST(SUM(output) AS BIGINT) AS output,
    CAST(SUM(cache_read) AS BIGINT) AS cache_read, CAST(SUM(cache_write) AS BIGINT) AS cache_write,
    CAST(SUM(reasoning) AS BIGINT) AS reasoning,
    CAST(SUM(input) + SUM(output) + SUM(cache_read) + SUM(cache_write) + SUM(reasoning) AS BIGINT) AS total,
    CAST(SUM(events) AS BIGINT) AS events, ROUND(SUM(raw_cost), 6) AS raw_cost, ROUND(SUM(cost), 6) AS cost,
    CAST(SUM(CASE WHEN priced THEN 0 ELSE est_events END) AS BIGINT) AS unpriced_events"""


# The same lines at full precision, for statements that go on computing with the costs.
LINE_EXACT = LINE_SELECT.replace("ROUND(SUM(raw_cost), 6)", "SUM(raw_cost)").replace("ROUND(SUM(cost), 6)", "SUM(cost)")


def report_sql(by: str, where: str = "TRUE") -> str:
    return f"""{priced_rows(by, where)}
SELECT key, {LINE_SELECT}
FROM pr GROUP BY key"""


def report_total_sql(by: str, where: str = "TRUE") -> str:
    return f"""{priced_rows(by, where)}
SELECT CASE WHEN GROUPING(key) = 1 THEN 'TOTAL' ELSE key END AS key, {LINE_SELECT}
FROM pr GROUP BY ROLLUP (key)"""


HUMANIZE = """CASE WHEN {n} >= 1000000000 THEN regexp_replace(printf('%.1f', {n} / 1e9), '\\.0$', '') || 'B'
  WHEN {n} >= 1000000 THEN regexp_replace(printf('%.1f', {n} / 1e6), '\\.0$', '') || 'M'
  WHEN {n} >= 1000 THEN regexp_replace(printf('%.1f', {n} / 1e3), '\\.0$', '') || 'K'
  ELSE CAST({n} AS VARCHAR) END"""

MONEY = """CASE WHEN {v} >= 100 THEN '$' || printf('%.0f', {v}) WHEN {v} >= 1 THEN '$' || printf('%.2f', {v})
  WHEN {v} > 0 THEN '$' || printf('%.3f', {v}) ELSE '$0' END"""


def humanize(n: str) -> str:
    return HUMANIZE.format(n=n)


def money(v: str) -> str:
    return MONEY.format(v=v)


def ts(text: str) -> str:
    return f"TIMESTAMP '{text}'"


def lines_cte(by: str, where: str = "TRUE", exact: bool = False) -> str:
    """priced_rows(...) plus 'lines' (the report lines; ``exact``: costs unrounded)."""
    return f"""{priced_rows(by, where)},
lines AS (SELECT key, {LINE_EXACT if exact else LINE_SELECT} FROM pr GROUP BY key)"""


def model_grain_sql(by: str, where: str = "TRUE") -> str:
    return f"""WITH {USAGE_CTE.strip()},
km AS (SELECT {DIMS[by]} AS key, COALESCE(model, 'unknown') AS model, {MEASURES}
       FROM usage WHERE {where} GROUP BY 1, 2)
SELECT key, model, input, output, cache_read, cache_write, reasoning, events, ROUND(raw_cost, 6) AS raw_cost,
       n_raw > 0 AS has_raw_cost, est_input, est_output, est_cache_read, est_cache_write, est_reasoning, est_events
FROM km"""


def session_rows_cte() -> str:
    return f"""WITH {USAGE_CTE.strip()},
{RATES_CTE.strip()},
sm AS (
  SELECT session_id, source, COALESCE(model, '') AS model, MAX(COALESCE(project, '')) AS project, {MEASURES},
         MIN(ts) AS first_ts, MAX(ts) AS last_ts
  FROM usage WHERE session_id IS NOT NULL AND session_id <> '' GROUP BY 1, 2, 3
),
pr AS (SELECT {PRICED_SELECT} FROM sm a LEFT JOIN rates r ON a.model = r.model),
sess AS (
  SELECT session_id, source, arg_min(project, model) AS project, COUNT(*) AS models,
    CAST(SUM(input) AS BIGINT) AS input, CAST(SUM(output) AS BIGINT) AS output,
    CAST(SUM(cache_read) AS BIGINT) AS cache_read, CAST(SUM(cache_write) AS BIGINT) AS cache_write,
    CAST(SUM(reasoning) AS BIGINT) AS reasoning,
    CAST(SUM(input) + SUM(output) + SUM(cache_read) + SUM(cache_write) + SUM(reasoning) AS BIGINT) AS total,
    CAST(SUM(events) AS BIGINT) AS events, SUM(cost) AS cost,
    CAST(SUM(CASE WHEN priced THEN 0 ELSE est_events END) AS BIGINT) AS unpriced_events,
    MIN(first_ts) AS first_ts, MAX(last_ts) AS last_ts,
    date_diff('second', MIN(first_ts), MAX(last_ts)) AS duration_s
  FROM pr GROUP BY 1, 2
)"""


# Per-event cost (linear form of the pricing policy): the reported cost when
# present, otherwise tokens x rates when the model has a price, otherwise 0.
EVENT_COST_CTE = """
ec AS (
  SELECT u.ts, COALESCE(u.raw_cost, CASE WHEN r.price_key IS NOT NULL THEN
      u.input * r.input_rate + u.output * r.output_rate + u.cache_read * r.cache_read_rate
      + u.cache_write * r.cache_write_rate + u.reasoning * r.reasoning_rate ELSE 0.0 END) AS cost
  FROM usage u LEFT JOIN rates r ON COALESCE(u.model, 'unknown') = r.model
)"""


def event_cost_cte() -> str:
    return f"""WITH {USAGE_CTE.strip()},
{RATES_CTE.strip()},
{EVENT_COST_CTE.strip()}"""


# Expected normalised form and candidate spellings of each
# derived model name, written out by hand.
NORM_VALUES = """
  ('claude-sonnet-4-5', 'claude-sonnet-4-5'), ('claude-opus-4-1-20250805', 'claude-opus-4-1'),
  ('gemini-2.5-pro', 'gemini-2.5-pro'), ('claude-3.5-haiku', 'claude-3.5-haiku'), ('gpt-4-1', 'gpt-4-1'),
  ('gpt-4o-latest', 'gpt-4o'), ('GPT-5-Mini', 'gpt-5-mini'), ('gpt-5', 'gpt-5'),
  ('openrouter/anthropic/claude-sonnet-4-5', 'openrouter/anthropic/claude-sonnet-4-5'), ('grok-4', 'grok-4'),
  ('mystery-model-9', 'mystery-model-9'), ('', '')"""

# The sample price list by normalised name (its keys' normal forms, written out by hand).
NORM_INDEX_VALUES = """
  ('anthropic/claude-sonnet-4-5', 'anthropic/claude-sonnet-4-5'), ('claude-3-5-haiku', 'claude-3-5-haiku'),
  ('claude-opus-4-1', 'claude-opus-4-1'), ('claude-sonnet-4-5', 'claude-sonnet-4-5'),
  ('gemini/gemini-2.5-pro', 'gemini/gemini-2.5-pro'), ('gpt-4.1', 'gpt-4.1'), ('gpt-4o', 'gpt-4o'),
  ('gpt-5-mini', 'gpt-5-mini'), ('grok-4', 'grok-4-latest'), ('openai/gpt-5', 'openai/gpt-5'),
  ('vertex_ai/gemini-2.5-pro', 'vertex_ai/gemini-2.5-pro')"""

CANDIDATE_VALUES = """
  ('claude-sonnet-4-5', 0, 'claude-sonnet-4-5'), ('claude-sonnet-4-5', 1, 'anthropic/claude-sonnet-4-5'),
  ('claude-sonnet-4-5', 2, 'openai/claude-sonnet-4-5'), ('claude-sonnet-4-5', 3, 'gemini/claude-sonnet-4-5'),
  ('claude-sonnet-4-5', 4, 'vertex_ai/claude-sonnet-4-5'), ('claude-sonnet-4-5', 5, 'openrouter/claude-sonnet-4-5'),
  ('claude-sonnet-4-5', 6, 'claude-sonnet-4.5'),
  ('claude-opus-4-1-20250805', 0, 'claude-opus-4-1-20250805'),
  ('claude-opus-4-1-20250805', 1, 'anthropic/claude-opus-4-1-20250805'),
  ('claude-opus-4-1-20250805', 2, 'openai/claude-opus-4-1-20250805'),
  ('claude-opus-4-1-20250805', 3, 'gemini/claude-opus-4-1-20250805'),
  ('claude-opus-4-1-20250805', 4, 'vertex_ai/claude-opus-4-1-20250805'),
  ('claude-opus-4-1-20250805', 5, 'openrouter/claude-opus-4-1-20250805'),
  ('claude-opus-4-1-20250805', 6, 'claude-opus-4-1.20250805'),
  ('gemini-2.5-pro', 0, 'gemini-2.5-pro'), ('gemini-2.5-pro', 1, 'anthropic/gemini-2.5-pro'),
  ('gemini-2.5-pro', 2, 'openai/gemini-2.5-pro'), ('gemini-2.5-pro', 3, 'gemini/gemini-2.5-pro'),
  ('gemini-2.5-pro', 4, 'vertex_ai/gemini-2.5-pro'), ('gemini-2.5-pro', 5, 'openrouter/gemini-2.5-pro'),
  ('gemini-2.5-pro', 6, 'gemini-2-5-pro'),
  ('claude-3.5-haiku', 0, 'claude-3.5-haiku'), ('claude-3.5-haiku', 1, 'anthropic/claude-3.5-haiku'),
  ('claude-3.5-haiku', 2, 'openai/claude-3.5-haiku'), ('claude-3.5-haiku', 3, 'gemini/claude-3.5-haiku'),
  ('claude-3.5-haiku', 4, 'vertex_ai/claude-3.5-haiku'), ('claude-3.5-haiku', 5, 'openrouter/claude-3.5-haiku'),
  ('claude-3.5-haiku', 6, 'claude-3-5-haiku'),
  ('gpt-4-1', 0, 'gpt-4-1'), ('gpt-4-1', 1, 'anthropic/gpt-4-1'), ('gpt-4-1', 2, 'openai/gpt-4-1'),
  ('gpt-4-1', 3, 'gemini/gpt-4-1'), ('gpt-4-1', 4, 'vertex_ai/gpt-4-1'), ('gpt-4-1', 5, 'openrouter/gpt-4-1'),
  ('gpt-4-1', 6, 'gpt-4.1'),
  ('gpt-4o-latest', 0, 'gpt-4o-latest'), ('gpt-4o-latest', 1, 'anthropic/gpt-4o-latest'),
  ('gpt-4o-latest', 2, 'openai/gpt-4o-latest'), ('gpt-4o-latest', 3, 'gemini/gpt-4o-latest'),
  ('gpt-4o-latest', 4, 'vertex_ai/gpt-4o-latest'), ('gpt-4o-latest', 5, 'openrouter/gpt-4o-latest'),
  ('GPT-5-Mini', 0, 'GPT-5-Mini'), ('GPT-5-Mini', 1, 'gpt-5-mini'), ('GPT-5-Mini', 2, 'anthropic/GPT-5-Mini'),
  ('GPT-5-Mini', 3, 'openai/GPT-5-Mini'), ('GPT-5-Mini', 4, 'gemini/GPT-5-Mini'),
  ('GPT-5-Mini', 5, 'vertex_ai/GPT-5-Mini'), ('GPT-5-Mini', 6, 'openrouter/GPT-5-Mini'),
  ('gpt-5', 0, 'gpt-5'), ('gpt-5', 1, 'anthropic/gpt-5'), ('gpt-5', 2, 'openai/gpt-5'), ('gpt-5', 3, 'gemini/gpt-5'),
  ('gpt-5', 4, 'vertex_ai/gpt-5'), ('gpt-5', 5, 'openrouter/gpt-5'),
  ('openrouter/anthropic/claude-sonnet-4-5', 0, 'openrouter/anthropic/claude-sonnet-4-5'),
  ('openrouter/anthropic/claude-sonnet-4-5', 1, 'anthropic/claude-sonnet-4-5'),
  ('openrouter/anthropic/claude-sonnet-4-5', 2, 'claude-sonnet-4-5'),
  ('openrouter/anthropic/claude-sonnet-4-5', 3, 'openrouter/anthropic/claude-sonnet-4.5'),
  ('grok-4', 0, 'grok-4'), ('grok-4', 1, 'anthropic/grok-4'), ('grok-4', 2, 'openai/grok-4'),
  ('grok-4', 3, 'gemini/grok-4'), ('grok-4', 4, 'vertex_ai/grok-4'), ('grok-4', 5, 'openrouter/grok-4'),
  ('mystery-model-9', 0, 'mystery-model-9'), ('mystery-model-9', 1, 'anthropic/mystery-model-9'),
  ('mystery-model-9', 2, 'openai/mystery-model-9'), ('mystery-model-9', 3, 'gemini/mystery-model-9'),
  ('mystery-model-9', 4, 'vertex_ai/mystery-model-9'), ('mystery-model-9', 5, 'openrouter/mystery-model-9')"""


def day_series_cte(first_day: str, days: int) -> str:
    return f"""cal AS (
  SELECT CAST(i AS INTEGER) AS i, strftime(DATE '{first_day}' + CAST(i AS INTEGER), '%Y-%m-%d') AS day
  FROM range({days}) t(i)
),
tot AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, SUM(input + output + cache_read + cache_write + reasoning) AS total
  FROM usage WHERE ts >= TIMESTAMP '{first_day} 00:00:00' GROUP BY 1
),
series AS (SELECT cal.i, cal.day, CAST(COALESCE(tot.total, 0) AS BIGINT) AS total FROM cal LEFT JOIN tot USING (day))"""


def statements() -> dict[str, str]:
    w7 = ts("2024-01-24 12:00:00")
    out = {
        "report_tool": report_sql("tool"),
        "report_model": report_sql("model"),
        "report_day": report_sql("day"),
        "report_project": report_sql("project"),
        "report_session": report_sql("session"),
        "report_total": report_total_sql("tool"),
        "report_model_by_cost": report_sql("model"),
        "usage_window": report_sql("tool", f"ts >= {w7} AND ts < {ts('2024-01-30 12:00:00')}"),
        "usage_by_model_one_source": report_sql("model", "source = 'codex'"),
        "agg_tool_model": model_grain_sql("tool"),
        "agg_day_model": model_grain_sql("day"),
        "raw_est_split": model_grain_sql("model"),
        "daily_from": report_sql("day", f"ts >= {ts('2024-01-20 00:00:00')}"),
    }
    out["session_model"] = f"""{session_rows_cte()}
SELECT session_id, source, model, project, input, output, cache_read, cache_write, reasoning, events,
       ROUND(raw_cost, 6) AS raw_cost, est_events, ROUND(cost, 6) AS cost,
       CAST(CASE WHEN priced THEN 0 ELSE est_events END AS BIGINT) AS unpriced_events, first_ts, last_ts
FROM pr"""
    out["sessions"] = f"""{session_rows_cte()}
SELECT * REPLACE (ROUND(cost, 6) AS cost) FROM sess"""
    out["sessions_total"] = f"""{session_rows_cte()}
SELECT COUNT(*) AS sessions, CAST(COALESCE(SUM(total), 0) AS BIGINT) AS total,
       CAST(COALESCE(SUM(events), 0) AS BIGINT) AS events, ROUND(COALESCE(SUM(cost), 0.0), 6) AS cost,
       CAST(COALESCE(SUM(unpriced_events), 0) AS BIGINT) AS unpriced_events
FROM sess"""
    out["sessions_display"] = f"""{session_rows_cte()}
SELECT CASE WHEN length(session_id) <= 13 THEN session_id ELSE substr(session_id, 1, 12) || '…' END AS session, source,
  {humanize("total")} AS tokens,
  CASE WHEN cost = 0 AND unpriced_events > 0 THEN '-*' WHEN unpriced_events > 0 THEN {money("cost")} || '*'
       ELSE {money("cost")} END AS cost,
  events, models,
  CASE WHEN duration_s < 60 THEN duration_s || 's'
       WHEN duration_s < 3600 THEN (duration_s // 60) || 'm' || (duration_s % 60) || 's'
       ELSE (duration_s // 3600) || 'h' || (duration_s % 3600 // 60) || 'm' || (duration_s % 60) || 's' END AS duration,
  CASE WHEN project = '' THEN '(unknown)' WHEN len(string_split(rtrim(project, '/'), '/')) <= 3 THEN project
       ELSE '.../' || array_to_string(string_split(rtrim(project, '/'), '/')[-2:], '/') END AS project
FROM (SELECT * REPLACE (ROUND(cost, 6) AS cost) FROM sess)"""
    out["sessions_json"] = f"""{session_rows_cte()}
SELECT session_id, source, project, models, input, output, cache_read, cache_write, reasoning, total, events,
  ROUND(cost, 6) AS cost, NULLIF(unpriced_events, 0) AS unpriced_events,
  strftime(first_ts, '%Y-%m-%dT%H:%M:%SZ') AS first_ts, strftime(last_ts, '%Y-%m-%dT%H:%M:%SZ') AS last_ts,
  CAST(duration_s * 1000000000 AS BIGINT) AS duration
FROM sess"""
    out["sessions_order"] = f"""{session_rows_cte()}
SELECT session_id, source, ROW_NUMBER() OVER (ORDER BY last_ts DESC, session_id, source) AS place FROM sess"""
    out["dashboard_tools"] = f"""WITH {USAGE_CTE.strip()}
SELECT source, ROW_NUMBER() OVER (ORDER BY source) AS place FROM (SELECT DISTINCT source FROM usage)"""
    out["dashboard_lines"] = " UNION ALL ".join(
        f"SELECT *, '{by}' AS panel FROM ({report_sql(by, 'TRUE' if by == 'day' else f'ts >= {w7}')})"
        for by in ("tool", "model", "project", "day"))
    out["export_json"] = f"""{lines_cte("model")}
SELECT key, input, output, cache_read, cache_write, reasoning, total, events, NULLIF(raw_cost, 0.0) AS raw_cost, cost,
  NULLIF(unpriced_events, 0) AS unpriced_events
FROM lines"""
    out["session_unpriced"] = f"""{session_rows_cte()}
SELECT DISTINCT model FROM pr WHERE NOT priced AND est_events > 0"""
    for key, by, order in (("tool", "tool", "total DESC, key"), ("day", "day", "key"),
                           ("cost", "model", "cost DESC, total DESC, key")):
        out[f"report_order_{key}"] = f"""{lines_cte(by)}
SELECT key, ROW_NUMBER() OVER (ORDER BY {order}) AS place FROM lines"""
    out["tail_lines"] = """WITH l AS (
  SELECT '/u' || user_id || '.jsonl' AS path, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ln,
    count(*) OVER (PARTITION BY user_id) - 1 AS last, '{"event":' || event_id || ',"type":"' || event_type || '"}' AS whole
  FROM events
),
t AS (SELECT *, CASE WHEN ln = last AND user_id % 4 = 3 THEN substr(whole, 1, 8) ELSE whole END AS line FROM l),
o AS (SELECT *, COALESCE(SUM(strlen(line) + 1) OVER (PARTITION BY path ORDER BY ln
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_off FROM t)
SELECT path, ln, CAST(byte_off AS BIGINT) AS byte_off, line FROM o
WHERE ln >= last / 2.0 AND NOT (ln = last AND user_id % 4 = 3)"""
    out["source_stats"] = f"""WITH {USAGE_CTE.strip()}
SELECT source, COUNT(*) AS events, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM usage GROUP BY source"""
    out["earliest_event"] = f"""WITH {USAGE_CTE.strip()}
SELECT MIN(ts) AS earliest_ts FROM usage"""
    out["unpriced_models"] = f"""{priced_rows("model")}
SELECT DISTINCT model FROM pr WHERE NOT priced AND est_events > 0"""
    out["price_resolve"] = f"""WITH {USAGE_CTE.strip()},
{RATES_CTE.strip()},
m AS (SELECT DISTINCT COALESCE(model, 'unknown') AS model FROM usage)
SELECT m.model, r.price_key FROM m LEFT JOIN rates r ON m.model = r.model"""
    out["price_norm_index"] = f"""WITH {USAGE_CTE.strip()},
expected(model, norm) AS (VALUES {NORM_VALUES.strip()}),
idx(norm, price_key) AS (VALUES {NORM_INDEX_VALUES.strip()}),
m AS (SELECT DISTINCT COALESCE(model, 'unknown') AS model FROM usage)
SELECT m.model, e.norm, idx.price_key AS norm_key
FROM m JOIN expected e ON m.model = e.model LEFT JOIN idx ON idx.norm = e.norm"""
    out["price_candidates"] = f"""WITH {USAGE_CTE.strip()},
expected(model, ord, cand) AS (VALUES {CANDIDATE_VALUES.strip()}),
m AS (SELECT DISTINCT COALESCE(model, 'unknown') AS model FROM usage)
SELECT m.model, CAST(e.ord AS INTEGER) AS ord, e.cand FROM m JOIN expected e ON m.model = e.model"""
    out["price_rows"] = f"""{priced_rows("tool")}
SELECT key, model, events, est_events, n_raw, price_key, ROUND(cost, 6) AS cost, priced,
       CAST(CASE WHEN priced THEN 0 ELSE est_events END AS BIGINT) AS unpriced_events
FROM pr"""
    out["statusline"] = f"""{lines_cte("tool", f"ts >= {ts('2024-01-28 12:00:00')}", exact=True)},
agg AS (
  SELECT ROUND(COALESCE(SUM(cost), 0.0), 6) AS cost, COUNT(*) AS tools, CAST(COALESCE(SUM(total), 0) AS BIGINT) AS total,
         CAST(COALESCE(SUM(events), 0) AS BIGINT) AS events, COALESCE(BOOL_OR(unpriced_events > 0), false) AS has_unpriced
  FROM lines
)
SELECT cost, tools, total, events, has_unpriced,
  CASE WHEN tools = 0 THEN 'no data' ELSE
    printf('%s%s  ·  %d tools  ·  %s tok  ·  %d events', {money("cost")},
           CASE WHEN has_unpriced THEN '*' ELSE '' END, tools, {humanize("total")}, events) END AS text
FROM agg"""
    out["efficiency"] = f"""{lines_cte("tool", f"ts >= {w7}", exact=True)},
agg AS (SELECT CAST(COALESCE(SUM(total), 0) AS BIGINT) AS total_tokens, COALESCE(SUM(cost), 0.0) AS cost,
               CAST(COALESCE(SUM(cache_read), 0) AS BIGINT) AS cache_read FROM lines),
r AS (SELECT *, CASE WHEN total_tokens > 0 THEN cache_read / CAST(total_tokens AS DOUBLE) ELSE 0.0 END AS rate FROM agg)
SELECT total_tokens, ROUND(cost, 6) AS total_cost,
  ROUND(CASE WHEN total_tokens > 0 THEN cost / CAST(total_tokens AS DOUBLE) * 1e6 ELSE 0.0 END, 6) AS cost_per_mtok,
  ROUND(rate, 6) AS cache_hit_rate,
  CASE WHEN rate > 0.1 THEN 'saving' WHEN rate > 0 THEN 'low' ELSE '' END AS verdict
FROM r"""
    for key, prev_cond in (("compare_periods", f"ts >= {ts('2024-01-17 12:00:00')}"),
                           ("compare_disjoint", f"ts >= {ts('2024-01-17 12:00:00')} AND ts < {w7}")):
        out[key] = f"""{event_cost_cte()},
c AS (SELECT COALESCE(SUM(CASE WHEN ts >= {w7} THEN cost END), 0.0) AS cur,
             COALESCE(SUM(CASE WHEN {prev_cond} THEN cost END), 0.0) AS prev FROM ec),
d AS (SELECT *, CASE WHEN prev > 0 THEN (cur - prev) / prev * 100 ELSE 0.0 END AS change FROM c)
SELECT ROUND(cur, 6) AS current, ROUND(prev, 6) AS previous, ROUND(change, 6) AS change_pct,
  CASE WHEN change > 20 THEN 'increase' WHEN change < -20 THEN 'decrease' ELSE '' END AS band,
  '2024-01-24' AS period, '2024-01-17' AS prev_text
FROM d"""
    cards = []
    for name, start in (("today", "2024-01-31"), ("7d", "2024-01-24"), ("30d", "2024-01-01"), ("all", "0001-01-01")):
        cards.append(f"""SELECT '{name}' AS card, '{start}' AS start_day,
  CAST(COALESCE(SUM(CASE WHEN key >= '{start}' THEN total END), 0) AS BIGINT) AS total,
  ROUND(COALESCE(SUM(CASE WHEN key >= '{start}' THEN cost END), 0.0), 6) AS cost,
  COALESCE(BOOL_OR(CASE WHEN key >= '{start}' THEN unpriced_events > 0 END), false) AS unpriced
FROM lines""")
    out["summary_cards"] = lines_cte("day", exact=True) + "\n" + "\nUNION ALL\n".join(cards)
    out["insights"] = f"""{lines_cte("tool")},
mods AS (
  SELECT COUNT(DISTINCT a.model) AS n FROM (
    SELECT COALESCE(model, 'unknown') AS model, COUNT(raw_cost) AS n_raw, COUNT(CASE WHEN raw_cost IS NULL THEN 1 END) AS est_events
    FROM usage GROUP BY 1) a LEFT JOIN rates r ON a.model = r.model
  WHERE r.price_key IS NULL AND a.est_events > 0
),
top AS (SELECT key, total FROM lines ORDER BY total DESC, key LIMIT 1),
agg AS (SELECT SUM(total) AS all_total, SUM(cache_read) AS cache_read, COUNT(*) AS tools FROM lines)
SELECT CASE WHEN top.total > 0 THEN top.key END AS top_tool, CAST(top.total AS BIGINT) AS top_total,
  CASE WHEN agg.tools > 1 AND top.total > 0 THEN ROUND(CAST(top.total AS DOUBLE) / CAST(agg.all_total AS DOUBLE) * 100, 6) END AS share_pct,
  CAST(mods.n AS BIGINT) AS unpriced_models,
  CASE WHEN agg.all_total > 0 AND CAST(agg.cache_read AS DOUBLE) / CAST(agg.all_total AS DOUBLE) > 0.01
       THEN ROUND(CAST(agg.cache_read AS DOUBLE) / CAST(agg.all_total AS DOUBLE) * 100, 6) END AS cache_pct
FROM top, agg, mods"""
    out["cost_hint"] = f"""{lines_cte("model", exact=True)},
top AS (SELECT key, cost FROM lines ORDER BY cost DESC, key LIMIT 1),
agg AS (SELECT SUM(input) AS input FROM lines),
h AS (
  SELECT CASE WHEN top.cost > 0 THEN top.key END AS top_key, ROUND(top.cost, 6) AS top_cost, agg.input FROM top, agg
),
t AS (
  SELECT top_key, top_cost, concat_ws('; ',
    CASE WHEN contains(top_key, 'Pro') OR contains(top_key, 'Opus')
         THEN 'consider ' || replace(top_key, 'Pro', 'Haiku') || ' for simpler tasks' END,
    CASE WHEN input > 10000000 THEN 'batch requests or use smaller context windows' END) AS hint
  FROM h
)
SELECT top_key, top_cost, NULLIF(hint, '') AS hint FROM t"""
    out["run_rate"] = f"""{lines_cte("tool", f"ts >= {w7}", exact=True)},
agg AS (SELECT COALESCE(SUM(cost), 0.0) AS c FROM lines)
SELECT ROUND(c, 6) AS cost, CAST(168.0 AS DOUBLE) AS hours,
  ROUND(c / CAST(168.0 AS DOUBLE) * 24 * 30, 6) AS monthly, (c / CAST(168.0 AS DOUBLE) * 24 * 30) > c AS rising
FROM agg"""
    rows = []
    for spec, bound, period, budget in (("today", "2024-01-31 00:00:00", "daily", "5.0"),
                                        ("24h", "2024-01-30 12:00:00", "monthly", "100.0"),
                                        ("7d", "2024-01-24 12:00:00", "monthly", "100.0"),
                                        ("30d", "2024-01-01 12:00:00", "weekly", "25.0")):
        rows.append(f"""SELECT '{spec}' AS spec, '{period}' AS period, COALESCE(SUM(CASE WHEN ts >= {ts(bound)} THEN cost END), 0.0) AS c,
  CAST({budget} AS DOUBLE) AS budget FROM ec""")
    out["budget_check"] = f"""{event_cost_cte()},
b AS ({" UNION ALL ".join(rows)})
SELECT spec, period, ROUND(c, 6) AS cost, budget, c > budget AS exceeded, ROUND(c / budget * 100, 6) AS pct FROM b"""
    out["top_models"] = f"""{lines_cte("model", exact=True)}
SELECT (SELECT key FROM lines ORDER BY total DESC, key LIMIT 1) AS top_by_tokens,
       (SELECT MAX(total) FROM lines) AS tokens,
       (SELECT key FROM lines ORDER BY cost DESC, key LIMIT 1) AS top_by_cost,
       (SELECT ROUND(MAX(cost), 6) FROM lines) AS cost"""
    out["tool_status"] = f"""WITH {USAGE_CTE.strip()},
known(tool) AS (VALUES ('antigravity'), ('claude-code'), ('codex'), ('opencode')),
st AS (SELECT source, COUNT(*) AS events, MIN(ts) AS first_ts, MAX(ts) AS last_ts FROM usage GROUP BY source)
SELECT k.tool, k.tool = 'claude-code' AS detected, CAST(COALESCE(st.events, 0) AS BIGINT) AS events,
       st.first_ts, st.last_ts
FROM known k LEFT JOIN st ON k.tool = st.source"""
    out["trend_30d"] = f"""WITH {USAGE_CTE.strip()},
{day_series_cte("2024-01-02", 30)},
m AS (SELECT MAX(total) AS peak FROM series)
SELECT i, day, total, CAST(CASE WHEN peak = 0 THEN 0
    WHEN total > 0 AND floor(CAST(total AS DOUBLE) / CAST(peak AS DOUBLE) * 56.0) = 0 THEN 1
    ELSE floor(CAST(total AS DOUBLE) / CAST(peak AS DOUBLE) * 56.0) END AS INTEGER) AS level
FROM series, m"""
    out["streak_days"] = f"""WITH {USAGE_CTE.strip()},
{day_series_cte("2023-10-05", 119)}
SELECT i, day, total FROM series"""
    out["streak_stats"] = f"""WITH {USAGE_CTE.strip()},
{day_series_cte("2023-10-05", 119)},
marked AS (
  SELECT i, total, CASE WHEN total > 0 THEN 1 ELSE 0 END AS active,
         SUM(CASE WHEN total > 0 THEN 0 ELSE 1 END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS island
  FROM series
),
runs AS (SELECT island, COUNT(*) AS run FROM marked WHERE active = 1 GROUP BY island),
last AS (SELECT MAX(island) AS li FROM marked)
SELECT COUNT(*) AS days, CAST(SUM(active) AS BIGINT) AS active_days,
  CAST(floor(SUM(active) * 100 / COUNT(*)) AS BIGINT) AS active_pct,
  CAST((SELECT COALESCE(MAX(run), 0) FROM runs) AS BIGINT) AS longest,
  CAST((SELECT COALESCE(MAX(run), 0) FROM runs, last WHERE island = li) AS BIGINT) AS current,
  MAX(total) AS peak
FROM marked"""
    out["heatmap_grid"] = f"""WITH {USAGE_CTE.strip()},
{day_series_cte("2023-10-05", 119)},
m AS (SELECT MAX(total) AS peak FROM series),
p AS (SELECT isodow(DATE '2023-10-05') - 1 AS pad)
SELECT day, total, CAST((i + pad) % 7 AS INTEGER) AS row, CAST(floor((i + pad) / 7) AS INTEGER) AS col,
  CAST(CASE WHEN total = 0 THEN NULL ELSE LEAST(floor(CAST(total AS DOUBLE) / CAST(peak AS DOUBLE) * 3.0), 3) END
       AS INTEGER) AS intensity
FROM series, m, p"""
    out["share_of_max"] = f"""{lines_cte("tool")},
m AS (SELECT MAX(total) AS peak FROM lines)
SELECT lines.*, CASE WHEN peak > 0 THEN ROUND(CAST(total AS DOUBLE) / CAST(peak AS DOUBLE), 6) ELSE 0.0 END AS share
FROM lines, m"""
    out["fmt_report"] = f"""{lines_cte("model")}
SELECT key, {humanize("input")} AS input_text, {humanize("output")} AS output_text,
  {humanize("cache_read")} AS cache_read_text, {humanize("cache_write")} AS cache_write_text,
  {humanize("reasoning")} AS reasoning_text, {humanize("total")} AS total_text, events,
  CASE WHEN cost = 0 AND unpriced_events > 0 THEN '-*'
       WHEN unpriced_events > 0 THEN {money("cost")} || '*' ELSE {money("cost")} END AS cost_text
FROM lines"""
    out["short_project"] = f"""{lines_cte("project")}
SELECT key, CASE WHEN key = '' THEN '(unknown)'
  WHEN len(string_split(rtrim(key, '/'), '/')) <= 3 THEN key
  ELSE '.../' || array_to_string(string_split(rtrim(key, '/'), '/')[-2:], '/') END AS label, total
FROM lines"""
    bounds = [("since", "today", "2024-01-31 00:00:00"), ("since", "36h", "2024-01-30 00:00:00"),
              ("since", "2w", "2024-01-17 12:00:00"), ("since", "1m", "2023-12-31 12:00:00"),
              ("since", "2024-01-15", "2024-01-15 00:00:00"), ("since", "all", None),
              ("until", "2024-01-10", "2024-01-11 00:00:00"), ("until", "3d", "2024-01-28 12:00:00")]
    parts = []
    for kind, spec, b in bounds:
        if b is None:
            parts.append(f"SELECT '{kind}' AS kind, '{spec}' AS spec, CAST(NULL AS TIMESTAMP) AS bound, COUNT(*) AS events FROM usage")
        else:
            op = ">=" if kind == "since" else "<"
            parts.append(f"SELECT '{kind}' AS kind, '{spec}' AS spec, {ts(b)} AS bound, "
                         f"COUNT(CASE WHEN ts {op} {ts(b)} THEN 1 END) AS events FROM usage")
    out["since_bounds"] = f"""WITH {USAGE_CTE.strip()}
{" UNION ALL ".join(parts)}"""
    out.update(decoder_statements())
    out["counter_diff"] = f"""WITH {USAGE_CTE.strip()},
b AS (SELECT *, floor((dayofmonth(event_ts) - 1) / 7) AS week FROM usage),
c AS (
  SELECT *, MIN(week) OVER (PARTITION BY user_id) AS first_week, input + cache_read + output + reasoning AS own,
    ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_ts, event_id) AS place,
    SUM(input + cache_read + output + reasoning) OVER (PARTITION BY user_id, week ORDER BY event_ts, event_id
                                                      ROWS UNBOUNDED PRECEDING) AS cum_total
  FROM b
)
SELECT printf('/logs/codex/2024/01/01/rollout-2024-01-01T00-00-00-%08d-0000-4000-8000-%012d.jsonl', user_id, user_id) AS path,
  place * 100 + 3 AS ln, CASE WHEN user_id % 4 = 0 AND week >= 2 THEN 2 ELSE 1 END AS segment,
  CAST(cum_total - own AS BIGINT) AS prev_total, CAST(cum_total AS BIGINT) AS cur_total,
  input + cache_read AS delta_input_tokens, cache_read AS delta_cached_input_tokens,
  output + reasoning AS delta_output_tokens, reasoning AS delta_reasoning_output_tokens, own AS delta_total_tokens
FROM c WHERE event_id % 19 <> 0 AND (CASE WHEN user_id % 5 = 0 AND week > first_week THEN 'gpt-5' ELSE model END) <> ''"""
    out.update(load_statements(out))
    return out


def decoder_statements() -> dict[str, str]:
    u = f"WITH {USAGE_CTE.strip()}"
    out = {}
    out["decode_claude"] = f"""{u}
SELECT 'claude-code' AS source,
  CASE WHEN event_id % 10 = 0 THEN 'u' || CAST(event_id AS VARCHAR)
       WHEN event_id % 9 = 0 THEN 'msg_' || CAST(event_id AS VARCHAR)
       ELSE 'msg_' || CAST(event_id AS VARCHAR) || ':req_' || CAST(event_id AS VARCHAR) END AS dedup_key,
  ts, model, session_id, project, input, output, cache_read, cache_write, CAST(0 AS BIGINT) AS reasoning,
  CAST(NULL AS DOUBLE) AS raw_cost
FROM usage, (VALUES (1), (2)) AS copies(c)
WHERE model <> '' AND (c = 1 OR event_id % 7 = 0)"""
    out["decode_codex"] = f"""{u},
b AS (SELECT *, floor((dayofmonth(event_ts) - 1) / 7) AS week FROM usage),
c AS (
  SELECT *, MIN(week) OVER (PARTITION BY user_id) AS first_week,
    SUM(input + cache_read + output + reasoning) OVER (PARTITION BY user_id, week ORDER BY event_ts, event_id
                                                      ROWS UNBOUNDED PRECEDING) AS cum_total,
    strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts_text
  FROM b
),
d AS (
  SELECT *, CASE WHEN user_id % 5 = 0 AND week > first_week THEN 'gpt-5' ELSE model END AS m,
    CASE WHEN user_id % 4 = 0 AND week >= 2 THEN 'sid-b-' || CAST(user_id AS VARCHAR)
         WHEN user_id % 3 = 0 THEN printf('%08d-0000-4000-8000-%012d', user_id, user_id)
         ELSE 'sid-a-' || CAST(user_id AS VARCHAR) END AS sid
  FROM c
),
ok AS (SELECT * FROM d WHERE m <> '' AND event_id % 19 <> 0),
fb AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_ts, event_id) - 1 AS seq
  FROM ok WHERE event_id % 23 = 0
)
SELECT 'codex' AS source, sid || ':' || ts_text || ':' || CAST(cum_total AS VARCHAR) AS dedup_key, ts, m AS model,
  sid AS session_id, project, input, output, cache_read, CAST(0 AS BIGINT) AS cache_write, reasoning,
  CAST(NULL AS DOUBLE) AS raw_cost
FROM ok
UNION ALL
SELECT 'codex', sid || ':' || ts_text || ':' || CAST(cum_total + 12 AS VARCHAR) || ':' || CAST(seq AS VARCHAR), ts, m,
  sid, project, CAST(5 AS BIGINT), CAST(4 AS BIGINT), CAST(2 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT),
  CAST(NULL AS DOUBLE)
FROM fb"""
    out["decode_opencode"] = f"""{u}
SELECT 'opencode' AS source, 'msg_' || CAST(event_id AS VARCHAR) AS dedup_key, ts, model, session_id, project,
  input, output, cache_read, cache_write, reasoning,
  COALESCE(raw_cost, CASE WHEN event_id % 3 = 0 THEN CAST(0.0 AS DOUBLE) END) AS raw_cost
FROM usage WHERE model <> '' AND event_id % 11 <> 0 AND event_id % 13 <> 0"""
    out["cursor_advance"] = f"""{u},
r AS (
  SELECT '/opencode/db' || CAST(user_id % 7 AS VARCHAR) || '.db' AS path, CAST(floor(epoch_us(event_ts) / 1000) AS BIGINT) AS tc,
         event_id % 11 = 0 AS incomplete FROM usage
  UNION ALL
  SELECT '/opencode/db' || CAST(user_id % 7 AS VARCHAR) || '.db', CAST(floor(epoch_us(event_ts) / 1000) AS BIGINT) - 700, false
  FROM usage WHERE event_id % 5 = 0
),
a AS (
  SELECT path, MAX(tc) AS max_seen,
    MIN(CASE WHEN incomplete AND tc >= epoch_ms(TIMESTAMP '2024-01-30 12:00:00') THEN tc END) AS pinned
  FROM r GROUP BY path
)
SELECT path, CAST(0 AS BIGINT) AS cursor_ms, CAST(max_seen AS BIGINT) AS max_seen, CAST(pinned AS BIGINT) AS pinned,
  CAST(CASE WHEN pinned IS NOT NULL AND pinned < max_seen THEN pinned ELSE max_seen END AS BIGINT) AS next_cursor
FROM a"""
    ranked = f"""{u},
rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_ts, event_id) AS rn FROM usage)"""
    out["decode_antigravity"] = f"""{ranked}
SELECT 'antigravity' AS source,
  CASE WHEN event_id % 10 = 0 THEN 'u' || CAST(user_id AS VARCHAR) || ':' || CAST(rn * 4 AS VARCHAR)
       ELSE 'gen-' || CAST(event_id AS VARCHAR) END AS dedup_key,
  ts, CASE WHEN user_id % 12 = 11 THEN 'antigravity-9999' ELSE model END AS model,
  'u' || CAST(user_id AS VARCHAR) AS session_id, project, input, output, cache_read,
  CAST(0 AS BIGINT) AS cache_write, CAST(0 AS BIGINT) AS reasoning, CAST(NULL AS DOUBLE) AS raw_cost
FROM rk"""
    out["cursor_idx"] = f"""{ranked}
SELECT '/antigravity/conversations/u' || CAST(user_id AS VARCHAR) || '.db' AS path, CAST(0 AS BIGINT) AS last_idx,
  CAST(MAX(rn * 4 + CASE WHEN event_id % 17 = 0 THEN 3 WHEN event_id % 11 = 0 THEN 2
                         WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS next_idx
FROM rk GROUP BY user_id"""
    return out


def load_statements(dec: dict[str, str]) -> dict[str, str]:
    u = f"WITH {USAGE_CTE.strip()}"
    cols = ("source, dedup_key, ts, model, session_id, project, input, output, cache_read, cache_write, "
            "reasoning, raw_cost")
    out = {}
    out["dedup_first_wins"] = f"""{u}
SELECT {cols} FROM usage"""
    out["insert_ignore"] = f"""{u}
SELECT source, COUNT(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 1 END) AS first_load,
  COUNT(CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN 1 END) AS second_load, COUNT(*) AS total
FROM usage GROUP BY source"""
    files = f"""{u},
pu AS (
  SELECT '/logs/u' || CAST(user_id AS VARCHAR) AS path, user_id, COUNT(*) AS n, MAX(ts) AS mtime,
    COUNT(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 1 END) AS n_before,
    MAX(CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN ts END) AS mtime_before
  FROM usage GROUP BY user_id
),
plan AS (
  SELECT path, 'claude-code' AS source, n * 100 AS size, mtime,
    CASE WHEN n_before = 0 THEN 'new'
         WHEN n = n_before AND mtime = mtime_before THEN 'skip'
         WHEN user_id % 9 = 0 THEN 'reset' ELSE 'resume' END AS action,
    n_before, user_id
  FROM pu
)"""
    out["changed_files"] = f"""{files}
SELECT path, source, CAST(size AS BIGINT) AS size, mtime, action,
  CAST(CASE WHEN action = 'resume' THEN n_before * 100 ELSE 0 END AS BIGINT) AS offset,
  CASE WHEN action = 'resume' THEN '{{"n":' || CAST(n_before AS VARCHAR) || '}}' END AS state
FROM plan"""
    out["manifest_upsert"] = f"""{files}
SELECT path, source, CAST(size AS BIGINT) AS size, mtime, CAST(size AS BIGINT) AS offset,
  '{{"n":' || CAST(CAST(size / 100 AS BIGINT) AS VARCHAR) || '}}' AS state, TIMESTAMP '2024-01-31 12:00:00' AS updated_at
FROM plan WHERE action <> 'skip'
UNION ALL
SELECT path, source, CAST(n_before * 100 AS BIGINT), mtime_before,
  CAST(CASE WHEN user_id % 9 = 0 THEN n * 100 + 100 ELSE n_before * 100 END AS BIGINT),
  '{{"n":' || CAST(n_before AS VARCHAR) || '}}', TIMESTAMP '2024-01-15 00:00:00'
FROM (SELECT p.*, pu.n, pu.mtime_before FROM plan p JOIN pu USING (path)) WHERE action = 'skip'"""
    cut = "TIMESTAMP '2024-01-10 12:00:00'"
    out["prune_keep"] = f"""{u}
SELECT strftime(ts, '%Y-%m-%d') AS dt, source, COUNT(*) AS events, MIN(ts) AS first_ts
FROM usage WHERE ts >= {cut} GROUP BY 1, 2"""
    out["prune_deleted"] = f"""{u}
SELECT COUNT(CASE WHEN ts < {cut} THEN 1 END) AS deleted, COUNT(CASE WHEN ts >= {cut} THEN 1 END) AS remaining,
  MIN(CASE WHEN ts >= {cut} THEN ts END) AS earliest_ts
FROM usage"""
    union = f"""SELECT DISTINCT * FROM ({dec["decode_claude"]})
UNION ALL SELECT * FROM ({dec["decode_codex"]})
UNION ALL SELECT * FROM ({dec["decode_opencode"]})
UNION ALL SELECT * FROM ({dec["decode_antigravity"]})"""
    out["ingest_union"] = union
    out["load_summary"] = f"""WITH ev AS (SELECT * FROM events),
files AS (
  SELECT 'claude-code' AS source, COUNT(DISTINCT user_id) AS files FROM ev
  UNION ALL SELECT 'codex', COUNT(DISTINCT user_id) FROM ev
  UNION ALL SELECT 'opencode', COUNT(DISTINCT user_id % 7) FROM ev
  UNION ALL SELECT 'antigravity', COUNT(DISTINCT user_id) FROM ev
),
loaded AS (SELECT source, COUNT(*) AS n FROM ({union}) GROUP BY source)
SELECT f.source, CAST(f.files + CASE WHEN f.source = 'claude-code' THEN 1 ELSE 0 END AS BIGINT) AS files,
  CAST(COALESCE(l.n, 0) AS BIGINT) AS new_events,
  CAST(CASE WHEN f.source = 'claude-code' THEN 1 ELSE 0 END AS BIGINT) AS errors
FROM files f LEFT JOIN loaded l USING (source)"""
    out["load_all_sources"] = f"""WITH ev AS (SELECT * FROM events),
files AS (
  SELECT 'claude-code' AS source, COUNT(DISTINCT user_id) AS files, false AS tab FROM ev
  UNION ALL SELECT 'codex', COUNT(DISTINCT user_id), false FROM ev
  UNION ALL SELECT 'opencode', COUNT(DISTINCT user_id % 7), true FROM ev
  UNION ALL SELECT 'antigravity', COUNT(DISTINCT user_id), true FROM ev
),
loaded AS (SELECT source, COUNT(*) AS n FROM ({union}) GROUP BY source)
SELECT f.source, r.run, CAST(CASE WHEN r.run = 1 OR tab THEN f.files ELSE 0 END AS BIGINT) AS files,
  CAST(CASE WHEN r.run = 1 THEN COALESCE(l.n, 0) ELSE 0 END AS BIGINT) AS new_events, CAST(0 AS BIGINT) AS errors,
  CAST(CASE WHEN tab THEN f.files ELSE 0 END AS BIGINT) AS cursors
FROM files f LEFT JOIN loaded l USING (source), (VALUES (1), (2)) AS r(run)"""
    out["export_csv"] = f"""{lines_cte("project")}
SELECT key, CAST(input AS VARCHAR) AS input, CAST(output AS VARCHAR) AS output,
  CAST(cache_read AS VARCHAR) AS cache_read, CAST(cache_write AS VARCHAR) AS cache_write,
  CAST(reasoning AS VARCHAR) AS reasoning, CAST(total AS VARCHAR) AS total, CAST(events AS VARCHAR) AS events,
  printf('%.6f', cost) AS cost, CAST(unpriced_events AS VARCHAR) AS unpriced_events
FROM lines"""
    out["stream_ingest"] = f"SELECT DISTINCT * FROM ({dec['decode_claude']})"
    out["stream_dedup"] = out["stream_ingest"]
    out["stream_counter_diff"] = dec["decode_codex"]
    out["stream_daily"] = f"""{u}
SELECT strftime(ts, '%Y-%m-%d') AS day, source,
  CAST(SUM(input + output + cache_read + cache_write + reasoning) AS BIGINT) AS total, COUNT(*) AS events
FROM usage GROUP BY 1, 2"""
    out["incremental_load"] = f"""{u}
,
ln AS (
  SELECT '/logs/claude/projects/-home-u-p' || CAST(user_id % 6 AS VARCHAR) || '/u' || CAST(user_id AS VARCHAR) || '.jsonl' AS path,
    model, event_id * 10 AS first_ln,
    event_id * 10 + CASE WHEN event_id % 31 = 0 THEN 8 WHEN event_id % 29 = 0 THEN 7 WHEN event_id % 23 = 0 THEN 6
      WHEN event_id % 19 = 0 THEN 5 WHEN event_id % 13 = 0 THEN 4 WHEN event_id % 11 = 0 THEN 3
      WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS last_ln
  FROM usage
),
cut AS (SELECT *, MAX(last_ln) OVER (PARTITION BY path) AS last, MIN(path) OVER () AS least FROM ln)
SELECT 'claude-code' AS source, 1 AS run, COUNT(DISTINCT CASE WHEN first_ln * 2 <= last THEN path END) AS files,
  COUNT(CASE WHEN first_ln * 2 <= last AND model <> '' THEN 1 END) AS new_events, CAST(0 AS BIGINT) AS errors
FROM cut
UNION ALL
SELECT 'claude-code', 2, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
UNION ALL
SELECT 'claude-code', 3, COUNT(DISTINCT CASE WHEN last > 0 THEN path END),
  COUNT(CASE WHEN first_ln * 2 > last AND model <> '' AND path <> least THEN 1 END), CAST(1 AS BIGINT)
FROM cut"""
    seen = """CASE WHEN first_ln * 3 <= last THEN 1 WHEN first_ln * 3 <= 2 * last THEN 2
      WHEN user_id % 5 <> 0 OR first_ln * 10 > 9 * last THEN 3 END"""
    grown = f"""{u},
cut AS (
  SELECT *, MAX(last_ln) OVER (PARTITION BY user_id) AS last FROM (
    SELECT *, event_id * 10 AS first_ln,
      event_id * 10 + CASE WHEN event_id % 31 = 0 THEN 8 WHEN event_id % 29 = 0 THEN 7 WHEN event_id % 23 = 0 THEN 6
        WHEN event_id % 19 = 0 THEN 5 WHEN event_id % 13 = 0 THEN 4 WHEN event_id % 11 = 0 THEN 3
        WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS last_ln
    FROM usage)
)"""
    out["growing_files_load"] = f"""{grown}
SELECT 'claude-code' AS source, run, COUNT(CASE WHEN model <> '' AND run = {seen} THEN 1 END) AS new_events,
  CAST(0 AS BIGINT) AS errors
FROM cut, (SELECT unnest([1, 2, 3]) AS run) GROUP BY run"""
    out["stream_growing_files"] = f"""SELECT d.* FROM (SELECT DISTINCT * FROM ({dec['decode_claude']})) d
WHERE d.dedup_key NOT IN ({grown}
  SELECT k FROM (
    SELECT CASE WHEN event_id % 10 <> 0 AND event_id % 9 <> 0 THEN 'msg_' || event_id || ':req_' || event_id
      WHEN event_id % 10 <> 0 THEN 'msg_' || event_id ELSE 'u' || event_id END AS k FROM cut WHERE ({seen}) IS NULL))"""
    out["price_list"] = f"""{u},
{RATES_CTE.strip()}
SELECT DISTINCT r.model, r.price_key, r.input_rate, r.output_rate, r.cache_read_rate, r.cache_write_rate,
  r.reasoning_rate
FROM usage u JOIN rates r ON COALESCE(u.model, 'unknown') = r.model"""
    out["source_listing"] = """SELECT 'claude-code' AS source, COUNT(*) > 0 AS detected, COUNT(DISTINCT user_id) AS files
FROM events"""
    return out
