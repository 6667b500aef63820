"""Ranked price lookup and the row pricing policy.

Resolution of a model name to a price-list key, first hit wins:
  phase 0 - any candidate spelling equals a price key exactly;
  phase 1 - the normalised form of a candidate equals a normalised key
            (one key per normalised form: the shortest, then the smallest).
Within a phase the earlier candidate wins. An empty name never matches.

Spark plan: distinct model names -> posexplode(candidates) -> two equi-joins
against the (size-checked, broadcast) price list and its normalised index ->
``min_by(key, (phase, ord))`` per model. The result has one row per distinct
model and is joined back to model-grain aggregates, never to raw events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.names import candidates_sql, normalize_model, strip_space_sql
from ledgerline.operators.joins import checked_broadcast, fits
from ledgerline.schema import RATE_COLUMNS, TOKEN_CLASSES


def norm_index(prices: DataFrame) -> DataFrame:
    """(norm, key): one price key per normalised name, shortest key wins."""
    return prices.groupBy(normalize_model("key").alias("norm")).agg(
        F.expr("min_by(key, struct(octet_length(key), key)) AS key")
    )


def resolve_models(models: DataFrame, prices: DataFrame, small: bool | None = None) -> DataFrame:
    """(model, price_key) for every distinct ``model`` that resolves.

    One pass over the candidate spellings: each candidate probes the price
    keys (exact, phase 0) and the normalised index (phase 1) through two
    broadcast lookups; ``min_by(key, (phase, ord))`` keeps the first hit.
    ``small``: whether the price list was proven small (checked here when
    None); the key list and the index are derived from it and no larger.
    """
    small = fits(prices) if small is None else small
    trimmed = models.selectExpr("model", f"{strip_space_sql('model')} AS _m")
    cands = trimmed.selectExpr("model", f"posexplode({candidates_sql('model', '_m')}) AS (ord, cand)")
    keys = checked_broadcast(prices.select(F.col("key").alias("cand"), F.col("key").alias("exact_key")), proven=small)
    index = checked_broadcast(norm_index(prices).withColumnRenamed("key", "norm_key"), proven=small)
    probed = (
        cands.withColumn("norm", normalize_model("cand"))
        .join(keys, "cand", "left")
        .join(index, "norm", "left")
    )
    hits = ("explode(filter(array(named_struct('phase', 0, 'ord', ord, 'key', exact_key), "
            "named_struct('phase', 1, 'ord', ord, 'key', norm_key)), h -> h.key IS NOT NULL)) AS h")
    return (
        probed.selectExpr("model", hits)
        .groupBy("model")
        .agg(F.expr("min_by(h.key, struct(h.phase, h.ord)) AS price_key"))
    )


def model_rates(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, price_key, 5 effective rates) for those of the distinct ``models`` that resolve.

    The reasoning rate falls back to the output rate when it is 0.
    """
    small = fits(prices)
    resolved = resolve_models(models, prices, small)
    rates = checked_broadcast(prices, proven=small).withColumnRenamed("key", "price_key")
    joined = resolved.join(rates, "price_key")
    return joined.selectExpr(
        "model", "price_key", *[c for c in RATE_COLUMNS if c != "reasoning_rate"],
        "CASE WHEN reasoning_rate = 0 THEN output_rate ELSE reasoning_rate END AS reasoning_rate",
    )


def token_cost_sql(prefix: str = "") -> str:
    """SQL text: sum over the five token classes of tokens x rate (NULL when unpriced)."""
    return " + ".join(f"`{prefix}{cls}` * {rate}" for cls, rate in zip(TOKEN_CLASSES, RATE_COLUMNS))


def token_cost(prefix: str = "") -> Column:
    return F.expr(token_cost_sql(prefix))


def attach_rates(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Left-join effective rates onto model-grain rows (column ``model``).

    The rates side has one row per distinct model. No hint is given: its
    size is only known at runtime, where AQE converts the join to a
    broadcast after measuring it, or keeps a shuffle join otherwise.
    """
    # The distinct models come from the aggregate itself, not from a second scan
    # of the events: using all of its columns keeps both sides of the join the
    # same subplan, whose shuffle Spark computes once and reads twice.
    rest = F.xxhash64(*[c for c in rows.columns if c != "model"])
    models = rows.groupBy("model").agg(F.max(rest).alias("r")).where(F.col("r").isNotNull()).select("model")
    rates = model_rates(models, prices)
    return rows.join(rates, "model", "left")


def price_rows(rows: DataFrame) -> DataFrame:
    """Apply the 'reported cost wins' policy to rows carrying A1/A2 columns.

    Adds ``cost`` (raw cost plus the estimate of the not-reported part when a
    price exists; otherwise the estimate; 0 when neither) and ``priced`` /
    ``unpriced_events`` (estimated events left without a price).
    """
    est = token_cost_sql("est_")
    cost = (f"CASE WHEN n_raw > 0 THEN raw_cost + CASE WHEN est_events > 0 AND price_key IS NOT NULL "
            f"THEN {est} ELSE 0.0D END WHEN price_key IS NOT NULL THEN {est} ELSE 0.0D END AS cost")
    priced = ("CASE WHEN n_raw > 0 THEN est_events = 0 OR price_key IS NOT NULL "
              "ELSE price_key IS NOT NULL END AS priced")
    return rows.selectExpr("*", cost, priced).selectExpr(
        "*", "CASE WHEN priced THEN 0L ELSE est_events END AS unpriced_events")
