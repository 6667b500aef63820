"""Join helpers.

``checked_broadcast`` hints a broadcast only for a side proven small:
first by the optimizer's own size estimate of the side's plan (derived from
file sizes, no job runs), and when that estimate is unknown or above the
limit, by counting at most ``max_rows + 1`` rows (a bounded job). A side that
fails both checks is returned unhinted, so the join stays a shuffle join
(with AQE skew handling and runtime broadcast conversion).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits for small dimensions (price lists, tool lists, budget tables).
DIMENSION_BROADCAST_ROWS = 200_000
DIMENSION_BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer's size estimate of the DataFrame's plan, or None when unavailable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - Spark Connect or a plan without statistics
        return None


def fits(df: DataFrame, max_rows: int = DIMENSION_BROADCAST_ROWS,
         max_bytes: int = DIMENSION_BROADCAST_BYTES) -> bool:
    """Whether ``df`` is proven small; the answer is remembered on the DataFrame object
    (a DataFrame is immutable, and reused input handles then pay the check once)."""
    memo = df.__dict__.setdefault("_ledgerline_fits", {})
    if (max_rows, max_bytes) not in memo:
        size = estimated_bytes(df)
        ok = (size is not None and size <= max_bytes) or df.limit(max_rows + 1).count() <= max_rows
        memo[(max_rows, max_bytes)] = ok
    return memo[(max_rows, max_bytes)]


def checked_broadcast(df: DataFrame, max_rows: int = DIMENSION_BROADCAST_ROWS,
                      max_bytes: int = DIMENSION_BROADCAST_BYTES, proven: bool | None = None) -> DataFrame:
    """Broadcast-hinted ``df`` when small (``proven`` skips the check for a side derived from a checked one)."""
    ok = proven if proven is not None else fits(df, max_rows, max_bytes)
    return F.broadcast(df) if ok else df
