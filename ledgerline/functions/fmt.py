"""Presentation functions for report rows.

Number formatting needs round-half-even on the exact binary value of a
double (what ``%.1f`` does in C, Go and Python). Spark's ``format_string``
rounds half-up on the decimal text and ``format_number`` is off for some
small values, so the two numeric formatters are Arrow-batched pandas UDFs.
They run on final report rows only (one row per report key), never on
events. Everything else is plain Column arithmetic.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.timecols import _c


def _humanize_one(n) -> str | None:
    if n is None or pd.isna(n):
        return None
    n = int(n)
    for limit, unit in ((1_000_000_000, "B"), (1_000_000, "M"), (1_000, "K")):
        if n >= limit:
            text = "%.1f" % (n / float(limit))
            if text.endswith(".0"):
                text = text[:-2]
            return text + unit
    return str(n)


def _money_one(v) -> str | None:
    if v is None or pd.isna(v):
        return None
    v = float(v)
    if v >= 100:
        return "$%.0f" % v
    if v >= 1:
        return "$%.2f" % v
    if v > 0:
        return "$%.3f" % v
    return "$0"


@F.pandas_udf(T.StringType())
def humanize(n: pd.Series) -> pd.Series:
    """Token count as text: 1.2K, 3M, 4.5B (one decimal, '.0' dropped)."""
    return n.map(_humanize_one)


@F.pandas_udf(T.StringType())
def money(v: pd.Series) -> pd.Series:
    """USD as text: $123, $12.34, $0.123, $0."""
    return v.map(_money_one)


def cost_cell(cost: Column | str, unpriced_events: Column | str) -> Column:
    """'-*' when nothing is priced but events are unpriced; else money, '*' if partial."""
    c, u = _c(cost), _c(unpriced_events)
    return (
        F.when((c == 0) & (u > 0), F.lit("-*"))
        .when(u > 0, F.concat(money(c), F.lit("*")))
        .otherwise(money(c))
    )


def short_project(path: Column | str) -> Column:
    """'(unknown)' for ''; paths of <= 3 '/'-parts unchanged; else '.../a/b'."""
    p = _c(path)
    trimmed = F.regexp_replace(p, "/+$", "")
    parts = F.split(trimmed, "/", -1)
    return (
        F.when(p == F.lit(""), F.lit("(unknown)"))
        .when(F.size(parts) <= 3, p)
        .otherwise(F.concat(F.lit(".../"), F.substring_index(trimmed, "/", -2)))
    )


def truncate_text(s: Column | str, n: int) -> Column:
    """At most ``n`` characters, the last replaced by an ellipsis when cut."""
    t = _c(s)
    cut = F.lit("…") if n <= 1 else F.concat(F.substring(t, 1, n - 1), F.lit("…"))
    return F.when(F.char_length(t) <= n, t).otherwise(cut)


def duration_text(seconds: Column | str) -> Column:
    """Whole-second duration like 1h2m3s / 5m0s / 42s."""
    s = _c(seconds)
    h, m, sec = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm%ds", m, sec))
        .otherwise(F.format_string("%dh%dm%ds", h, m, sec))
    )

