"""Model-name functions used by the ranked price lookup, as JVM-side Columns.

``normalize_model`` folds a name to its comparison form and
``model_candidates`` lists, in rank order, the spellings under which a
model may appear in a price list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lookup's provider prefixes, tried in this order for a
# name that has no "/" of its own; and the suffixes normalisation removes.
PROVIDER_PREFIXES = ["anthropic/", "openai/", "gemini/", "vertex_ai/", "openrouter/"]
DATE_SUFFIX = r"[-@]20\d{6}\z"
DROPPED_SUFFIXES = ["-latest", ":free", "-free"]
DASH_VERSION = r"(\d)-(\d+)\z"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _sql_quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_space_sql(name: str) -> str:
    """SQL text: trim leading/trailing whitespace of any kind (tabs, newlines too)."""
    return f"regexp_replace({name}, {_sql_quote(r'^\s+|\s+\z')}, '')"


def strip_space(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), r"^\s+|\s+\z", "")


def normalize_sql(name: str) -> str:
    """SQL text: lower-case, trimmed, without a date stamp, then each dropped suffix once."""
    n = f"lower({strip_space_sql(name)})"
    n = f"regexp_replace({n}, {_sql_quote(DATE_SUFFIX)}, '')"
    for suffix in DROPPED_SUFFIXES:
        n = f"regexp_replace({n}, {_sql_quote(_quote(suffix) + chr(92) + 'z')}, '')"
    return n


def normalize_model(col: Column | str) -> Column:
    """Lower-case, trimmed, without a date stamp, then each dropped suffix once."""
    if isinstance(col, str):
        return F.expr(normalize_sql(f"`{col}`"))
    n = F.lower(strip_space(col))
    n = F.regexp_replace(n, DATE_SUFFIX, "")
    for suffix in DROPPED_SUFFIXES:
        n = F.regexp_replace(n, F.lit(_quote(suffix) + r"\z"), "")
    return n


def _quote(s: str) -> str:
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in s)


def candidates_sql(raw: str, trimmed: str) -> str:
    """SQL text of ``model_candidates`` over column names ``raw`` and ``trimmed``."""
    m = trimmed
    parts = f"split({m}, '/', -1)"
    empty = "CAST(array() AS array<string>)"
    prefixes = ", ".join(_sql_quote(p) for p in PROVIDER_PREFIXES)
    dash = _sql_quote(DASH_VERSION)
    every = (
        f"concat(array({m}, lower({m})), "
        f"CASE WHEN size({parts}) > 1 THEN transform(sequence(2, size({parts})), "
        f"s -> array_join(slice({parts}, s, size({parts}) - s + 1), '/')) ELSE {empty} END, "
        f"CASE WHEN NOT contains({m}, '/') THEN transform(array({prefixes}), p -> concat(p, {m})) ELSE {empty} END, "
        f"CASE WHEN contains({m}, '.') THEN array(replace({m}, '.', '-')) ELSE {empty} END, "
        f"CASE WHEN {m} RLIKE {dash} THEN array(regexp_replace({m}, {dash}, '$1.$2')) ELSE {empty} END)"
    )
    return f"CASE WHEN {raw} = '' THEN {empty} ELSE array_distinct(filter({every}, x -> x != '')) END"


def model_candidates(col: str, trimmed: str | None = None) -> Column:
    """Ordered, distinct, non-empty spellings to try for a model name (column ``col``).

    Order: the trimmed name; its lower-case form; every suffix after a "/";
    provider-prefixed forms (only when the name has no "/"); the name with
    "." turned into "-"; and a trailing ``<digit>-<digits>`` turned into
    ``<digit>.<digits>``. An empty name has no candidates (it never matches).
    ``trimmed`` may name a column already holding the trimmed name.
    """
    m = f"`{trimmed}`" if trimmed else f"({strip_space_sql(f'`{col}`')})"
    return F.expr(candidates_sql(f"`{col}`", m))
