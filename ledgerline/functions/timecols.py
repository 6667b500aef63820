"""Timestamp column helpers that do not depend on the session time zone.

All event instants are ``TIMESTAMP_NTZ`` values holding UTC wall-clock time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

# RFC 3339 date-time with a mandatory zone designator (Z or +hh:mm).
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Unix seconds of the years 1 to 9999.
LEAST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def epoch_seconds_to_ntz(secs: Column | str) -> Column:
    """Unix seconds -> UTC ``TIMESTAMP_NTZ``; NULL outside the years 1 to 9999 (one odd value never fails a job)."""
    s = _c(secs)
    inside = F.when(s.between(LEAST_SECOND, LAST_SECOND), s)
    return F.timestamp_add("SECOND", inside, F.expr(EPOCH_NTZ))


def epoch_millis_to_ntz(ms: Column | str) -> Column:
    """Unix milliseconds -> UTC ``TIMESTAMP_NTZ`` truncated to the second."""
    return epoch_seconds_to_ntz(F.floor(_c(ms) / F.lit(1000)))


def ntz_epoch_seconds(ts: Column | str) -> Column:
    """UTC ``TIMESTAMP_NTZ`` -> whole unix seconds (floor)."""
    return F.timestamp_diff("SECOND", F.expr(EPOCH_NTZ), _c(ts))


def trunc_second(ts: Column | str) -> Column:
    """Drop the sub-second part of a ``TIMESTAMP_NTZ``."""
    return epoch_seconds_to_ntz(ntz_epoch_seconds(ts))


def rfc3339_to_ntz(text: Column | str) -> Column:
    """Parse an RFC 3339 string to a UTC second-truncated ``TIMESTAMP_NTZ``.

    Strings without a zone designator (which Spark's parser would otherwise
    read in the session zone) and unparsable strings give NULL.
    """
    t = _c(text)
    secs = F.unix_seconds(F.try_to_timestamp(t))
    return F.when(t.rlike(RFC3339), epoch_seconds_to_ntz(secs))


def with_rfc3339(rows: DataFrame, text: Column | str, out: str) -> DataFrame:
    """``rows`` plus ``out``, the ``rfc3339_to_ntz`` of a string; each string is parsed once.

    The parse stands in a Generate: as a plain column it would be repeated for each mention of its
    seconds, and again in every filter on ``out``.
    """
    t = _c(text)
    secs = F.when(t.rlike(RFC3339), F.unix_seconds(F.try_to_timestamp(t)))
    found = rows.select("*", F.inline(F.array(F.struct(secs.alias("__secs")))))
    return found.withColumn(out, epoch_seconds_to_ntz("__secs")).drop("__secs")


def in_zone(ts: Column | str, tz: str) -> Column:
    """UTC wall-clock -> wall-clock of zone ``tz`` (both ``TIMESTAMP_NTZ``)."""
    if tz.upper() in ("UTC", "Z", "+00:00", "GMT"):
        return _c(ts)
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts))


def day_key(ts: Column | str, tz: str = "UTC") -> Column:
    """Local calendar day as ``yyyy-MM-dd`` text (the report's day key)."""
    return F.date_format(in_zone(ts, tz), "yyyy-MM-dd")


def raw_file_path(uri: Column | str) -> Column:
    """File path from ``_metadata.file_path`` (a URI: %-escaped) as the listing shows it.

    A URI never uses '+' for a space, so '+' is protected before decoding.
    """
    return F.url_decode(F.replace(_c(uri), F.lit("+"), F.lit("%2B")))


def ntz_lit(t) -> Column:
    """A ``TIMESTAMP_NTZ`` literal for a naive (UTC) datetime, independent of any time zone.

    ``F.lit(datetime)`` builds an instant in the Python process's zone, and
    comparing it with an NTZ column goes through the session zone; a string
    cast to NTZ involves neither.
    """
    return F.lit(t.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
