"""Driver-side parsing of ``--since`` / ``--until`` specs into literal bounds.

Bounds are computed once on the driver and enter plans as literals, so they
constant-fold and push down to the Parquet scan. ``now`` is explicit; all
values are naive UTC datetimes; ``tz`` names the "local" zone for ``today``
and calendar dates.
"""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

_REL = re.compile(r"^(\d+)([hdwm])$")
_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def _to_local(now_utc: datetime, tz: str) -> datetime:
    return now_utc.replace(tzinfo=timezone.utc).astimezone(ZoneInfo(tz))


def _to_utc(local: datetime) -> datetime:
    return local.astimezone(timezone.utc).replace(tzinfo=None)


def add_months(t: datetime, months: int) -> datetime:
    """Calendar month shift with day overflow carried forward (Mar 31 - 1 month = Mar 3)."""
    y, m = divmod(t.month - 1 + months, 12)
    year, month = t.year + y, m + 1
    last = calendar.monthrange(year, month)[1]
    base = t.replace(year=year, month=month, day=min(t.day, last))
    return base + timedelta(days=t.day - min(t.day, last))


def add_days_local(local: datetime, days: int) -> datetime:
    """Shift by calendar days keeping wall-clock time in the zone."""
    shifted = local.replace(tzinfo=None) + timedelta(days=days)
    return shifted.replace(tzinfo=local.tzinfo)


def _relative(spec: str, now: datetime, tz: str) -> datetime | None:
    m = _REL.match(spec)
    if not m:
        return None
    n, unit = int(m.group(1)), m.group(2)
    if unit == "h":
        return now - timedelta(hours=n)
    local = _to_local(now, tz)
    if unit == "d":
        return _to_utc(add_days_local(local, -n))
    if unit == "w":
        return _to_utc(add_days_local(local, -7 * n))
    shifted = add_months(local.replace(tzinfo=None), -n).replace(tzinfo=local.tzinfo)
    return _to_utc(shifted)


def _date(spec: str, tz: str) -> datetime | None:
    if not _DATE.match(spec):
        return None
    try:
        d = datetime.strptime(spec, "%Y-%m-%d")
    except ValueError:
        return None
    return _to_utc(d.replace(tzinfo=ZoneInfo(tz)))


def parse_since(spec: str, now: datetime, tz: str = "UTC") -> datetime | None:
    """'' / 'all' -> None; 'today' -> local midnight; N[hdwm]; YYYY-MM-DD (local)."""
    if spec in ("", "all"):
        return None
    if spec == "today":
        return start_of_day(now, tz)
    for parsed in (_relative(spec, now, tz), _date(spec, tz)):
        if parsed is not None:
            return parsed
    raise ValueError(f"bad since {spec!r} (want all|today|7d|24h|2w|1m|YYYY-MM-DD)")


def parse_until(spec: str, now: datetime, tz: str = "UTC") -> datetime | None:
    """'' -> None; N[hdwm]; YYYY-MM-DD -> next local midnight (the day is included)."""
    if spec == "":
        return None
    rel = _relative(spec, now, tz)
    if rel is not None:
        return rel
    d = _date(spec, tz)
    if d is not None:
        local = _to_local(d, tz)
        return _to_utc(add_days_local(local, 1))
    raise ValueError(f"bad until {spec!r} (want 7d|24h|2w|1m|YYYY-MM-DD)")


def start_of_day(now: datetime, tz: str = "UTC") -> datetime:
    local = _to_local(now, tz)
    return _to_utc(local.replace(hour=0, minute=0, second=0, microsecond=0))


def day_text(t: datetime | None, tz: str = "UTC") -> str:
    """Local calendar date of an instant; the zero time formats as 0001-01-01."""
    if t is None:
        return "0001-01-01"
    return _to_local(t, tz).strftime("%Y-%m-%d")


def local_date(now: datetime, tz: str = "UTC"):
    """Calendar date of an instant in zone ``tz``."""
    return _to_local(now, tz).date()


def local_midnight(d, tz: str = "UTC") -> datetime:
    """UTC instant of the start of local calendar date ``d``."""
    return _to_utc(datetime(d.year, d.month, d.day, tzinfo=ZoneInfo(tz)))
