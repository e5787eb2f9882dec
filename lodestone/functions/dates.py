"""Time zones, intervals and calendar units."""

from __future__ import annotations

import datetime as dt
import math
import re
import zoneinfo
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidQueryError, UnsupportedError

SECOND = 1_000_000
#: Microseconds of the units that intervals are written in, and months of those that are months (fixed values).
UNITS = {
    "nanos": Decimal("0.001"), "micros": 1, "microsecond": 1, "us": 1, "ms": 1000, "millisecond": 1000, "s": SECOND, "sec": SECOND, "second": SECOND,
    "m": 60 * SECOND, "min": 60 * SECOND, "minute": 60 * SECOND, "h": 3600 * SECOND, "hour": 3600 * SECOND, "d": 86400 * SECOND, "day": 86400 * SECOND,
    "w": 604800 * SECOND, "week": 604800 * SECOND,
}
MONTHS = {"mon": 1, "month": 1, "quarter": 3, "y": 12, "year": 12}
#: What whole years, and the months left over, count in days.
YEAR_DAYS, MONTH_DAYS = Decimal("365.25"), 30
#: The ways that date facets write their keys (fixed values).
FORMATS = ("strict_date_optional_time", "epoch_millis")
#: Calendar units and their short names (fixed values).
CALENDAR = {"1s": "second", "1m": "minute", "1h": "hour", "1d": "day", "1w": "week", "1M": "month", "1q": "quarter", "1y": "year"} | {u: u for u in ("second", "minute", "hour", "day", "week", "month", "quarter", "year")}


def micros(text: str | int | float | dt.timedelta) -> int:
    """The length of an interval such as 7d, 1.5 days, 1 year 2 months or -2 hours 30 minutes in microseconds.

    Twelve months are a year of 365.25 days, months left over have 30 days each; a fraction of a month is days.
    """
    if isinstance(text, dt.timedelta):
        return round(text.total_seconds() * SECOND)
    if isinstance(text, (int, float)) and not isinstance(text, bool):
        return round(text * SECOND)
    total, months, rest = Decimal(0), Decimal(0), str(text).strip()
    if not rest:
        raise InvalidQueryError("empty interval")
    while rest:
        found = re.match(r"([+-]?\d+(?:\.\d+)?)\s*([A-Za-z]+)\s*", rest)
        names = [found[2], found[2].lower(), found[2].lower().rstrip("s")] if found else []
        name = next((n for n in names if n in UNITS or n in MONTHS), None)
        if name is None:
            raise InvalidQueryError(f"interval {text!r} isn't understood")
        if name in MONTHS:
            months += Decimal(found[1]) * MONTHS[name]
        else:
            total += Decimal(found[1]) * UNITS[name]
        rest = rest[found.end() :]
    years, left = divmod(abs(months), 12)
    return int(total + (1 if months >= 0 else -1) * (years * YEAR_DAYS + left * MONTH_DAYS) * 86400 * SECOND)


def zone_name(zone: str | int | float | None) -> str:
    """A zone Spark understands: an IANA name, or a fixed offset (whole hours, +hh, +hhmm, +hh:mm) of at most 18 hours."""
    if zone is None or zone in ("UTC", "Z", "UT", "GMT"):
        return "UTC"
    if isinstance(zone, bool) or not isinstance(zone, (str, int, float)) or (isinstance(zone, float) and not math.isfinite(zone)):
        raise InvalidQueryError("time_zone is a name or a number of hours")
    if not isinstance(zone, str):
        seconds = int(zone) * 3600
    elif found := re.fullmatch(r"(?:UTC|GMT|UT)?([+-])(\d{1,2})(?::?(\d{2})(?::?(\d{2}))?)?", zone):
        hours, minutes, rest = (int(x or 0) for x in found.groups()[1:])
        if minutes > 59 or rest > 59:
            raise InvalidQueryError(f"time zone {zone!r} has no such minutes or seconds")
        seconds = (hours * 3600 + minutes * 60 + rest) * (-1 if found[1] == "-" else 1)
    else:
        try:
            zoneinfo.ZoneInfo(zone)
        except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError) as e:
            raise InvalidQueryError(f"unknown time zone {zone!r}") from e
        return zone
    if abs(seconds) > 18 * 3600:
        raise InvalidQueryError(f"time zone {zone!r} is out of range")
    minutes, rest = divmod(abs(seconds), 60)
    return "UTC" if not seconds else f"{'-' if seconds < 0 else '+'}{minutes // 60:02d}:{minutes % 60:02d}" + (f":{rest:02d}" if rest else "")


def _tz(zone: str) -> dt.tzinfo:
    if zone == "UTC":
        return dt.UTC
    if zone[0] in "+-":
        h, m, *s = (int(x) for x in zone[1:].split(":"))
        return dt.timezone((-1 if zone[0] == "-" else 1) * dt.timedelta(hours=h, minutes=m, seconds=s[0] if s else 0))
    return zoneinfo.ZoneInfo(zone)


def in_zone(local: dt.datetime, zone: str) -> dt.datetime:
    """The instant of a local time, as local_to_utc() has it."""
    for fold in (1, 0):
        at = local.replace(tzinfo=_tz(zone), fold=fold).astimezone(dt.UTC)
        if at.astimezone(_tz(zone)).replace(tzinfo=None, fold=0) == local:
            return at
    return local.replace(tzinfo=_tz(zone), fold=0).astimezone(dt.UTC)


def date_format(option) -> str:
    if option is None:
        return FORMATS[0]
    if not isinstance(option, str) or not option:
        raise InvalidQueryError("format is a text")
    if option not in FORMATS:
        raise UnsupportedError(f"date patterns aren't offered; format is {' or '.join(FORMATS)}")
    return option


def date_text(at_micros: int, zone: str, style: str) -> str:
    """An instant as a date facet writes it: local with its offset, or milliseconds."""
    if style == "epoch_millis":
        return str(int(at_micros / 1000))
    local = (dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(microseconds=at_micros)).astimezone(_tz(zone))
    text = local.isoformat(timespec="milliseconds")
    return text[:23] + "Z" if not local.utcoffset() else text


def instant(value, zone: str = "UTC") -> dt.datetime:
    """A bound as an aware datetime: dates, datetimes, ISO texts (of the zone, if they name none) and epoch milliseconds;
    date math isn't offered."""
    if isinstance(value, str):
        if "||" in value or value.startswith("now"):
            raise UnsupportedError("date math isn't offered")
        if re.fullmatch(r"[+-]?\d+", value):
            return instant(int(value))
        try:
            value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError as e:
            raise InvalidQueryError(f"date {value!r} isn't understood") from e
        return value if value.tzinfo else in_zone(value, zone)
    if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value):
        return dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(milliseconds=value)
    if isinstance(value, dt.datetime):
        return value if value.tzinfo else value.replace(tzinfo=dt.UTC)
    if isinstance(value, dt.date):
        return in_zone(dt.datetime(value.year, value.month, value.day), zone)
    raise InvalidQueryError(f"date {value!r} isn't understood")


def instant_micros(value, zone: str = "UTC") -> int:
    return (instant(value, zone) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)


def floor_micros(at: int, unit: str | None, step: int | None, zone: str) -> int:
    """What calendar_floor(), or the grid of a fixed step, makes of one instant."""
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)
    if unit is None:
        origin = (in_zone(dt.datetime(1970, 1, 1), zone) - epoch) // dt.timedelta(microseconds=1)
        return (at - origin) // step * step + origin
    local = (epoch + dt.timedelta(microseconds=at)).astimezone(_tz(zone))
    away = local.utcoffset()
    whole = local.replace(tzinfo=None, fold=0, microsecond=0)
    if unit in ("second", "minute", "hour"):
        whole = whole.replace(**{k: 0 for k in {"second": (), "minute": ("second",), "hour": ("second", "minute")}[unit]})
        return (whole.replace(tzinfo=dt.UTC) - away - epoch) // dt.timedelta(microseconds=1)
    day = whole.replace(hour=0, minute=0, second=0)
    if unit == "week":
        day -= dt.timedelta(days=day.weekday())
    elif unit != "day":
        month = {"month": day.month, "quarter": (day.month - 1) // 3 * 3 + 1, "year": 1}[unit]
        day = day.replace(month=month, day=1)
    return (in_zone(day, zone) - epoch) // dt.timedelta(microseconds=1)


def utc(column: Column, kind: str) -> Column:
    """A date, naive timestamp (read as UTC) or timestamp as a timestamp; the session's zone is UTC."""
    return column if kind == "timestamp" else column.cast("timestamp")


def offset_micros(at: Column, zone: str) -> Column:
    """The zone's offset from UTC at an instant, in microseconds."""
    return F.unix_micros(F.from_utc_timestamp(at, zone)) - F.unix_micros(at)


def local_to_utc(local: Column, zone: str) -> Column:
    """The instant of a local time; of a repeated one the later, as PostgreSQL has it, and of a skipped one past the gap."""
    first = F.to_utc_timestamp(local, zone)
    after = offset_micros(first + F.expr("INTERVAL 3 HOURS"), zone)
    other = F.timestamp_micros(F.unix_micros(local) - after)
    return F.when(F.from_utc_timestamp(other, zone) == local, F.greatest(first, other)).otherwise(first)


def calendar_floor(at: Column, unit: str, zone: str) -> Column:
    """The start of the calendar unit that holds an instant.  Units under a day keep the instant's own offset."""
    local = F.from_utc_timestamp(at, zone)
    floor = F.date_trunc(unit, local)
    if unit in ("second", "minute", "hour"):
        return F.timestamp_micros(F.unix_micros(floor) - offset_micros(at, zone))
    return local_to_utc(floor, zone)
