"""Time literals: microseconds since the epoch as @n, ISO-8601 texts, and everyday phrases."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, timezone, tzinfo
from zoneinfo import ZoneInfo

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
#: Times this near to zero are versions, and are shown as @n.
VERSIONS = 10_000

_ISO = re.compile(
    r"(?P<Y>\d{4})(?:-?(?P<M>\d{2})(?:-?(?P<D>\d{2})(?:[Tt ]?(?P<h>\d{2})(?::?(?P<m>\d{2})(?::?(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?)?)?)?)?"
    r"\s*(?P<z>[Zz]|[+-]\d{2}(?::?\d{2})?)?"
)


def zone(name: str) -> tzinfo:
    return UTC if name.upper() in ("UTC", "Z", "GMT") else ZoneInfo(name)


def micros(t: datetime) -> int:
    return (t - _EPOCH) // timedelta(microseconds=1)


def match_time(text: str, at: int, tz: str = "UTC") -> tuple[int, int]:
    """(microseconds, end) of the time literal that starts at `at`; ValueError if none does.

    Texts without a zone are in `tz`, which callers take from spark.sql.session.timeZone; digits past
    the microsecond are cut off.
    """
    m = re.compile(r"@([+-]?\d+)").match(text, at)
    if m:
        return int(m[1]), m.end()
    m = _ISO.match(text, at)
    if not m:
        raise ValueError(f"no time at {text[at : at + 20]!r}")
    z = m["z"]
    if z is None:
        where: tzinfo = zone(tz)
    elif z in "Zz":
        where = UTC
    else:
        minutes = int(z[1:3]) * 60 + int(z[3:].replace(":", "") or 0)
        where = timezone(timedelta(minutes=-minutes if z[0] == "-" else minutes))
    frac = int(((m["f"] or "") + "000000")[:6])
    n = {k: int(m[k]) if m[k] else d for k, d in (("M", 1), ("D", 1), ("h", 0), ("m", 0), ("s", 0))}
    t = datetime(int(m["Y"]), n["M"], n["D"], n["h"], n["m"], min(n["s"], 59), frac, tzinfo=where)
    return micros(t) + (n["s"] - min(n["s"], 59)) * 1_000_000, m.end()


def parse_time(text: str, tz: str = "UTC") -> int:
    text = text.strip()
    t, end = match_time(text, 0, tz)
    if end != len(text):
        raise ValueError(f"not a time: {text!r}")
    return t


def format_time(us: int, tz: str = "UTC") -> str:
    """ISO-8601 in the zone, with six digits of the second; UTC where the zone's offset has seconds."""
    t = (_EPOCH + timedelta(microseconds=us)).astimezone(zone(tz))
    off = t.utcoffset() or timedelta()
    if off.seconds % 60:
        t, off = t.astimezone(UTC), timedelta()
    shown = t.strftime("%m-%dT%H:%M:%S.%f")
    minutes = int(off.total_seconds()) // 60
    sign, (h, m) = "-" if minutes < 0 else "+", divmod(abs(minutes), 60)
    return f"{t.year:04d}-{shown}" + ("Z" if not minutes else f"{sign}{h:02d}" + (f"{m:02d}" if m else ""))


def show_time(us: int, tz: str = "UTC") -> str:
    return f"@{us}" if abs(us) < VERSIONS else format_time(us, tz)


_UNITS = {"second": 1, "sec": 1, "s": 1, "minute": 60, "min": 60, "m": 60, "hour": 3600, "hr": 3600, "h": 3600, "day": 86400, "d": 86400, "week": 604800, "wk": 604800, "w": 604800}


def phrase_time(text: str, now: datetime) -> datetime:
    """now, today, yesterday, tomorrow, +N unit, -N unit, N unit ago, last or next unit, H[:MM[:SS]] [am|pm],
    [Y/]M/D, and their combinations, read from left to right."""
    t, rest = now, text.strip().lower()
    if not rest:
        raise ValueError("no time")
    unit = "(" + "|".join(sorted(_UNITS, key=len, reverse=True)) + r")s?\b"
    while rest:
        if m := re.match(r"now\b", rest):
            t = now
        elif m := re.match(r"(today|yesterday|tomorrow)\b", rest):
            days = {"today": 0, "yesterday": -1, "tomorrow": 1}[m[1]]
            t = now.replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=days)
        elif m := re.match(rf"(\d+)\s*{unit}\s+ago\b", rest):
            t -= timedelta(seconds=int(m[1]) * _UNITS[m[2]])
        elif m := re.match(rf"([+-])\s*(\d+)\s*{unit}", rest):
            t += timedelta(seconds=int(m[1] + m[2]) * _UNITS[m[3]])
        elif m := re.match(rf"(last|next)\s+{unit}", rest):
            t += timedelta(seconds=(1 if m[1] == "next" else -1) * _UNITS[m[2]])
        elif m := re.match(r"(?:(\d{4})/)?(\d{1,2})/(\d{1,2})\b", rest):
            t = t.replace(year=int(m[1] or t.year), month=int(m[2]), day=int(m[3]), hour=0, minute=0, second=0, microsecond=0)
        elif m := re.match(r"(\d{1,2})(?::(\d{2})(?::(\d{2}))?)?\s*(am|pm)?\b", rest):
            if not (m[2] or m[4]):
                raise ValueError(f"not a time: {text!r}")
            hour = int(m[1]) % 12 + (12 if m[4] == "pm" else 0) if m[4] else int(m[1])
            t = t.replace(hour=hour, minute=int(m[2] or 0), second=int(m[3] or 0), microsecond=0)
        else:
            raise ValueError(f"not a time: {text!r}")
        rest = rest[m.end() :].lstrip(" ,")
    return t
