"""Times, durations and ranges as they are written in summaries and on command lines."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spellings of a read's start time, tried in this order after a number of seconds.
TIME_PATTERNS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss"]
UNITS = {"d": 86400, "h": 3600, "m": 60, "s": 1}


def parse_timestamp_multi(text: Column) -> Column:
    """A timestamp in any of the usual spellings, or a number of seconds; null if it is none."""
    number = text.try_cast("double")
    return F.coalesce(F.when(number.isNotNull(), F.timestamp_micros(F.floor(number * 1_000_000).cast("long"))), *(F.try_to_timestamp(text, F.lit(p)) for p in TIME_PATTERNS))


def parse_summary_time(text: Column) -> Column:
    """Seconds: a number, or since 1970 for an RFC 3339 time."""
    return F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text, F.lit(TIME_PATTERNS[0]))) / 1e6)


def parse_duration(text: str) -> int:
    """Seconds of ``2h30m``, ``-1h`` or a bare number of minutes; digits after the last unit are dropped."""
    text = text.strip()
    sign, body = (-1, text[1:]) if text[:1] == "-" else (1, text)
    if body.isdigit():
        return sign * 60 * int(body)
    parts = re.findall(r"(\d+)([a-zA-Z])", body)
    if not parts or any(u.lower() not in UNITS for _, u in parts) or not re.fullmatch(r"(\d+[a-zA-Z])+\d*", body):
        raise ValueError(f"not a duration: {text!r}")
    return sign * sum(int(n) * UNITS[u.lower()] for n, u in parts)


def parse_range(text: str) -> tuple[int, int]:
    """``A-B`` with A <= B."""
    m = re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", text)
    if not m or int(m[1]) > int(m[2]):
        raise ValueError(f"not a range: {text!r}")
    return int(m[1]), int(m[2])


def parse_len(text: str, most: int = 2**63 - 1) -> tuple[int, int]:
    """``MIN``, or ``MIN-MAX`` with -, comma or space between."""
    parts = [p for p in re.split(r"[-,\s]+", text.strip()) if p]
    if len(parts) not in (1, 2) or not all(p.isdigit() for p in parts):
        raise ValueError(f"not a length range: {text!r}")
    low, high = int(parts[0]), int(parts[1]) if len(parts) == 2 else most
    if low > high:
        raise ValueError(f"not a length range: {text!r}")
    return low, high


def relative_window(start: str | None, end: str | None, run_start: datetime, run_end: datetime) -> tuple[datetime, datetime]:
    """A closed time window. Offsets count from the run's start, negative ones from its end; RFC 3339 times are absolute."""

    def place(text: str | None, default: datetime) -> datetime:
        if text is None:
            return default
        try:
            seconds = parse_duration(text)
        except ValueError:
            t = datetime.fromisoformat(text.replace("Z", "+00:00"))
            return t if t.tzinfo else t.replace(tzinfo=timezone.utc)
        return (run_end if seconds < 0 else run_start) + timedelta(seconds=seconds)

    a, b = place(start, run_start), place(end, run_end)
    if a > b:
        raise ValueError("the window's start is after its end")
    return a, b
