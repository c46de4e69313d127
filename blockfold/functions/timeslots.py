"""Block times as slots of 500 ms since 2000-01-01, hours since 1970, and dates (UTC sessions)."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_MS, SLOT_MS = 946_684_800_000, 500
EPOCH_HOURS = EPOCH_MS // 3_600_000


def time_text(at: Column, pattern: str) -> Column:
    """date_format by a pattern that begins with the year; years of more than four digits have no sign before them."""
    return F.ltrim(F.date_format(at, pattern), F.lit("+"))


def slot_to_time(slot: Column) -> Column:
    return time_text(F.timestamp_millis(slot * SLOT_MS + EPOCH_MS), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def time_to_slot(text: Column) -> Column:
    """Inverse of slot_to_time; a trailing Z is dropped, an empty text is slot 0, others that are no time are null."""
    at = F.try_to_timestamp(F.rtrim(text, F.lit("Z")))
    return F.when(text == "", F.lit(0).cast("long")).otherwise(F.floor((F.unix_millis(at) - EPOCH_MS) / SLOT_MS))


def slot_to_hour(slot: Column) -> Column:
    return F.floor(slot / 7200).cast("long") + EPOCH_HOURS


def hour_to_date(hour: Column) -> Column:
    return time_text(F.timestamp_seconds(hour * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_to_hour(text: Column, end: bool = False) -> Column:
    """Unix hour of `YYYY-MM-DD[:HH]`; a day beyond the month's end runs into the next; a bare date is its first (or last) hour."""
    pattern = r"^(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?::([01]\d|2[0-3]))?$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    first = F.make_date(part(1).try_cast("int"), part(2).try_cast("int"), F.lit(1))
    days = F.unix_date(first) + part(3).try_cast("int") - 1
    hour = F.coalesce(part(4).try_cast("int"), F.lit(23 if end else 0))
    return F.when(text.rlike(pattern), (days * 24 + hour).cast("long"))


def parse_date(text: str, end: bool = False) -> int:
    """date_to_hour for a request's parameter."""
    m = re.fullmatch(r"(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(?::([01]\d|2[0-3]))?", text)
    if not m:
        raise ValueError(f"not a date: {text!r}")
    days = dt.date(int(m[1]), int(m[2]), 1).toordinal() - dt.date(1970, 1, 1).toordinal() + int(m[3]) - 1
    return days * 24 + (int(m[4]) if m[4] else 23 if end else 0)


def date_range(start: str | None, end: str | None) -> tuple[int, int]:
    """Inclusive unix hours of a range: a missing bound is a year from the other; over 366 days is an error; end before start is an empty range."""
    if not start and not end:
        raise ValueError("a date range needs a bound")

    def year(text: str, by: int) -> str:
        d, _, h = text.partition(":")
        y, m, rest = d.split("-")
        day = min(int(rest), 28) if m == "02" else int(rest)
        return f"{int(y) + by:04}-{m}-{day:02}" + (f":{h}" if h else "")

    first, last = parse_date(start or year(end, -1)), parse_date(end or year(start, 1), end=True)
    if (last - first) // 24 > 366:
        raise ValueError("a date range has at most 366 days")
    return first, last


def datehour_pack(hour: Column) -> Column:
    """days << 5 | hour of day, days since 2000-01-01."""
    since = hour - EPOCH_HOURS
    return F.floor(since / 24).cast("long") * 32 + since % 24


def datehour_unpack(packed: Column) -> Column:
    return F.floor(packed / 32).cast("long") * 24 + packed % 32 + EPOCH_HOURS
