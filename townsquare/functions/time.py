"""Time buckets. Buckets are ``timestamp_ntz`` wall-clock times of one zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted scale names, and the text form of a date.
SCALES = {
    "-m": "minute", "minute": "minute",
    "-h": "hour", "hour": "hour", "hourly": "hour",
    "-d": "day", "day": "day", "daily": "day",
}
DATE_TEXT = "EEE MMM d HH:mm:ss Z yyyy"

# The parser takes no weekday letters, so the leading "EEE " is cut off first.
_DATE_TEXT_AFTER_WEEKDAY = "MMM d HH:mm:ss Z yyyy"


def scale_name(scale: str) -> str:
    """``minute`` / ``hour`` / ``day`` for a name or a ``-m -h -d`` flag."""
    try:
        return SCALES[scale.lower()]
    except KeyError:
        raise ValueError(f"unknown time scale {scale!r}") from None


def wall_clock(ts: Column, tz: str = "UTC") -> Column:
    """Wall-clock time in ``tz`` of an instant, in a session of any zone. A
    time without a zone (``timestamp_ntz``) is taken as UTC in a UTC session."""
    return F.convert_timezone(F.current_timezone(), F.lit(tz), ts.cast("timestamp").cast("timestamp_ntz"))


def bucket(ts: Column, scale: str, tz: str = "UTC") -> Column:
    """Start of the minute, hour or day that holds ``ts``."""
    return F.date_trunc(scale_name(scale), wall_clock(ts, tz)).cast("timestamp_ntz")


def one_step(scale: str) -> Column:
    return F.expr(f"interval 1 {scale_name(scale)}")


def parse_date_text(text: Column) -> Column:
    """Instant of ``Wed Aug 27 13:08:45 +0000 2008``; null when malformed."""
    return F.try_to_timestamp(F.substr(text, F.lit(5)), F.lit(_DATE_TEXT_AFTER_WEEKDAY))


def format_date_text(ts: Column) -> Column:
    """The same text form, in UTC, in a session of any zone."""
    utc = F.date_format(wall_clock(ts), "EEE MMM d HH:mm:ss")
    return F.concat(utc, F.lit(" +0000 "), F.date_format(wall_clock(ts), "yyyy"))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def first_time(*candidates: Column) -> Column:
    """The first epoch time that is present, as an instant; null if none is."""
    return from_epoch(F.coalesce(*candidates))
