"""Time arithmetic on zone-less UTC timestamps (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86400


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970-01-01, rounded down."""
    return F.unix_seconds(ts.cast("timestamp"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def floor_div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by)).cast("long")


def floor_to(ts: Column, seconds: int) -> Column:
    return from_epoch(floor_div(epoch(ts), seconds) * F.lit(seconds))


def shift(ts: Column, seconds: Column | int) -> Column:
    offset = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return (ts + F.make_dt_interval(secs=offset)).cast("timestamp_ntz")


def local(ts: Column, timezone: str) -> Column:
    """Civil time in ``timezone`` of a UTC instant."""
    return F.from_utc_timestamp(ts.cast("timestamp"), timezone).cast("timestamp_ntz")


def to_utc(ts: Column, timezone: str) -> Column:
    """UTC instant of civil time; an ambiguous time takes the first offset."""
    return F.to_utc_timestamp(ts.cast("timestamp"), timezone).cast("timestamp_ntz")


def iso(ts: Column, suffix: str = "+00:00") -> Column:
    """ISO-8601 text; the fraction appears only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(
        whole, F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""), F.lit(suffix)
    )
