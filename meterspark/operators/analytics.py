"""Bounded analytics over hourly facts.

Ranges are half-open and of any length. A series has one row an hour, 8,784 a year at most; the
calendar is the bound that allows an exact percentile per series here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterspark.functions.clock import HOUR, local

SERIES = ("series_id",)
# Bucket widths in seconds, bucket anchor (Monday 1970-01-05), labels.
BASE_BUCKETS = {"hour": 3600, "day": 86400, "week": 604800}
BUCKET_ANCHOR = 345600
POINT_BOUNDS = (100, 10_000)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


@dataclass(frozen=True)
class TimeRange:
    """Half-open UTC range; offsets are required so that a naive time is never misread.

    ``longest`` lets a caller refuse ranges beyond a length of its choice.
    """

    start: datetime
    end: datetime
    longest: timedelta | None = None

    def __post_init__(self) -> None:
        if self.start.tzinfo is None or self.end.tzinfo is None:
            raise ValueError("range times need a UTC offset")
        if self.start >= self.end:
            raise ValueError("the range must start before it ends")
        if self.longest is not None and self.end - self.start > self.longest:
            raise ValueError(f"the range exceeds {self.longest.days} days")

    @property
    def utc(self) -> tuple[datetime, datetime]:
        return tuple(t.astimezone(UTC).replace(tzinfo=None) for t in (self.start, self.end))

    @property
    def expected_hours(self) -> int:
        return math.ceil((self.end - self.start).total_seconds() / HOUR)


def in_range(hourly: DataFrame, span: TimeRange, version: str | None = None) -> DataFrame:
    """Rows of the range; both conditions reach the Parquet scan."""
    start, end = (F.lit(t).cast("timestamp_ntz") for t in span.utc)
    rows = hourly.where((F.col("hour_start") >= start) & (F.col("hour_start") < end))
    return rows if version is None else rows.where(F.col("dataset_version_id") == version)


def energy_summary(
    hourly: DataFrame, span: TimeRange, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Counts, mean, exact median, extremes, total and coverage of each series."""
    energy = F.col("energy_kwh")
    stored = F.count(F.lit(1))
    expected = span.expected_hours
    return in_range(hourly, span).groupBy(*keys).agg(
        F.lit(expected).cast("long").alias("expected_hours"),
        stored.alias("stored_hours"),
        F.count(energy).alias("energy_value_count"),
        F.greatest(F.lit(0), expected - stored).cast("long").alias("absent_hours"),
        F.greatest(F.lit(0), expected - F.count(energy)).cast("long").alias("missing_energy_hours"),
        F.avg(energy).alias("mean_energy_kwh"),
        F.percentile(energy, 0.5).alias("median_energy_kwh"),
        F.min(energy).alias("min_energy_kwh"),
        F.max(energy).alias("max_energy_kwh"),
        F.sum(energy).alias("total_energy_kwh"),
        F.avg("coverage_ratio").alias("mean_coverage_ratio"),
    )


def range_metadata(
    hourly: DataFrame, span: TimeRange, series: DataFrame, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Expected, stored, absent and missing hours, also for series without rows in the range."""
    counts = in_range(hourly, span).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("stored_hours"), F.count("energy_kwh").alias("energy_value_count")
    )
    expected = span.expected_hours
    stored = F.coalesce("stored_hours", F.lit(0))
    values = F.coalesce("energy_value_count", F.lit(0))
    return series.join(counts, list(keys), "left").select(
        *keys,
        F.lit(expected).cast("long").alias("expected_hours"),
        stored.alias("stored_hours"),
        values.alias("energy_value_count"),
        F.greatest(F.lit(0), expected - stored).cast("long").alias("absent_hours"),
        F.greatest(F.lit(0), expected - values).cast("long").alias("missing_energy_hours"),
    )


def status_counts(
    hourly: DataFrame, span: TimeRange, keys: Sequence[str] = SERIES
) -> DataFrame:
    """``status_counts`` map of each series; at most six entries."""
    counted = in_range(hourly, span).groupBy(*keys, "quality_status").agg(
        F.count(F.lit(1)).alias("hours")
    )
    entries = F.array_sort(F.collect_list(F.struct("quality_status", "hours")))
    return counted.groupBy(*keys).agg(F.map_from_entries(entries).alias("status_counts"))


def bucket_seconds(span: TimeRange, resolution: str, max_points: int) -> int:
    """Smallest multiple of the resolution whose aligned buckets fit in ``max_points``."""
    low, high = POINT_BOUNDS
    if not low <= max_points <= high:
        raise ValueError(f"max_points must be between {low} and {high}")
    second = 1_000_000
    unit = BASE_BUCKETS[resolution] * second
    begin, last = (round((t.timestamp() - BUCKET_ANCHOR) * second) for t in (span.start, span.end))
    last -= 1  # the end is not part of the range

    reach = last - begin
    # Widths of at most reach / max_points always need one bucket more than allowed, and those of at least
    # reach / (max_points - 1) never do, wherever the range begins. Only the few between depend on its place.
    least = reach // (max_points * unit) + 1
    enough = max(least, -(-reach // ((max_points - 1) * unit)))
    widths = np.arange(least, enough + 1, dtype=np.int64) * unit
    buckets = last // widths - begin // widths + 1
    return int(widths[np.argmax(buckets <= max_points)]) // second


def energy_series(
    hourly: DataFrame,
    span: TimeRange,
    resolution: str = "hour",
    max_points: int = 1000,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Bucketed energy with coverage and status, at most ``max_points`` rows a series.

    The bucket width is chosen so that the range cannot hold more buckets; no row is cut off.
    """
    width = bucket_seconds(span, resolution, max_points)
    bucket = F.window("hour_start", f"{width} seconds", startTime=f"{BUCKET_ANCHOR % width} seconds")
    low, high = F.min("quality_status"), F.max("quality_status")
    return (
        in_range(hourly, span)
        .groupBy(*keys, bucket.alias("bucket"))
        .agg(
            F.sum("energy_kwh").alias("energy_kwh"),
            F.avg("coverage_ratio").alias("mean_coverage_ratio"),
            F.when(low == high, low).otherwise("mixed").alias("quality_status"),
            F.count(F.lit(1)).alias("sample_count"),
        )
        .select(
            *keys,
            F.col("bucket.start").alias("bucket_start"),
            "energy_kwh",
            "mean_coverage_ratio",
            "quality_status",
            "sample_count",
            F.lit(width).cast("long").alias("bucket_seconds"),
            F.lit(width > BASE_BUCKETS[resolution]).alias("downsampled"),
        )
    )


def hour_profile(
    hourly: DataFrame, span: TimeRange, timezone: str = "UTC", keys: Sequence[str] = SERIES
) -> DataFrame:
    key = F.hour(local(F.col("hour_start"), timezone))
    profile = _profile(hourly, span, {"profile_key": key}, keys)
    return profile.withColumn("label", F.lpad(F.col("profile_key").cast("string"), 2, "0"))


def weekday_profile(
    hourly: DataFrame, span: TimeRange, timezone: str = "UTC", keys: Sequence[str] = SERIES
) -> DataFrame:
    key = F.weekday(local(F.col("hour_start"), timezone)) + 1
    profile = _profile(hourly, span, {"profile_key": key}, keys)
    names = F.array(*(F.lit(name) for name in WEEKDAYS))
    return profile.withColumn("label", F.element_at(names, F.col("profile_key").cast("int")))


def heatmap(
    hourly: DataFrame, span: TimeRange, timezone: str = "UTC", keys: Sequence[str] = SERIES
) -> DataFrame:
    civil = local(F.col("hour_start"), timezone)
    axes = {"iso_weekday": F.weekday(civil) + 1, "hour_of_day": F.hour(civil)}
    return _profile(hourly, span, axes, keys).drop("total_energy_kwh")


def energy_histogram(
    hourly: DataFrame, span: TimeRange, bins: int = 20, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Equal-width bins between the extremes of each series; only bins that hold values."""
    values = in_range(hourly, span).where(F.col("energy_kwh").isNotNull()).select(*keys, "energy_kwh")
    extremes = values.groupBy(*keys).agg(
        F.min("energy_kwh").alias("low"), F.max("energy_kwh").alias("high")
    )
    low, high = F.col("low"), F.col("high")
    flat = low == high
    place = F.width_bucket("energy_kwh", low, high, F.lit(bins))
    index = F.when(flat, F.lit(1)).otherwise(F.least(F.lit(bins), place)).cast("long")
    width = (high - low) / bins
    return (
        values.join(extremes, list(keys))
        .groupBy(*keys, "low", "high", index.alias("bin_index"))
        .agg(F.count(F.lit(1)).alias("sample_count"))
        .select(
            *keys,
            "bin_index",
            F.when(flat, low).otherwise(low + (F.col("bin_index") - 1) * width).alias("lower_kwh"),
            F.when(flat, high).otherwise(low + F.col("bin_index") * width).alias("upper_kwh"),
            "sample_count",
        )
    )


def _profile(
    hourly: DataFrame, span: TimeRange, axes: dict[str, Column], keys: Sequence[str]
) -> DataFrame:
    return (
        in_range(hourly, span)
        .where(F.col("energy_kwh").isNotNull())
        .groupBy(*keys, *(column.cast("long").alias(name) for name, column in axes.items()))
        .agg(
            F.avg("energy_kwh").alias("mean_energy_kwh"),
            F.sum("energy_kwh").alias("total_energy_kwh"),
            F.avg("coverage_ratio").alias("mean_coverage_ratio"),
            F.count(F.lit(1)).alias("sample_count"),
        )
    )
