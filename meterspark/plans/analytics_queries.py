"""Registered queries: bounded analytics over hourly facts made from events."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.operators import analytics as A
from meterspark.operators.hourly import Policy, hourly_transform
from meterspark.plans.inputs import HOURLY_SQL, READINGS_SQL, hourly_events, readings, rounded
from meterspark.plans.hourly_queries import INTERVAL, grid_sql, resolved_sql

ZONE = "Europe/Kyiv"
SPAN = A.TimeRange(datetime(2023, 12, 31, tzinfo=UTC), datetime(2024, 1, 29, 7, tzinfo=UTC))
LONG_SPAN = A.TimeRange(datetime(2020, 1, 1, tzinfo=UTC), datetime(2024, 12, 31, tzinfo=UTC))
BINS = 20


def energy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.energy_summary(hourly_events(spark, sf_dir), SPAN))


def energy_status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = A.status_counts(hourly_events(spark, sf_dir), SPAN)
    entries = F.transform(
        F.map_entries("status_counts"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return counts.select("series_id", F.array_join(entries, ",").alias("status_counts"))


def hourly_series_3h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: readings to hourly facts to a bounded series, in one plan."""
    hourly = hourly_transform(readings(spark, sf_dir), INTERVAL, Policy(5, 0.8, "keep_first"))
    return rounded(A.energy_series(hourly, SPAN, "hour", 250))


def series_week_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.energy_series(hourly_events(spark, sf_dir), LONG_SPAN, "week", 100))


def hour_profile_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.hour_profile(hourly_events(spark, sf_dir), SPAN, ZONE))


def weekday_profile_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.weekday_profile(hourly_events(spark, sf_dir), SPAN, ZONE))


def heatmap_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.heatmap(hourly_events(spark, sf_dir), SPAN, ZONE))


def energy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.energy_histogram(hourly_events(spark, sf_dir), SPAN, BINS))


def range_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = hourly_events(spark, sf_dir)
    series = hourly.select("series_id").distinct()
    return rounded(A.range_metadata(hourly, SPAN, series))


QUERIES = {
    "energy_summary": energy_summary,
    "energy_status_map": energy_status_map,
    "hourly_series_3h": hourly_series_3h,
    "series_week_bounded": series_week_bounded,
    "hour_profile_local": hour_profile_local,
    "weekday_profile_local": weekday_profile_local,
    "heatmap_local": heatmap_local,
    "energy_histogram": energy_histogram,
    "range_metadata": range_metadata,
}

_IN_RANGE = "hour_start >= TIMESTAMP '2023-12-31' AND hour_start < TIMESTAMP '2024-01-29 07:00:00'"
_EXPECTED = 703
_RANGE = f"WITH {HOURLY_SQL}, s AS (SELECT * FROM h WHERE {_IN_RANGE})"
_LOCAL = f"(hour_start AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}')"
_MEANS = """round(avg(energy_kwh), 6) AS mean_energy_kwh, round(sum(energy_kwh), 6) AS total_energy_kwh,
       round(avg(coverage_ratio), 6) AS mean_coverage_ratio, count(*) AS sample_count"""


def _series(source: str, width: int, downsampled: str) -> str:
    return f"""SELECT series_id,
       time_bucket(INTERVAL '{width} seconds', hour_start, TIMESTAMP '1970-01-05') AS bucket_start,
       round(sum(energy_kwh), 6) AS energy_kwh, round(avg(coverage_ratio), 6) AS mean_coverage_ratio,
       CASE WHEN count(DISTINCT quality_status) = 1 THEN min(quality_status) ELSE 'mixed' END AS quality_status,
       count(*) AS sample_count, CAST({width} AS BIGINT) AS bucket_seconds, {downsampled} AS downsampled
FROM {source} GROUP BY 1, 2"""


ORACLE = {
    "energy_summary": f"""{_RANGE}
SELECT series_id, CAST({_EXPECTED} AS BIGINT) AS expected_hours, count(*) AS stored_hours,
       count(energy_kwh) AS energy_value_count,
       CAST(greatest(0, {_EXPECTED} - count(*)) AS BIGINT) AS absent_hours,
       CAST(greatest(0, {_EXPECTED} - count(energy_kwh)) AS BIGINT) AS missing_energy_hours,
       round(avg(energy_kwh), 6) AS mean_energy_kwh,
       round(quantile_cont(energy_kwh, 0.5), 6) AS median_energy_kwh,
       round(min(energy_kwh), 6) AS min_energy_kwh, round(max(energy_kwh), 6) AS max_energy_kwh,
       round(sum(energy_kwh), 6) AS total_energy_kwh, round(avg(coverage_ratio), 6) AS mean_coverage_ratio
FROM s GROUP BY 1""",
    "energy_status_map": f"""{_RANGE}
SELECT series_id, string_agg(quality_status || '=' || n, ',' ORDER BY quality_status) AS status_counts
FROM (SELECT series_id, quality_status, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""",
    "hourly_series_3h": f"""WITH {READINGS_SQL}, {resolved_sql('keep_first')}, {grid_sql(INTERVAL)}, s AS (
  SELECT series_id, hour_start, energy_kwh, observed / 12 AS coverage_ratio, status AS quality_status
  FROM hh WHERE {_IN_RANGE}
)
{_series('s', 10800, 'true')}""",
    "series_week_bounded": f"WITH {HOURLY_SQL} {_series('h', 1814400, 'true')}",
    "hour_profile_local": f"""{_RANGE}
SELECT series_id, hour({_LOCAL}) AS profile_key, lpad(CAST(hour({_LOCAL}) AS VARCHAR), 2, '0') AS label,
       {_MEANS} FROM s WHERE energy_kwh IS NOT NULL GROUP BY 1, 2, 3""",
    "weekday_profile_local": f"""{_RANGE}
SELECT series_id, date_part('isodow', {_LOCAL}) AS profile_key, dayname({_LOCAL}) AS label, {_MEANS}
FROM s WHERE energy_kwh IS NOT NULL GROUP BY 1, 2, 3""",
    "heatmap_local": f"""{_RANGE}
SELECT series_id, date_part('isodow', {_LOCAL}) AS iso_weekday, hour({_LOCAL}) AS hour_of_day,
       round(avg(energy_kwh), 6) AS mean_energy_kwh, round(avg(coverage_ratio), 6) AS mean_coverage_ratio,
       count(*) AS sample_count FROM s WHERE energy_kwh IS NOT NULL GROUP BY 1, 2, 3""",
    "energy_histogram": f"""{_RANGE}, v AS (
  SELECT series_id, energy_kwh, min(energy_kwh) OVER (PARTITION BY series_id) AS lo,
         max(energy_kwh) OVER (PARTITION BY series_id) AS hi
  FROM s WHERE energy_kwh IS NOT NULL
), b AS (
  SELECT *, CASE WHEN lo = hi THEN 1 ELSE least({BINS},
         CAST(floor((energy_kwh - lo) * {BINS} / (hi - lo)) AS BIGINT) + 1) END AS bin_index FROM v
)
SELECT series_id, bin_index,
       round(CASE WHEN lo = hi THEN lo ELSE lo + (bin_index - 1) * (hi - lo) / {BINS} END, 6) AS lower_kwh,
       round(CASE WHEN lo = hi THEN hi ELSE lo + bin_index * (hi - lo) / {BINS} END, 6) AS upper_kwh,
       count(*) AS sample_count
FROM b GROUP BY series_id, bin_index, lo, hi""",
    "range_metadata": f"""{_RANGE}
SELECT series_id, CAST({_EXPECTED} AS BIGINT) AS expected_hours, count(*) AS stored_hours,
       count(energy_kwh) AS energy_value_count,
       CAST(greatest(0, {_EXPECTED} - count(*)) AS BIGINT) AS absent_hours,
       CAST(greatest(0, {_EXPECTED} - count(energy_kwh)) AS BIGINT) AS missing_energy_hours
FROM s GROUP BY 1""",
}
