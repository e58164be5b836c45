"""Table schemas, vocabularies and the versioned feature schema."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import types as T

# Names, vocabularies and constants that results depend on.
UCI_COLUMNS = (
    "Date",
    "Time",
    "Global_active_power",
    "Global_reactive_power",
    "Voltage",
    "Global_intensity",
    "Sub_metering_1",
    "Sub_metering_2",
    "Sub_metering_3",
)
UCI_MEASURES = {
    "Global_active_power": "active_power_kw",
    "Global_reactive_power": "reactive_power_kw",
    "Voltage": "voltage_v",
    "Global_intensity": "current_a",
    "Sub_metering_1": "sub_metering_1_wh",
    "Sub_metering_2": "sub_metering_2_wh",
    "Sub_metering_3": "sub_metering_3_wh",
}
UCI_INTERVAL_SECONDS = 60
UCI_TIMEZONE = "Europe/Paris"
MISSING_TOKENS = ("", "?", "nan", "NaN", "NAN")
DELIMITERS = (",", ";", "\t")
MEASURES = (
    "energy_kwh",
    "active_power_kw",
    "reactive_power_kw",
    "voltage_v",
    "current_a",
    "sub_metering_1_wh",
    "sub_metering_2_wh",
    "sub_metering_3_wh",
)
TRANSFORM_MEASURES = MEASURES[:5]
OPTIONAL_MEASURES = MEASURES[2:]
PARSE_STATUSES = ("valid", "warning", "invalid")
DUPLICATE_POLICIES = ("reject", "keep_first", "keep_last", "mean")
HOUR_STATUSES = (
    "complete",
    "imputed_short_gap",
    "valid_partial",
    "invalid_missing",
    "invalid_conflict",
    "invalid_value",
)
TRAINING_READY = ("complete", "imputed_short_gap")
VALID_HOUR = ("complete", "imputed_short_gap", "valid_partial")
ISSUE_SEVERITY = {
    "timestamp_order": "warning",
    "exact_duplicate": "warning",
    "conflicting_duplicate": "error",
    "time_gap": "warning",
    "missing": "warning",
    "non_finite": "error",
    "physical_invalidity": "error",
    "parse_error": "error",
    "statistical_anomaly": "info",
}
ROBUST_Z_LIMIT = 6.0
MAD_SCALE = 1.4826
EVIDENCE_LIMIT = 10
HORIZONS = 24
LAGS = (1, 2, 3, 6, 12, 24, 48, 168)
ROLLING_MEANS = (3, 6, 12, 24, 168)
SEASONAL_PERIODS = (24, 168)
LAG_FEATURES = tuple(f"lag_{n}" for n in LAGS)
ROLLING_FEATURES = (
    *(f"rolling_mean_{n}" for n in ROLLING_MEANS),
    "rolling_std_24",
    "rolling_min_24",
    "rolling_max_24",
)
CALENDAR_FEATURES = (
    "hour",
    "day_of_week",
    "day_of_month",
    "month",
    "is_weekend",
    "hour_sin",
    "hour_cos",
    "day_of_week_sin",
    "day_of_week_cos",
    "month_sin",
    "month_cos",
)
QUALITY_FEATURES = (
    "past_24h_coverage_mean",
    "past_168h_missing_hours",
    "last_hour_imputed",
)
FEATURE_VERSIONS = {False: "base_v1", True: "base_quality_v1"}
# End of fixed values.

MEASUREMENT_SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("source_row_number", T.LongType(), False),
        T.StructField("observed_at", T.TimestampNTZType(), False),
        T.StructField("timestamp_original", T.StringType()),
        T.StructField("timezone_context", T.StringType()),
        T.StructField("interval_seconds", T.IntegerType()),
        *(T.StructField(name, T.DoubleType()) for name in MEASURES),
        T.StructField("parse_status", T.StringType(), False),
        T.StructField("quality_flags", T.ArrayType(T.StringType()), False),
    ]
)

HOURLY_SCHEMA = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("hour_start", T.TimestampNTZType(), False),
        T.StructField("timezone_context", T.StringType()),
        T.StructField("energy_kwh", T.DoubleType()),
        T.StructField("mean_active_power_kw", T.DoubleType()),
        T.StructField("mean_reactive_power_kw", T.DoubleType()),
        T.StructField("mean_voltage_v", T.DoubleType()),
        T.StructField("min_voltage_v", T.DoubleType()),
        T.StructField("max_voltage_v", T.DoubleType()),
        T.StructField("mean_current_a", T.DoubleType()),
        T.StructField("max_current_a", T.DoubleType()),
        T.StructField("observed_samples", T.LongType(), False),
        T.StructField("expected_samples", T.LongType(), False),
        T.StructField("coverage_ratio", T.DoubleType(), False),
        T.StructField("imputed_samples", T.LongType(), False),
        T.StructField("max_missing_run", T.LongType(), False),
        T.StructField("quality_status", T.StringType(), False),
        T.StructField("quality_flags", T.ArrayType(T.StringType()), False),
    ]
)


def feature_names(include_quality: bool = False) -> tuple[str, ...]:
    names = (*LAG_FEATURES, *ROLLING_FEATURES, *CALENDAR_FEATURES)
    return (*names, *QUALITY_FEATURES) if include_quality else names


def target_names() -> tuple[str, ...]:
    return tuple(f"target_h{h:02d}" for h in range(1, HORIZONS + 1))


def feature_digest(include_quality: bool = False) -> str:
    """SHA-256 of the canonical JSON description of a feature schema."""
    names = feature_names(include_quality)
    description = {
        "version": FEATURE_VERSIONS[include_quality],
        "names": names,
        "dtypes": ["float64"] * len(names),
        "forecast_horizon": HORIZONS,
    }
    text = json.dumps(description, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()
