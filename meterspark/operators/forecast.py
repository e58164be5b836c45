"""24-step forecasts, one per series, from a stored origin."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterspark.functions.clock import HOUR, epoch
from meterspark.operators.features import build_features, eligible_features, quality_view
from meterspark.operators.splits import instant
from meterspark.schemas import LAGS, VALID_HOUR, feature_digest

SERIES = ("series_id",)


def check_manifest(
    manifest: Mapping[str, object], *, algorithm: str, dataset_version_id: str, quality: bool = False
) -> None:
    """Refuse a model trained on another version, algorithm or feature schema."""
    expected = {
        "algorithm": algorithm,
        "dataset_version_id": dataset_version_id,
        "feature_schema_sha256": feature_digest(quality),
    }
    wrong = [name for name, value in expected.items() if manifest.get(name) != value]
    if wrong:
        raise ValueError(f"the model does not match the data: {', '.join(wrong)}")


def valid_origin() -> Column:
    return F.col("energy_kwh").isNotNull() & F.col("quality_status").isin(*VALID_HOUR)


def latest_origins(hourly: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Latest stored hour of each series that holds energy and a valid status."""
    return hourly.groupBy(*keys).agg(
        F.max(F.when(valid_origin(), F.col("hour_start"))).alias("origin")
    )


def requested_origins(
    hourly: DataFrame, origin: datetime, keys: Sequence[str] = SERIES
) -> DataFrame:
    """``origin`` for the series where it is a valid stored hour, null elsewhere."""
    if origin.tzinfo is not None:
        raise ValueError("give the origin as a UTC time without an offset")
    if origin.minute or origin.second or origin.microsecond:
        raise ValueError("the origin must be a whole hour")
    return hourly.groupBy(*keys).agg(
        F.max(
            F.when(valid_origin() & (F.col("hour_start") == instant(origin)), F.col("hour_start"))
        ).alias("origin")
    )


def origin_rows(
    hourly: DataFrame,
    origins: DataFrame,
    *,
    timezone: str = "UTC",
    quality: bool = False,
    step: int = HOUR,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Features and baseline values at the origins; only the last 168 steps before them are read."""
    start = F.col("forecast_origin")
    history = hourly.join(origins.withColumnRenamed("origin", "forecast_origin"), list(keys)).where(
        (F.col("hour_start") <= start)
        & (epoch(F.col("hour_start")) >= epoch(start) - max(LAGS) * step)
    )
    frame = build_features(
        history, timezone=timezone, quality=quality, naive=True, step=step, keys=keys
    )
    return frame.join(origins, [*keys, "origin"], "left_semi")


def forecast_errors(
    origins: DataFrame, rows: DataFrame, predicted: str, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Series without a forecast and why."""
    usable = eligible_features(rows).select(
        *keys, F.forall(predicted, lambda v: v.isNotNull()).alias("whole")
    )
    return (
        origins.join(usable, list(keys), "left")
        .select(
            *keys,
            F.when(F.col("origin").isNull(), "origin_invalid")
            .when(~F.coalesce("whole", F.lit(False)), "history_missing")
            .alias("error"),
        )
        .where(F.col("error").isNotNull())
    )


def forecast_points(
    rows: DataFrame, predicted: str, *, step: int = HOUR, keys: Sequence[str] = SERIES
) -> DataFrame:
    """``keys, origin, horizon, target_time, predicted_energy_kwh``; negatives become zero.

    A series with a missing prediction has no points at all.
    """
    whole = rows.where(F.forall(predicted, lambda v: v.isNotNull()))
    points = whole.select(*keys, "origin", F.posexplode(predicted).alias("place", "value"))
    horizon = F.col("place") + 1
    return points.select(
        *keys,
        "origin",
        horizon.cast("long").alias("horizon"),
        (F.col("origin") + F.make_dt_interval(secs=horizon * step))
        .cast("timestamp_ntz")
        .alias("target_time"),
        F.greatest("value", F.lit(0.0)).alias("predicted_energy_kwh"),
    )


def naive_forecast(
    hourly: DataFrame,
    period: int = 24,
    *,
    mode: str = "complete_only",
    origins: DataFrame | None = None,
    step: int = HOUR,
    timezone: str = "UTC",
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Seasonal forecast of every series from its latest valid hour."""
    view = quality_view(hourly, mode)
    origins = latest_origins(view, keys) if origins is None else origins
    rows = origin_rows(view, origins, timezone=timezone, step=step, keys=keys)
    return forecast_points(eligible_features(rows), f"naive_{period}", step=step, keys=keys)


def forecast_totals(points: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return points.groupBy(*keys, "origin").agg(
        F.count(F.lit(1)).alias("point_count"),
        F.sum("predicted_energy_kwh").alias("total_energy_kwh"),
    )
