"""Stored models: weights or trees with a manifest, written once and checked before each use.

A bundle is a folder with ``models`` (a table of ridge weights, or one fitted regressor a horizon) and
``manifest`` (one JSON row). The manifest comes last, so a folder without it was not written completely
and is refused. The quality view belongs to the model: training and forecasting apply the same one.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.functions.clock import HOUR
from meterspark.operators.features import build_features, eligible_features, eligible_supervised, quality_view
from meterspark.operators.forecast import check_manifest, forecast_points, latest_origins, origin_rows
from meterspark.operators.ridge import DEFAULT_ALPHA, FINAL_FOLD, fit_ridge, predict_ridge
from meterspark.operators.splits import SplitPlan, final_training
from meterspark.operators.trees import fit_trees, predict_trees
from meterspark.schemas import HORIZONS, feature_digest

_READERS = {"random_forest": RandomForestRegressionModel, "hist_gradient_boosting": GBTRegressionModel}


@dataclass(frozen=True)
class Bundle:
    """A loaded bundle; ``models`` is a table of weights or a list of regressors in horizon order."""

    manifest: Mapping[str, Any]
    models: Any


def train_bundle(
    hourly: DataFrame,
    plan: SplitPlan,
    algorithm: str,
    path: str,
    *,
    dataset_version_id: str,
    mode: str | None = "complete_only",
    params: Mapping[str, Any] | None = None,
    timezone: str = "UTC",
    quality: bool = False,
    step: int = HOUR,
) -> None:
    """Fit one algorithm on everything before the test period and store it under ``path``.

    With ``mode`` None all hours with energy count. An existing bundle is never overwritten.
    """
    params = dict(params or {})
    view = _view(hourly, mode)
    frame = eligible_supervised(
        build_features(view, timezone=timezone, step=step, quality=quality, targets=True), quality=quality
    )
    spark = hourly.sparkSession
    if algorithm == "ridge":
        alpha = float(params.setdefault("alpha", DEFAULT_ALPHA))
        models = fit_ridge(frame, plan, (alpha,), quality=quality)
        models.where(F.col("fold_no") == FINAL_FOLD).write.parquet(f"{path}/models")
    elif algorithm in _READERS:
        training = final_training(frame, plan).persist()
        try:
            fitted = fit_trees(training, algorithm, params, quality=quality)
        finally:
            training.unpersist()
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda item: item[1].save(f"{path}/models/{item[0]:02d}"), enumerate(fitted, 1)))
    else:
        raise ValueError(f"no model to store: {algorithm}")
    manifest = {
        "algorithm": algorithm,
        "dataset_version_id": dataset_version_id,
        "feature_schema_sha256": feature_digest(quality),
        "mode": mode,
        "quality": quality,
        "step": step,
        "timezone": timezone,
        "params": params,
    }
    row = spark.range(1).select(F.lit(json.dumps(manifest, sort_keys=True)).alias("value"))
    row.write.text(f"{path}/manifest")


def _view(hourly: DataFrame, mode: str | None) -> DataFrame:
    return hourly if mode is None else quality_view(hourly, mode)


def load_bundle(spark: SparkSession, path: str, *, algorithm: str, dataset_version_id: str, quality: bool = False) -> Bundle:
    """Read a bundle; one of another algorithm, dataset version or feature schema is refused."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    check_manifest(manifest, algorithm=algorithm, dataset_version_id=dataset_version_id, quality=quality)
    if algorithm == "ridge":
        return Bundle(manifest, spark.read.parquet(f"{path}/models"))
    reader = _READERS[algorithm]
    with ThreadPoolExecutor(4) as pool:
        models = list(pool.map(lambda h: reader.load(f"{path}/models/{h:02d}"), range(1, HORIZONS + 1)))
    return Bundle(manifest, models)


def forecast_from_bundle(hourly: DataFrame, bundle: Bundle, *, origins: DataFrame | None = None) -> DataFrame:
    """Forecast points of every series from its latest valid hour under the bundle's own view."""
    kept = bundle.manifest
    view = _view(hourly, kept["mode"])
    origins = latest_origins(view) if origins is None else origins
    rows = origin_rows(view, origins, timezone=kept["timezone"], quality=kept["quality"], step=kept["step"])
    rows = eligible_features(rows, quality=kept["quality"])
    if kept["algorithm"] == "ridge":
        rows = rows.withColumn("fold_no", F.lit(FINAL_FOLD))
        predicted = predict_ridge(rows, bundle.models, quality=kept["quality"])
    else:
        predicted = predict_trees(rows, bundle.models, ["series_id", "origin"], quality=kept["quality"])
    return forecast_points(predicted, "predicted", step=kept["step"])
