"""Forecast and metric exports: flat CSV rows, nested JSON documents, comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterspark.functions.clock import iso

# Published column orders.
FORECAST_COLUMNS = (
    "forecast_id",
    "model_run_id",
    "dataset_version_id",
    "origin",
    "timezone",
    "algorithm",
    "feature_schema_version",
    "bundle_sha256",
    "total_energy_kwh",
    "horizon",
    "target_time",
    "predicted_energy_kwh",
    "actual_energy_kwh",
)
METRIC_COLUMNS = (
    "experiment_id",
    "model_run_id",
    "algorithm",
    "status",
    "is_recommended",
    "hyperparameters_json",
    "row_type",
    "fold_no",
    "evaluation_scope",
    "horizon",
    "evaluation_rows",
    "mae",
    "rmse",
    "smape",
    "mean_cv_mae",
    "std_cv_mae",
    "final_mae",
    "final_rmse",
    "final_smape",
    "predict_ms_median",
    "failure_code",
)
FORMULA_PATTERN = "^([\\t\\r\\n]|[ \\t\\r\\n]*[=+\\-@])"
MODEL_COLUMNS = (
    "model_run_id",
    "algorithm",
    "status",
    "hyperparameters_json",
    "mean_cv_mae",
    "std_cv_mae",
    "final_mae",
    "final_rmse",
    "final_smape",
    "predict_ms_median",
    "is_recommended",
    "failure_code",
)


def neutral_text(text: Column) -> Column:
    """Text a spreadsheet would run as a formula gets a leading quote mark."""
    return F.when(text.rlike(FORMULA_PATTERN), F.concat(F.lit("'"), text)).otherwise(text)


def csv_cells(df: DataFrame) -> DataFrame:
    """Every column as CSV text: null empty, times ISO, booleans lower case, text neutralised."""
    cells = []
    for field in df.schema.fields:
        column, kind = F.col(field.name), field.dataType.typeName()
        if kind == "string":
            text = neutral_text(column)
        elif kind in ("timestamp_ntz", "timestamp"):
            text = iso(column)
        else:
            text = column.cast("string")
        cells.append(F.coalesce(text, F.lit("")).alias(field.name))
    return df.select(*cells)


def write_csv(df: DataFrame, path: str) -> None:
    csv_cells(df).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def forecast_rows(forecasts: DataFrame, points: DataFrame) -> DataFrame:
    """One row per point with the header of its forecast repeated, in the fixed column order."""
    if "actual_energy_kwh" not in points.columns:
        points = points.withColumn("actual_energy_kwh", F.lit(None).cast("double"))
    return forecasts.join(points, "forecast_id").select(*FORECAST_COLUMNS)


def with_actuals(points: DataFrame, hourly: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill the actual energy of the target hours that are stored by now."""
    stored = hourly.select(
        *keys,
        F.col("hour_start").alias("target_time"),
        F.col("energy_kwh").alias("actual_energy_kwh"),
    )
    return points.drop("actual_energy_kwh").join(stored, [*keys, "target_time"], "left")


def forecast_provenance(
    forecasts: DataFrame, runs: DataFrame, experiments: DataFrame, versions: DataFrame
) -> DataFrame:
    """Forecast headers with the run, experiment and dataset version they come from."""
    return (
        forecasts.join(runs.select("model_run_id", "experiment_id", "algorithm"), "model_run_id")
        .join(experiments.select("experiment_id", "dataset_version_id", "experiment_name"), "experiment_id")
        .join(versions.select("dataset_version_id", "dataset_id", "version_no"), "dataset_version_id")
    )


def chart_documents(rows: DataFrame) -> DataFrame:
    """``forecast_id, chart``: one JSON object per forecast with its 24 points in order."""
    point = F.struct(
        F.col("horizon"),
        iso(F.col("target_time")).alias("timestamp"),
        F.col("predicted_energy_kwh"),
        F.col("actual_energy_kwh"),
    )
    header = ("forecast_id", "origin", "timezone", "total_energy_kwh")
    nested = rows.groupBy(*header).agg(
        F.array_sort(F.collect_list(point)).alias("points")
    )
    ordered = F.transform(
        "points",
        lambda p: F.struct(
            p["actual_energy_kwh"].alias("actual_energy_kwh"),
            p["horizon"].alias("horizon"),
            p["predicted_energy_kwh"].alias("predicted_energy_kwh"),
            p["timestamp"].alias("timestamp"),
        ),
    )
    document = F.struct(
        F.col("forecast_id"),
        iso(F.col("origin")).alias("origin"),
        F.lit("forecast-chart-data/v1").alias("schema"),
        ordered.alias("series"),
        F.col("timezone"),
        F.col("total_energy_kwh"),
        F.lit("kWh").alias("unit"),
    )
    return nested.select(
        "forecast_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("chart")
    )


def metric_rows(
    runs: DataFrame, fold_metrics: DataFrame, horizon_metrics: DataFrame
) -> DataFrame:
    """Summary, fold and horizon rows of every run stacked in the fixed column order."""
    base = runs.select(
        "experiment_id",
        "model_run_id",
        "algorithm",
        "status",
        "is_recommended",
        "hyperparameters_json",
        "failure_code",
    )
    summary = runs.withColumn("row_type", F.lit("summary"))
    folds = base.join(fold_metrics, "model_run_id").withColumn("row_type", F.lit("fold"))
    horizons = base.join(horizon_metrics, "model_run_id").withColumn("row_type", F.lit("horizon"))
    stacked = summary.unionByName(folds, allowMissingColumns=True).unionByName(
        horizons, allowMissingColumns=True
    )
    return stacked.select(*METRIC_COLUMNS)


def model_comparison(
    runs: DataFrame, fold_metrics: DataFrame, horizon_metrics: DataFrame
) -> DataFrame:
    """One row per run with its folds and horizons as ordered arrays, joined in one plan.

    A run has as many folds as the split plan and 24 horizons per scope.
    """
    folds = fold_metrics.groupBy("model_run_id").agg(
        F.array_sort(
            F.collect_list(F.struct("fold_no", "evaluation_rows", "mae", "rmse", "smape"))
        ).alias("fold_metrics")
    )
    horizons = horizon_metrics.groupBy("model_run_id").agg(
        F.array_sort(
            F.collect_list(F.struct("evaluation_scope", "horizon", "mae", "rmse", "smape"))
        ).alias("horizon_metrics")
    )
    return (
        runs.select("experiment_id", *MODEL_COLUMNS)
        .join(folds, "model_run_id", "left")
        .join(horizons, "model_run_id", "left")
    )


def comparison_order() -> list[Column]:
    """Runs with a cross-validation error first, least error first, then by name."""
    return [F.col("mean_cv_mae").asc_nulls_last(), F.col("algorithm").asc()]


def metric_documents(comparison: DataFrame, experiments: DataFrame) -> DataFrame:
    """``experiment_id, metrics``: one JSON object per experiment, object keys in sorted order."""

    def in_order(array: str, fields: Sequence[str]) -> Column:
        return F.transform(array, lambda m: F.struct(*(m[f].alias(f) for f in fields)))

    nested = {
        "fold_metrics": ("evaluation_rows", "fold_no", "mae", "rmse", "smape"),
        "horizon_metrics": ("evaluation_scope", "horizon", "mae", "rmse", "smape"),
    }
    model = {name: F.col(name) for name in MODEL_COLUMNS if name != "hyperparameters_json"}
    model["hyperparameters"] = F.parse_json("hyperparameters_json")
    model |= {name: in_order(name, fields) for name, fields in nested.items()}
    models = comparison.groupBy("experiment_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.coalesce("mean_cv_mae", F.lit(float("inf"))).alias("place"),
                    F.col("algorithm"),
                    F.struct(*(model[name].alias(name) for name in sorted(model))).alias("model"),
                )
            ),
            _by_place,
        ).alias("models")
    )
    fields = {c: F.col(c) for c in experiments.columns if c != "experiment_id"}
    fields["id"] = F.col("experiment_id")
    document = F.struct(
        F.struct(*(fields[name].alias(name) for name in sorted(fields))).alias("experiment"),
        F.transform("models", lambda m: m["model"]).alias("models"),
        F.lit("experiment-metrics-export/v1").alias("schema"),
    )
    return models.join(experiments, "experiment_id").select(
        "experiment_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("metrics")
    )


def _by_place(left: Column, right: Column) -> Column:
    return (
        F.when(left["place"] < right["place"], -1)
        .when(left["place"] > right["place"], 1)
        .when(left["algorithm"] < right["algorithm"], -1)
        .when(left["algorithm"] > right["algorithm"], 1)
        .otherwise(0)
    )
