"""Forecast errors, cross-validation summaries and the selection rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("series_id",)
# Order of simplicity, tolerances of the selection rule.
SIMPLICITY = {
    "seasonal_naive_24": 0,
    "seasonal_naive_168": 1,
    "ridge": 2,
    "hist_gradient_boosting": 3,
    "random_forest": 4,
}
MAE_TOLERANCE = 1.01
STD_TOLERANCE = 1.05


def pairs(frame: DataFrame, actual: str, predicted: str, keep: Sequence[str]) -> DataFrame:
    """``keep, horizon, actual, predicted`` from an array of targets and one of predictions."""
    cells = F.arrays_zip(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
    return frame.select(*keep, F.posexplode(cells).alias("place", "cell")).select(
        *keep,
        (F.col("place") + 1).alias("horizon"),
        F.col("cell")["actual"].alias("actual"),
        F.col("cell")["predicted"].alias("predicted"),
    )


def absolute_error() -> Column:
    return F.abs(F.col("actual") - F.col("predicted"))


def mae() -> Column:
    return F.avg(absolute_error())


def rmse() -> Column:
    error = F.col("actual") - F.col("predicted")
    return F.sqrt(F.avg(error * error))


def smape() -> Column:
    """Symmetric percentage error; zero against zero counts as no error."""
    size = F.abs(F.col("actual")) + F.abs(F.col("predicted"))
    return F.avg(F.when(size == 0, 0.0).otherwise(2 * absolute_error() / size)) * 100


def error_metrics(
    scored: DataFrame, by: Sequence[str], run: Sequence[str] | None = None, **extra: Column
) -> DataFrame:
    """MAE, RMSE and sMAPE of each group; ``evaluation_rows`` counts origins.

    With ``run`` given, a missing prediction anywhere in a run removes the whole run. The check
    is made on the aggregated rows, so the predictions are read once.
    """
    counted = scored.groupBy(*by).agg(
        F.count_if(F.col("horizon") == 1).alias("evaluation_rows"),
        *_errors(),
        *(column.alias(name) for name, column in extra.items()),
        F.count_if(F.col("predicted").isNull()).alias("lost"),
    )
    return _whole_runs(counted, run)


def horizon_metrics(
    scored: DataFrame, by: Sequence[str], run: Sequence[str] | None = None
) -> DataFrame:
    """Errors per horizon, pooled over all folds; ``run`` as in :func:`error_metrics`."""
    counted = scored.groupBy(*by, "horizon").agg(
        *_errors(), F.count_if(F.col("predicted").isNull()).alias("lost")
    )
    return _whole_runs(counted, run)


def _errors() -> list[Column]:
    return [mae().alias("mae"), rmse().alias("rmse"), smape().alias("smape")]


def _whole_runs(counted: DataFrame, run: Sequence[str] | None) -> DataFrame:
    if run is None:
        return counted.drop("lost")
    lost = F.sum("lost").over(Window.partitionBy(*run))
    return counted.withColumn("lost", lost).where("lost = 0").drop("lost")


def cv_summary(fold_metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the fold errors; folds count equally whatever their size.

    A group has one row per fold, and the median prediction time is taken when it was measured.
    """
    aggregates = [F.avg("mae").alias("mean_cv_mae"), F.stddev_pop("mae").alias("std_cv_mae")]
    if "predict_ms" in fold_metrics.columns:
        aggregates.append(F.percentile("predict_ms", 0.5).alias("predict_ms_median"))
    return fold_metrics.groupBy(*by).agg(*aggregates)


def improvement_percent(baseline: Column, model: Column) -> Column:
    """Gain over a baseline; undefined (an error) when only the baseline is perfect."""
    undefined = F.raise_error(F.lit("improvement is undefined for a zero baseline")).cast("double")
    return (
        F.when((baseline == 0) & (model == 0), 0.0)
        .when(baseline == 0, undefined)
        .otherwise((baseline - model) / baseline * 100)
    )


def best_candidate(summary: DataFrame, by: Sequence[str], params: str = "params") -> DataFrame:
    """Parameters with the least mean error, then least deviation, then canonical text."""
    order = F.struct("mean_cv_mae", "std_cv_mae", params)
    return summary.groupBy(*by).agg(
        F.min_by(F.struct(*(c for c in summary.columns if c not in by)), order).alias("best")
    ).select(*by, "best.*")


def select_recommended(candidates: DataFrame, experiment: Sequence[str] = SERIES) -> DataFrame:
    """Mark the recommended model of each experiment.

    Within 1 % of the least error, then within 5 % of the least deviation of those, the fastest
    wins; then the simplest; then the first by name. An experiment holds a handful of models.
    """
    group = Window.partitionBy(*experiment)
    ranks = F.create_map(*(F.lit(x) for pair in SIMPLICITY.items() for x in pair))
    near = F.col("mean_cv_mae") <= F.min("mean_cv_mae").over(group) * MAE_TOLERANCE
    steady_limit = F.min(F.when(F.col("near"), F.col("std_cv_mae"))).over(group) * STD_TOLERANCE
    finalists = F.when(F.col("near") & (F.col("std_cv_mae") <= F.col("steady_limit")), 0).otherwise(1)
    order = group.orderBy("outside", "predict_ms_median", ranks[F.col("algorithm")], "algorithm")
    return (
        candidates.withColumn("near", near)
        .withColumn("steady_limit", steady_limit)
        .withColumn("outside", finalists)
        .withColumn("is_recommended", F.row_number().over(order) == 1)
        .drop("near", "steady_limit", "outside")
    )
