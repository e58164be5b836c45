"""Registered queries: features, folds, baselines, models and forecasts on daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.functions.clock import DAY
from meterspark.operators import bundles as B
from meterspark.operators import experiment as X
from meterspark.operators import features as FE
from meterspark.operators import forecast as FC
from meterspark.operators import metrics as M
from meterspark.operators import ridge as R
from meterspark.operators import splits as S
from meterspark.operators import trees as T
from meterspark.plans.inputs import (
    DAILY_SQL,
    GRID_SQL,
    HOURLY_SQL,
    daily_quantity,
    hourly_events,
    rounded,
)
from meterspark.schemas import (
    CALENDAR_FEATURES,
    HORIZONS,
    LAG_FEATURES,
    LAGS,
    QUALITY_FEATURES,
    ROLLING_FEATURES,
    ROLLING_MEANS,
    target_names,
)
from meterspark.session import scratch_folder

ZONE = "Europe/Kyiv"
PLAN = S.SplitPlan.quarters(2000, DAY)
# Smaller ensembles than the defaults: the registered runs show the operators, not tuned models.
FOREST = {"n_estimators": 10, "max_depth": 6}
BOOSTING = {"max_iter": 5, "max_leaf_nodes": 15}


def _frame(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return FE.build_features(daily_quantity(spark, sf_dir), timezone=ZONE, step=DAY, **options)


def _supervised(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return FE.eligible_supervised(_frame(spark, sf_dir, targets=True, **options))


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.build_features(hourly_events(spark, sf_dir), timezone=ZONE, quality=True, targets=True)


def _columns(names):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(_frame(spark, sf_dir, quality=True).select("series_id", "origin", *names))

    return query


def features_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_hours(spark, sf_dir).select("series_id", "origin", *CALENDAR_FEATURES))


def targets_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _frame(spark, sf_dir, targets=True)
    return rounded(frame.select("series_id", "origin", *FE.target_columns()))


def eligible_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _supervised(spark, sf_dir).select("series_id", "origin")


def eligible_origins_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.eligible_supervised(_hours(spark, sf_dir), quality=True).select("series_id", "origin")


def sensitivity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = hourly_events(spark, sf_dir)
    views = [
        FE.quality_view(hourly, mode).withColumn("mode", F.lit(mode))
        for mode in ("complete_only", "coverage_90")
    ]
    return rounded(views[0].unionByName(views[1]))


def fold_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.fold_membership(eligible_origins(spark, sf_dir), PLAN))


def fold_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    membership = S.fold_membership(eligible_origins(spark, sf_dir), PLAN)
    return rounded(S.fold_bounds(membership, PLAN))


def empty_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of the last year that some series cannot be evaluated on, as they end before it does."""
    plan = S.SplitPlan.quarters(2001, DAY)
    bounds = S.fold_bounds(S.fold_membership(eligible_origins(spark, sf_dir), plan), plan)
    return rounded(S.empty_folds(bounds).select("series_id", "fold_no", "train_rows", "evaluation_rows"))


def final_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    origins = eligible_origins(spark, sf_dir)
    test = S.final_test(origins, PLAN).withColumn("part", F.lit("test"))
    return test.unionByName(S.final_training(origins, PLAN).withColumn("part", F.lit("train")))


def _naive_predictions(period: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = S.final_test(_supervised(spark, sf_dir, naive=True), PLAN)
        scored = M.pairs(rows, "targets", f"naive_{period}", ["series_id", "origin"])
        return rounded(scored)

    return query


def naive_missing_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = FE.build_features(
        FE.quality_view(daily_quantity(spark, sf_dir), "complete_only"), step=DAY, naive=True
    )
    return X.naive_missing_history(S.final_test(frame, PLAN), 24, DAY)


def _naive_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.validation_rows(_supervised(spark, sf_dir, naive=True), PLAN)
    return X.naive_scored(rows, ["series_id", "fold_no", "origin"])


def _fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = ["series_id", "algorithm"]
    return M.error_metrics(_naive_scored(spark, sf_dir), [*run, "fold_no"], run)


def cv_fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fold_metrics(spark, sf_dir))


def cv_horizon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = ["series_id", "algorithm"]
    return rounded(M.horizon_metrics(_naive_scored(spark, sf_dir), run, run))


def cv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.cv_summary(_fold_metrics(spark, sf_dir), ["series_id", "algorithm"]))


def improvement_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of each baseline over the daily one in every fold."""
    folds = _fold_metrics(spark, sf_dir)
    base = folds.where("algorithm = 'seasonal_naive_24'").select(
        "series_id", "fold_no", F.col("mae").alias("baseline_mae")
    )
    gain = M.improvement_percent(F.col("baseline_mae"), F.col("mae"))
    return rounded(
        folds.join(base, ["series_id", "fold_no"]).select(
            "series_id", "algorithm", "fold_no", gain.alias("improvement_pct")
        )
    )


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every algorithm name with errors and times taken from part and supplier figures."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = F.array(*(F.lit(n) for n in M.SIMPLICITY))
    return part.select(
        F.col("p_size").alias("experiment_id"),
        F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("algorithm"),
        F.col("p_retailprice").alias("price"),
        F.col("p_partkey").alias("key"),
    ).groupBy("experiment_id", "algorithm").agg(
        (F.round(F.avg("price") / 10, 0) * 10).alias("mean_cv_mae"),
        F.round(F.min("price") / 100, 0).alias("std_cv_mae"),
        (F.count(F.lit(1)) % 3).cast("double").alias("predict_ms_median"),
    )


def select_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.select_recommended(_candidates(spark, sf_dir), ["experiment_id"]))


def final_test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The better baseline of each series by cross-validation, scored on the test period."""
    frame = _supervised(spark, sf_dir, naive=True)
    summary = M.cv_summary(_fold_metrics(spark, sf_dir), ["series_id", "algorithm"])
    chosen = M.select_recommended(summary.withColumn("predict_ms_median", F.lit(0.0)))
    scored = X.naive_scored(S.final_test(frame, PLAN), ["series_id", "origin"]).join(
        chosen.where("is_recommended").select("series_id", "algorithm"), ["series_id", "algorithm"]
    )
    return rounded(M.error_metrics(scored, ["series_id", "algorithm"]))


def scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.scaled_features(_supervised(spark, sf_dir), PLAN)).select(
        "series_id", "fold_no", "part", "origin", "lag_1", "rolling_mean_168", "day_of_week_sin"
    )


def ridge_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fit_ridge(_supervised(spark, sf_dir), PLAN)


def ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation error of every penalty."""
    scored = X.ridge_scored(_supervised(spark, sf_dir), PLAN)
    folds = M.error_metrics(scored, ["series_id", "params", "fold_no"])
    return M.cv_summary(folds, ["series_id", "params"])


def ridge_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = daily_quantity(spark, sf_dir)
    models = R.fit_ridge(_supervised(spark, sf_dir), PLAN, (R.DEFAULT_ALPHA,)).where("fold_no = 0")
    view = FE.quality_view(hourly, "coverage_90")
    origins = FC.latest_origins(view)
    rows = FC.origin_rows(hourly, origins, timezone=ZONE, step=DAY)
    rows = FE.eligible_features(rows).withColumn("fold_no", F.lit(R.FINAL_FOLD))
    return FC.forecast_points(R.predict_ridge(rows, models), "predicted", step=DAY)


def _tree_forecast(algorithm: str, params: dict):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hourly = daily_quantity(spark, sf_dir)
        training = S.final_training(_supervised(spark, sf_dir), PLAN).persist()
        models = T.fit_trees(training, algorithm, params)
        training.unpersist()
        origins = FC.latest_origins(FE.quality_view(hourly, "coverage_90"))
        rows = FE.eligible_features(FC.origin_rows(hourly, origins, timezone=ZONE, step=DAY))
        predicted = T.predict_trees(rows, models, ["series_id", "origin"])
        return FC.forecast_points(predicted, "predicted", step=DAY)

    return query


def experiment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All series through baselines and ridge: cross-validation, selection and final test."""
    return X.run_experiment(_supervised(spark, sf_dir, naive=True), PLAN).model_runs


def experiment_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baselines through the whole experiment: runs, reasons of failures, selection and final test."""
    runs = X.run_experiment(_supervised(spark, sf_dir, naive=True), PLAN, tuple(X.NAIVE)).model_runs
    return rounded(
        runs.select(
            "series_id", "algorithm", "status", "failure_detail", "mean_cv_mae", "std_cv_mae", "is_recommended",
            "final_mae", "final_rmse", "final_smape",
        )
    )


def ridge_bundle_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge trained over all series, stored as a bundle, checked and loaded, and used for forecasts."""
    hourly = daily_quantity(spark, sf_dir)
    path = scratch_folder(spark, "bundle")
    kept = {"algorithm": "ridge", "dataset_version_id": "lineitem"}
    B.train_bundle(hourly, PLAN, path=path, mode=None, timezone=ZONE, step=DAY, **kept)
    return B.forecast_from_bundle(hourly, B.load_bundle(spark, path, **kept))


def forecast_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FC.latest_origins(FE.quality_view(daily_quantity(spark, sf_dir), "complete_only"))


def forecast_naive24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(FC.naive_forecast(_full(hourly_events(spark, sf_dir)), 24, mode="coverage_90"))


def _full(hourly: DataFrame) -> DataFrame:
    """Hours with energy count as covered, so that a week without breaks exists at small scale."""
    return hourly.withColumn(
        "coverage_ratio", F.when(F.col("energy_kwh").isNotNull(), 1.0).otherwise(0.0)
    ).withColumn("quality_status", F.lit("valid_partial"))


def forecast_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = FC.naive_forecast(_full(hourly_events(spark, sf_dir)), 168, mode="coverage_90")
    return rounded(FC.forecast_totals(points))


def origins_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.origins_fingerprint(eligible_origins(spark, sf_dir))


QUERIES = {
    "features_lags": _columns(LAG_FEATURES),
    "features_rolling": _columns(ROLLING_FEATURES),
    "features_quality": _columns(QUALITY_FEATURES),
    "features_calendar": features_calendar,
    "targets_24": targets_24,
    "eligible_origins": eligible_origins,
    "eligible_origins_hourly": eligible_origins_hourly,
    "sensitivity_view": sensitivity_view,
    "origins_fingerprint": origins_fingerprint,
    "fold_membership": fold_membership,
    "fold_bounds": fold_bounds,
    "empty_folds": empty_folds,
    "final_test_rows": final_test_rows,
    "naive24_predictions": _naive_predictions(24),
    "naive168_predictions": _naive_predictions(168),
    "naive_missing_history": naive_missing_history,
    "cv_fold_metrics": cv_fold_metrics,
    "cv_horizon_metrics": cv_horizon_metrics,
    "cv_summary": cv_summary,
    "improvement_pct": improvement_pct,
    "select_model": select_model,
    "final_test_metrics": final_test_metrics,
    "scaled_features": scaled_features,
    "ridge_models": ridge_models,
    "ridge_cv": ridge_cv,
    "ridge_forecast": ridge_forecast,
    "forest_forecast": _tree_forecast("random_forest", FOREST),
    "boosting_forecast": _tree_forecast("hist_gradient_boosting", BOOSTING),
    "ridge_bundle_forecast": ridge_bundle_forecast,
    "experiment_runs": experiment_runs,
    "experiment_naive": experiment_naive,
    "forecast_origin": forecast_origin,
    "forecast_naive24": forecast_naive24,
    "forecast_totals": forecast_totals,
}

_W = "PARTITION BY series_id ORDER BY origin"


def _past(rows: int) -> str:
    return f"({_W} ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)"


def _guarded(expression: str, column: str, rows: int) -> str:
    frame = _past(rows)
    return f"CASE WHEN count({column}) OVER {frame} = {rows} THEN {expression} OVER {frame} END"


_LAGS = ", ".join(f"round(lag(energy_kwh, {n}) OVER ({_W}), 6) AS lag_{n}" for n in LAGS)
_ROLLING = ", ".join(
    [
        f"round({_guarded('avg(energy_kwh)', 'energy_kwh', n)}, 6) AS rolling_mean_{n}"
        for n in ROLLING_MEANS
    ]
    + [
        f"round({_guarded(f'{f}(energy_kwh)', 'energy_kwh', 24)}, 6) AS rolling_{name}_24"
        for f, name in (("stddev_pop", "std"), ("min", "min"), ("max", "max"))
    ]
)
_QUALITY = f"""round({_guarded('avg(coverage_ratio)', 'coverage_ratio', 24)}, 6) AS past_24h_coverage_mean,
  CASE WHEN count(*) OVER {_past(168)} = 168
       THEN CAST(count(*) OVER {_past(168)} - count(energy_kwh) OVER {_past(168)} AS DOUBLE)
  END AS past_168h_missing_hours,
  CASE WHEN lag(quality_status) OVER ({_W}) = 'imputed_short_gap' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  AS last_hour_imputed"""
_HOUR_GRID = f"""{HOURLY_SQL}, ends AS (
  SELECT series_id, min(hour_start) AS lo, max(hour_start) AS hi FROM h GROUP BY 1
), g AS (
  SELECT s.series_id, s.origin, h.energy_kwh, h.coverage_ratio, h.quality_status
  FROM (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL '1 hour')) AS origin FROM ends) s
  LEFT JOIN h ON h.series_id = s.series_id AND h.hour_start = s.origin
)"""
_CIVIL = f"(origin AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}')"
_LEADS = ", ".join(
    f"lead(energy_kwh, {h}) OVER ({_W}) AS {name}" for h, name in enumerate(target_names(), 1)
)
_FUTURE = f"({_W} ROWS BETWEEN 1 FOLLOWING AND {HORIZONS} FOLLOWING)"
_ELIGIBLE = f"""el AS (
  SELECT series_id, origin FROM (
    SELECT series_id, origin, count(energy_kwh) OVER {_past(168)} AS past,
           count(energy_kwh) OVER {_FUTURE} AS future FROM g)
  WHERE past = 168 AND future = {HORIZONS}
)"""
_SUPERVISED = f"{GRID_SQL}, {_ELIGIBLE}"
_FOLDS = """fo AS (
  SELECT * FROM (VALUES
    (1, TIMESTAMP '2000-01-01', TIMESTAMP '2000-04-01'), (2, TIMESTAMP '2000-04-01', TIMESTAMP '2000-07-01'),
    (3, TIMESTAMP '2000-07-01', TIMESTAMP '2000-10-01'), (4, TIMESTAMP '2000-10-01', TIMESTAMP '2001-01-01')
  ) t(fold_no, val_start, val_end)
), mem AS (
  SELECT series_id, origin, CAST(fold_no AS BIGINT) AS fold_no,
         CASE WHEN origin >= val_start THEN 'validation' ELSE 'train' END AS part
  FROM el JOIN fo ON origin < val_start - INTERVAL '24 days' OR (origin >= val_start AND origin < val_end)
)"""

# The same quarters one year later.
_LATE_FOLDS = _FOLDS.replace("'2001-", "'2002-").replace("'2000-", "'2001-")


def _scored(where: str) -> str:
    return f"""sc AS (
  SELECT o.series_id, o.origin, o.fold_no, a.algorithm, x.h AS horizon,
         t.energy_kwh AS actual, p.energy_kwh AS predicted
  FROM ({where}) o
  CROSS JOIN (SELECT unnest(generate_series(1, {HORIZONS})) AS h) x
  CROSS JOIN (VALUES ('seasonal_naive_24', 24), ('seasonal_naive_168', 168)) a(algorithm, period)
  LEFT JOIN g t ON t.series_id = o.series_id AND t.origin = o.origin + to_days(CAST(x.h AS INTEGER))
  LEFT JOIN g p ON p.series_id = o.series_id AND p.origin = o.origin + to_days(CAST(x.h - a.period AS INTEGER))
)"""


_CV_SCORED = _scored("SELECT * FROM mem WHERE part = 'validation'")
_OK = """ok AS (
  SELECT * FROM sc WHERE (series_id, algorithm) NOT IN (
    SELECT (series_id, algorithm) FROM sc WHERE predicted IS NULL)
)"""
_ERRORS = """round(avg(abs(actual - predicted)), 6) AS mae,
       round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse,
       round(avg(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0
             ELSE 2 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END) * 100, 6) AS smape"""
_CV = f"WITH {_SUPERVISED}, {_FOLDS}, {_CV_SCORED}, {_OK}"
_FM = """fm AS (
  SELECT series_id, algorithm, fold_no, avg(abs(actual - predicted)) AS mae FROM ok GROUP BY 1, 2, 3
)"""
_TEST = "SELECT series_id, origin, 0 AS fold_no FROM el WHERE origin >= TIMESTAMP '2001-01-01'"


def _naive_oracle(period: int) -> str:
    return f"""WITH {_SUPERVISED}, {_scored(_TEST)}
SELECT series_id, origin, horizon, round(actual, 6) AS actual, round(predicted, 6) AS predicted
FROM sc WHERE algorithm = 'seasonal_naive_{period}'"""


def _forecast_sql(period: int) -> str:
    return f"""WITH {HOURLY_SQL}, og AS (
  SELECT series_id, max(hour_start) AS origin FROM h WHERE energy_kwh IS NOT NULL GROUP BY 1
), whole AS (
  SELECT og.* FROM og JOIN h ON h.series_id = og.series_id AND h.hour_start < og.origin
    AND h.hour_start >= og.origin - INTERVAL '168 hours'
  GROUP BY 1, 2 HAVING count(energy_kwh) = 168
), pts AS (
  SELECT w.series_id, w.origin, x.h AS horizon, w.origin + to_hours(CAST(x.h AS INTEGER)) AS target_time,
         greatest(h.energy_kwh, 0) AS predicted_energy_kwh
  FROM whole w CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS h) x
  JOIN h ON h.series_id = w.series_id AND h.hour_start = w.origin + to_hours(CAST(x.h - {period} AS INTEGER))
)"""


ORACLE = {
    "features_lags": f"WITH {GRID_SQL} SELECT series_id, origin, {_LAGS} FROM g",
    "features_rolling": f"WITH {GRID_SQL} SELECT series_id, origin, {_ROLLING} FROM g",
    "features_quality": f"WITH {GRID_SQL} SELECT series_id, origin, {_QUALITY} FROM g",
    "features_calendar": f"""WITH {_HOUR_GRID}, p AS (
  SELECT series_id, origin, CAST(hour({_CIVIL}) AS DOUBLE) AS hh,
         CAST(isodow({_CIVIL}) - 1 AS DOUBLE) AS dow, CAST(day({_CIVIL}) AS DOUBLE) AS dom,
         CAST(month({_CIVIL}) AS DOUBLE) AS mo FROM g
)
SELECT series_id, origin, hh AS hour, dow AS day_of_week, dom AS day_of_month, mo AS month,
       CASE WHEN dow >= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_weekend,
       round(sin(2 * pi() * hh / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hh / 24), 6) + 0.0 AS hour_cos,
       round(sin(2 * pi() * dow / 7), 6) + 0.0 AS day_of_week_sin,
       round(cos(2 * pi() * dow / 7), 6) + 0.0 AS day_of_week_cos,
       round(sin(2 * pi() * (mo - 1) / 12), 6) + 0.0 AS month_sin,
       round(cos(2 * pi() * (mo - 1) / 12), 6) + 0.0 AS month_cos
FROM p""",
    "targets_24": f"WITH {GRID_SQL} SELECT series_id, origin, {_LEADS} FROM g",
    "eligible_origins": f"WITH {_SUPERVISED} SELECT * FROM el",
    "eligible_origins_hourly": f"WITH {_HOUR_GRID}, {_ELIGIBLE} SELECT * FROM el",
    "sensitivity_view": f"""WITH {HOURLY_SQL}
SELECT series_id, hour_start, coverage_ratio_6 AS coverage_ratio, quality_status, mode,
       CASE WHEN mode = 'complete_only' AND quality_status = 'complete' THEN round(energy_kwh, 6)
            WHEN mode = 'coverage_90' AND coverage_ratio >= 0.9 AND quality_status IN
              ('complete', 'imputed_short_gap', 'valid_partial') THEN round(energy_kwh, 6) END AS energy_kwh
FROM (SELECT *, round(coverage_ratio, 6) AS coverage_ratio_6 FROM h)
CROSS JOIN (VALUES ('complete_only'), ('coverage_90')) m(mode)""",
    "origins_fingerprint": f"""WITH {_SUPERVISED}
SELECT series_id, count(*) AS origin_count,
       sha256(string_agg(strftime(origin, '%Y-%m-%dT%H:%M:%S+00:00'), chr(10) ORDER BY origin))
       AS eligible_origins_sha256 FROM el GROUP BY 1""",
    "fold_membership": f"WITH {_SUPERVISED}, {_FOLDS} SELECT * FROM mem",
    "fold_bounds": f"""WITH {_SUPERVISED}, {_FOLDS}
SELECT series_id, fold_no, count(*) FILTER (WHERE part = 'train') AS train_rows,
       count(*) FILTER (WHERE part = 'validation') AS evaluation_rows,
       min(origin) FILTER (WHERE part = 'train') AS train_start,
       max(origin) FILTER (WHERE part = 'train') AS train_end
FROM mem GROUP BY 1, 2""",
    "empty_folds": f"""WITH {_SUPERVISED}, {_LATE_FOLDS}
SELECT s.series_id, CAST(f.fold_no AS BIGINT) AS fold_no, count(*) FILTER (WHERE part = 'train') AS train_rows,
       count(*) FILTER (WHERE part = 'validation') AS evaluation_rows
FROM (SELECT DISTINCT series_id FROM mem) s CROSS JOIN fo f
LEFT JOIN mem m ON m.series_id = s.series_id AND m.fold_no = f.fold_no
GROUP BY 1, 2 HAVING train_rows = 0 OR evaluation_rows = 0""",
    "experiment_naive": f"""{_CV}, {_FM}, br AS (
  SELECT series_id, min(fold_no) AS fold_no FROM (
    SELECT s.series_id, f.fold_no FROM (SELECT DISTINCT series_id FROM el) s CROSS JOIN fo f
    LEFT JOIN mem m ON m.series_id = s.series_id AND m.fold_no = f.fold_no
    GROUP BY 1, 2 HAVING count(*) FILTER (WHERE part = 'train') = 0 OR count(*) FILTER (WHERE part = 'validation') = 0)
  GROUP BY 1
), cs AS (
  SELECT series_id, algorithm, avg(mae) AS m, stddev_pop(mae) AS sd FROM fm
  WHERE series_id NOT IN (SELECT series_id FROM br) GROUP BY 1, 2 HAVING count(*) = 4
), n AS (
  SELECT *, m <= min(m) OVER (PARTITION BY series_id) * 1.01::DOUBLE AS near FROM cs
), l AS (
  SELECT *, min(CASE WHEN near THEN sd END) OVER (PARTITION BY series_id) * 1.05::DOUBLE AS lim FROM n
), ch AS (
  SELECT series_id, algorithm, m, sd, row_number() OVER (PARTITION BY series_id
    ORDER BY CASE WHEN near AND sd <= lim THEN 0 ELSE 1 END,
             CASE algorithm WHEN 'seasonal_naive_24' THEN 0 ELSE 1 END) = 1 AS best FROM l
), te AS ({_TEST}), {_scored('SELECT * FROM te').replace('sc AS', 'ts AS', 1)}, fi AS (
  SELECT series_id, algorithm, {_ERRORS} FROM ts JOIN ch USING (series_id, algorithm) WHERE best GROUP BY 1, 2
)
SELECT p.series_id, p.algorithm, CASE WHEN ch.m IS NULL THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN ch.m IS NULL THEN coalesce('fold ' || br.fold_no || ' has no training or validation origins',
         'a fold has no prediction') END AS failure_detail,
       round(ch.m, 6) AS mean_cv_mae, round(ch.sd, 6) AS std_cv_mae, coalesce(ch.best, false) AS is_recommended,
       fi.mae AS final_mae, fi.rmse AS final_rmse, fi.smape AS final_smape
FROM (SELECT DISTINCT series_id, a.algorithm FROM el
      CROSS JOIN (VALUES ('seasonal_naive_24'), ('seasonal_naive_168')) a(algorithm)) p
LEFT JOIN ch ON ch.series_id = p.series_id AND ch.algorithm = p.algorithm
LEFT JOIN fi ON fi.series_id = p.series_id AND fi.algorithm = p.algorithm
LEFT JOIN br ON br.series_id = p.series_id""",
    "final_test_rows": f"""WITH {_SUPERVISED}
SELECT series_id, origin, CASE WHEN origin >= TIMESTAMP '2001-01-01' THEN 'test' ELSE 'train' END AS part
FROM el WHERE origin >= TIMESTAMP '2001-01-01' OR origin < TIMESTAMP '2001-01-01' - INTERVAL '24 days'""",
    "naive24_predictions": _naive_oracle(24),
    "naive168_predictions": _naive_oracle(168),
    "naive_missing_history": f"""WITH {GRID_SQL}, q AS (
  SELECT series_id, origin, CASE WHEN quality_status = 'complete' THEN energy_kwh END AS e FROM g
), o AS (
  SELECT o.series_id, o.origin, x.h AS horizon, o.origin + to_days(CAST(x.h - 24 AS INTEGER)) AS source_time
  FROM q o CROSS JOIN (SELECT unnest(generate_series(1, 24)) AS h) x
  WHERE o.origin >= TIMESTAMP '2001-01-01'
)
SELECT o.* FROM o LEFT JOIN q ON q.series_id = o.series_id AND q.origin = o.source_time WHERE q.e IS NULL""",
    "cv_fold_metrics": f"""{_CV}
SELECT series_id, algorithm, fold_no, count(*) FILTER (WHERE horizon = 1) AS evaluation_rows, {_ERRORS}
FROM ok GROUP BY 1, 2, 3""",
    "cv_horizon_metrics": f"{_CV} SELECT series_id, algorithm, horizon, {_ERRORS} FROM ok GROUP BY 1, 2, 3",
    "cv_summary": f"""{_CV}, {_FM}
SELECT series_id, algorithm, round(avg(mae), 6) AS mean_cv_mae, round(stddev_pop(mae), 6) AS std_cv_mae
FROM fm GROUP BY 1, 2""",
    "improvement_pct": f"""{_CV}, {_FM}
SELECT f.series_id, f.algorithm, f.fold_no,
       round(CASE WHEN b.mae = 0 AND f.mae = 0 THEN 0 ELSE (b.mae - f.mae) / b.mae * 100 END, 6) AS improvement_pct
FROM fm f JOIN fm b ON b.series_id = f.series_id AND b.fold_no = f.fold_no
  AND b.algorithm = 'seasonal_naive_24'""",
    "select_model": """WITH c AS (
  SELECT p_size AS experiment_id, CASE p_partkey % 5 WHEN 0 THEN 'seasonal_naive_24'
           WHEN 1 THEN 'seasonal_naive_168' WHEN 2 THEN 'ridge' WHEN 3 THEN 'hist_gradient_boosting'
           ELSE 'random_forest' END AS algorithm, p_partkey % 5 AS simple,
         round(avg(p_retailprice) / 10, 0) * 10 AS mean_cv_mae,
         round(min(p_retailprice) / 100, 0) AS std_cv_mae,
         CAST(count(*) % 3 AS DOUBLE) AS predict_ms_median
  FROM part GROUP BY 1, 2, 3
), n AS (
  SELECT *, mean_cv_mae <= min(mean_cv_mae) OVER (PARTITION BY experiment_id) * 1.01::DOUBLE AS near FROM c
), s AS (
  SELECT *, min(CASE WHEN near THEN std_cv_mae END) OVER (PARTITION BY experiment_id) * 1.05::DOUBLE AS lim FROM n
)
SELECT CAST(experiment_id AS BIGINT) AS experiment_id, algorithm, mean_cv_mae, std_cv_mae, predict_ms_median,
       row_number() OVER (PARTITION BY experiment_id ORDER BY CASE WHEN near AND std_cv_mae <= lim THEN 0 ELSE 1 END,
         predict_ms_median, simple, algorithm) = 1 AS is_recommended
FROM s""",
    "final_test_metrics": f"""{_CV}, {_FM}, cs AS (
  SELECT series_id, algorithm, avg(mae) AS m, stddev_pop(mae) AS sd FROM fm GROUP BY 1, 2
), n AS (
  SELECT *, m <= min(m) OVER (PARTITION BY series_id) * 1.01::DOUBLE AS near FROM cs
), l AS (
  SELECT *, min(CASE WHEN near THEN sd END) OVER (PARTITION BY series_id) * 1.05::DOUBLE AS lim FROM n
), ch AS (
  SELECT series_id, algorithm FROM (SELECT *, row_number() OVER (PARTITION BY series_id
    ORDER BY CASE WHEN near AND sd <= lim THEN 0 ELSE 1 END,
             CASE algorithm WHEN 'seasonal_naive_24' THEN 0 ELSE 1 END) AS rn FROM l) WHERE rn = 1
), te AS ({_TEST}), {_scored('SELECT * FROM te').replace('sc AS', 'ts AS', 1)}
SELECT series_id, algorithm, count(*) FILTER (WHERE horizon = 1) AS evaluation_rows, {_ERRORS}
FROM ts JOIN ch USING (series_id, algorithm) GROUP BY 1, 2""",
    "forecast_origin": f"""WITH {DAILY_SQL}
SELECT series_id, max(CASE WHEN quality_status = 'complete' THEN hour_start END) AS origin FROM d GROUP BY 1""",
    "forecast_naive24": f"""{_forecast_sql(24)}
SELECT series_id, origin, horizon, target_time, round(predicted_energy_kwh, 6) AS predicted_energy_kwh FROM pts""",
    "forecast_totals": f"""{_forecast_sql(168)}
SELECT series_id, origin, count(*) AS point_count, round(sum(predicted_energy_kwh), 6) AS total_energy_kwh
FROM pts GROUP BY 1, 2""",
}
