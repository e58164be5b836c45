import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterspark.operators import bundles as B
from meterspark.operators import experiment as X
from meterspark.operators import features as FE
from meterspark.operators import forecast as FC
from meterspark.operators import metrics as M
from meterspark.operators import ridge as R
from meterspark.operators import splits as S
from meterspark.operators import trees as T
from meterspark.schemas import feature_digest, feature_names

DAY = 86400
BEGIN = dt.datetime(2000, 1, 1)


def scored(spark, actual, predicted):
    rows = [(h + 1, float(a), float(p)) for h, (a, p) in enumerate(zip(actual, predicted, strict=True))]
    return spark.createDataFrame(rows, "horizon int, actual double, predicted double").withColumn(
        "m", F.lit("x")
    )


def test_errors(spark):
    row = M.error_metrics(scored(spark, [0.0] * 24, [1.0] * 24), ["m"]).first()
    assert (row.mae, row.rmse, row.smape, row.evaluation_rows) == (1.0, 1.0, 200.0, 1)
    row = M.error_metrics(scored(spark, [0.0] * 24, [1.0] + [0.0] * 23), ["m"]).first()
    assert row.smape == pytest.approx(200 / 24)


def test_improvement(spark):
    def gain(b, m):
        return spark.range(1).select(M.improvement_percent(F.lit(b), F.lit(m)).alias("g")).first().g

    assert gain(2.0, 1.5) == 25.0 and gain(0.0, 0.0) == 0.0
    with pytest.raises(Exception, match="undefined"):
        gain(0.0, 1.0)


@pytest.mark.parametrize(
    ("candidates", "winner"),
    [
        ([("random_forest", 100, 10, 5), ("ridge", 101, 9, 1)], "ridge"),
        ([("random_forest", 100, 10, 5), ("ridge", 101.0001, 1, 0.1)], "random_forest"),
        ([("random_forest", 100, 10, 9), ("ridge", 100.5, 10.5, 1)], "ridge"),
        ([("random_forest", 100, 10, 5), ("ridge", 100, 10, 5)], "ridge"),
        ([("ridge", 100, 10, 5), ("seasonal_naive_24", 100, 10, 5)], "seasonal_naive_24"),
    ],
)
def test_selection_rule(spark, candidates, winner):
    df = spark.createDataFrame(
        [("e", a, float(m), float(s), float(t)) for a, m, s, t in candidates],
        "series_id string, algorithm string, mean_cv_mae double, std_cv_mae double, predict_ms_median double",
    )
    (row,) = M.select_recommended(df).where("is_recommended").collect()
    assert row.algorithm == winner


@pytest.fixture(scope="module")
def plan():
    edges = [BEGIN + dt.timedelta(days=d) for d in (300, 330, 360, 390, 420)]
    return S.SplitPlan(tuple(zip(edges[:-1], edges[1:], strict=True)), edges[-1], DAY)


@pytest.fixture(scope="module")
def frame(spark, plan):
    rng = np.random.default_rng(3)
    rows = []
    for series in ("a", "b"):
        for d in range(470):
            value = 50 + 10 * math.sin(d / 5) + float(rng.normal()) + (20 if series == "b" else 0)
            rows.append((series, BEGIN + dt.timedelta(days=d), value))
    df = spark.createDataFrame(rows, "series_id string, hour_start timestamp_ntz, energy_kwh double")
    built = FE.build_features(df, step=DAY, targets=True, naive=True)
    return FE.eligible_supervised(built).cache()


def closed_form(rows, alpha):
    x = np.array([[r[n] for n in feature_names()] for r in rows])
    y = np.array([r.targets for r in rows])
    mean, std = x.mean(0), x.std(0)
    std[std < 1e-12] = 1.0
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean(0)))
    return lambda q: (q - mean) / std @ w + y.mean(0)


def test_ridge_equals_the_closed_form(frame, plan):
    # Rows spread over many tasks: blocks of one segment must merge exactly.
    spread = frame.repartition(7)
    models = R.fit_ridge(spread, plan, (0.1, 100.0))
    predicted = R.predict_ridge(R.validation_rows(frame, plan), models).collect()
    all_rows = frame.orderBy("series_id", "origin").collect()
    by_key = {(r.series_id, r.origin): r for r in all_rows}
    for fold, (start, _) in enumerate(plan.validation, 1):
        train = [r for r in all_rows if r.series_id == "b" and r.origin < start - plan.purge]
        for alpha in (0.1, 100.0):
            model = closed_form(train, alpha)
            mine = [p for p in predicted if (p.series_id, p.fold_no, p.alpha) == ("b", fold, alpha)]
            assert len(mine) == 30
            for p in mine:
                q = np.array([by_key[("b", p.origin)][n] for n in feature_names()])
                np.testing.assert_allclose(p.predicted, model(q), atol=1e-8, rtol=1e-8)


def test_scaling_uses_training_rows_only(frame, plan):
    scaled = R.scaled_features(frame, plan)
    stats = scaled.where("part = 'train'").groupBy("series_id", "fold_no").agg(
        F.avg("lag_1").alias("mean"), F.stddev_pop("lag_1").alias("std")
    )
    for row in stats.collect():
        assert row["mean"] == pytest.approx(0, abs=1e-9) and row["std"] == pytest.approx(1)
    changed = frame.withColumn(
        "lag_1", F.when(F.col("origin") >= S.instant(plan.test_start), 1e9).otherwise(F.col("lag_1"))
    )
    a, b = (
        R.scaled_features(f, plan).where("fold_no = 1").orderBy("series_id", "origin").select("lag_1").collect()
        for f in (frame, changed)
    )
    assert a == b


def test_experiment_selects_then_tests(spark, plan):
    rows = [("a", BEGIN + dt.timedelta(days=d), float(d % 24 + 1)) for d in range(470)]
    df = spark.createDataFrame(rows, "series_id string, hour_start timestamp_ntz, energy_kwh double")
    built = FE.eligible_supervised(FE.build_features(df, step=DAY, targets=True, naive=True))
    naive = tuple(X.NAIVE)
    result = X.run_experiment(built, plan, naive)
    runs = {r.algorithm: r for r in result.model_runs.collect()}
    assert runs["seasonal_naive_24"].is_recommended and runs["seasonal_naive_24"].mean_cv_mae == 0.0
    assert runs["seasonal_naive_24"].final_mae == 0.0
    assert runs["seasonal_naive_168"].final_mae is None
    horizons = result.horizon_metrics.where("algorithm = 'seasonal_naive_24'")
    assert {r.evaluation_scope: r.n for r in horizons.groupBy("evaluation_scope").agg(
        F.count("*").alias("n")).collect()} == {"cv": 24, "final_test": 24}
    assert result.fold_metrics.where("algorithm = 'seasonal_naive_24'").count() == 4
    result.release()
    other = X.run_experiment(built, plan, naive, is_failed=("seasonal_naive_24",))
    runs = {r.algorithm: r for r in other.model_runs.collect()}
    assert runs["seasonal_naive_24"].status == "failed"
    assert runs["seasonal_naive_168"].is_recommended
    other.release()


def test_a_failing_algorithm_does_not_end_the_experiment(frame, plan, monkeypatch):
    def broken(*_, **__):
        raise ValueError("no solution\nsecond line")

    monkeypatch.setattr(X, "fit_ridge", broken)
    result = X.run_experiment(frame, plan, ("seasonal_naive_24", "ridge"))
    runs = {(r.series_id, r.algorithm): r for r in result.model_runs.collect()}
    for series in ("a", "b"):
        failed = runs[series, "ridge"]
        assert (failed.status, failed.failure_detail, failed.is_recommended) == ("failed", "no solution", False)
        good = runs[series, "seasonal_naive_24"]
        assert good.is_recommended and good.failure_detail is None and good.final_mae is not None
    result.release()
    with pytest.raises(RuntimeError, match="no solution"):
        X.run_experiment(frame, plan, ("ridge",))
    with pytest.raises(ValueError, match="unknown"):
        X.run_experiment(frame, plan, ("ridge", "oracle"))


def test_a_series_with_an_empty_fold_fails_alone(frame, plan):
    start, end = (S.instant(d) for d in plan.validation[1])
    holed = frame.where((F.col("series_id") != "a") | (F.col("origin") < start) | (F.col("origin") >= end))
    result = X.run_experiment(holed, plan, tuple(X.NAIVE))
    runs = {(r.series_id, r.algorithm): r for r in result.model_runs.collect()}
    for algorithm in X.NAIVE:
        assert runs["a", algorithm].failure_detail == "fold 2 has no training or validation origins"
        assert runs["b", algorithm].status == "completed"
    assert {r.series_id for r in result.fold_metrics.collect()} == {"b"}
    result.release()


@pytest.mark.parametrize(
    ("algorithm", "params"), [("ridge", {"alpha": 10.0}), ("random_forest", {"n_estimators": 2, "max_depth": 2})]
)
def test_bundles_come_back_and_foreign_ones_are_refused(spark, plan, tmp_path, algorithm, params):
    rows = []
    for d in range(470):
        status = "invalid" if d == 280 else "complete"
        rows.append(("a", BEGIN + dt.timedelta(days=d), 1e6 if d == 280 else 50 + 10 * math.sin(d / 5), 1.0, status))
    hourly = spark.createDataFrame(
        rows, "series_id string, hour_start timestamp_ntz, energy_kwh double, coverage_ratio double, quality_status string"
    )
    path = f"{tmp_path}/bundle"
    B.train_bundle(hourly, plan, algorithm, path, dataset_version_id="v1", params=params, step=DAY)
    bundle = B.load_bundle(spark, path, algorithm=algorithm, dataset_version_id="v1")
    assert bundle.manifest["params"] == params and bundle.manifest["mode"] == "complete_only"
    points = B.forecast_from_bundle(hourly, bundle).orderBy("horizon").collect()
    assert [p.horizon for p in points] == list(range(1, 25))
    # The view kept the outlier of an ineligible hour out of training.
    assert all(30 < p.predicted_energy_kwh < 70 for p in points)
    for wrong in ({"dataset_version_id": "v2"}, {"quality": True}):
        with pytest.raises(ValueError, match="does not match"):
            B.load_bundle(spark, path, **({"algorithm": algorithm, "dataset_version_id": "v1"} | wrong))
    with pytest.raises(Exception, match="(?i)exists"):
        B.train_bundle(hourly, plan, algorithm, path, dataset_version_id="v1", params=params, step=DAY)


def test_missing_history_fails_the_run(frame, plan):
    holed = frame.withColumn(
        "naive_24",
        F.when(
            (F.col("series_id") == "a") & (F.col("origin") == S.instant(plan.validation[1][0])),
            F.transform("naive_24", lambda v: F.lit(None).cast("double")),
        ).otherwise(F.col("naive_24")),
    )
    rows = R.validation_rows(holed, plan)
    assert X.naive_missing_history(rows, 24, DAY).count() == 24
    values = X.naive_scored(rows, ["series_id", "fold_no", "origin"])
    run = ["series_id", "algorithm"]
    left = M.error_metrics(values, [*run, "fold_no"], run)
    assert {(r.series_id, r.algorithm) for r in left.collect()} == {
        ("b", "seasonal_naive_24"),
        ("a", "seasonal_naive_168"),
        ("b", "seasonal_naive_168"),
    }


@pytest.mark.parametrize(
    ("algorithm", "params"),
    [
        ("random_forest", {"n_estimators": 3, "max_depth": 3}),
        ("hist_gradient_boosting", {"max_iter": 2, "max_leaf_nodes": 4}),
    ],
)
def test_trees_predict_every_horizon(frame, plan, algorithm, params):
    training = S.final_training(frame, plan).where("series_id = 'a'")
    models = T.fit_trees(training, algorithm, params)
    rows = S.final_test(frame, plan).where("series_id = 'a'")
    predicted = T.predict_trees(rows, models, ["series_id", "origin"]).collect()
    assert predicted and all(len(r.predicted) == 24 for r in predicted)
    assert all(20 < v < 90 for r in predicted for v in r.predicted)


def test_search_candidates_are_distinct_and_repeatable():
    first = T.search_candidates(T.FOREST_SPACE, 20)
    assert first == T.search_candidates(T.FOREST_SPACE, 20) and len(first) == 20
    assert len({tuple(sorted(c.items(), key=str)) for c in first}) == 20
    with pytest.raises(ValueError):
        T.search_candidates(T.FOREST_SPACE, 21)


def test_forecast_points(hourly):
    history = hourly([float(h % 24) for h in range(240)])
    points = FC.naive_forecast(history, 24).orderBy("horizon").collect()
    assert [p.horizon for p in points] == list(range(1, 25))
    origin = dt.datetime(2026, 1, 10, 23)
    assert points[0].origin == origin and points[0].target_time == origin + dt.timedelta(hours=1)
    assert points[3].predicted_energy_kwh == 3.0
    total = FC.forecast_totals(FC.naive_forecast(history, 24)).first()
    assert total.total_energy_kwh == sum(range(24)) and total.point_count == 24


def test_negative_predictions_become_zero(spark):
    rows = spark.createDataFrame(
        [("a", BEGIN, [float(v) for v in range(-1, 23)])],
        "series_id string, origin timestamp_ntz, predicted array<double>",
    )
    points = FC.forecast_points(rows, "predicted").orderBy("horizon").collect()
    assert points[0].predicted_energy_kwh == 0.0 and points[2].predicted_energy_kwh == 1.0


def test_short_history_is_an_error(hourly):
    view = hourly([1.0] * 100)
    origins = FC.latest_origins(view)
    rows = FC.origin_rows(view, origins)
    assert FC.forecast_errors(origins, rows, "naive_24").first().error == "history_missing"
    assert FC.naive_forecast(view, 24).count() == 0


def test_requested_origin_must_be_stored_and_whole(hourly):
    view = hourly([1.0] * 200)
    with pytest.raises(ValueError):
        FC.requested_origins(view, dt.datetime(2026, 1, 1, 0, 30))
    outside = FC.requested_origins(view, dt.datetime(2027, 1, 1))
    rows = FC.origin_rows(view, outside)
    assert FC.forecast_errors(outside, rows, "naive_24").first().error == "origin_invalid"


def test_manifest_must_match():
    good = {"algorithm": "ridge", "dataset_version_id": "v", "feature_schema_sha256": feature_digest()}
    FC.check_manifest(good, algorithm="ridge", dataset_version_id="v")
    with pytest.raises(ValueError, match="feature_schema"):
        FC.check_manifest({**good, "feature_schema_sha256": "x"}, algorithm="ridge", dataset_version_id="v")
