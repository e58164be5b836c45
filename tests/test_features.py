import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from meterspark.operators import features as FE
from meterspark.operators import splits as S
from meterspark.schemas import feature_digest, feature_names

BEGIN = dt.datetime(2008, 1, 1)


def at(rows, hour):
    return next(r for r in rows if r.origin == BEGIN + dt.timedelta(hours=hour))


@pytest.fixture(scope="module")
def rows(spark):
    data = [("a", BEGIN + dt.timedelta(hours=h), float(h)) for h in range(220)]
    df = spark.createDataFrame(data, "series_id string, hour_start timestamp_ntz, energy_kwh double")
    frame = FE.build_features(df, targets=True, naive=True).cache()
    return frame


def test_first_origin_and_counts(rows):
    eligible = FE.eligible_features(rows).orderBy("origin").collect()
    assert len(eligible) == 52
    assert eligible[0].origin == BEGIN + dt.timedelta(hours=168) and eligible[0].lag_168 == 0.0
    supervised = FE.eligible_supervised(rows).orderBy("origin").collect()
    assert len(supervised) == 28
    assert supervised[0].targets == [float(v) for v in range(169, 193)]


def test_windows_end_before_the_origin(rows):
    first = at(FE.eligible_features(rows).collect(), 168)
    assert first.lag_1 == 167.0
    day = [float(v) for v in range(144, 168)]
    assert first.rolling_mean_24 == pytest.approx(statistics.fmean(day))
    assert first.rolling_std_24 == pytest.approx(statistics.pstdev(day))
    assert (first.rolling_min_24, first.rolling_max_24) == (144.0, 167.0)
    assert first.rolling_mean_168 == pytest.approx(statistics.fmean(range(168)))


def test_naive_arrays(rows):
    row = at(rows.collect(), 200)
    assert row.naive_24 == [float(v) for v in range(177, 201)]
    assert row.naive_168 == [float(v) for v in range(33, 57)]


def test_the_future_does_not_leak(hourly):
    before = [math.sin(h) + 2 for h in range(230)]
    after = list(before)
    after[201] += 100_000
    names = feature_names(True)
    a, b = (
        at(FE.build_features(hourly(e, BEGIN), quality=True, targets=True).collect(), 200)
        for e in (before, after)
    )
    assert [a[n] for n in names] == [b[n] for n in names]
    assert a.targets[0] != b.targets[0]


def test_quality_features_look_back_only(hourly):
    base = hourly([1.0] * 200, BEGIN)
    changed = base.withColumn(
        "quality_status",
        F.when(
            F.col("hour_start") == F.lit(BEGIN + dt.timedelta(hours=180)).cast("timestamp_ntz"),
            "imputed_short_gap",
        ).otherwise(F.col("quality_status")),
    )
    frame = FE.build_features(changed, quality=True).collect()
    assert at(frame, 180).last_hour_imputed == 0.0 and at(frame, 181).last_hour_imputed == 1.0
    assert at(frame, 170).past_24h_coverage_mean == 1.0
    assert at(frame, 170).past_168h_missing_hours == 0.0
    assert at(frame, 100).past_168h_missing_hours is None


def test_missing_hour_blocks_its_windows(hourly):
    df = hourly([float(h) for h in range(400)], BEGIN)
    hole = F.lit(BEGIN + dt.timedelta(hours=180)).cast("timestamp_ntz")
    frame = FE.build_features(df.where(F.col("hour_start") != hole))
    hours = {
        int((r.origin - BEGIN).total_seconds() // 3600) for r in FE.eligible_features(frame).collect()
    }
    assert 180 in hours and 181 not in hours and 348 not in hours and 349 in hours


def test_calendar_in_local_time(spark, hourly):
    frame = FE.build_features(hourly([1.0], dt.datetime(2025, 1, 1)), timezone="Europe/Kyiv").first()
    assert (frame.hour, frame.day_of_week, frame.month, frame.is_weekend) == (2.0, 2.0, 1.0, 0.0)
    assert frame.hour_sin == pytest.approx(math.sin(2 * math.pi * 2 / 24))
    assert frame.month_cos == pytest.approx(1.0)


def test_digests():
    assert feature_digest(False).startswith("e58c9eb93e8ce16823bb4c5010346818")
    assert feature_digest(True).startswith("f335e7668a525686b6111e34386db569")
    assert len(feature_names()) == 27 and len(feature_names(True)) == 30


def test_sensitivity_views(spark, hourly):
    df = hourly([1.0], status="valid_partial", coverage=0.95)
    assert FE.quality_view(df, "complete_only").first().energy_kwh is None
    assert FE.quality_view(df, "coverage_90").first().energy_kwh == 1.0
    assert FE.quality_view(hourly([1.0], coverage=0.8), "coverage_90").first().energy_kwh is None


def test_invalid_hours_are_named(hourly):
    df = hourly([1.0, -1.0, 2.0])
    problems = FE.invalid_hourly(df.unionByName(hourly([1.0]))).collect()
    assert {p.problem for p in problems} == {"duplicate_hour", "energy_invalid"}


def test_folds_are_purged(spark):
    hours = [("a", dt.datetime(2008, 6, 1) + dt.timedelta(hours=h)) for h in range(24 * 640)]
    origins = spark.createDataFrame(hours, "series_id string, origin timestamp_ntz")
    bounds = S.fold_bounds(S.fold_membership(origins, S.DEFAULT_PLAN), S.DEFAULT_PLAN)
    rows = bounds.orderBy("fold_no").collect()
    assert len(rows) == 4
    for row, (start, _) in zip(rows, S.DEFAULT_PLAN.validation, strict=True):
        assert row.train_end == start - dt.timedelta(hours=25)
    assert rows[0].evaluation_rows == 90 * 24
    assert S.empty_folds(bounds).count() == 0
    final = S.final_training(origins, S.DEFAULT_PLAN).agg(F.max("origin")).first()[0]
    assert final == dt.datetime(2009, 12, 31) - dt.timedelta(hours=1)
    assert S.final_test(origins, S.DEFAULT_PLAN).agg(F.min("origin")).first()[0] == dt.datetime(2010, 1, 1)


def test_empty_fold_is_reported(spark):
    origins = spark.createDataFrame(
        [("a", dt.datetime(2009, 2, 1))], "series_id string, origin timestamp_ntz"
    )
    bounds = S.fold_bounds(S.fold_membership(origins, S.DEFAULT_PLAN), S.DEFAULT_PLAN)
    assert S.empty_folds(bounds).count() == 4


def test_feature_plan(rows, hourly):
    plan = FE.build_features(hourly([1.0]), targets=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Join" not in plan
