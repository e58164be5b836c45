import datetime as dt
import math

import pytest

from meterspark.operators import hourly as H

START = dt.datetime(2026, 1, 1)


def power(minutes, value=1.0):
    return [(m, {"active_power_kw": value}) for m in minutes]


def hours(df, interval=60, **policy):
    rows = H.hourly_transform(df, interval, H.Policy(**policy)).orderBy("series_id", "hour_start")
    return rows.collect()


def test_complete_hour(readings):
    (hour,) = hours(readings(power(range(60))))
    assert hour.energy_kwh == pytest.approx(1.0)
    assert (hour.quality_status, hour.observed_samples) == ("complete", 60)


def test_short_gap_is_filled(readings):
    (hour,) = hours(readings(power(m for m in range(60) if not 20 <= m <= 24)))
    assert hour.energy_kwh == pytest.approx(1.0)
    assert (hour.observed_samples, hour.imputed_samples, hour.max_missing_run) == (55, 5, 5)
    assert hour.quality_status == "imputed_short_gap"
    assert hour.quality_flags == ["missing_samples", "short_gap_interpolated"]


def test_long_gap_is_not_filled(readings):
    (hour,) = hours(readings(power((m for m in range(60) if not 20 <= m <= 25), 2.0)))
    assert hour.energy_kwh == pytest.approx(1.8)
    assert (hour.imputed_samples, hour.max_missing_run) == (0, 6)
    assert hour.quality_status == "valid_partial"


def test_gap_at_the_start_is_not_filled(readings):
    (hour,) = hours(readings(power(range(5, 60))))
    assert (hour.imputed_samples, hour.quality_status) == (0, "valid_partial")


def test_conflict_under_reject(readings):
    rows = power(range(60)) + [(10, {"active_power_kw": 9.0})]
    (hour,) = hours(readings(rows))
    assert hour.quality_status == "invalid_conflict"
    assert "conflicting_duplicate" in hour.quality_flags
    assert hour.energy_kwh == pytest.approx(1.0)


@pytest.mark.parametrize(("policy", "value"), [("keep_first", 1.0), ("keep_last", 9.0), ("mean", 5.0)])
def test_other_duplicate_policies(readings, policy, value):
    rows = power(range(60)) + [(10, {"active_power_kw": 9.0})]
    (hour,) = hours(readings(rows), duplicates=policy)
    assert hour.quality_status == "complete"
    assert hour.energy_kwh == pytest.approx((59 + value) / 60)


def test_energy_target(readings):
    rows = [(m, {"energy_kwh": 0.02, "active_power_kw": None}) for m in range(60)]
    (hour,) = hours(readings(rows))
    assert hour.energy_kwh == pytest.approx(1.2) and hour.mean_active_power_kw is None


def test_one_power_value_makes_power_the_target(readings):
    rows = [(m, {"energy_kwh": 0.02, "active_power_kw": None}) for m in range(60)]
    rows[5] = (5, {"energy_kwh": 0.02, "active_power_kw": 3.0})
    (hour,) = hours(readings(rows))
    assert hour.energy_kwh == pytest.approx(3.0 / 60) and hour.observed_samples == 1


def test_negative_current(readings):
    rows = power(range(60))
    rows[10] = (10, {"current_a": -1.0})
    (hour,) = hours(readings(rows))
    assert hour.quality_status == "invalid_value" and hour.mean_current_a == 4.0


def test_row_that_did_not_parse(readings):
    rows = power(range(60))
    rows[10] = (10, {"parse_status": "invalid"})
    (hour,) = hours(readings(rows))
    assert (hour.observed_samples, hour.quality_status) == (59, "invalid_value")


def test_mean_policy_keeps_the_first_status(readings):
    rows = power(range(60)) + [(10, {"active_power_kw": 3.0})]
    rows[10] = (10, {"parse_status": "invalid"})
    (hour,) = hours(readings(rows), duplicates="mean")
    assert hour.observed_samples == 59


def test_gap_across_an_hour_edge(readings):
    rows = [(m, {"active_power_kw": float(m)}) for m in range(120) if not 57 <= m <= 61]
    first, second = hours(readings(rows))
    assert (first.imputed_samples, second.imputed_samples) == (3, 2)
    assert first.energy_kwh == pytest.approx(sum(range(60)) / 60)
    assert second.energy_kwh == pytest.approx(sum(range(60, 120)) / 60)


def test_gap_across_midnight(readings):
    rows = [(m, {"active_power_kw": float(m)}) for m in range(1380, 1500) if not 1438 <= m <= 1441]
    first, second = hours(readings(rows))
    assert (first.imputed_samples, second.imputed_samples) == (2, 2)
    assert second.energy_kwh == pytest.approx(sum(range(1440, 1500)) / 60)


def test_empty_hours_are_emitted(readings):
    rows = hours(readings(power([0, 200])))
    assert [r.quality_status for r in rows] == ["invalid_missing"] * 4
    assert rows[1].energy_kwh is None and rows[1].max_missing_run == 60
    assert rows[1].quality_flags == ["missing_samples"]


def test_off_grid_row_only_widens_the_range(readings):
    late = START + dt.timedelta(hours=2, seconds=30)
    rows = hours(readings(power(range(60)) + [(0, {"observed_at": late})]))
    assert len(rows) == 3
    assert [r.observed_samples for r in rows] == [60, 0, 0]


def test_filled_hour_below_the_threshold(readings):
    df = readings(power(m for m in range(60) if m % 5 == 0 or m == 59))
    (hour,) = hours(df)
    assert hour.imputed_samples + hour.observed_samples == 60
    assert hour.quality_status == "invalid_missing"
    assert hour.energy_kwh == pytest.approx(1.0)


def test_no_filling_when_the_limit_is_zero(readings):
    (hour,) = hours(readings(power(m for m in range(60) if m != 20)), short_gap_minutes=0)
    assert (hour.imputed_samples, hour.quality_status) == (0, "valid_partial")


def test_several_series(readings):
    df = readings(power(range(60))).unionByName(readings(power(range(120), 2.0), series_id="b"))
    rows = hours(df)
    assert [(r.series_id, r.energy_kwh) for r in rows] == [("a", 1.0), ("b", 2.0), ("b", 2.0)]


def test_policy_bounds():
    for bad in ({"short_gap_minutes": 6}, {"minimum_coverage": 0.7}, {"duplicates": "x"}):
        with pytest.raises(ValueError):
            H.Policy(**bad)
    with pytest.raises(ValueError):
        H.check_interval(7)


def test_cadence_inference(spark, readings):
    daily = readings([(60 * h, {"interval_seconds": None}) for h in range(24)])
    assert H.infer_cadence(daily).first().interval_seconds == 3600
    uneven = readings(power((0, 1, 2, 4)))
    assert H.infer_cadence(uneven).first().interval_seconds == 60
    odd = readings([(0, {}), (1, {}), (2, {"observed_at": START + dt.timedelta(seconds=90)})])
    assert H.infer_cadence(odd).first().interval_seconds is None
    assert H.infer_cadence(readings(power([0]))).first().interval_seconds is None


def test_cadence_uses_every_time(spark):
    minutes = spark.range(6000).selectExpr("id * 60 AS second")
    late = spark.sql("SELECT 400030L AS second")

    def cadence(seconds):
        rows = seconds.selectExpr("'a' AS series_id", "CAST(timestamp_seconds(second) AS timestamp_ntz) AS observed_at")
        return H.infer_cadence(rows).first().interval_seconds

    assert cadence(minutes) == 60
    assert cadence(minutes.unionByName(late)) is None


def test_row_level_gap_operators_agree(readings):
    df = readings(power(m for m in range(120) if not (20 <= m <= 22 or 70 <= m <= 90)))
    resolved, semantic = H.resolve_duplicates(df), H.target_semantics(df)
    runs = {r.run_start.minute + 60 * r.run_start.hour: r.run_length
            for r in H.missing_runs(resolved, semantic, 60).collect()}
    assert runs == {20: 3, 70: 21}
    filled = H.interpolate_short_gaps(resolved, semantic, 60, 5).collect()
    assert len(filled) == 3 and all(math.isclose(r.value, 1.0) for r in filled)
    grid = H.grid_fill(resolved, semantic, 60)
    assert grid.count() == 120 and grid.where("value is null").count() == 24


def test_transform_plan(readings):
    plan = H.hourly_transform(readings(power([0])), 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3
    assert "SortAggregate" not in plan and "Python" not in plan and "Cartesian" not in plan
