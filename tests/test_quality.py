import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from meterspark.operators import quality as Q
from meterspark.operators.quantiles import NON_FINITE, exact_medians, value_class

START = dt.datetime(2026, 1, 1)


def same(minute, **changes):
    return (minute, changes)


def issues(df):
    return {(r.issue_type, r.column_name): r.occurrence_count for r in Q.quality_issues(df).collect()}


def test_exact_and_conflicting_duplicates(readings):
    found = issues(readings([same(0), same(0)]))
    assert found[("exact_duplicate", None)] == 1
    assert ("conflicting_duplicate", None) not in found
    found = issues(readings([same(0), same(0), same(0, active_power_kw=2.0)]))
    assert found[("exact_duplicate", None)] == 1
    assert found[("conflicting_duplicate", None)] == 3


def test_cadence_gap_and_estimate(readings):
    df = readings([same(m) for m in (0, 1, 2, 6)])
    steps = Q.time_steps(df)
    assert Q.cadence(steps).first().expected_interval_seconds == 60
    (gap,) = Q.gaps(steps, Q.cadence(steps)).collect()
    assert gap.estimated_missing == 3 and gap.delta_seconds == 240


def test_steps_cross_days(readings):
    df = readings([same(m) for m in (0, 1, 2, 5000, 5001)])
    steps = {r.step for r in Q.time_steps(df).collect()}
    assert steps == {60, 4998 * 60}


def test_half_even_estimate(readings):
    df = readings([same(m) for m in (0, 2, 4, 9)])
    steps = Q.time_steps(df)
    assert Q.gaps(steps, Q.cadence(steps)).first().estimated_missing == 1


def test_sub_second_cadence_is_unknown(readings):
    late = START + dt.timedelta(milliseconds=5)
    df = readings([same(0), same(0, observed_at=late)])
    assert Q.cadence(Q.time_steps(df)).first().expected_interval_seconds is None
    assert ("time_gap", None) not in issues(df)


def test_order_violation(readings):
    assert issues(readings([same(m) for m in (0, 2, 1)]))[("timestamp_order", None)] == 1


def test_missing_non_finite_and_zero(readings):
    df = readings(
        [
            same(0, active_power_kw=None),
            same(1, active_power_kw=float("inf")),
            same(2, active_power_kw=0.0),
        ]
    )
    found = issues(df)
    assert found[("missing", "active_power_kw")] == 1
    assert found[("non_finite", "active_power_kw")] == 1
    assert ("physical_invalidity", "active_power_kw") not in found


def test_impossible_values(readings):
    df = readings(
        [
            same(0, energy_kwh=-0.1, voltage_v=0.0),
            same(1, active_power_kw=-1.0, current_a=-2.0),
        ]
    )
    wrong = {c for kind, c in issues(df) if kind == "physical_invalidity"}
    assert wrong == {"energy_kwh", "active_power_kw", "current_a", "voltage_v"}


def test_outlier_is_reported_and_kept(readings):
    values = (10.0, 10.1, 9.9, 10.2, 1000.0)
    df = readings([same(m, active_power_kw=v) for m, v in enumerate(values)])
    (row,) = Q.outliers(df).collect()
    assert row.value == 1000.0 and row.column_name == "active_power_kw"
    assert df.where("active_power_kw = 1000").count() == 1


def test_report_summary(readings):
    df = readings([same(0), same(0), same(1, parse_status="invalid")])
    expected = Q.cadence(Q.time_steps(df))
    report = Q.report_summary(df, Q.quality_issues(df), expected).first()
    assert report.total_rows == 3 and report.exact_duplicates == 1
    assert report.missing_values == 3 and report.parse_errors == 1
    assert report.expected_interval_seconds == 60


def test_evidence_holds_the_first_ten(readings):
    df = readings([same(m, active_power_kw=None) for m in range(25)])
    rows = Q.value_evidence(df).where("column_name = 'active_power_kw'")
    assert [r.source_row_number for r in rows.orderBy("position").collect()] == list(range(2, 12))
    shown = Q.quality_evidence(df).where("column_name = 'active_power_kw'").collect()
    assert len(shown) == 10


def test_rank_limit_runs_before_the_shuffle(readings):
    plan = Q.value_evidence(readings([same(0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_exact_medians_match_brute_force(spark):
    random.seed(7)
    groups = {
        "even": [random.gauss(0, 1) for _ in range(40_000)],
        "odd": [random.expovariate(1) for _ in range(30_001)],
        "copies": [1.0] * 20_000 + [5.0] * 20_000,
        "few": [3.0, 1.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, value double").repartition(16)
    found = {r.g: r.median for r in exact_medians(df, ["g"], ["value"]).collect()}
    assert found == {g: statistics.median(values) for g, values in groups.items()}


def test_many_series_are_independent(readings):
    a = readings([same(m) for m in (0, 1, 2)])
    b = readings([same(m) for m in (0, 5, 10, 20)], series_id="b")
    steps = Q.time_steps(a.unionByName(b))
    cadence = {r.series_id: r.expected_interval_seconds for r in Q.cadence(steps).collect()}
    assert cadence == {"a": 60, "b": 300}
    assert Q.gaps(steps, Q.cadence(steps)).select(F.first("series_id")).first()[0] == "b"


def test_medians_of_values_that_share_their_first_digits(spark):
    random.seed(11)
    tiny = 5e-324
    groups = {
        "close": [1.0 + random.randrange(2**20) * 2.0**-52 for _ in range(2_001)],
        "signs": [random.choice([-1, 1]) * 10.0 ** random.uniform(-300, 300) for _ in range(3_000)],
        "edges": [-1.7e308, -tiny, -0.0, 0.0, tiny, 2 * tiny, 1.7e308, 1.7e300],
        "apart": [-3.0, -2.0, 1e9, 2e9],
        "one": [7.25],
        "odd ones": [float("nan"), float("inf"), float("-inf"), 2.0, 4.0, None],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    found = {r.g: (r.n, r.median) for r in exact_medians(df, ["g"], ["value"]).collect()}
    groups["odd ones"] = [2.0, 4.0]
    assert found == {g: (len(values), statistics.median(values)) for g, values in groups.items()}


def test_value_classes_grow_with_the_value(spark):
    random.seed(3)
    values = sorted(random.choice([-1, 1]) * 10.0 ** random.uniform(-300, 300) for _ in range(2_000)) + [1.79e308]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    digits = [r.d for r in df.select("i", value_class(F.col("v")).alias("d")).orderBy("i").collect()]
    assert digits == sorted(digits) and max(map(abs, digits)) < NON_FINITE
    assert all((d > 0) == (v > 0) for d, v in zip(digits, values))


def test_rows_meet_statistics_by_day_beyond_the_broadcast_limit(spark, readings):
    rows = [same(m, active_power_kw=10.0 + m % 7 / 10) for m in range(0, 8_000, 5)] + [same(8_001, active_power_kw=900.0)]
    df = readings(rows).unionByName(readings(rows, series_id="b"))
    expected = {tuple(r) for r in Q.outliers(df).collect()}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = Q.outliers(df)
        assert {tuple(r) for r in found.collect()} == expected and len(expected) == 2
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        raw = [line for line in plan.splitlines() if "Join" in line and "_part" in line]
        assert raw, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_report_agrees_with_its_single_checks(readings):
    df = readings([same(0), same(0, voltage_v=None), same(1, current_a=-1.0), same(9, parse_status="invalid"), same(4)])
    report = Q.quality_report(df)
    single = Q.row_issues(df).unionByName(Q.order_issues(df)).unionByName(Q.duplicate_issues(Q.duplicate_times(df)))
    kinds = {"time_gap", "statistical_anomaly"}
    columns = ["issue_type", "column_name", "range_start", "range_end", "occurrence_count"]
    got = {tuple(r) for r in report.issues.select(*columns).collect() if r.issue_type not in kinds}
    assert got == {tuple(r) for r in single.select(*columns).collect()}
    summary = report.summary.first()
    assert summary.total_rows == 5 and summary.timestamp_order_violations == 1 and summary.physical_invalid_values == 1
