import datetime as dt
from datetime import UTC, datetime, timedelta

import pytest

from meterspark.operators import analytics as A

START = datetime(2026, 1, 1, tzinfo=UTC)
ZONE = "Europe/Kyiv"


@pytest.fixture(scope="module")
def facts(spark):
    rows = []
    for h in range(240):
        gap = h == 2
        rows.append(
            (
                "a",
                dt.datetime(2026, 1, 1) + timedelta(hours=h),
                None if gap else float(h % 24 + 1),
                0.5 if gap else 1.0,
                "invalid_missing" if gap else "complete",
            )
        )
    return spark.createDataFrame(
        rows,
        "series_id string, hour_start timestamp_ntz, energy_kwh double, "
        "coverage_ratio double, quality_status string",
    ).cache()


def span(hours):
    return A.TimeRange(START, START + timedelta(hours=hours))


def test_summary(facts):
    row = A.energy_summary(facts, span(4)).first()
    assert (row.expected_hours, row.stored_hours, row.energy_value_count) == (4, 4, 3)
    assert (row.absent_hours, row.missing_energy_hours) == (0, 1)
    assert row.mean_energy_kwh == pytest.approx(7 / 3) and row.median_energy_kwh == 2.0
    assert (row.min_energy_kwh, row.max_energy_kwh, row.total_energy_kwh) == (1.0, 4.0, 7.0)
    assert row.mean_coverage_ratio == 0.875
    counts = A.status_counts(facts, span(4)).first().status_counts
    assert counts == {"complete": 3, "invalid_missing": 1}


def test_profiles_and_heatmap(facts):
    hours = A.hour_profile(facts, span(240), ZONE).orderBy("profile_key").collect()
    assert [r.profile_key for r in hours] == list(range(24)) and hours[3].label == "03"
    days = A.weekday_profile(facts, span(240), ZONE).orderBy("profile_key").collect()
    assert [r.label for r in days] == list(A.WEEKDAYS)
    cells = A.heatmap(facts, span(240), ZONE).collect()
    assert sum(c.sample_count for c in cells) == 239


def test_histogram(facts, spark):
    bins = A.energy_histogram(facts, span(240), 5).orderBy("bin_index").collect()
    assert len(bins) == 5 and sum(b.sample_count for b in bins) == 239
    assert (bins[0].lower_kwh, bins[-1].upper_kwh) == (1.0, 24.0)
    flat = A.energy_histogram(facts.where("energy_kwh = 5"), span(240), 5).collect()
    assert len(flat) == 1 and flat[0].lower_kwh == flat[0].upper_kwh == 5.0


def test_empty_range(facts):
    later = A.TimeRange(START + timedelta(days=100), START + timedelta(days=101))
    row = A.range_metadata(facts, later, facts.select("series_id").distinct()).first()
    assert (row.stored_hours, row.missing_energy_hours, row.absent_hours) == (0, 24, 24)


def test_series_is_bounded(facts):
    rows = A.energy_series(facts, span(240), "hour", 100).orderBy("bucket_start").collect()
    assert len(rows) == 80 and rows[0].bucket_seconds == 10_800 and rows[0].downsampled
    assert (rows[0].energy_kwh, rows[0].quality_status) == (3.0, "mixed")
    assert rows[1].quality_status == "complete"


def test_bucket_choice():
    long = A.TimeRange(START, START + timedelta(hours=20_000))
    width = A.bucket_seconds(long, "hour", 200)
    assert 20_000 * 3600 / width <= 200
    assert A.bucket_seconds(span(24), "hour", 100) == 3600
    shifted = A.TimeRange(START + timedelta(hours=1), START + timedelta(hours=201))
    assert A.bucket_seconds(shifted, "hour", 100) == 3 * 3600
    with pytest.raises(ValueError):
        A.bucket_seconds(span(24), "hour", 99)


@pytest.mark.parametrize("resolution", ["hour", "day", "week"])
@pytest.mark.parametrize("most", [100, 137, 9999])
def test_bucket_choice_is_the_least(resolution, most):
    unit = A.BASE_BUCKETS[resolution]
    for hours in (1, 99, 100, 101, 4_321, 137_001, 2_000_003):
        for shift in (0, 1, 5, 166):
            begin = START + timedelta(hours=shift)
            width = A.bucket_seconds(A.TimeRange(begin, begin + timedelta(hours=hours)), resolution, most)
            first = int(begin.timestamp()) - A.BUCKET_ANCHOR
            last = first + hours * 3600 - 1

            def buckets(seconds, first=first, last=last):
                return last // seconds - first // seconds + 1

            assert buckets(width) <= most
            assert all(buckets(w) > most for w in range(max(unit, width - 400 * unit), width, unit))


def test_range_checks():
    with pytest.raises(ValueError):
        A.TimeRange(datetime(2026, 1, 1), datetime(2026, 1, 2))
    with pytest.raises(ValueError):
        A.TimeRange(START, START)
    with pytest.raises(ValueError):
        A.TimeRange(START, START + timedelta(days=1831), longest=timedelta(days=1830))
    assert A.TimeRange(START, START + timedelta(days=10_000)).expected_hours == 240_000


def test_filters_reach_the_scan(facts, tmp_path, spark):
    path = str(tmp_path / "facts")
    facts.write.parquet(path)
    plan = A.energy_series(spark.read.parquet(path), span(24), "hour", 100)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(hour_start" in text and "LessThan(hour_start" in text
    assert text.count("Exchange") == 1
