import csv
import datetime as dt
import glob
import json

import pytest
from pyspark.sql import functions as F

from meterspark.operators import catalog as C
from meterspark.operators import export as E

ORIGIN = dt.datetime(2026, 1, 1)


@pytest.fixture
def forecast(spark):
    headers = spark.createDataFrame(
        [("f1", "r1", "v1", ORIGIN, "UTC", "=ridge", "base_v1", "sha", 3.0)],
        "forecast_id string, model_run_id string, dataset_version_id string, origin timestamp_ntz, "
        "timezone string, algorithm string, feature_schema_version string, bundle_sha256 string, "
        "total_energy_kwh double",
    )
    points = spark.createDataFrame(
        [("f1", h, ORIGIN + dt.timedelta(hours=h), float(h)) for h in (2, 1)],
        "forecast_id string, horizon long, target_time timestamp_ntz, predicted_energy_kwh double",
    )
    return E.forecast_rows(headers, points)


def test_neutral_text(spark):
    texts = ["=SUM(A1:A2)", "+cmd", "-danger", "@HYPERLINK", "\t=hidden", " \n-x", "plain text", "a=b", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [r.o for r in rows.select(E.neutral_text(F.col("t")).alias("o")).collect()]
    assert out == ["'" + t for t in texts[:6]] + texts[6:]


def test_forecast_csv(forecast, tmp_path):
    assert tuple(forecast.columns) == E.FORECAST_COLUMNS
    E.write_csv(forecast.coalesce(1), str(tmp_path / "csv"))
    (name,) = glob.glob(str(tmp_path / "csv" / "*.csv"))
    rows = sorted(csv.DictReader(open(name)), key=lambda r: r["horizon"])
    assert rows[0]["origin"] == "2026-01-01T00:00:00+00:00" and rows[0]["algorithm"] == "'=ridge"
    assert rows[0]["predicted_energy_kwh"] == "1.0" and rows[0]["actual_energy_kwh"] == ""


def test_chart_document(forecast):
    chart = json.loads(E.chart_documents(forecast).first().chart)
    assert [p["horizon"] for p in chart["series"]] == [1, 2]
    assert chart["unit"] == "kWh" and chart["series"][0]["actual_energy_kwh"] is None
    assert list(chart) == sorted(chart) and list(chart["series"][0]) == sorted(chart["series"][0])


def test_metric_tables(spark):
    runs = spark.createDataFrame(
        [
            ("e", "m1", "ridge", "completed", True, '{"alpha":1.0}', 2.0, 0.1, 1.0, 1.0, 5.0, 0.2, None),
            ("e", "m2", "broken", "failed", False, "{}", None, None, None, None, None, None, "x"),
        ],
        "experiment_id string, model_run_id string, algorithm string, status string, is_recommended boolean, "
        "hyperparameters_json string, mean_cv_mae double, std_cv_mae double, final_mae double, "
        "final_rmse double, final_smape double, predict_ms_median double, failure_code string",
    )
    folds = spark.createDataFrame(
        [("m1", f, 10, 1.0, 1.0, 1.0) for f in (2, 1)],
        "model_run_id string, fold_no int, evaluation_rows long, mae double, rmse double, smape double",
    )
    horizons = spark.createDataFrame(
        [("m1", "cv", h, 1.0, 1.0, 1.0) for h in range(24, 0, -1)],
        "model_run_id string, evaluation_scope string, horizon int, mae double, rmse double, smape double",
    )
    rows = E.metric_rows(runs, folds, horizons)
    assert tuple(rows.columns) == E.METRIC_COLUMNS
    kinds = {r.row_type: r.n for r in rows.groupBy("row_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"summary": 2, "fold": 2, "horizon": 24}
    compared = E.model_comparison(runs, folds, horizons)
    first, second = compared.orderBy(*E.comparison_order()).collect()
    assert [f.fold_no for f in first.fold_metrics] == [1, 2] and second.fold_metrics is None
    experiments = spark.createDataFrame(
        [("e", "v", "named")], "experiment_id string, dataset_version_id string, name string"
    )
    text = E.metric_documents(compared, experiments).first().metrics
    document = json.loads(text)
    assert [m["algorithm"] for m in document["models"]] == ["ridge", "broken"]
    assert document["models"][0]["hyperparameters"] == {"alpha": 1.0}
    assert list(document["models"][0]) == sorted(document["models"][0])
    assert list(document["experiment"]) == sorted(document["experiment"])


def test_catalogue(spark):
    datasets = spark.createDataFrame([(1, "x"), (2, "y")], "dataset_id long, name string")
    versions = spark.createDataFrame(
        [("v1", 1, 1, "s1"), ("v2", 1, 2, "s2")],
        "dataset_version_id string, dataset_id long, version_no long, source_sha256 string",
    )
    counts = {r.dataset_id: r.version_count for r in C.version_counts(datasets, versions).collect()}
    assert counts == {1: 2, 2: 0}
    numbers = {r.dataset_id: r.next_version_no for r in C.next_version(datasets, versions).collect()}
    assert numbers == {1: 3, 2: 1}
    assert [r.dataset_id for r in C.deletable(datasets, versions).collect()] == [2]
    assert [r.dataset_id for r in C.in_use(datasets, versions).collect()] == [1]
    incoming = spark.createDataFrame([(2, "s1")], "dataset_id long, source_sha256 string")
    C.refuse_duplicates(incoming, versions)
    with pytest.raises(ValueError, match="already imported"):
        C.refuse_duplicates(incoming.withColumn("dataset_id", F.lit(1).cast("long")), versions)


def test_version_scan_is_pruned(spark, hourly, tmp_path):
    path = str(tmp_path / "t")
    df = hourly([1.0, 2.0]).unionByName(hourly([3.0], series="b"))
    C.replace_version(df.withColumn(C.VERSION, F.col("series_id")), path)
    scan = C.scan_version(spark, path, "b", ["hour_start", "energy_kwh"])
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_version_id" in plan
    assert "quality_status" not in plan.split("ReadSchema")[1]
    assert [r.energy_kwh for r in scan.collect()] == [3.0]
