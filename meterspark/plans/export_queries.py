"""Registered queries: exports, versioned tables and the dataset catalogue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.operators import catalog as C
from meterspark.operators import experiment as X
from meterspark.operators import export as E
from meterspark.operators import forecast as FC
from meterspark.operators import metrics as M
from meterspark.operators import ridge as R
from meterspark.operators.features import build_features, eligible_supervised
from meterspark.operators.pages import index_pages, read_page
from meterspark.functions.clock import DAY
from meterspark.plans.inputs import (
    CATALOG_SQL,
    HOURLY_SQL,
    daily_quantity,
    datasets,
    hourly_events,
    rounded,
    table,
    versions,
)
from meterspark.plans.model_queries import _CV, _FM, PLAN, ZONE, _forecast_sql, _full
from meterspark.schemas import FEATURE_VERSIONS
from meterspark.session import scratch_folder

ORIGIN = datetime(2024, 1, 25)


def _run_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, fold metrics and horizon metrics of the seasonal baselines; one experiment a series."""
    frame = build_features(
        daily_quantity(spark, sf_dir), timezone=ZONE, step=DAY, targets=True, naive=True
    )
    rows = R.validation_rows(eligible_supervised(frame), PLAN)
    scored = X.naive_scored(rows, ["series_id", "fold_no", "origin"])
    run = ["series_id", "algorithm"]
    run_id = F.concat_ws(":", "series_id", "algorithm").alias("model_run_id")
    folds = M.error_metrics(scored, [*run, "fold_no"], run)
    horizons = M.horizon_metrics(scored, run, run)
    summary = M.cv_summary(folds, run)
    nothing = F.lit(None).cast("double")
    runs = summary.select(
        F.col("series_id").alias("experiment_id"),
        run_id,
        "algorithm",
        F.lit("completed").alias("status"),
        F.lit(False).alias("is_recommended"),
        F.lit("{}").alias("hyperparameters_json"),
        "mean_cv_mae",
        "std_cv_mae",
        *(nothing.alias(n) for n in ("final_mae", "final_rmse", "final_smape", "predict_ms_median")),
        F.lit(None).cast("string").alias("failure_code"),
    )
    scope = F.lit(X.SCOPE_CV).alias("evaluation_scope")
    errors = ("mae", "rmse", "smape")
    return (
        runs,
        folds.select(run_id, "fold_no", "evaluation_rows", *errors),
        horizons.select(run_id, scope, "horizon", *errors),
    )


def export_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.metric_rows(*_run_tables(spark, sf_dir)))


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = E.model_comparison(*_run_tables(spark, sf_dir))
    milli = lambda value: F.round(value * 1000, 0).cast("long").cast("string")
    folds = F.transform(
        "fold_metrics",
        lambda m: F.concat_ws(":", m["fold_no"], m["evaluation_rows"], milli(m["mae"])),
    )
    horizons = F.transform(
        "horizon_metrics", lambda m: F.concat_ws(":", m["horizon"], milli(m["smape"]))
    )
    flat = compared.select(
        "experiment_id",
        "model_run_id",
        "mean_cv_mae",
        F.array_join(folds, ",").alias("folds"),
        F.array_join(horizons, ",").alias("horizons"),
    )
    return rounded(flat.orderBy(*_comparison_order()))


def _comparison_order():
    return [F.col("mean_cv_mae").asc_nulls_last(), F.col("model_run_id")]


def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs, folds, horizons = _run_tables(spark, sf_dir)
    compared = E.model_comparison(runs, folds, horizons)
    experiments = runs.select(
        "experiment_id",
        F.col("experiment_id").alias("dataset_version_id"),
        F.lit("baselines").alias("name"),
        F.lit("completed").alias("status"),
        F.lit("coverage_90").alias("sensitivity_mode"),
    ).distinct()
    return E.metric_documents(compared, experiments)


def _forecast_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Forecast headers and their points, amounts in hundredths."""
    hourly = _full(hourly_events(spark, sf_dir))
    points = FC.naive_forecast(hourly, 24, mode="coverage_90")
    cents = F.round("predicted_energy_kwh", 2).alias("predicted_energy_kwh")
    forecast_id = F.concat(F.lit("=f:"), F.col("series_id")).alias("forecast_id")
    totals = FC.forecast_totals(points)
    headers = totals.select(
        forecast_id,
        F.concat_ws(":", "series_id", F.lit("seasonal_naive_24")).alias("model_run_id"),
        F.col("series_id").alias("dataset_version_id"),
        "origin",
        F.lit("UTC").alias("timezone"),
        F.lit("seasonal_naive_24").alias("algorithm"),
        F.lit(FEATURE_VERSIONS[False]).alias("feature_schema_version"),
        F.sha2(F.col("series_id"), 256).alias("bundle_sha256"),
        F.round("total_energy_kwh", 2).alias("total_energy_kwh"),
    )
    return headers, points.select(forecast_id, "horizon", "target_time", cents)


def export_forecast_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.csv_cells(E.forecast_rows(*_forecast_tables(spark, sf_dir)))


def chart_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.chart_documents(E.forecast_rows(*_forecast_tables(spark, sf_dir)))


def forecast_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = _full(hourly_events(spark, sf_dir))
    origins = FC.requested_origins(hourly, ORIGIN)
    points = FC.naive_forecast(hourly, 168, mode="coverage_90", origins=origins)
    return rounded(E.with_actuals(points, hourly, ["series_id"]))


def forecast_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of an experiment per customer, line items as their forecasts."""
    forecasts = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("forecast_id"),
        F.col("l_orderkey").cast("string").alias("model_run_id"),
        F.col("l_shipdate").alias("origin"),
    )
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("model_run_id"),
        F.col("o_custkey").alias("experiment_id"),
        F.col("o_orderpriority").alias("algorithm"),
    )
    experiments = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("experiment_id"),
        F.col("c_nationkey").cast("long").alias("dataset_version_id"),
        F.col("c_name").alias("experiment_name"),
    )
    stored = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("dataset_version_id"),
        F.col("n_regionkey").cast("long").alias("dataset_id"),
        F.lit(1).cast("long").alias("version_no"),
    )
    return E.forecast_provenance(forecasts, runs, experiments, stored)


def neutralize_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts behind formula marks, blanks and tabs."""
    marks = ["", "=", " +", "\t", "-", "\n@", " "]
    mark = F.element_at(F.array(*(F.lit(m) for m in marks)), (F.col("doc_id") % 7 + 1).cast("int"))
    text = F.concat(mark, F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(E.neutral_text(text)).alias("digest")
    )


def replace_version_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated import replaces its own version and leaves the others."""
    path = scratch_folder(spark, "hourly")
    daily = daily_quantity(spark, sf_dir).withColumn(C.VERSION, F.col("series_id"))
    C.replace_version(daily, path)
    again = daily.where("series_id = 'R'").withColumn("energy_kwh", F.col("energy_kwh") * 2)
    C.replace_version(again, path)
    stored = spark.read.parquet(path)
    return rounded(
        stored.groupBy(C.VERSION).agg(
            F.count(F.lit(1)).alias("row_count"), F.sum("energy_kwh").alias("energy_kwh")
        )
    )


def hourly_write_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "hourly")
    C.replace_version(hourly_events(spark, sf_dir).withColumn(C.VERSION, F.col("series_id")), path)
    return C.version_statistics(C.scan_version(spark, path, "all"))


def catalog_version_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.version_counts(datasets(spark, sf_dir), versions(spark, sf_dir))


def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = catalog_version_counts(spark, sf_dir)
    order = [F.col("version_count").desc(), F.col("dataset_id")]
    return read_page(spark, index_pages(listed, order, scratch_folder(spark, "pages")), 2, 25)


def next_version_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.next_version(datasets(spark, sf_dir), versions(spark, sf_dir))


def duplicate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("c_acctbal") > 0, "O").otherwise("F")
    incoming = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("dataset_id"),
        F.sha2(F.concat(status, F.lit("1-URGENT")), 256).alias("source_sha256"),
    )
    return C.duplicate_sources(incoming, versions(spark, sf_dir))


def _guarded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders as datasets and all line items as what refers to them; a few orders have none."""
    parents = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("dataset_id"), F.col("o_orderpriority").alias("name")
    )
    return parents, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dataset_id"))


def deletable_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.deletable(*_guarded(spark, sf_dir))


def datasets_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.in_use(*_guarded(spark, sf_dir))


def latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias(C.VERSION),
        F.col("o_orderkey").alias("report_version"),
        F.col("o_totalprice").alias("total"),
    )
    return C.latest_report(reports)


QUERIES = {
    "export_metrics_long": export_metrics_long,
    "model_comparison": model_comparison,
    "metrics_json": metrics_json,
    "export_forecast_csv_rows": export_forecast_csv_rows,
    "chart_json": chart_json,
    "forecast_actuals": forecast_actuals,
    "forecast_provenance": forecast_provenance,
    "neutralize_cells": neutralize_cells,
    "replace_version_roundtrip": replace_version_roundtrip,
    "hourly_write_roundtrip": hourly_write_roundtrip,
    "catalog_version_counts": catalog_version_counts,
    "catalog_page": catalog_page,
    "next_version_no": next_version_no,
    "duplicate_sources": duplicate_sources,
    "deletable_datasets": deletable_datasets,
    "datasets_in_use": datasets_in_use,
    "latest_report": latest_report,
}

_RUNS = f"""{_CV}, {_FM}, fe AS (
  SELECT series_id || ':' || algorithm AS model_run_id, fold_no,
         count(*) FILTER (WHERE horizon = 1) AS evaluation_rows, avg(abs(actual - predicted)) AS mae,
         sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
         avg(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0
             ELSE 2 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END) * 100 AS smape
  FROM ok GROUP BY 1, 2
), he AS (
  SELECT series_id || ':' || algorithm AS model_run_id, horizon, avg(abs(actual - predicted)) AS mae,
         sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse,
         avg(CASE WHEN abs(actual) + abs(predicted) = 0 THEN 0
             ELSE 2 * abs(actual - predicted) / (abs(actual) + abs(predicted)) END) * 100 AS smape
  FROM ok GROUP BY 1, 2
), ru AS (
  SELECT series_id AS experiment_id, series_id || ':' || algorithm AS model_run_id, algorithm,
         avg(mae) AS mean_cv_mae, stddev_pop(mae) AS std_cv_mae FROM fm GROUP BY 1, 2, 3
)"""
_BASE = """experiment_id, model_run_id, algorithm, 'completed' AS status, false AS is_recommended,
       '{}' AS hyperparameters_json"""
_NULLS = """CAST(NULL AS DOUBLE) AS final_mae, CAST(NULL AS DOUBLE) AS final_rmse,
       CAST(NULL AS DOUBLE) AS final_smape, CAST(NULL AS DOUBLE) AS predict_ms_median,
       CAST(NULL AS VARCHAR) AS failure_code"""

ORACLE = {
    "export_metrics_long": f"""{_RUNS}
SELECT {_BASE}, 'summary' AS row_type, CAST(NULL AS BIGINT) AS fold_no,
       CAST(NULL AS VARCHAR) AS evaluation_scope, CAST(NULL AS BIGINT) AS horizon,
       CAST(NULL AS BIGINT) AS evaluation_rows, CAST(NULL AS DOUBLE) AS mae, CAST(NULL AS DOUBLE) AS rmse,
       CAST(NULL AS DOUBLE) AS smape, round(mean_cv_mae, 6) AS mean_cv_mae,
       round(std_cv_mae, 6) AS std_cv_mae, {_NULLS}
FROM ru
UNION ALL BY NAME
SELECT {_BASE}, 'fold' AS row_type, fold_no, evaluation_rows, round(mae, 6) AS mae, round(rmse, 6) AS rmse,
       round(smape, 6) AS smape FROM ru JOIN fe USING (model_run_id)
UNION ALL BY NAME
SELECT {_BASE}, 'horizon' AS row_type, 'cv' AS evaluation_scope, horizon, round(mae, 6) AS mae,
       round(rmse, 6) AS rmse, round(smape, 6) AS smape FROM ru JOIN he USING (model_run_id)""",
    "model_comparison": f"""{_RUNS}
SELECT experiment_id, model_run_id, round(mean_cv_mae, 6) AS mean_cv_mae,
       (SELECT string_agg(fold_no || ':' || evaluation_rows || ':' || CAST(round(mae * 1000, 0) AS BIGINT),
               ',' ORDER BY fold_no) FROM fe WHERE fe.model_run_id = ru.model_run_id) AS folds,
       (SELECT string_agg(horizon || ':' || CAST(round(smape * 1000, 0) AS BIGINT), ',' ORDER BY horizon)
        FROM he WHERE he.model_run_id = ru.model_run_id) AS horizons
FROM ru""",
    "export_forecast_csv_rows": f"""{_forecast_sql(24)}
SELECT '''=f:' || series_id AS forecast_id, series_id || ':seasonal_naive_24' AS model_run_id,
       series_id AS dataset_version_id, strftime(origin, '%Y-%m-%dT%H:%M:%S+00:00') AS origin,
       'UTC' AS timezone, 'seasonal_naive_24' AS algorithm, 'base_v1' AS feature_schema_version,
       sha256(series_id) AS bundle_sha256,
       CAST(round(sum(predicted_energy_kwh) OVER (PARTITION BY series_id), 2) AS VARCHAR) AS total_energy_kwh,
       CAST(horizon AS VARCHAR) AS horizon, strftime(target_time, '%Y-%m-%dT%H:%M:%S+00:00') AS target_time,
       CAST(round(predicted_energy_kwh, 2) AS VARCHAR) AS predicted_energy_kwh, '' AS actual_energy_kwh
FROM pts""",
    "forecast_actuals": f"""{_forecast_sql(168).replace(
        "SELECT series_id, max(hour_start) AS origin FROM h WHERE energy_kwh IS NOT NULL GROUP BY 1",
        "SELECT series_id, hour_start AS origin FROM h WHERE energy_kwh IS NOT NULL"
        " AND hour_start = TIMESTAMP '2024-01-25'")}
SELECT p.series_id, p.origin, p.horizon, p.target_time,
       round(p.predicted_energy_kwh, 6) AS predicted_energy_kwh, round(h.energy_kwh, 6) AS actual_energy_kwh
FROM pts p LEFT JOIN h ON h.series_id = p.series_id AND h.hour_start = p.target_time""",
    "forecast_provenance": """SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS forecast_id,
       CAST(o_orderkey AS VARCHAR) AS model_run_id, o_custkey AS experiment_id,
       CAST(c_nationkey AS BIGINT) AS dataset_version_id, l_shipdate AS origin, o_orderpriority AS algorithm,
       c_name AS experiment_name, CAST(n_regionkey AS BIGINT) AS dataset_id, CAST(1 AS BIGINT) AS version_no
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey""",
    "neutralize_cells": """WITH t AS (
  SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '=' WHEN 2 THEN ' +' WHEN 3 THEN chr(9)
         WHEN 4 THEN '-' WHEN 5 THEN chr(10) || '@' ELSE ' ' END || text AS text FROM documents
)
SELECT doc_id, md5(CASE WHEN text = '' THEN text
  WHEN substr(text, 1, 1) IN (chr(9), chr(10), chr(13))
    OR substr(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), 1, 1) IN ('=', '+', '-', '@')
  THEN '''' || text ELSE text END) AS digest FROM t""",
    "replace_version_roundtrip": """WITH d AS (
  SELECT l_returnflag AS v, l_shipdate, sum(l_quantity) AS e FROM lineitem GROUP BY 1, 2
)
SELECT v AS dataset_version_id, count(*) AS row_count,
       round(sum(CASE WHEN v = 'R' THEN 2 * e ELSE e END), 6) AS energy_kwh FROM d GROUP BY 1""",
    "hourly_write_roundtrip": f"""WITH {HOURLY_SQL}
SELECT series_id AS dataset_version_id, count(*) AS row_count,
       count(*) FILTER (WHERE quality_status IN ('complete', 'imputed_short_gap')) AS training_ready_count,
       min(hour_start) AS min_hour, max(hour_start) AS max_hour FROM h GROUP BY 1""",
    "catalog_version_counts": f"""WITH {CATALOG_SQL}
SELECT dataset_id, name, (SELECT count(*) FROM vs WHERE vs.dataset_id = ds.dataset_id) AS version_count
FROM ds""",
    "catalog_page": f"""WITH {CATALOG_SQL}
SELECT dataset_id, name, (SELECT count(*) FROM vs WHERE vs.dataset_id = ds.dataset_id) AS version_count
FROM ds ORDER BY version_count DESC, dataset_id LIMIT 25 OFFSET 25""",
    "next_version_no": f"""WITH {CATALOG_SQL}
SELECT dataset_id, coalesce((SELECT max(version_no) FROM vs WHERE vs.dataset_id = ds.dataset_id), 0) + 1
       AS next_version_no FROM ds""",
    "duplicate_sources": f"""WITH {CATALOG_SQL}, inc AS (
  SELECT c_custkey AS dataset_id,
         sha256(CASE WHEN c_acctbal > 0 THEN 'O' ELSE 'F' END || '1-URGENT') AS source_sha256 FROM customer
)
SELECT * FROM inc WHERE EXISTS (SELECT 1 FROM vs WHERE vs.dataset_id = inc.dataset_id
  AND vs.source_sha256 = inc.source_sha256)""",
    "deletable_datasets": """SELECT o_orderkey AS dataset_id, o_orderpriority AS name FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "datasets_in_use": """SELECT o_orderkey AS dataset_id, o_orderpriority AS name FROM orders
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "latest_report": """SELECT o_custkey AS dataset_version_id, max(o_orderkey) AS report_version,
       arg_max(o_totalprice, o_orderkey) AS total FROM orders GROUP BY 1""",
}
