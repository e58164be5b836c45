"""Registered queries: quality checks over events read as one meter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.operators import quality as Q
from meterspark.operators.pages import index_pages, read_page
from meterspark.plans.inputs import METERS_SQL, READINGS_SQL, meter_readings, readings, rounded
from meterspark.schemas import MEASURES
from meterspark.session import scratch_folder, staged


def quality_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.duplicate_times(readings(spark, sf_dir)))


def quality_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.cadence(Q.time_steps(meter_readings(spark, sf_dir))))


def quality_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = staged(Q.time_steps(meter_readings(spark, sf_dir)), "steps")
    return rounded(Q.gaps(steps, Q.cadence(steps)))


def quality_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.order_pairs(readings(spark, sf_dir)))


def quality_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.value_issues(readings(spark, sf_dir)))


def quality_parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.parse_error_issues(readings(spark, sf_dir)))


def quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.outliers(readings(spark, sf_dir)).withColumn("robust_z", F.bround("robust_z", 6))
    return rounded(rows)


def quality_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.quality_issues(readings(spark, sf_dir)))


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.quality_report(readings(spark, sf_dir)).summary)


def quality_evidence_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.value_evidence(readings(spark, sf_dir)))


def quality_evidence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.quality_evidence(readings(spark, sf_dir))


def page_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = Q.value_issues(readings(spark, sf_dir))
    index = index_pages(issues, Q.issue_order(), scratch_folder(spark, "pages"))
    return rounded(read_page(spark, index, 2, 3))


QUERIES = {
    "quality_duplicates": quality_duplicates,
    "quality_cadence": quality_cadence,
    "quality_gaps": quality_gaps,
    "quality_order": quality_order,
    "quality_values": quality_values,
    "quality_parse_errors": quality_parse_errors,
    "quality_outliers": quality_outliers,
    "quality_issues": quality_issues,
    "quality_summary": quality_summary,
    "quality_evidence_top10": quality_evidence_top10,
    "quality_evidence_json": quality_evidence_json,
    "page_issues": page_issues,
}

_STEPS = """t AS (
  SELECT series_id, observed_at, lag(observed_at) OVER (PARTITION BY series_id ORDER BY observed_at) AS prev
  FROM (SELECT DISTINCT series_id, observed_at FROM r)
), st AS (
  SELECT *, CAST(date_diff('second', prev, observed_at) AS BIGINT) AS step FROM t WHERE prev IS NOT NULL
), cad AS (
  SELECT series_id, step AS expected_interval_seconds FROM (
    SELECT series_id, step, row_number() OVER (PARTITION BY series_id ORDER BY count(*) DESC, step) AS rn
    FROM st GROUP BY series_id, step) WHERE rn = 1
), gap AS (
  SELECT st.series_id, prev AS gap_start, observed_at AS gap_end, step AS delta_seconds,
         CAST(greatest(1, round_even(step / expected_interval_seconds, 0) - 1) AS BIGINT) AS estimated_missing
  FROM st JOIN cad USING (series_id) WHERE step > 1.5 * expected_interval_seconds
)"""
_DUPLICATES = f"""dup AS (
  SELECT series_id, observed_at, CAST(sum(c) AS BIGINT) AS n, count(*) AS d FROM (
    SELECT series_id, observed_at, count(*) AS c FROM r
    GROUP BY series_id, observed_at, {', '.join(MEASURES)}, parse_status, flag)
  GROUP BY 1, 2 HAVING sum(c) > 1
), dt AS (
  SELECT series_id, observed_at, n - d AS exact_excess, CASE WHEN d > 1 THEN n ELSE 0 END AS conflicting_rows
  FROM dup
)"""
_ORDER = """ord AS (
  SELECT * FROM (
    SELECT series_id, lag(source_row_number) OVER w AS prev_source_row_number, source_row_number,
           lag(observed_at) OVER w AS prev_observed_at, observed_at
    FROM r WINDOW w AS (PARTITION BY series_id ORDER BY source_row_number))
  WHERE observed_at < prev_observed_at
)"""


def _invalid(measure: str) -> str:
    return f"isfinite({measure}) AND {measure} {'<=' if measure == 'voltage_v' else '<'} 0"


def _value_cases() -> list[tuple[str, str, str]]:
    cases = []
    for measure in MEASURES:
        cases += [
            ("missing", measure, f"{measure} IS NULL"),
            ("non_finite", measure, f"{measure} IS NOT NULL AND NOT isfinite({measure})"),
            ("physical_invalidity", measure, _invalid(measure)),
        ]
    return cases


_VALUES = "val AS (" + " UNION ALL ".join(
    f"""SELECT series_id, '{kind}' AS issue_type, '{measure}' AS column_name, min(observed_at) AS range_start,
        max(observed_at) AS range_end, count(*) AS occurrence_count
        FROM r WHERE {condition} GROUP BY series_id"""
    for kind, measure, condition in _value_cases()
) + ")"
_OUTLIERS = "cell AS (" + " UNION ALL ".join(
    f"""SELECT series_id, source_row_number, observed_at, '{m}' AS column_name, {m} AS value
        FROM r WHERE isfinite({m})"""
    for m in MEASURES
) + """), med AS (
  SELECT series_id, column_name, median(value) AS median FROM cell GROUP BY 1, 2 HAVING count(*) >= 3
), spread AS (
  SELECT series_id, column_name, median, median(abs(value - median)) AS mad
  FROM cell JOIN med USING (series_id, column_name) GROUP BY 1, 2, 3
), outl AS (
  SELECT series_id, source_row_number, observed_at, column_name, value, median, mad,
         abs(value - median) / (1.4826 * mad) AS robust_z
  FROM cell JOIN spread USING (series_id, column_name)
  WHERE mad <> 0 AND abs(value - median) / (1.4826 * mad) > 6
)"""
_ISSUES = """iss AS (
  SELECT series_id, 'timestamp_order' AS issue_type, 'warning' AS severity,
         CAST(NULL AS VARCHAR) AS column_name, min(observed_at) AS range_start,
         max(observed_at) AS range_end, count(*) AS occurrence_count FROM ord GROUP BY 1
  UNION ALL SELECT series_id, 'exact_duplicate', 'warning', NULL, min(observed_at), max(observed_at),
         CAST(sum(exact_excess) AS BIGINT) FROM dt WHERE exact_excess > 0 GROUP BY 1
  UNION ALL SELECT series_id, 'conflicting_duplicate', 'error', NULL, min(observed_at),
         max(observed_at), CAST(sum(conflicting_rows) AS BIGINT) FROM dt WHERE conflicting_rows > 0 GROUP BY 1
  UNION ALL SELECT series_id, 'time_gap', 'warning', NULL, min(gap_start), max(gap_end), count(*)
         FROM gap GROUP BY 1
  UNION ALL SELECT series_id, issue_type, CASE issue_type WHEN 'missing' THEN 'warning' ELSE 'error' END,
         column_name, range_start, range_end, occurrence_count FROM val
  UNION ALL SELECT series_id, 'parse_error', 'error', NULL, min(observed_at), max(observed_at), count(*)
         FROM r WHERE parse_status = 'invalid' GROUP BY 1
  UNION ALL SELECT series_id, 'statistical_anomaly', 'info', column_name, min(observed_at),
         max(observed_at), count(*) FROM outl GROUP BY series_id, column_name
)"""
_ALL = ", ".join([READINGS_SQL, _STEPS, _DUPLICATES, _ORDER, _VALUES, _OUTLIERS, _ISSUES])
_SUMMED = {
    "missing_values": "missing",
    "non_finite_values": "non_finite",
    "physical_invalid_values": "physical_invalidity",
    "statistical_anomalies": "statistical_anomaly",
    "exact_duplicates": "exact_duplicate",
    "conflicting_duplicates": "conflicting_duplicate",
    "gap_count": "time_gap",
    "timestamp_order_violations": "timestamp_order",
    "parse_errors": "parse_error",
}

ORACLE = {
    "quality_duplicates": f"WITH {READINGS_SQL}, {_DUPLICATES} SELECT * FROM dt",
    "quality_cadence": f"WITH {METERS_SQL}, {_STEPS} SELECT * FROM cad",
    "quality_gaps": f"WITH {METERS_SQL}, {_STEPS} SELECT * FROM gap",
    "quality_order": f"WITH {READINGS_SQL}, {_ORDER} SELECT * FROM ord",
    "quality_values": f"WITH {READINGS_SQL}, {_VALUES} SELECT * FROM val",
    "quality_parse_errors": f"""WITH {READINGS_SQL}
SELECT series_id, 'parse_error' AS issue_type, CAST(NULL AS VARCHAR) AS column_name,
       min(observed_at) AS range_start, max(observed_at) AS range_end, count(*) AS occurrence_count
FROM r WHERE parse_status = 'invalid' GROUP BY 1""",
    "quality_outliers": f"""WITH {READINGS_SQL}, {_OUTLIERS}
SELECT series_id, source_row_number, observed_at, column_name, round(value, 6) AS value,
       round(median, 6) AS median, round(mad, 6) AS mad, round_even(robust_z, 6) AS robust_z FROM outl""",
    "quality_issues": f"WITH {_ALL} SELECT * FROM iss",
    "quality_summary": f"""WITH {_ALL}
SELECT series_id, (SELECT count(*) FROM r) AS total_rows,
       (SELECT expected_interval_seconds FROM cad) AS expected_interval_seconds,
       {', '.join(f"CAST(coalesce(sum(occurrence_count) FILTER (WHERE issue_type = '{kind}'), 0) AS BIGINT) AS {name}"
                  for name, kind in _SUMMED.items())},
       count(*) AS issue_group_count
FROM iss GROUP BY 1""",
    "quality_evidence_top10": f"""WITH {READINGS_SQL}, hit AS (
{' UNION ALL '.join(f'''SELECT series_id, source_row_number, observed_at, '{kind}' AS issue_type,
      '{measure}' AS column_name FROM r WHERE {condition}''' for kind, measure, condition in _value_cases())}
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, issue_type, column_name
                               ORDER BY source_row_number) AS position FROM hit)
WHERE position <= 10""",
    "page_issues": f"""WITH {READINGS_SQL}, {_VALUES}
SELECT * FROM val ORDER BY series_id, issue_type, coalesce(column_name, ''), range_start, range_end
LIMIT 3 OFFSET 3""",
}
