"""Registered queries: duplicate policies, gaps and the hourly transform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.operators import hourly as H
from meterspark.plans.inputs import (
    METERS_SQL,
    READINGS_SQL,
    meter_readings,
    readings,
    rounded,
    table,
)
from meterspark.schemas import TRANSFORM_MEASURES

INTERVAL = 300
GAP_MINUTES = 5
FIRST = H.Policy(GAP_MINUTES, 0.8, "keep_first")


def _resolve(policy: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = H.resolve_duplicates(readings(spark, sf_dir), policy, flags=True)
        return rounded(
            rows.select(
                "series_id",
                "observed_at",
                *TRANSFORM_MEASURES,
                "status_code",
                "conflict",
                F.array_join("quality_flags", "|").alias("flags"),
            )
        )

    return query


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = readings(spark, sf_dir)
    return H.resolve_duplicates(rows, "keep_first"), H.target_semantics(rows)


def target_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.target_semantics(meter_readings(spark, sf_dir))


def grid_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.grid_fill(*_resolved(spark, sf_dir), INTERVAL))


def missing_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.missing_runs(*_resolved(spark, sf_dir), INTERVAL))


def interpolate_short_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = H.interpolate_short_gaps(*_resolved(spark, sf_dir), INTERVAL, GAP_MINUTES)
    return rounded(filled)


def _flat(hourly: DataFrame) -> DataFrame:
    return rounded(
        hourly.drop("timezone_context").withColumn(
            "quality_flags", F.array_join("quality_flags", "|")
        )
    )


def _transform(policy: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rules = H.Policy(GAP_MINUTES, 0.8, policy)
        return _flat(H.hourly_transform(readings(spark, sf_dir), INTERVAL, rules))

    return query


def hourly_transform_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = H.Policy(GAP_MINUTES, 0.8, "mean")
    return _flat(H.hourly_transform(meter_readings(spark, sf_dir), 1200, rules))


def hourly_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = H.transform_summary(H.hourly_transform(readings(spark, sf_dir), INTERVAL, FIRST))
    return summary.select(
        "series_id",
        "hour_count",
        "training_ready_hours",
        F.explode("status_counts").alias("quality_status", "hours"),
    )


def infer_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.infer_cadence(readings(spark, sf_dir)))


def infer_cadence_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates read as quarter-hour readings, one series per line status."""
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("series_id"),
        F.timestamp_seconds(days * 900).cast("timestamp_ntz").alias("observed_at"),
    )
    return rounded(H.infer_cadence(rows))


QUERIES = {
    "resolve_reject": _resolve("reject"),
    "resolve_first": _resolve("keep_first"),
    "resolve_last": _resolve("keep_last"),
    "resolve_mean": _resolve("mean"),
    "target_semantic": target_semantic,
    "grid_fill": grid_fill,
    "missing_runs": missing_runs,
    "interpolate_short_gaps": interpolate_short_gaps,
    "hourly_transform": _transform("keep_first"),
    "hourly_transform_reject": _transform("reject"),
    "hourly_transform_mean": _transform("mean"),
    "hourly_transform_meters": hourly_transform_meters,
    "hourly_status_counts": hourly_status_counts,
    "infer_cadence": infer_cadence,
    "infer_cadence_daily": infer_cadence_daily,
}

_SIGNATURE = ", ".join((*TRANSFORM_MEASURES, "parse_status"))


def resolved_sql(policy: str) -> str:
    """Common table expressions ``k`` (ranked rows with signature counts) and ``z`` (one per time)."""
    means = ", ".join(f"avg({m}) OVER w AS mean_{m}" for m in TRANSFORM_MEASURES)
    place = "rl" if policy == "keep_last" else "rn"
    if policy == "mean":
        values = ", ".join(
            f"CASE WHEN d > 1 THEN mean_{m} ELSE {m} END AS {m}" for m in TRANSFORM_MEASURES
        )
        flags = """CASE WHEN d > 1 THEN (SELECT coalesce(string_agg(DISTINCT f.flag, '|' ORDER BY f.flag), '')
            FROM r f WHERE f.series_id = k.series_id AND f.observed_at = k.observed_at AND f.flag <> '')
            ELSE flag END"""
    else:
        values, flags = ", ".join(TRANSFORM_MEASURES), "flag"
    pick = "CASE WHEN d > 1 THEN rl = 1 ELSE rn = 1 END" if place == "rl" else "rn = 1"
    conflict = "d > 1" if policy == "reject" else "false"
    return f"""sig AS (
  SELECT series_id, observed_at, count(*) AS d FROM (
    SELECT DISTINCT series_id, observed_at, {_SIGNATURE} FROM r) GROUP BY 1, 2
), k AS (
  SELECT r.*, d, {means},
         row_number() OVER (PARTITION BY series_id, observed_at ORDER BY source_row_number) AS rn,
         row_number() OVER (PARTITION BY series_id, observed_at ORDER BY source_row_number DESC) AS rl
  FROM r JOIN sig USING (series_id, observed_at)
  WINDOW w AS (PARTITION BY series_id, observed_at)
), z AS (
  SELECT series_id, observed_at, {values}, parse_status,
         CAST(CASE parse_status WHEN 'invalid' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END AS BIGINT) AS status_code,
         {conflict} AS conflict, {flags} AS flags
  FROM k WHERE {pick}
)"""


def _resolve_oracle(policy: str) -> str:
    values = ", ".join(f"round({m}, 6) AS {m}" for m in TRANSFORM_MEASURES)
    return f"""WITH {READINGS_SQL}, {resolved_sql(policy)}
SELECT series_id, observed_at, {values}, status_code, conflict, flags FROM z"""


def grid_sql(interval: int) -> str:
    """Full slot grid ``y`` with the usable energy ``v`` and islands ``i`` of missing slots."""
    per_hour = 3600 // interval
    return f"""e AS (
  SELECT series_id, date_trunc('hour', min(observed_at)) AS lo,
         date_trunc('hour', max(observed_at)) + INTERVAL '1 hour' - INTERVAL '{interval} seconds' AS hi
  FROM r GROUP BY 1
), x AS (
  SELECT series_id, unnest(generate_series(lo, hi, INTERVAL '{interval} seconds')) AS slot_at FROM e
), y AS (
  SELECT x.series_id, x.slot_at, z.* EXCLUDE (series_id),
         CASE WHEN z.status_code <> 2 AND isfinite(z.energy_kwh) AND z.energy_kwh >= 0 THEN z.energy_kwh END AS v,
         row_number() OVER (PARTITION BY x.series_id ORDER BY x.slot_at) AS pos
  FROM x LEFT JOIN z ON z.series_id = x.series_id AND z.observed_at = x.slot_at
), i AS (
  SELECT *, count(v) OVER (PARTITION BY series_id ORDER BY pos) AS island FROM y
), n AS (
  SELECT *, count(*) FILTER (WHERE v IS NULL) OVER (PARTITION BY series_id, island) AS run,
         min(CASE WHEN v IS NULL THEN pos END) OVER (PARTITION BY series_id, island) AS run_pos,
         first_value(v) OVER (PARTITION BY series_id, island ORDER BY pos) AS before_v,
         max(pos) OVER (PARTITION BY series_id) AS last_pos
  FROM i
), a AS (
  SELECT n.*, b.v AS after_v FROM n
  LEFT JOIN i b ON b.series_id = n.series_id AND b.pos = n.run_pos + n.run
), o AS (
  SELECT *, v IS NULL AND island > 0 AND run_pos + run <= last_pos
            AND run * {interval} <= {GAP_MINUTES * 60} AS filled,
         before_v + (after_v - before_v) * (pos - run_pos + 1) / (run + 1) AS line
  FROM a
), hr AS (
  SELECT *, date_trunc('hour', slot_at) AS hour_start, CASE WHEN filled THEN line ELSE v END AS w,
         count(v) OVER (PARTITION BY series_id, date_trunc('hour', slot_at) ORDER BY pos) AS hour_island
  FROM o
), mr AS (
  SELECT series_id, hour_start, max(c) AS max_missing_run FROM (
    SELECT series_id, hour_start, hour_island, count(*) FILTER (WHERE v IS NULL) AS c
    FROM hr GROUP BY 1, 2, 3) GROUP BY 1, 2
), ag AS (
  SELECT series_id, hour_start, count(v) AS observed, count(w) AS present,
         count(*) FILTER (WHERE filled) AS imputed, sum(w) AS energy_kwh,
         coalesce(bool_or(conflict), false) AS conflict,
         coalesce(bool_or(status_code = 2 OR energy_kwh < 0 OR reactive_power_kw < 0 OR current_a < 0
                          OR voltage_v <= 0), false) AS wrong,
         avg(active_power_kw) AS mean_active_power_kw,
         avg(CASE WHEN reactive_power_kw >= 0 THEN reactive_power_kw END) AS mean_reactive_power_kw,
         avg(CASE WHEN voltage_v > 0 THEN voltage_v END) AS mean_voltage_v,
         min(CASE WHEN voltage_v > 0 THEN voltage_v END) AS min_voltage_v,
         max(CASE WHEN voltage_v > 0 THEN voltage_v END) AS max_voltage_v,
         avg(CASE WHEN current_a >= 0 THEN current_a END) AS mean_current_a,
         max(CASE WHEN current_a >= 0 THEN current_a END) AS max_current_a
  FROM hr GROUP BY 1, 2
), hh AS (
  SELECT *, CASE WHEN conflict THEN 'invalid_conflict' WHEN wrong THEN 'invalid_value'
                 WHEN observed = {per_hour} THEN 'complete'
                 WHEN observed >= ceil(0.8 * {per_hour}) AND present = {per_hour} THEN 'imputed_short_gap'
                 WHEN observed >= ceil(0.8 * {per_hour}) THEN 'valid_partial' ELSE 'invalid_missing' END AS status
  FROM ag JOIN mr USING (series_id, hour_start)
)"""


def _transform_oracle(source: str, policy: str, interval: int) -> str:
    per_hour = 3600 // interval
    means = ", ".join(
        f"round({m}, 6) AS {m}"
        for m in (
            "energy_kwh",
            "mean_active_power_kw",
            "mean_reactive_power_kw",
            "mean_voltage_v",
            "min_voltage_v",
            "max_voltage_v",
            "mean_current_a",
            "max_current_a",
        )
    )
    return f"""WITH {source}, {resolved_sql(policy)}, {grid_sql(interval)}
SELECT series_id, hour_start, {means}, observed AS observed_samples,
       CAST({per_hour} AS BIGINT) AS expected_samples, round(observed / {per_hour}, 6) AS coverage_ratio,
       imputed AS imputed_samples, max_missing_run, status AS quality_status,
       concat_ws('|', CASE WHEN conflict THEN 'conflicting_duplicate' END,
                 CASE WHEN wrong THEN 'invalid_target_value' END,
                 CASE WHEN observed < {per_hour} THEN 'missing_samples' END,
                 CASE WHEN imputed > 0 THEN 'short_gap_interpolated' END) AS quality_flags
FROM hh"""


def _cadence_oracle(rows: str) -> str:
    return f"""WITH {rows}, t AS (
  SELECT series_id, observed_at, row_number() OVER (PARTITION BY series_id ORDER BY observed_at) AS rn
  FROM (SELECT DISTINCT series_id, observed_at FROM r)
), s AS (
  SELECT series_id, rn, date_diff('microsecond', lag(observed_at) OVER (
           PARTITION BY series_id ORDER BY rn), observed_at) AS us
  FROM t
), c AS (
  SELECT series_id, us // 1000000 AS step, count(*) AS n, min(rn) AS seen,
         us % 1000000 = 0 AND us <= 3600000000 AND 3600000000 % us = 0 AS fits
  FROM s WHERE us IS NOT NULL GROUP BY series_id, us
), b AS (
  SELECT series_id, step, n FROM (SELECT *, row_number() OVER (
    PARTITION BY series_id ORDER BY n DESC, seen) AS rn FROM c WHERE fits) WHERE rn = 1
)
SELECT q.series_id, CASE WHEN bool_and(s.us % 1000000 = 0 AND (s.us // 1000000) % b.step = 0)
       AND max(b.n) * 2 >= count(*) THEN max(b.step) END AS interval_seconds
FROM (SELECT DISTINCT series_id FROM r) q
LEFT JOIN s ON s.series_id = q.series_id AND s.us IS NOT NULL
LEFT JOIN b ON b.series_id = q.series_id GROUP BY 1"""


_GRID = f"WITH {READINGS_SQL}, {resolved_sql('keep_first')}, {grid_sql(INTERVAL)}"

ORACLE = {
    "resolve_reject": _resolve_oracle("reject"),
    "resolve_first": _resolve_oracle("keep_first"),
    "resolve_last": _resolve_oracle("keep_last"),
    "resolve_mean": _resolve_oracle("mean"),
    "target_semantic": f"""WITH {METERS_SQL}
SELECT series_id, CASE WHEN count(*) FILTER (WHERE isfinite(energy_kwh)) > 0
  AND count(*) FILTER (WHERE isfinite(active_power_kw)) = 0 THEN 'energy' ELSE 'active_power' END AS semantic
FROM r GROUP BY 1""",
    "grid_fill": f"""{_GRID}
SELECT series_id, slot_at AS observed_at, CAST(epoch(slot_at) AS BIGINT) // {INTERVAL} AS slot,
       round(v, 6) AS value FROM y""",
    "missing_runs": f"""{_GRID}
SELECT series_id, min(slot_at) AS run_start, count(*) AS run_length
FROM i WHERE v IS NULL GROUP BY series_id, island""",
    "interpolate_short_gaps": f"""{_GRID}
SELECT series_id, slot_at AS observed_at, round(line, 6) AS value FROM o WHERE filled""",
    "hourly_transform": _transform_oracle(READINGS_SQL, "keep_first", INTERVAL),
    "hourly_transform_reject": _transform_oracle(READINGS_SQL, "reject", INTERVAL),
    "hourly_transform_mean": _transform_oracle(READINGS_SQL, "mean", INTERVAL),
    "hourly_transform_meters": _transform_oracle(METERS_SQL, "mean", 1200),
    "hourly_status_counts": f"""{_GRID}
SELECT series_id, (SELECT count(*) FROM hh) AS hour_count,
       (SELECT count(*) FROM hh WHERE status IN ('complete', 'imputed_short_gap')) AS training_ready_hours,
       status AS quality_status, count(*) AS hours
FROM hh GROUP BY series_id, status""",
    "infer_cadence": _cadence_oracle(READINGS_SQL),
    "infer_cadence_daily": _cadence_oracle("""r AS (
  SELECT l_linestatus AS series_id, TIMESTAMP '1970-01-01'
         + to_seconds(900 * date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))) AS observed_at
  FROM lineitem)"""),
}
