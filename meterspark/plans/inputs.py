"""Adapters from the given tables to measurements, hourly facts, daily series and text lines.

Each adapter exists as a DataFrame and as a SQL common table expression with the same meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.functions.clock import epoch, floor_to, from_epoch
from meterspark.session import spread, use_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# -- events as readings ---------------------------------------------------------------------------


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one meter on a 300-second grid, with copies, late rows and damaged cells."""
    return _readings(spark, sf_dir, F.lit("all"), 300)


def meter_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as five meters on a 1,200-second grid."""
    return _readings(spark, sf_dir, F.col("event_type"), 1200)


def _readings(spark: SparkSession, sf_dir: str, series, slot: int) -> DataFrame:
    event = F.col("event_id")
    copies = F.when(event % 37 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", F.explode(copies).alias("copy")
    )
    late = F.when(event % 53 == 0, 30).otherwise(0)
    return events.select(
        series.alias("series_id"),
        (event * 2 + 2 + F.col("copy")).alias("source_row_number"),
        from_epoch(epoch(floor_to(F.col("ts"), slot)) + late).alias("observed_at"),
        F.lit(slot).alias("interval_seconds"),
        F.col("value").alias("energy_kwh"),
        F.lit(None).cast("double").alias("active_power_kw"),
        (F.col("value") / 7).alias("reactive_power_kw"),
        F.when(event % 701 == 0, 0.0).otherwise(220.0 + F.col("user_id") % 20).alias("voltage_v"),
        F.when(event % 907 == 0, -1.0).otherwise(F.col("value") / 3).alias("current_a"),
        F.when(event % 5 != 0, F.col("value") * 2).alias("sub_metering_1_wh"),
        F.lit(None).cast("double").alias("sub_metering_2_wh"),
        F.lit(None).cast("double").alias("sub_metering_3_wh"),
        F.when(event % 499 == 0, "invalid")
        .when(event % 5 == 0, "warning")
        .otherwise("valid")
        .alias("parse_status"),
        F.when(event % 499 == 0, F.array(F.lit("parse_error:energy")))
        .when(event % 5 == 0, F.array(F.lit("missing:sub_1")))
        .otherwise(F.array().cast("array<string>"))
        .alias("quality_flags"),
    )


def readings_sql(name: str = "r", series: str = "'all'", slot: int = 300) -> str:
    return f"""{name} AS (
  SELECT {series} AS series_id,
         event_id * 2 + 2 + copy AS source_row_number,
         time_bucket(INTERVAL '{slot} seconds', ts, TIMESTAMP '1970-01-01')
           + CASE WHEN event_id % 53 = 0 THEN INTERVAL '30 seconds' ELSE INTERVAL '0 seconds' END
           AS observed_at,
         value AS energy_kwh,
         CAST(NULL AS DOUBLE) AS active_power_kw,
         value / 7 AS reactive_power_kw,
         CASE WHEN event_id % 701 = 0 THEN 0.0::DOUBLE
              ELSE (220 + user_id % 20)::DOUBLE END AS voltage_v,
         CASE WHEN event_id % 907 = 0 THEN -1.0::DOUBLE ELSE value / 3 END AS current_a,
         CASE WHEN event_id % 5 <> 0 THEN value * 2 END AS sub_metering_1_wh,
         CAST(NULL AS DOUBLE) AS sub_metering_2_wh,
         CAST(NULL AS DOUBLE) AS sub_metering_3_wh,
         CASE WHEN event_id % 499 = 0 THEN 'invalid'
              WHEN event_id % 5 = 0 THEN 'warning' ELSE 'valid' END AS parse_status,
         CASE WHEN event_id % 499 = 0 THEN 'parse_error:energy'
              WHEN event_id % 5 = 0 THEN 'missing:sub_1' ELSE '' END AS flag
  FROM (SELECT *, 0 AS copy FROM events
        UNION ALL SELECT *, 1 AS copy FROM events WHERE event_id % 37 = 0)
)"""


READINGS_SQL = readings_sql()
METERS_SQL = readings_sql(series="event_type", slot=1200)


# -- events as hourly facts -----------------------------------------------------------------------


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events summed to hours of one series; coverage is the share of 300-second slots used.

    The slots of an hour are bits of one integer, so distinct slots need no second shuffle.
    """
    slot = F.expr("shiftleft(1, cast(floor(minute(ts) / 5) as int))")
    hour = floor_to(F.col("ts"), 3600)
    per_hour = (
        table(spark, sf_dir, "events")
        .groupBy(hour.alias("hour_start"))
        .agg(F.bit_count(F.bit_or(slot)).alias("used"), F.sum("value").alias("total"))
    )
    used = F.col("used")
    return per_hour.select(
        F.lit("all").alias("series_id"),
        "hour_start",
        F.when(used > 3, F.col("total")).alias("energy_kwh"),
        (used / F.lit(12)).alias("coverage_ratio"),
        F.when(used == 12, "complete")
        .when(used >= 10, "valid_partial")
        .when(used >= 8, "imputed_short_gap")
        .otherwise("invalid_missing")
        .alias("quality_status"),
    )


HOURLY_SQL = """h AS (
  SELECT 'all' AS series_id, hour_start,
         CASE WHEN used > 3 THEN total END AS energy_kwh,
         used / 12 AS coverage_ratio,
         CASE WHEN used = 12 THEN 'complete' WHEN used >= 10 THEN 'valid_partial'
              WHEN used >= 8 THEN 'imputed_short_gap' ELSE 'invalid_missing' END AS quality_status
  FROM (SELECT date_trunc('hour', ts) AS hour_start,
               count(DISTINCT floor(minute(ts) / 5)) AS used, sum(value) AS total
        FROM events GROUP BY 1)
)"""


# -- line items as daily series -------------------------------------------------------------------


def daily_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped per day as three series (by return flag) with a step of one day."""
    daily = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series_id"), F.col("l_shipdate").alias("hour_start"))
        .agg(F.sum("l_quantity").alias("energy_kwh"), F.count(F.lit(1)).alias("n"))
    )
    return daily.select(
        "series_id",
        "hour_start",
        "energy_kwh",
        F.least(F.lit(1.0), F.col("n") / 10).alias("coverage_ratio"),
        F.when(F.col("n") >= 10, "complete")
        .when(F.col("n") % 3 == 0, "imputed_short_gap")
        .otherwise("valid_partial")
        .alias("quality_status"),
    )


DAILY_SQL = """d AS (
  SELECT series_id, hour_start, energy_kwh, least(1.0::DOUBLE, n / 10) AS coverage_ratio,
         CASE WHEN n >= 10 THEN 'complete' WHEN n % 3 = 0 THEN 'imputed_short_gap'
              ELSE 'valid_partial' END AS quality_status
  FROM (SELECT l_returnflag AS series_id, l_shipdate AS hour_start,
               sum(l_quantity) AS energy_kwh, count(*) AS n
        FROM lineitem GROUP BY 1, 2)
)"""

GRID_SQL = f"""{DAILY_SQL},
ends AS (SELECT series_id, min(hour_start) AS lo, max(hour_start) AS hi FROM d GROUP BY 1),
g AS (
  SELECT s.series_id, s.origin, d.energy_kwh, d.coverage_ratio, d.quality_status
  FROM (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL '1 day')) AS origin FROM ends) s
  LEFT JOIN d ON d.series_id = s.series_id AND d.hour_start = s.origin
)"""


# -- events as text lines -------------------------------------------------------------------------


def uci_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as household-power lines; some cells, dates and line lengths are damaged."""
    event = F.col("event_id")
    date = F.when(event % 211 == 0, F.lit("32/13/2024")).otherwise(F.date_format("ts", "d/M/yyyy"))
    power = (
        F.when(event % 13 == 0, "?")
        .when(event % 17 == 0, "bad")
        .when(event % 19 == 0, "inf")
        .when(event % 23 == 0, "1_0.5")
        .otherwise(F.col("value").cast("decimal(12,2)").cast("string"))
    )
    cells = [
        date,
        F.date_format("ts", "H:m:s"),
        power,
        F.lit("0.418"),
        (F.lit(220) + F.col("user_id") % 20).cast("string"),
        F.when(event % 29 == 0, "").otherwise(F.col("user_id").cast("string")),
        F.lit("0.000"),
        F.lit("1.000"),
    ]
    last = F.when(event % 101 == 0, F.lit("")).otherwise(F.lit(";17.000"))
    return spread(table(spark, sf_dir, "events")).select(
        F.lit("all").alias("series_id"),
        (event + 2).alias("source_row_number"),
        F.concat(F.concat_ws(";", *cells), last).alias("value"),
    )


UCI_SQL = """l AS (
  SELECT event_id + 2 AS source_row_number,
         concat_ws(';',
           CASE WHEN event_id % 211 = 0 THEN '32/13/2024' ELSE strftime(ts, '%-d/%-m/%Y') END,
           strftime(ts, '%-H:%-M:%-S'),
           CASE WHEN event_id % 13 = 0 THEN '?' WHEN event_id % 17 = 0 THEN 'bad'
                WHEN event_id % 19 = 0 THEN 'inf' WHEN event_id % 23 = 0 THEN '1_0.5'
                ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END,
           '0.418', CAST(220 + user_id % 20 AS VARCHAR),
           CASE WHEN event_id % 29 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END,
           '0.000', '1.000')
         || CASE WHEN event_id % 101 = 0 THEN '' ELSE ';17.000' END AS value
  FROM events
)"""


def mapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ``timestamp;watts;volts`` lines with decimal commas; some cells are damaged."""
    event = F.col("event_id")
    watts = (
        F.when(event % 31 == 0, "nan")
        .when(event % 41 == 0, "1,5x")
        .otherwise(F.replace(F.col("value").cast("decimal(12,2)").cast("string"), F.lit("."), F.lit(",")))
    )
    stamp = F.when(event % 97 == 0, F.lit("yesterday")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    volts = F.when(event % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit(";"), (F.lit(220) + F.col("user_id") % 20).cast("string"), F.lit(",5"))
    )
    return spread(table(spark, sf_dir, "events")).select(
        F.lit("all").alias("series_id"),
        (event + 2).alias("source_row_number"),
        F.concat(stamp, F.lit(";"), watts, volts).alias("value"),
    )


MAPPED_SQL = """l AS (
  SELECT event_id + 2 AS source_row_number,
         CASE WHEN event_id % 97 = 0 THEN 'yesterday'
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END || ';'
         || CASE WHEN event_id % 31 = 0 THEN 'nan' WHEN event_id % 41 = 0 THEN '1,5x'
                 ELSE replace(CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR), '.', ',') END
         || CASE WHEN event_id % 7 = 0 THEN ''
                 ELSE ';' || CAST(220 + user_id % 20 AS VARCHAR) || ',5' END AS value
  FROM events
)"""


# -- orders as a dataset catalogue ----------------------------------------------------------------


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("dataset_id"), F.col("c_name").alias("name")
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("dataset_version_id"),
        F.col("o_custkey").alias("dataset_id"),
        F.col("o_orderkey").alias("version_no"),
        F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("source_sha256"),
        F.col("o_orderdate").alias("created_at"),
    )


CATALOG_SQL = """ds AS (SELECT c_custkey AS dataset_id, c_name AS name FROM customer),
vs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS dataset_version_id, o_custkey AS dataset_id,
         o_orderkey AS version_no, sha256(o_orderstatus || o_orderpriority) AS source_sha256,
         o_orderdate AS created_at
  FROM orders
)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded and counts as longs, so that engines can be compared value by value."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "double":
            columns.append((F.round(field.name, digits) + F.lit(0.0)).alias(field.name))
        elif kind in ("integer", "short"):
            columns.append(F.col(field.name).cast("long"))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)
