"""Registered queries: parsing text lines and import bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.functions.clock import shift, to_utc
from meterspark.functions.parsing import parse_timestamp, with_numbers
from meterspark.plans.inputs import (
    MAPPED_SQL,
    UCI_SQL,
    mapped_lines,
    rounded,
    table,
    uci_lines,
)
from meterspark.schemas import UCI_COLUMNS
from meterspark.session import scratch_folder
from meterspark.sources.files import read_uci
from meterspark.sources.ingest import ImportTarget
from meterspark.sources.rows import (
    CsvMapping,
    import_report,
    measurements,
    parse_issues,
    parse_mapped_lines,
    parse_uci_lines,
    separator_profile,
)
from meterspark.streaming.landing import import_landing

HEADER = ("timestamp", "watts", "volts")
MAPPING = CsvMapping(
    timestamp_column="timestamp",
    power_column="watts",
    unit="W",
    timezone="Europe/Kyiv",
    timestamp_semantics="interval_end",
    interval_seconds=60,
    delimiter=";",
    decimal_separator=",",
    optional_columns={"voltage_v": "volts"},
)
#: Events a line file is written for.
FILE_EVENTS = 20_000
ROW_COLUMNS = (
    "source_row_number",
    "observed_at",
    "active_power_kw",
    "reactive_power_kw",
    "voltage_v",
    "current_a",
    "sub_metering_1_wh",
    "sub_metering_2_wh",
    "sub_metering_3_wh",
    "parse_status",
)


def _flat(df: DataFrame) -> DataFrame:
    return rounded(
        measurements(df).select(*ROW_COLUMNS, F.array_join("quality_flags", "|").alias("flags"))
    )


def parse_uci_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(parse_uci_lines(uci_lines(spark, sf_dir)))


def parse_uci_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_issues(parse_uci_lines(uci_lines(spark, sf_dir)), ())


def parse_generic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(parse_mapped_lines(mapped_lines(spark, sf_dir), MAPPING, HEADER)).select(
        "source_row_number", "observed_at", "active_power_kw", "voltage_v", "parse_status", "flags"
    )


def parse_generic_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_issues(parse_mapped_lines(mapped_lines(spark, sf_dir), MAPPING, HEADER), ())


def import_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = import_report(parse_uci_lines(uci_lines(spark, sf_dir)), profile="uci", keep=())
    return rounded(report)


def separator_profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separator_profile(mapped_lines(spark, sf_dir), ";", keep=("series_id",))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, value = F.col("event_id"), F.col("value").cast("decimal(12,2)").cast("string")
    spelled = {
        0: value,
        1: F.concat(F.lit(" "), value, F.lit("\t")),
        2: F.lit("?"),
        3: F.lit("NaN"),
        4: F.concat(F.lit("1_0"), value),
        5: F.concat(F.lit("+"), value, F.lit("e2")),
        6: F.concat(value, F.lit("d")),
        7: F.lit("-Infinity"),
        8: F.lit("1e999"),
        9: F.concat(F.lit("0x"), value),
        10: F.concat(value, F.lit("_")),
        11: F.concat(F.lit("."), F.col("user_id").cast("string")),
        12: F.concat(F.col("user_id").cast("string"), F.lit(".")),
        13: F.lit("nAn"),
    }
    token = value
    for place, text in spelled.items():
        token = F.when(event % len(spelled) == place, text).otherwise(token)
    return table(spark, sf_dir, "events").select("event_id", token.alias("token"))


def parse_number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = with_numbers(_tokens(spark, sf_dir), {"token": F.col("token")})
    return rounded(
        parsed.select(
            "event_id", F.col("token_value").alias("value"), F.col("token_problem").alias("problem")
        )
    )


def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order times as civil text of several spellings, read as Paris time unless offset."""
    key = F.col("o_orderkey")
    at = F.col("o_orderdate") + F.make_dt_interval(secs=(key % 86400).cast("int"))
    text = (
        F.when(key % 4 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(key % 4 == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss'+02:00'"))
        .when(key % 4 == 2, F.date_format(at, "dd.MM.yyyy HH:mm"))
        .otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
    )
    texts = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return texts.select(
        "o_orderkey",
        parse_timestamp(F.col("text"), None, "Europe/Paris").alias("iso_utc"),
        parse_timestamp(F.col("text"), "%d.%m.%Y %H:%M", "Europe/Paris").alias("pattern_utc"),
    )


def parse_timestamps_dst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order days at 02:30 Paris time, an hour that clock changes repeat or skip."""
    at = F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(2), mins=F.lit(30))
    days = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), at.alias("civil"))
    return days.select(
        "o_orderkey",
        to_utc(F.col("civil"), "Europe/Paris").alias("utc"),
        shift(to_utc(F.col("civil"), "Europe/Paris"), -60).alias("interval_start"),
    )


def _line_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Writes the lines as text files, one for each event type and run of events.

    Runs have a fixed number of events, so files and the tasks that sort them stay of one size.
    """
    lines = uci_lines(spark, sf_dir).select("source_row_number", "value")
    kinds = table(spark, sf_dir, "events").select(
        (F.col("event_id") + 2).alias("source_row_number"),
        "event_type",
        F.floor(F.col("event_id") / FILE_EVENTS).alias("run"),
    )
    first = kinds.select("event_type", "run").distinct().select(
        F.lit(1).cast("long").alias("source_row_number"),
        F.lit(";".join(UCI_COLUMNS)).alias("value"),
        "event_type",
        "run",
    )
    (
        lines.join(kinds, "source_row_number")
        .unionByName(first)
        .repartition("event_type", "run")
        .sortWithinPartitions("event_type", "run", "source_row_number")
        .select("event_type", "run", "value")
        .write.partitionBy("event_type", "run")
        .text(folder)
    )


def source_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as text files and read back with record numbers."""
    folder = scratch_folder(spark, "lines")
    _line_files(spark, sf_dir, folder)
    kind = F.array_join(
        F.regexp_extract_all("source_file", F.lit("(?:event_type|run)=([^/]*)/"), F.lit(1)), "-"
    )
    parsed = read_uci(spark, folder, series=kind)
    return rounded(
        parsed.where(F.col("observed_at").isNotNull()).select(
            "series_id", "source_row_number", "observed_at", "active_power_kw"
        )
    )


def landing_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line files land in one folder and are imported twice, the second time with nothing new.

    Counts of the stored rows, issues and reports by the record number of their line in its file.
    """
    folder, tables = scratch_folder(spark, "landing"), scratch_folder(spark, "landed")
    _line_files(spark, sf_dir, folder)
    target = ImportTarget(*(f"{tables}/{name}" for name in ("measurements", "issues", "reports")))
    for _ in range(2):
        import_landing(spark, folder, target, name=f"landing-{tables.rpartition('-')[2]}").awaitTermination()
    stored = spark.read.parquet(target.measurements).select(
        "source_row_number",
        F.lit("row").alias("part"),
        F.col("parse_status").alias("code"),
        F.col("active_power_kw").alias("amount"),
    )
    problems = spark.read.parquet(target.issues).select(
        "source_row_number", F.lit("issue").alias("part"), "code", F.lit(None).cast("double").alias("amount")
    )
    reports = spark.read.parquet(target.reports).select(
        F.lit(0).cast("long").alias("source_row_number"),
        F.lit("report").alias("part"),
        F.lit("source_rows").alias("code"),
        F.col("source_rows").cast("double").alias("amount"),
    )
    counted = stored.unionByName(problems).unionByName(reports).groupBy("part", "code", "source_row_number")
    return rounded(counted.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")))


QUERIES = {
    "parse_uci_rows": parse_uci_rows,
    "parse_uci_issues": parse_uci_issues,
    "parse_generic_rows": parse_generic_rows,
    "parse_generic_issues": parse_generic_issues,
    "parse_number_tokens": parse_number_tokens,
    "parse_timestamps": parse_timestamps,
    "parse_timestamps_dst": parse_timestamps_dst,
    "import_report": import_report_query,
    "separator_profile": separator_profile_query,
    "source_row_numbers": source_row_numbers,
    "landing_import": landing_import,
}

# Number text in SQL: the same pattern on both sides, since engines accept different spellings.
NUMBER = "^[+-]?([0-9](_?[0-9])*(\\.([0-9](_?[0-9])*)?)?|\\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?$"


def _number_sql(text: str) -> str:
    return f"""CASE WHEN regexp_matches({text}, '{NUMBER}')
      THEN try_cast(replace({text}, '_', '') AS DOUBLE) END"""


def _value_sql(text: str) -> str:
    number = _number_sql(text)
    return f"CASE WHEN isfinite({number}) THEN {number} END"


def _problem_sql(text: str) -> str:
    number = _number_sql(text)
    return f"""CASE WHEN {text} IN ('', '?', 'nan', 'NaN', 'NAN') THEN 'missing'
      WHEN isfinite({number}) THEN NULL
      WHEN {number} IS NOT NULL OR lower({text}) IN
        ('inf', '+inf', '-inf', 'infinity', '+infinity', '-infinity', 'nan', '+nan', '-nan')
      THEN 'non_finite' ELSE 'invalid' END"""


def _local_sql(civil: str, zone: str) -> str:
    """UTC of civil time; a repeated hour, which SQL reads as the second one, means the first."""
    utc = f"(({civil}) AT TIME ZONE '{zone}' AT TIME ZONE 'UTC')"
    earlier = f"({utc} - INTERVAL '1 hour')"
    back = f"({earlier} AT TIME ZONE 'UTC' AT TIME ZONE '{zone}')"
    return f"(CASE WHEN {back} = {civil} THEN {earlier} ELSE {utc} END)"


_NAMES = UCI_COLUMNS[2:]
_UCI_PARSED = f"""WITH {UCI_SQL},
p AS (
  SELECT source_row_number, value, len(string_split(value, ';')) AS n,
         split_part(value, ';', 1) || ' ' || split_part(value, ';', 2) AS stamp,
         {', '.join(f"split_part(value, ';', {i + 3}) AS c{i}" for i in range(7))}
  FROM l
), q AS (
  SELECT *, CASE WHEN n = 9 THEN {_local_sql("try_strptime(stamp, '%d/%m/%Y %H:%M:%S')", "Europe/Paris")}
            END AS observed_at,
         {', '.join(f"{_value_sql(f'c{i}')} AS v{i}" for i in range(7))},
         {', '.join(f"{_problem_sql(f'c{i}')} AS x{i}" for i in range(7))}
  FROM p
), f AS (
  SELECT *, concat_ws('|', {', '.join(
      f"CASE WHEN x{i} = 'missing' THEN 'missing:{name}' WHEN x{i} IS NOT NULL THEN 'parse_error:{name}' END"
      for i, name in enumerate(_NAMES))}) AS flags,
      ({' + '.join(f"CASE WHEN x{i} IN ('invalid', 'non_finite') THEN 1 ELSE 0 END" for i in range(7))}) AS bad
  FROM q
), m AS (
  SELECT *, CASE WHEN bad > 0 THEN 'invalid' WHEN flags <> '' THEN 'warning' ELSE 'valid' END AS parse_status
  FROM f WHERE observed_at IS NOT NULL
)"""
_MEASURES = ROW_COLUMNS[2:9]

_MAPPED_PARSED = f"""WITH {MAPPED_SQL},
p AS (
  SELECT source_row_number, split_part(value, ';', 1) AS stamp, split_part(value, ';', 2) AS raw_watts,
         split_part(value, ';', 3) AS raw_volts,
         replace(split_part(value, ';', 2), ',', '.') AS watts,
         replace(split_part(value, ';', 3), ',', '.') AS volts
  FROM l
), q AS (
  SELECT *, {_local_sql("try_strptime(stamp, '%Y-%m-%d %H:%M:%S')", "Europe/Kyiv")} - INTERVAL '60 seconds'
            AS observed_at,
         {_value_sql('watts')} / 1000 AS active_power_kw, {_value_sql('volts')} AS voltage_v,
         {_problem_sql('watts')} AS xw, {_problem_sql('volts')} AS xv
  FROM p
)"""

# Every line's place in its file, after the header.
_PLACES = f"""e AS (
  SELECT event_id + 2 AS row_number, event_type || '-' || event_id // {FILE_EVENTS} AS series_id,
         row_number() OVER (PARTITION BY event_type, event_id // {FILE_EVENTS} ORDER BY event_id) + 1 AS place
  FROM events
)"""

ORACLE = {
    "parse_uci_rows": f"""{_UCI_PARSED}
SELECT source_row_number, observed_at, parse_status, flags,
       {', '.join(f'round(v{i}, 6) AS {name}' for i, name in enumerate(_MEASURES))}
FROM m""",
    "parse_uci_issues": f"""{_UCI_PARSED}
SELECT source_row_number, 'column_count' AS code,
       'Expected 9 columns, received ' || n || '.' AS message,
       CAST(NULL AS VARCHAR) AS column_name, CAST(NULL AS VARCHAR) AS raw_value
FROM p WHERE n <> 9
UNION ALL
SELECT source_row_number, 'timestamp_invalid',
       'Date and time do not match dd/mm/yyyy HH:MM:SS.', 'Date/Time', substr(stamp, 1, 160)
FROM q WHERE n = 9 AND observed_at IS NULL
{' '.join(f'''UNION ALL SELECT source_row_number, 'number_invalid', 'Numeric value could not be parsed.',
       '{name}', substr(c{i}, 1, 160) FROM m WHERE x{i} IN ('invalid', 'non_finite')'''
       for i, name in enumerate(_NAMES))}""",
    "parse_generic_rows": f"""{_MAPPED_PARSED}
SELECT source_row_number, observed_at, round(active_power_kw, 6) AS active_power_kw,
       round(voltage_v, 6) AS voltage_v,
       CASE WHEN xw IN ('invalid', 'non_finite') OR xv IN ('invalid', 'non_finite') THEN 'invalid'
            WHEN xw IS NOT NULL OR xv IS NOT NULL THEN 'warning' ELSE 'valid' END AS parse_status,
       concat_ws('|',
         CASE WHEN xw = 'missing' THEN 'missing:watts' WHEN xw IS NOT NULL THEN 'parse_error:watts' END,
         CASE WHEN xv = 'missing' THEN 'missing:volts' WHEN xv IS NOT NULL THEN 'parse_error:volts' END
       ) AS flags
FROM q WHERE observed_at IS NOT NULL""",
    "parse_generic_issues": f"""{_MAPPED_PARSED}
SELECT source_row_number, 'timestamp_invalid' AS code,
       'Timestamp could not be parsed or lacks timezone context.' AS message,
       'timestamp' AS column_name, stamp AS raw_value
FROM q WHERE observed_at IS NULL
UNION ALL
SELECT source_row_number, 'number_invalid', 'Target value could not be parsed.', 'watts', raw_watts
FROM q WHERE observed_at IS NOT NULL AND xw IN ('invalid', 'non_finite')
UNION ALL
SELECT source_row_number, 'number_invalid', 'Optional numeric value could not be parsed.',
       'volts', raw_volts
FROM q WHERE observed_at IS NOT NULL AND xv IN ('invalid', 'non_finite')""",
    "parse_number_tokens": f"""WITH t AS (
  SELECT event_id, trim(CASE event_id % 14
    WHEN 1 THEN ' ' || v || chr(9) WHEN 2 THEN '?' WHEN 3 THEN 'NaN' WHEN 4 THEN '1_0' || v
    WHEN 5 THEN '+' || v || 'e2' WHEN 6 THEN v || 'd' WHEN 7 THEN '-Infinity' WHEN 8 THEN '1e999'
    WHEN 9 THEN '0x' || v WHEN 10 THEN v || '_' WHEN 11 THEN '.' || user_id
    WHEN 12 THEN user_id || '.' WHEN 13 THEN 'nAn' ELSE v END, ' ' || chr(9)) AS token
  FROM (SELECT *, CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS v FROM events)
), u AS (
  SELECT event_id, token, CASE WHEN token = '1e999' THEN 'non_finite' ELSE {_problem_sql('token')} END
         AS problem FROM t
)
SELECT event_id, problem, CASE WHEN problem IS NULL THEN round({_number_sql('token')}, 6) END AS value
FROM u""",
    "parse_timestamps": f"""WITH t AS (
  SELECT o_orderkey, o_orderdate + to_seconds(CAST(o_orderkey % 86400 AS INTEGER)) AS moment FROM orders
)
SELECT o_orderkey,
       CASE o_orderkey % 4 WHEN 0 THEN moment WHEN 1 THEN moment - INTERVAL '2 hours' WHEN 2 THEN NULL
            ELSE {_local_sql('moment', 'Europe/Paris')} END AS iso_utc,
       CASE WHEN o_orderkey % 4 = 2
            THEN {_local_sql("date_trunc('minute', moment)", 'Europe/Paris')} END AS pattern_utc
FROM t""",
    # Paris: +1 in winter, +2 in summer. At 02:30 the repeated hour (last Sunday of October, before
    # 1996 of September) takes the first offset and the skipped hour (last Sunday of March) the
    # offset before the change.
    "parse_timestamps_dst": """WITH t AS (
  SELECT o_orderkey, o_orderdate AS day,
         CAST(year(o_orderdate) || '-03-31' AS DATE) AS m31, CAST(year(o_orderdate) || CASE WHEN year(o_orderdate) < 1996 THEN '-09-30' ELSE '-10-31' END AS DATE) AS o31
  FROM orders
), u AS (
  SELECT o_orderkey, day, m31 - CAST(dayofweek(m31) AS INTEGER) AS m_change,
         o31 - CAST(dayofweek(o31) AS INTEGER) AS o_change FROM t
), z AS (
  SELECT o_orderkey, day + INTERVAL '2 hours 30 minutes'
         - CASE WHEN day > m_change AND day <= o_change THEN INTERVAL '2 hours' ELSE INTERVAL '1 hour' END
         AS utc FROM u
)
SELECT o_orderkey, utc, utc - INTERVAL '60 seconds' AS interval_start FROM z""",
    "import_report": f"""{_UCI_PARSED}
SELECT 'uci' AS profile, (SELECT count(*) FROM l) AS source_rows, count(*) AS stored_rows,
       CAST(count(*) FILTER (WHERE bad = 0) AS BIGINT) AS valid_rows,
       (SELECT count(*) FROM l) - CAST(count(*) FILTER (WHERE bad = 0) AS BIGINT)
         AS invalid_or_skipped_rows,
       CAST(sum(bad) + (SELECT count(*) FROM l) - count(*) AS BIGINT) AS parse_issue_count,
       min(observed_at) AS min_timestamp, max(observed_at) AS max_timestamp,
       CAST(60 AS BIGINT) AS interval_seconds
FROM m""",
    "separator_profile": f"""WITH {MAPPED_SQL}, c AS (
  SELECT len(string_split(value, ';')) AS n,
         len(value) - len(replace(value, '.', '')) AS dots,
         len(value) - len(replace(value, ',', '')) AS commas FROM l
)
SELECT 'all' AS series_id, count(*) AS line_count, CAST(sum(dots) AS BIGINT) AS dot_count,
       CAST(sum(commas) AS BIGINT) AS comma_count, min(n) AS min_columns, max(n) AS max_columns,
       CASE WHEN sum(commas) > sum(dots) THEN ',' ELSE '.' END AS decimal_separator
FROM c""",
    "source_row_numbers": f"""{_UCI_PARSED}, {_PLACES}
SELECT series_id, place AS source_row_number, observed_at, round(v0, 6) AS active_power_kw
FROM m JOIN e ON e.row_number = m.source_row_number""",
    "landing_import": f"""{_UCI_PARSED}, {_PLACES}, u AS (
  SELECT 'row' AS part, parse_status AS code, source_row_number, v0 AS amount FROM m
  UNION ALL SELECT 'issue', 'column_count', source_row_number, NULL FROM p WHERE n <> 9
  UNION ALL SELECT 'issue', 'timestamp_invalid', source_row_number, NULL FROM q WHERE n = 9 AND observed_at IS NULL
  {' '.join(f"UNION ALL SELECT 'issue', 'number_invalid', source_row_number, NULL FROM m WHERE x{i} IN ('invalid', 'non_finite')"
            for i in range(7))}
)
SELECT part, code, place AS source_row_number, count(*) AS n, round(sum(amount), 6) AS amount
FROM u JOIN e ON e.row_number = u.source_row_number GROUP BY ALL
UNION ALL
SELECT 'report', 'source_rows', 0, count(*), CAST(sum(lines) AS DOUBLE)
FROM (SELECT count(*) AS lines FROM e GROUP BY series_id)""",
}
