"""Row parsers: text lines to measurements and parse issues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterspark.functions.clock import shift
from meterspark.functions.parsing import (
    parse_timestamp,
    parse_uci_timestamp,
    split_line,
    with_numbers,
)
from meterspark.schemas import (
    DELIMITERS,
    MEASURES,
    OPTIONAL_MEASURES,
    UCI_COLUMNS,
    UCI_INTERVAL_SECONDS,
    UCI_MEASURES,
    UCI_TIMEZONE,
)

ISSUE_TYPE = "struct<code:string,message:string,column_name:string,raw_value:string>"


@dataclass(frozen=True)
class CsvMapping:
    """How the columns of a delimited file become one target measure and optional measures."""

    timestamp_column: str
    unit: str
    energy_column: str | None = None
    power_column: str | None = None
    timezone: str | None = None
    timestamp_format: str | None = None
    timestamp_semantics: str = "interval_start"
    interval_seconds: int | None = None
    delimiter: str = ","
    decimal_separator: str = "."
    optional_columns: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.timestamp_column:
            raise ValueError("timestamp_column is required")
        if bool(self.energy_column) == bool(self.power_column):
            raise ValueError("exactly one of energy_column and power_column is required")
        units = ("kwh", "wh") if self.energy_column else ("kw", "w")
        if self.unit.lower() not in units:
            raise ValueError(f"unit must be one of {units}")
        if self.delimiter not in DELIMITERS:
            raise ValueError("unsupported delimiter")
        if self.decimal_separator not in (".", ","):
            raise ValueError("unsupported decimal separator")
        if self.timestamp_semantics not in ("interval_start", "interval_end"):
            raise ValueError("unknown timestamp semantics")
        if self.interval_seconds is not None and self.interval_seconds <= 0:
            raise ValueError("interval_seconds must be positive")
        unknown = set(self.optional_columns) - set(OPTIONAL_MEASURES)
        if unknown:
            raise ValueError(f"unknown optional measures: {sorted(unknown)}")

    @property
    def target_column(self) -> str:
        return self.energy_column or self.power_column or ""

    @property
    def target_measure(self) -> str:
        return "energy_kwh" if self.energy_column else "active_power_kw"

    @property
    def required_columns(self) -> tuple[str, str]:
        return (self.timestamp_column, self.target_column)


def parse_uci_lines(
    lines: DataFrame, *, timezone: str = UCI_TIMEZONE, keep: Sequence[str] = ("series_id",)
) -> DataFrame:
    """One row per data line with measures, status, flags and an ``issues`` array.

    ``lines`` has ``source_row_number``, ``value`` and the ``keep`` columns. A line with a wrong
    column count or a bad date has ``observed_at`` null: it is an issue, not a measurement.
    """
    place = {name: F.get("cells", F.lit(i)) for i, name in enumerate(UCI_COLUMNS)}
    right_size = F.size("cells") == len(UCI_COLUMNS)
    stamp = parse_uci_timestamp(place["Date"], place["Time"], timezone)
    cells = lines.select(
        *keep, "source_row_number", split_line(F.col("value"), ";").alias("cells")
    ).select(
        "*",
        F.when(right_size, stamp).alias("observed_at"),
        F.when(right_size, F.concat_ws(" ", place["Date"], place["Time"])).alias(
            "timestamp_original"
        ),
    )
    wrong_size = _issue(
        "column_count",
        F.concat(
            F.lit(f"Expected {len(UCI_COLUMNS)} columns, received "),
            F.size("cells").cast("string"),
            F.lit("."),
        ),
    )
    bad_time = _issue(
        "timestamp_invalid",
        F.lit("Date and time do not match dd/mm/yyyy HH:MM:SS."),
        F.lit("Date/Time"),
        F.col("timestamp_original"),
    )
    row_level = F.when(~right_size, wrong_size).when(F.col("observed_at").isNull(), bad_time)
    raws = {measure: place[name] for name, measure in UCI_MEASURES.items()}
    return _finish(
        with_numbers(cells, raws),
        keep,
        {measure: name for name, measure in UCI_MEASURES.items()},
        raws,
        {m: "Numeric value could not be parsed." for m in UCI_MEASURES.values()},
        row_level,
        timezone,
        UCI_INTERVAL_SECONDS,
    )


def parse_mapped_lines(
    lines: DataFrame,
    mapping: CsvMapping,
    header: Sequence[str],
    *,
    keep: Sequence[str] = ("series_id",),
) -> DataFrame:
    """As :func:`parse_uci_lines` for a mapped file whose header cells are ``header``.

    Missing cells of a short line count as empty; cells beyond the header are ignored.
    """
    absent = sorted(set(mapping.required_columns) - set(header))
    if absent:
        raise ValueError(f"mapped columns are missing: {', '.join(absent)}")
    place = {name: i for i, name in enumerate(header)}

    def cell(name: str) -> Column:
        found = F.get("cells", F.lit(place[name])) if name in place else F.lit(None).cast("string")
        return F.coalesce(found, F.lit(""))

    wanted = {"timestamp_text": mapping.timestamp_column, "target_raw": mapping.target_column}
    wanted.update({f"{m}_raw": c for m, c in mapping.optional_columns.items()})
    cells = lines.select(
        *keep, "source_row_number", split_line(F.col("value"), mapping.delimiter).alias("cells")
    ).select(*keep, "source_row_number", *(cell(c).alias(a) for a, c in wanted.items()))
    stamp = parse_timestamp(
        F.col("timestamp_text"), mapping.timestamp_format, mapping.timezone
    )
    cells = cells.select(
        "*",
        stamp.alias("parsed_at"),
        F.substring("timestamp_text", 1, 80).alias("timestamp_original"),
    )
    bad_time = _issue(
        "timestamp_invalid",
        F.lit("Timestamp could not be parsed or lacks timezone context."),
        F.lit(mapping.timestamp_column),
        F.col("timestamp_text"),
    )
    row_level = F.when(F.col("parsed_at").isNull(), bad_time)
    observed = F.col("parsed_at")
    if mapping.timestamp_semantics == "interval_end":
        if mapping.interval_seconds is None:
            row_level = row_level.otherwise(
                _issue(
                    "interval_required",
                    F.lit("interval_seconds is required for interval-end timestamps."),
                )
            )
            observed = F.lit(None).cast("timestamp_ntz")
        else:
            observed = shift(observed, -mapping.interval_seconds)
    cells = cells.withColumn("observed_at", observed)

    columns = {mapping.target_measure: mapping.target_column, **mapping.optional_columns}
    raws = {m: F.col(f"{m}_raw") for m in mapping.optional_columns}
    raws[mapping.target_measure] = F.col("target_raw")
    messages = dict.fromkeys(columns, "Optional numeric value could not be parsed.")
    messages[mapping.target_measure] = "Target value could not be parsed."
    parsed = with_numbers(cells, raws, mapping.decimal_separator)
    if mapping.unit.lower() in ("wh", "w"):
        scaled = F.col(f"{mapping.target_measure}_value") / F.lit(1000.0)
        parsed = parsed.withColumn(f"{mapping.target_measure}_value", scaled)
    return _finish(
        parsed,
        keep,
        columns,
        raws,
        messages,
        row_level,
        mapping.timezone,
        mapping.interval_seconds,
    )


def measurements(parsed: DataFrame) -> DataFrame:
    """Stored rows: every line whose timestamp could be read."""
    return parsed.where(F.col("observed_at").isNotNull()).drop("issues")


def parse_issues(parsed: DataFrame, keep: Sequence[str] = ("series_id",)) -> DataFrame:
    """One row per problem found."""
    # The outer form keeps the optimiser from copying the parsing below a guessed size filter.
    return parsed.select(*keep, "source_row_number", F.inline_outer("issues")).where(
        F.col("code").isNotNull()
    )


def import_report(
    parsed: DataFrame, *, profile: str, keep: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Counts and time range of an import, per series, in one aggregation."""
    stored = F.col("observed_at").isNotNull()
    valid = stored & (F.col("parse_status") != "invalid")
    report = parsed.groupBy(*keep).agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_if(stored).alias("stored_rows"),
        F.count_if(valid).alias("valid_rows"),
        F.count_if(~valid).alias("invalid_or_skipped_rows"),
        F.sum(F.size("issues")).cast("long").alias("parse_issue_count"),
        F.min("observed_at").alias("min_timestamp"),
        F.max("observed_at").alias("max_timestamp"),
        F.max("interval_seconds").alias("interval_seconds"),
    )
    return report.select(F.lit(profile).alias("profile"), "*")


def separator_profile(
    lines: DataFrame, delimiter: str, *, keep: Sequence[str] = ("series_id",)
) -> DataFrame:
    """Decimal hint and column-count spread over all cells of each source.

    Cells, not raw text, are counted: a delimiting comma is no decimal comma.
    """
    cells = split_line(F.col("value"), delimiter)
    text = F.array_join(cells, "")

    def occurrences(mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    counted = lines.select(
        *keep,
        F.size(cells).alias("n_cells"),
        occurrences(".").alias("dots"),
        occurrences(",").alias("commas"),
    )
    return (
        counted.groupBy(*keep)
        .agg(
            F.count(F.lit(1)).alias("line_count"),
            F.sum("dots").alias("dot_count"),
            F.sum("commas").alias("comma_count"),
            F.min("n_cells").cast("long").alias("min_columns"),
            F.max("n_cells").cast("long").alias("max_columns"),
        )
        .withColumn(
            "decimal_separator",
            F.when(F.col("comma_count") > F.col("dot_count"), ",").otherwise("."),
        )
    )


def _issue(
    code: str, message: Column, column_name: Column | None = None, raw: Column | None = None
) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.lit(code).alias("code"),
        message.alias("message"),
        (nothing if column_name is None else column_name).alias("column_name"),
        (nothing if raw is None else F.substring(raw, 1, 160)).alias("raw_value"),
    ).cast(ISSUE_TYPE)


def _finish(
    cells: DataFrame,
    keep: Sequence[str],
    columns: Mapping[str, str],
    raws: Mapping[str, Column],
    messages: Mapping[str, str],
    row_level: Column,
    timezone: str | None,
    interval_seconds: int | None,
) -> DataFrame:
    """Attach measures, then flags, issues and status from each cell's problem.

    ``columns`` names the source column of each parsed measure.
    """
    flags, cell_issues = [], []
    for measure, column in columns.items():
        problem = F.col(f"{measure}_problem")
        flags.append(
            F.when(problem == "missing", f"missing:{column}").when(
                problem.isNotNull(), f"parse_error:{column}"
            )
        )
        cell_issues.append(
            F.when(
                problem.isin("invalid", "non_finite"),
                _issue("number_invalid", F.lit(messages[measure]), F.lit(column), raws[measure]),
            )
        )
    problems = [F.col(f"{measure}_problem") for measure in columns]
    # Clean rows, nearly all of them, skip the array building.
    marked = cells.select(
        "*",
        row_level.alias("row_issue"),
        F.coalesce(*problems).isNotNull().alias("has_flag"),
        reduce(or_, (p.isin("invalid", "non_finite") & p.isNotNull() for p in problems)).alias("has_issue"),
    )
    dropped = F.col("row_issue").isNotNull()
    no_flags = F.array().cast("array<string>")
    no_issues = F.array().cast(f"array<{ISSUE_TYPE}>")
    status = (
        F.when(dropped | F.col("has_issue"), "invalid")
        .when(F.col("has_flag"), "warning")
        .otherwise("valid")
    )
    return marked.select(
        *keep,
        "source_row_number",
        "observed_at",
        "timestamp_original",
        F.lit(timezone).cast("string").alias("timezone_context"),
        F.lit(interval_seconds).cast("int").alias("interval_seconds"),
        *(
            (F.col(f"{m}_value") if m in columns else F.lit(None).cast("double")).alias(m)
            for m in MEASURES
        ),
        status.alias("parse_status"),
        F.when(dropped | ~F.col("has_flag"), no_flags)
        .otherwise(F.array_compact(F.array(*flags)))
        .alias("quality_flags"),
        F.when(dropped, F.array("row_issue"))
        .when(F.col("has_issue"), F.array_compact(F.array(*cell_issues)))
        .otherwise(no_issues)
        .alias("issues"),
    )
