"""Quality checks over raw measurements, one report row and many issue rows per series.

Input: the measurement schema. Order of rows is the order of ``source_row_number``. Every check
aggregates before it shuffles, and none puts a whole series in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterspark.functions.chunks import CHUNK, consecutive_pairs
from meterspark.functions.clock import DAY, epoch, floor_div, iso, micros
from meterspark.functions.parsing import is_finite
from meterspark.operators.quantiles import MISSING, NON_FINITE, beside, class_counts, exact_medians, widen
from meterspark.schemas import (
    EVIDENCE_LIMIT,
    ISSUE_SEVERITY,
    MAD_SCALE,
    MEASURES,
    ROBUST_Z_LIMIT,
)
from meterspark.session import staged

SERIES = ("series_id",)
ROWS_PER_CHUNK = 1_000_000
_VALUE_GROUPS = tuple(
    (kind, measure)
    for measure in MEASURES
    for kind in ("missing", "non_finite", "physical_invalidity")
)
class Report(NamedTuple):
    """Issue groups, and one row a series."""

    issues: DataFrame
    summary: DataFrame


GROUP_COLUMNS = ("issue_type", "column_name", "range_start", "range_end", "occurrence_count")


def physically_invalid(measure: str) -> Column:
    """A finite value no meter can show: negative, or a voltage that is not positive."""
    value = F.col(measure)
    wrong = value <= 0 if measure == "voltage_v" else value < 0
    return is_finite(value) & wrong


def order_pairs(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Rows whose time is before that of the previous source row."""
    chunked = df.select(
        *keys,
        "source_row_number",
        "observed_at",
        floor_div(F.col("source_row_number"), ROWS_PER_CHUNK).alias(CHUNK),
    )
    pairs = consecutive_pairs(chunked, keys, "source_row_number", ["observed_at"])
    return pairs.where(F.col("observed_at") < F.col("prev_observed_at"))


def order_issues(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return _group(order_pairs(df, keys), keys, "timestamp_order", F.count(F.lit(1)))


def time_steps(
    df: DataFrame, keys: Sequence[str] = SERIES, *, chunk_seconds: int = DAY
) -> DataFrame:
    """``keys, prev_observed_at, observed_at, step`` between consecutive distinct times."""
    times = df.select(
        *keys,
        floor_div(epoch(F.col("observed_at")), chunk_seconds).alias(CHUNK),
        "observed_at",
    ).distinct()
    step = F.floor(
        (micros(F.col("observed_at")) - micros(F.col("prev_observed_at"))) / F.lit(1_000_000)
    )
    return consecutive_pairs(times, keys, "observed_at").withColumn("step", step.cast("long"))


def cadence(steps: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Most frequent step, the smaller one on a tie; a sub-second cadence counts as unknown."""
    frequency = steps.groupBy(*keys, "step").agg(F.count(F.lit(1)).alias("times"))
    best = frequency.groupBy(*keys).agg(
        F.min_by("step", F.struct(-F.col("times"), F.col("step"))).alias("step")
    )
    return best.select(
        *keys, F.when(F.col("step") > 0, F.col("step")).alias("expected_interval_seconds")
    )


def gaps(
    steps: DataFrame, expected: DataFrame, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Steps longer than one and a half cadences, with the estimated number of lost readings."""
    long_steps = steps.join(expected, list(keys)).where(
        F.col("step") > 1.5 * F.col("expected_interval_seconds")
    )
    missing = F.bround(F.col("step") / F.col("expected_interval_seconds"), 0) - 1
    return long_steps.select(
        *keys,
        F.col("prev_observed_at").alias("gap_start"),
        F.col("observed_at").alias("gap_end"),
        F.col("step").alias("delta_seconds"),
        F.greatest(F.lit(1), missing.cast("long")).cast("long").alias("estimated_missing"),
    )


def gap_issues(gap_rows: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return gap_rows.groupBy(*keys).agg(
        F.lit("time_gap").alias("issue_type"),
        F.lit(None).cast("string").alias("column_name"),
        F.min("gap_start").alias("range_start"),
        F.max("gap_end").alias("range_end"),
        F.count(F.lit(1)).alias("occurrence_count"),
    )


def time_counts(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """``keys, observed_at, row_count, signature_count``: rows of each time, and how many of them differ.

    Copies are counted per signature first, so many equal rows shrink before the shuffle.
    """
    signatures = df.groupBy(*keys, "observed_at", *MEASURES, "parse_status", "quality_flags").agg(
        F.count(F.lit(1)).alias("copies")
    )
    return signatures.groupBy(*keys, "observed_at").agg(
        F.sum("copies").alias("row_count"), F.count(F.lit(1)).alias("signature_count")
    )


def duplicate_times(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Times with more than one row: surplus exact copies and rows that disagree."""
    return repeated_times(time_counts(df, keys), keys)


def repeated_times(times: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """:func:`duplicate_times` of counted times."""
    return times.where("row_count > 1").select(
        *keys,
        "observed_at",
        (F.col("row_count") - F.col("signature_count")).alias("exact_excess"),
        F.when(F.col("signature_count") > 1, F.col("row_count"))
        .otherwise(F.lit(0))
        .alias("conflicting_rows"),
    )


def duplicate_issues(times: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    kinds = (("exact_duplicate", "exact_excess"), ("conflicting_duplicate", "conflicting_rows"))
    wide = times.groupBy(*keys).agg(
        *(
            expression
            for _, count in kinds
            for expression in (
                F.sum(count).alias(count),
                F.min(F.when(F.col(count) > 0, F.col("observed_at"))).alias(f"{count}_start"),
                F.max(F.when(F.col(count) > 0, F.col("observed_at"))).alias(f"{count}_end"),
            )
        )
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(kind).alias("issue_type"),
                F.lit(None).cast("string").alias("column_name"),
                F.col(f"{count}_start").alias("range_start"),
                F.col(f"{count}_end").alias("range_end"),
                F.col(count).alias("occurrence_count"),
            )
            for kind, count in kinds
        )
    )
    return wide.select(*keys, F.inline(rows)).where("occurrence_count > 0")


def value_issues(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Missing, non-finite and impossible values of the eight measures.

    One wide aggregation over the rows; only its one row per series is unpivoted.
    """
    return _counted(df, keys, _VALUE_GROUPS)


def row_issues(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Value issues and parse errors together, in one aggregation."""
    return _counted(df, keys, (*_VALUE_GROUPS, ("parse_error", None)))


def _counted(df: DataFrame, keys: Sequence[str], groups) -> DataFrame:
    aggregates, structs = [], []
    for measure in dict.fromkeys(m for _, m in groups):
        for kind, hit in _row_checks(measure):
            name = f"{measure}__{kind}"
            aggregates += [
                F.count_if(hit).alias(f"{name}_n"),
                F.min(F.when(hit, F.col("observed_at"))).alias(f"{name}_start"),
                F.max(F.when(hit, F.col("observed_at"))).alias(f"{name}_end"),
            ]
            structs.append(
                F.struct(
                    F.lit(kind).alias("issue_type"),
                    F.lit(measure).cast("string").alias("column_name"),
                    F.col(f"{name}_start").alias("range_start"),
                    F.col(f"{name}_end").alias("range_end"),
                    F.col(f"{name}_n").alias("occurrence_count"),
                )
            )
    wide = df.groupBy(*keys).agg(*aggregates)
    return wide.select(*keys, F.inline(F.array(*structs))).where("occurrence_count > 0")


def parse_error_issues(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return _group(df.where("parse_status = 'invalid'"), keys, "parse_error", F.count(F.lit(1)))


def row_classes(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Counts, first and last time of every measure's value classes and of the parse status.

    A class tells a missing, non-finite or impossible value and is the first digit of the medians, so
    one pass over the rows serves all of these.
    """
    status = F.when(F.col("parse_status") == "invalid", 1.0).otherwise(0.0)
    cells = df.select(*keys, "observed_at", *MEASURES, status.alias("parse_status"))
    return class_counts(cells, keys, [*MEASURES, "parse_status"], "observed_at")


def class_issues(classes: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """:func:`row_issues` read off the classes."""
    digit, column = F.col("class"), F.col("column_name")
    wrong = F.when(column == "voltage_v", digit <= 0).otherwise(digit < 0)
    kind = (
        F.when(column == "parse_status", F.when(digit > 0, "parse_error"))
        .when(digit == MISSING, "missing")
        .when(digit == NON_FINITE, "non_finite")
        .when(wrong, "physical_invalidity")
    )
    found = classes.withColumn("issue_type", kind).where(F.col("issue_type").isNotNull())
    name = F.when(column != "parse_status", column)
    return found.groupBy(*keys, "issue_type", name.alias("column_name")).agg(
        F.min("first_at").alias("range_start"), F.max("last_at").alias("range_end"), F.sum("copies").alias("occurrence_count")
    )


def outliers(df: DataFrame, keys: Sequence[str] = SERIES, classes: DataFrame | None = None) -> DataFrame:
    """Values more than six robust deviations from the median of their measure.

    Medians and deviations are one row a series, written once because the passes over the values that
    follow need them; rows meet them in place, or by series and day where the series are very many.
    """
    day = floor_div(epoch(F.col("observed_at")), DAY)
    medians = exact_medians(df, keys, MEASURES, part=day, classes=classes).where("n >= 3")
    centers = staged(widen(medians, keys, MEASURES, "median"), "medians")
    deviations = beside(df, centers, keys, day).select(
        *keys, "observed_at", *(F.abs(F.col(m) - F.col(f"{m}__median")).alias(m) for m in MEASURES)
    )
    spreads = exact_medians(deviations, keys, MEASURES, part=day).withColumnRenamed("median", "mad")
    scale = staged(centers.join(widen(spreads, keys, MEASURES, "mad"), list(keys)), "deviations")

    def cell(measure: str) -> Column:
        value, center, mad = F.col(measure), F.col(f"{measure}__median"), F.col(f"{measure}__mad")
        return F.struct(F.lit(measure).alias("column_name"), value.alias("value"), center.alias("median"), mad.alias("mad"))

    cells = beside(df, scale, keys, day).select(
        *keys, "source_row_number", "observed_at", F.inline(F.array(*(cell(m) for m in MEASURES)))
    )
    z = F.abs(F.col("value") - F.col("median")) / (MAD_SCALE * F.col("mad"))
    finite = cells.where((F.col("mad") != 0) & is_finite(F.col("value")))
    return finite.withColumn("robust_z", z).where(F.col("robust_z") > ROBUST_Z_LIMIT)


def outlier_issues(rows: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return _group(rows, [*keys, "column_name"], "statistical_anomaly", F.count(F.lit(1)))


def quality_issues(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """All issue groups of a series, with severity."""
    return quality_report(df, keys).issues


def quality_report(df: DataFrame, keys: Sequence[str] = SERIES) -> Report:
    """All issue groups and the report row of each series.

    The rows are read for their value classes, their times, their order, and four times for the outliers
    (values in the middle classes, the classes of deviations, deviations in the middle classes, and the
    outliers). Everything else is read off the written classes and times.
    """
    classes = staged(row_classes(df, keys), "classes")
    times = staged(time_counts(df, keys), "times")
    steps = staged(time_steps(times, keys), "steps")
    expected = staged(cadence(steps, keys), "cadence")
    measured = classes.where("column_name <> 'parse_status'")
    parts = [
        order_issues(df, keys),
        duplicate_issues(repeated_times(times, keys), keys),
        gap_issues(gaps(steps, expected, keys), keys),
        class_issues(classes, keys),
        outlier_issues(outliers(df, keys, measured), keys),
    ]
    issues = with_severity(reduce(DataFrame.unionByName, parts)).select(
        *keys, "issue_type", "severity", *GROUP_COLUMNS[1:]
    )
    issues = staged(issues, "issues")
    totals = classes.where("column_name = 'parse_status'").groupBy(*keys).agg(F.sum("copies").alias("total_rows"))
    return Report(issues, _summary(totals, issues, expected, keys))


def with_severity(issues: DataFrame) -> DataFrame:
    severity = F.create_map(*(F.lit(x) for pair in ISSUE_SEVERITY.items() for x in pair))
    return issues.withColumn("severity", severity[F.col("issue_type")])


def issue_order(keys: Sequence[str] = SERIES) -> list[Column]:
    """Report order: type, column, start, end; a missing column or time comes first."""
    return [
        *(F.col(k) for k in keys),
        F.col("issue_type"),
        F.coalesce(F.col("column_name"), F.lit("")),
        F.col("range_start").asc_nulls_first(),
        F.col("range_end").asc_nulls_first(),
    ]


def report_summary(
    df: DataFrame, issues: DataFrame, expected: DataFrame, keys: Sequence[str] = SERIES
) -> DataFrame:
    """The report row of each series: total rows, cadence and counts per issue type."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_rows"))
    return _summary(totals, issues, expected, keys)


def _summary(
    totals: DataFrame, issues: DataFrame, expected: DataFrame, keys: Sequence[str]
) -> DataFrame:
    names = {
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
    counts = issues.groupBy(*keys).agg(
        *(
            F.sum(F.when(F.col("issue_type") == kind, F.col("occurrence_count"))).alias(name)
            for name, kind in names.items()
        ),
        F.count(F.lit(1)).alias("issue_group_count"),
    )
    return (
        totals.join(expected, list(keys), "left")
        .join(counts, list(keys), "left")
        .select(
            *keys,
            "total_rows",
            "expected_interval_seconds",
            *(F.coalesce(F.col(n), F.lit(0)).alias(n) for n in (*names, "issue_group_count")),
        )
    )


def quality_evidence(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """At most ten examples per issue group, as ``position`` 1.. and a JSON ``evidence`` text.

    A rank limit is applied inside each task before any shuffle, so no group is gathered.
    """
    steps = time_steps(df, keys)
    cells = [
        F.when(
            hit,
            F.struct(
                F.lit(kind).alias("issue_type"),
                F.lit(measure).alias("column_name"),
                F.col(measure).cast("string").alias("value"),
            ),
        )
        for measure in MEASURES
        for kind, hit in _value_checks(measure)
    ]
    values = df.select(
        *keys,
        F.col("source_row_number").alias("sort_key"),
        "source_row_number",
        iso(F.col("observed_at")).alias("timestamp"),
        F.inline(F.array_compact(F.array(*cells))),
    )
    found = [
        _evidence(values, keys, None, "source_row_number", "timestamp", "value"),
        _evidence(
            df.where("parse_status = 'invalid'").withColumnRenamed("quality_flags", "flags"),
            keys,
            "parse_error",
            "source_row_number",
            "flags",
        ),
        _evidence(
            order_pairs(df, keys).select(
                *keys,
                F.col("prev_source_row_number").alias("previous_source_row"),
                "source_row_number",
                iso(F.col("prev_observed_at")).alias("previous_timestamp"),
                iso(F.col("observed_at")).alias("timestamp"),
            ),
            keys,
            "timestamp_order",
            "previous_source_row",
            "source_row_number",
            "previous_timestamp",
            "timestamp",
        ),
        _evidence(
            gaps(steps, cadence(steps, keys), keys).select(
                *keys,
                F.col("gap_start").alias("sort_key"),
                iso(F.col("gap_start")).alias("start"),
                iso(F.col("gap_end")).alias("end"),
                "delta_seconds",
                F.col("estimated_missing").alias("estimated_missing_intervals"),
            ),
            keys,
            "time_gap",
            "start",
            "end",
            "delta_seconds",
            "estimated_missing_intervals",
        ),
        _evidence(
            outliers(df, keys).select(
                *keys,
                "column_name",
                "source_row_number",
                "value",
                F.bround("robust_z", 6).alias("robust_z"),
                "median",
                "mad",
            ),
            keys,
            "statistical_anomaly",
            "source_row_number",
            "value",
            "robust_z",
            "median",
            "mad",
        ),
        *_duplicate_evidence(df, keys),
    ]
    return reduce(DataFrame.unionByName, found)


def value_evidence(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """The first ten rows, in source order, of each kind of value issue."""
    cells = [
        F.when(
            hit,
            F.struct(F.lit(kind).alias("issue_type"), F.lit(measure).alias("column_name")),
        )
        for measure in MEASURES
        for kind, hit in _value_checks(measure)
    ]
    hits = df.select(
        *keys,
        "source_row_number",
        "observed_at",
        F.inline(F.array_compact(F.array(*cells))),
    )
    return first_examples(hits, [*keys, "issue_type", "column_name"], "source_row_number")


def first_examples(df: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    ranked = Window.partitionBy(*group).orderBy(order)
    return df.withColumn("position", F.row_number().over(ranked)).where(
        F.col("position") <= EVIDENCE_LIMIT
    )


def _row_checks(measure: str | None) -> list[tuple[str, Column]]:
    if measure is None:
        return [("parse_error", F.col("parse_status") == "invalid")]
    return _value_checks(measure)


def _value_checks(measure: str) -> list[tuple[str, Column]]:
    value = F.col(measure)
    return [
        ("missing", value.isNull()),
        ("non_finite", value.isNotNull() & ~is_finite(value)),
        ("physical_invalidity", physically_invalid(measure)),
    ]


def _group(df: DataFrame, keys: Sequence[str], kind: str, count: Column) -> DataFrame:
    has_column = "column_name" in keys
    grouped = df.groupBy(*keys).agg(
        F.min("observed_at").alias("range_start"),
        F.max("observed_at").alias("range_end"),
        count.alias("occurrence_count"),
    )
    plain = [k for k in keys if k != "column_name"]
    column = F.col("column_name") if has_column else F.lit(None).cast("string")
    return grouped.select(
        *plain,
        F.lit(kind).alias("issue_type"),
        column.alias("column_name"),
        "range_start",
        "range_end",
        "occurrence_count",
    )


def _evidence(df: DataFrame, keys: Sequence[str], kind: str | None, *fields: str) -> DataFrame:
    if kind is not None:
        df = df.withColumn("issue_type", F.lit(kind))
    if "column_name" not in df.columns:
        df = df.withColumn("column_name", F.lit(None).cast("string"))
    if "sort_key" not in df.columns:
        df = df.withColumn("sort_key", F.col("source_row_number"))
    top = first_examples(df, [*keys, "issue_type", "column_name"], "sort_key")
    return top.select(
        *keys,
        "issue_type",
        "column_name",
        F.col("position").cast("long").alias("position"),
        F.to_json(F.struct(*fields)).alias("evidence"),
    )


def _duplicate_evidence(df: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    times = duplicate_times(df, keys)
    found = []
    for kind, count in (
        ("exact_duplicate", "exact_excess"),
        ("conflicting_duplicate", "conflicting_rows"),
    ):
        chosen = first_examples(times.where(F.col(count) > 0), keys, "observed_at")
        rows = df.select(*keys, "observed_at", "source_row_number").join(
            chosen.select(*keys, "observed_at", F.col("position").alias("place")),
            [*keys, "observed_at"],
        )
        # At most ten rows of at most ten times are left in a series when they are collected.
        few = first_examples(rows, [*keys, "place", "observed_at"], "source_row_number")
        found.append(
            few.groupBy(*keys, "place", "observed_at")
            .agg(F.array_sort(F.collect_list("source_row_number")).alias("source_rows"))
            .select(
                *keys,
                F.lit(kind).alias("issue_type"),
                F.lit(None).cast("string").alias("column_name"),
                F.col("place").cast("long").alias("position"),
                F.to_json(
                    F.struct(iso(F.col("observed_at")).alias("timestamp"), "source_rows")
                ).alias("evidence"),
            )
        )
    return found
