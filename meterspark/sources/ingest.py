"""Import of text files into the versioned measurement and issue tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterspark.operators.catalog import VERSION, clear_versions, replace_version
from meterspark.session import staged
from meterspark.sources.rows import import_report, measurements, parse_issues


@dataclass(frozen=True)
class ImportTarget:
    """Locations of the tables an import writes."""

    measurements: str
    issues: str
    reports: str


def store_import(parsed: DataFrame, target: ImportTarget, *, profile: str) -> None:
    """Write measurements, issues and the report of the parsed series, replacing earlier attempts.

    The lines are parsed once: the three tables are read off one table in the shared folder.
    Each series is a dataset version. The report comes last: a version without a report has not
    been imported completely, and repeating the import replaces whatever it left.
    """
    versioned = staged(parsed.withColumn(VERSION, F.col("series_id")), "import")
    replace_version(measurements(versioned), target.measurements)
    replace_version(parse_issues(versioned, ("series_id", VERSION)), target.issues)
    report = staged(import_report(versioned, profile=profile, keep=("series_id", VERSION)), "report")
    replace_version(report.coalesce(1), target.reports)
    spark = parsed.sparkSession
    clear_versions(spark, target.measurements, report.where("stored_rows = 0"))
    clear_versions(spark, target.issues, report.where("parse_issue_count = 0"))
