"""Versioned tables and the dataset catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterspark.schemas import TRAINING_READY

VERSION = "dataset_version_id"


def replace_version(df: DataFrame, path: str) -> None:
    """Write rows so that the versions they belong to are replaced and all others stay.

    Rows are spread over the tasks as they come, so one version that holds most rows is still
    written by many tasks; a retried import leaves no rows of its earlier attempt behind.
    """
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(VERSION)
        .parquet(path)
    )


def clear_versions(spark: SparkSession, path: str, versions: DataFrame) -> None:
    """Drop the stored rows of versions whose repeated import kept none.

    Only versions that are in the table and came back empty are listed, one name at a time.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in versions.select(VERSION).toLocalIterator():
        folder = jvm.org.apache.hadoop.fs.Path(root, f"{VERSION}={escape(row[VERSION])}")
        if files.exists(folder):
            files.delete(folder, True)


def scan_version(
    spark: SparkSession, path: str, version: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows of one version: a pruned partition and only the columns asked for."""
    rows = spark.read.parquet(path).where(F.col(VERSION) == version)
    return rows.select(*columns) if columns else rows


def version_statistics(hourly: DataFrame) -> DataFrame:
    """Row count, training-ready count and time range of each written version."""
    return hourly.groupBy(VERSION).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("quality_status").isin(*TRAINING_READY)).alias("training_ready_count"),
        F.min("hour_start").alias("min_hour"),
        F.max("hour_start").alias("max_hour"),
    )


def duplicate_sources(incoming: DataFrame, versions: DataFrame) -> DataFrame:
    """Incoming sources whose checksum the same dataset already holds."""
    return incoming.join(versions, ["dataset_id", "source_sha256"], "left_semi")


def refuse_duplicates(incoming: DataFrame, versions: DataFrame) -> None:
    clash = duplicate_sources(incoming, versions).limit(1).collect()
    if clash:
        raise ValueError(f"source already imported: {clash[0].asDict()}")


def next_version(
    parents: DataFrame, versions: DataFrame, key: str = "dataset_id", number: str = "version_no"
) -> DataFrame:
    """The number the next version (or report) of each parent gets."""
    last = versions.groupBy(key).agg(F.max(number).alias("last"))
    return parents.select(key).join(last, key, "left").select(
        key, (F.coalesce("last", F.lit(0)) + 1).cast("long").alias(f"next_{number}")
    )


def version_counts(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """The catalogue with the number of versions of each dataset."""
    counts = versions.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    return datasets.join(counts, "dataset_id", "left").select(
        *datasets.columns, F.coalesce("n", F.lit(0)).alias("version_count")
    )


def deletable(datasets: DataFrame, *children: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Parents that no child row refers to."""
    for child in children:
        datasets = datasets.join(child.select(key), key, "left_anti")
    return datasets


def in_use(datasets: DataFrame, child: DataFrame, key: str = "dataset_id") -> DataFrame:
    return datasets.join(child.select(key), key, "left_semi")


def latest_report(
    reports: DataFrame, parent: str = VERSION, number: str = "report_version"
) -> DataFrame:
    """The newest report row of each parent."""
    rest = [c for c in reports.columns if c != parent]
    return reports.groupBy(parent).agg(
        F.max_by(F.struct(*rest), number).alias("newest")
    ).select(parent, "newest.*")
