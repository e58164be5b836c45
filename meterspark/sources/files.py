"""Text file readers with source row numbers."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterspark.schemas import UCI_COLUMNS, UCI_TIMEZONE
from meterspark.session import use_utc
from meterspark.sources.rows import CsvMapping, parse_mapped_lines, parse_uci_lines

BYTE_ORDER_MARK = "\ufeff"
# One row of the block table takes well under this many bytes in a broadcast.
BLOCK_ROW_BYTES = 512
BROADCAST_BYTES = 64 * 1024 * 1024


def raw_lines(text: DataFrame) -> DataFrame:
    """Lines of a text scan with their file and the start of their split."""
    value = F.col("value")
    return text.select(
        F.when(value.startswith(BYTE_ORDER_MARK), F.expr("substring(value, 2)"))
        .otherwise(value)
        .alias("value"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def number_lines(lines: DataFrame, *, few_splits: bool = False) -> DataFrame:
    """``source_file, source_row_number, value``: the 1-based record number in its file.

    Files are read in splits. Lines of one split are consecutive in one partition, so a line's
    number is the count of lines in earlier splits of its file plus its distance from the first
    line of its own split. Only one row per split is aggregated and joined back; with ``few_splits``
    (their number is known to be small) that side is broadcast and no line is shuffled or sorted.
    """
    lines = lines.withColumn("place", F.monotonically_increasing_id())
    blocks = lines.groupBy("source_file", "block_start").agg(
        F.min("place").alias("first_place"), F.count(F.lit(1)).alias("block_lines")
    )
    earlier = (
        Window.partitionBy("source_file")
        .orderBy("block_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = blocks.select(
        "source_file",
        "block_start",
        (
            F.coalesce(F.sum("block_lines").over(earlier), F.lit(0)) - F.col("first_place") + 1
        ).alias("base"),
    )
    if few_splits:
        bases = F.broadcast(bases)
    return lines.join(bases, ["source_file", "block_start"]).select(
        "source_file", (F.col("place") + F.col("base")).alias("source_row_number"), "value"
    )


def numbered_lines(spark: SparkSession, path: str, *, skip_blank: bool = False) -> DataFrame:
    """Numbered lines of the text files at ``path``; skipped blank lines are not counted."""
    lines = raw_lines(use_utc(spark).read.text(path))
    if skip_blank:
        lines = lines.where(F.col("value") != "")
    # A file has one split more than the partitions it fills, so this bounds the block table.
    splits = len(lines.inputFiles()) + lines.rdd.getNumPartitions()
    return number_lines(lines, few_splits=splits * BLOCK_ROW_BYTES <= BROADCAST_BYTES)


def read_uci(
    spark: SparkSession,
    path: str,
    *,
    timezone: str = UCI_TIMEZONE,
    series: Column | None = None,
) -> DataFrame:
    """Parse household-power text files; each file is a series unless ``series`` says otherwise."""
    header = _first_line(spark, path)
    if tuple(header.split(";")) != UCI_COLUMNS:
        raise ValueError(f"header {header!r} does not hold the columns {UCI_COLUMNS} in order")
    lines = numbered_lines(spark, path)
    return parse_uci_lines(data_lines(lines, header, series), timezone=timezone)


def read_mapped_csv(
    spark: SparkSession, path: str, mapping: CsvMapping, *, series: Column | None = None
) -> DataFrame:
    """Parse delimited files that share one header; blank lines are skipped and not numbered."""
    header = _first_line(spark, path)
    cells = next(csv.reader([header], delimiter=mapping.delimiter, strict=True))
    lines = numbered_lines(spark, path, skip_blank=True)
    return parse_mapped_lines(data_lines(lines, header, series), mapping, cells)


def data_lines(lines: DataFrame, header: str, series: Column | None = None) -> DataFrame:
    """Numbered lines without the header, as ``series_id, source_row_number, value``.

    The first line of every file is compared while the lines are read, so no pass over the files
    is spent on it; another header fails the job before its output is committed.
    """
    name = F.col("source_file") if series is None else series
    refused = F.raise_error(F.concat(F.lit("unexpected header in "), F.col("source_file"))).cast("string")
    # The refusal sits in the text itself: whatever reads the cells of such a line meets it, in
    # whichever order the optimiser places later filters.
    data = F.col("source_row_number") > 1
    text = F.when(data | (F.col("value") == header), F.col("value")).otherwise(refused)
    return lines.where(data | (F.col("value") != header)).select(
        name.alias("series_id"), "source_row_number", text.alias("value")
    )


def _first_line(spark: SparkSession, path: str) -> str:
    """First line that is not blank; only the start of the first file is read."""
    first = raw_lines(use_utc(spark).read.text(path)).where("value <> ''").select("value").first()
    if first is None:
        raise ValueError("the source holds no header line")
    return first.value
