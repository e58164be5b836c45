"""Pages of an ordered listing, read off an index of key ranges.

The listing is written once in key ranges of about equal size, every row with its position in its
range, and one row a range says how many rows come before it. A page then opens only the ranges it
touches, and in them only the row groups of its positions, so a late page reads as much as the first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterspark.session import staged

ROWS_PER_RANGE = 1_000_000
RANGES = "range_no int, first_row long, n_rows long"
# A running id holds the partition above this many bits and the place in it below.
_PLACE_BITS = 33


@dataclass(frozen=True)
class PageIndex:
    """Where an index lies and the columns of its listing."""

    path: str
    schema: T.StructType

    def rows(self, spark: SparkSession) -> DataFrame:
        stored = (
            T.StructType()
            .add("row", self.schema)
            .add("position", T.LongType())
            .add("range_no", T.IntegerType())
        )
        return spark.read.schema(stored).parquet(f"{self.path}/rows")

    def ranges(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(RANGES).parquet(f"{self.path}/ranges")


def index_pages(
    df: DataFrame, order: Sequence[Column], path: str, *, rows_per_range: int = ROWS_PER_RANGE
) -> PageIndex:
    """Write the index of a listing to a new folder.

    The order should tell all rows apart: rows equal in it lie in one range, in any order among
    themselves. An empty listing has no ranges.
    """
    spark = df.sparkSession
    listed = staged(df, "listing")
    ranges = max(1, -(-listed.count() // rows_per_range))
    placed = (
        listed.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place"))
    )
    placed.select(
        "row",
        F.col("place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("position"),
        F.shiftright("place", _PLACE_BITS).cast("int").alias("range_no"),
    ).write.partitionBy("range_no").parquet(f"{path}/rows")
    index = PageIndex(path, df.schema)
    counts = index.rows(spark).groupBy("range_no").agg(F.count(F.lit(1)).alias("n_rows"))
    # One row a range of a million rows; this small table alone is summed in one task.
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counts.select(
        "range_no", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("first_row"), "n_rows"
    ).write.parquet(f"{path}/ranges")
    return index


def read_page(spark: SparkSession, index: PageIndex, number: int, size: int) -> DataFrame:
    """Rows of one page in the listing's order; beyond the last page there are none."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    first, stop = (number - 1) * size, number * size
    # A range has at least one row, so a page touches at most as many ranges as it has rows.
    touched = (
        index.ranges(spark)
        .where((F.col("first_row") < stop) & (F.col("first_row") + F.col("n_rows") > first))
        .collect()
    )
    parts = (
        (F.col("range_no") == r.range_no)
        & F.col("position").between(max(0, first - r.first_row), min(r.n_rows, stop - r.first_row) - 1)
        for r in touched
    )
    opened = index.rows(spark).where(F.col("range_no").isin([r.range_no for r in touched]))
    return opened.where(reduce(or_, parts, F.lit(False))).orderBy("range_no", "position").select("row.*")
