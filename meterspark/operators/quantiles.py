"""Exact medians of several columns per group, for groups of any size, by radix selection.

A double is located digit by digit, each digit a function that never falls as the value grows: first its
logarithmic class (under one per cent wide), then its nearest single-precision number, then the value. Each pass
counts values by digit, with partial sums in every task, and keeps the digits that hold the two middle ranks. Rows
are read twice: once to count classes, once to count the values in the middle classes. What follows works on counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterspark.functions.parsing import is_finite
from meterspark.session import staged

#: Classes per unit of the natural logarithm, and a shift that makes classes of positive values positive:
#: the logarithm of the smallest double is above -745.
STEPS_PER_LOG = 128
_SHIFT = 745 * STEPS_PER_LOG + 1
MISSING, NON_FINITE = -1_000_000, 1_000_000
SALT = "_part"


def value_class(value: Column) -> Column:
    """The logarithmic class of a finite value: 0 for zero, its sign is the value's, and it grows with the value."""
    magnitude = (F.floor(F.log(F.abs(value)) * STEPS_PER_LOG) + _SHIFT).cast("int")
    return F.when(value > 0, magnitude).when(value < 0, -magnitude).otherwise(0)


def class_counts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], at: str | None = None) -> DataFrame:
    """``keys, column_name, class, copies, least, most`` (and first and last ``at``), for missing and non-finite values too."""

    def cell(name: str) -> Column:
        value = F.col(name)
        digit = F.when(value.isNull(), MISSING).when(~is_finite(value), NON_FINITE).otherwise(value_class(value))
        return F.struct(F.lit(name).alias("column_name"), digit.alias("class"), value.alias("value"))

    times = [F.min(at).alias("first_at"), F.max(at).alias("last_at")] if at else []
    cells = df.select(*keys, *([at] if at else []), F.inline(F.array(*(cell(c) for c in columns))))
    return cells.groupBy(*keys, "column_name", "class").agg(
        F.count(F.lit(1)).alias("copies"), F.min("value").alias("least"), F.max("value").alias("most"), *times
    )


def _middle(
    counted: DataFrame, group: Sequence[str], digit: str, low: Column, high: Column, ends: tuple[str, str] | None = None
) -> DataFrame:
    """``group, n, low, high, low_rank, high_rank``: the digits that hold two ranks, and the ranks from the lower digit on.

    ``ends`` names the columns to return for the lower and the upper digit instead of the digits themselves.
    """
    within = Window.partitionBy(*group).orderBy(digit)
    ranked = counted.withColumn("upto", F.sum("copies").over(within)).withColumn("n", F.sum("copies").over(Window.partitionBy(*group)))
    ranked = ranked.withColumn("before", F.col("upto") - F.col("copies"))
    first, last = ends or (digit, digit)

    def holder(rank: Column, value: str) -> Column:
        return F.max(F.when((F.col("before") < rank) & (F.col("upto") >= rank), F.col(value)))

    found = ranked.groupBy(*group).agg(
        F.max("n").alias("n"),
        F.max(low).alias("low_rank"),
        F.max(high).alias("high_rank"),
        holder(low, first).alias("low"),
        holder(high, last).alias("high"),
        holder(low, "before").alias("skipped"),
    )
    return found.select(*group, "n", "low", "high", *((F.col(r) - F.col("skipped")).alias(r) for r in ("low_rank", "high_rank")))


def beside(df: DataFrame, stats: DataFrame, keys: Sequence[str], part: Column | None = None) -> DataFrame:
    """Rows with the one row of statistics of their group; groups without statistics fall away.

    ``stats`` is a written table, so its size is known: below the session's broadcast limit it goes to the tasks and
    no row moves. Beyond that, rows meet it by group and ``part``, a bounded share of a group such as a day.
    """
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = stats._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if part is None or int(str(size)) <= limit:
        return df.join(stats, list(keys))
    rows = df.withColumn(SALT, part)
    places = rows.select(*keys, SALT).distinct().join(stats, list(keys))
    return rows.join(places, [*keys, SALT]).drop(SALT)


def exact_medians(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    *,
    part: Column | None = None,
    classes: DataFrame | None = None,
) -> DataFrame:
    """``keys, column_name, n, median`` over the finite values.

    ``classes`` are the :func:`class_counts` of ``df`` where the caller has them; ``part`` as in :func:`beside`.
    """
    group = [*keys, "column_name"]
    if classes is None:
        classes = class_counts(df, keys, columns)
    finite = classes.where(F.col("class").between(MISSING + 1, NON_FINITE - 1)).select(*group, "class", "copies", "least", "most")
    half = F.col("n").cast("long")
    first = _middle(finite, group, "class", F.floor((half + 1) / 2).cast("long"), F.floor(half / 2).cast("long") + 1, ("least", "most"))
    state = F.struct("n", "low", "high", "low_rank", "high_rank")
    brackets = staged(
        first.groupBy(*keys).agg(*(F.max(F.when(F.col("column_name") == c, state)).alias(f"_{c}") for c in columns)),
        "median-classes",
    )

    cells = F.array(
        *(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"), F.col(f"_{c}.low").alias("low"), F.col(f"_{c}.high").alias("high")) for c in columns)
    )
    near = beside(df, brackets, keys, part).select(*keys, F.inline(cells)).where("value >= low AND value <= high")
    counted = staged(near.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("copies")), "median-values")

    named = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"_{c}").alias("state")) for c in columns))
    ranks = brackets.select(*keys, F.inline(named)).where("state IS NOT NULL")
    ranks = ranks.select(*group, F.col("state.n").alias("all"), "state.low_rank", "state.high_rank")
    single = F.col("value").cast("float")
    coarse = counted.groupBy(*group, single.alias("single")).agg(F.sum("copies").alias("copies")).join(ranks, group)
    second = _middle(coarse, group, "single", F.col("low_rank"), F.col("high_rank"))
    ends = second.select(*group, F.col("low").alias("_low"), F.col("high").alias("_high"), "low_rank", "high_rank")
    fine = counted.join(ends, group).where((single == F.col("_low")) | (single == F.col("_high")))
    last = _middle(fine, group, "value", F.col("low_rank"), F.col("high_rank")).drop("n")
    return last.join(ranks.select(*group, F.col("all").alias("n")), group).select(
        *group, "n", ((F.col("low") + F.col("high")) / 2).alias("median")
    )


def widen(
    stats: DataFrame, keys: Sequence[str], columns: Sequence[str], value: str
) -> DataFrame:
    """One row per group with ``<column>__<value>`` for each column."""
    return stats.groupBy(*keys).agg(
        *(
            F.max(F.when(F.col("column_name") == c, F.col(value))).alias(f"{c}__{value}")
            for c in columns
        )
    )
