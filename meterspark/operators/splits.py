"""Chronological folds with a purge, and the held-out test period."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterspark.functions.clock import HOUR
from meterspark.schemas import HORIZONS

SERIES = ("series_id",)


@dataclass(frozen=True)
class SplitPlan:
    """Validation periods in time order and the start of the final test.

    A training origin must have all its targets before the period it is tested on, so the last
    ``HORIZONS`` steps before a period are left out of its training part.
    """

    validation: tuple[tuple[datetime, datetime], ...]
    test_start: datetime
    step: int = HOUR

    def __post_init__(self) -> None:
        starts = [start for start, _ in self.validation]
        if starts != sorted(starts) or any(s >= e for s, e in self.validation):
            raise ValueError("validation periods must be in time order")
        if self.validation and self.test_start < self.validation[-1][1]:
            raise ValueError("the final test must follow the validation periods")

    @property
    def purge(self) -> timedelta:
        return timedelta(seconds=self.step * HORIZONS)

    @property
    def cutoffs(self) -> tuple[datetime, ...]:
        """First origin time that is no longer training, per fold and then for the final model."""
        starts = [start for start, _ in self.validation] + [self.test_start]
        return tuple(start - self.purge for start in starts)

    @classmethod
    def quarters(cls, year: int, step: int = HOUR) -> SplitPlan:
        """The four quarters of a year, then a test from the next year on."""
        edges = [datetime(year, month, 1) for month in (1, 4, 7, 10)] + [datetime(year + 1, 1, 1)]
        return cls(tuple(zip(edges[:-1], edges[1:], strict=True)), edges[-1], step)


# The published protocol validates on the quarters of 2009 and tests from 2010.
DEFAULT_PLAN = SplitPlan.quarters(2009)


def instant(value: datetime) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def validation_fold(plan: SplitPlan, origin: str = "origin") -> Column:
    """Fold number in whose validation period an origin lies, or null."""
    column = F.lit(None).cast("int")
    for number, (start, end) in enumerate(plan.validation, 1):
        inside = (F.col(origin) >= instant(start)) & (F.col(origin) < instant(end))
        column = F.when(inside, F.lit(number)).otherwise(column)
    return column


def training_segment(plan: SplitPlan, origin: str = "origin") -> Column:
    """Number of cutoffs at or before an origin: fold ``k`` trains on segments below ``k``."""
    return sum(
        (F.when(F.col(origin) >= instant(cut), 1).otherwise(0) for cut in plan.cutoffs), F.lit(0)
    )


def fold_membership(
    frame: DataFrame, plan: SplitPlan, keys: Sequence[str] = SERIES
) -> DataFrame:
    """``keys, origin, fold_no, part`` with part ``train`` or ``validation``."""
    choices = []
    for number, (start, end) in enumerate(plan.validation, 1):
        trains = F.col("origin") < instant(start - plan.purge)
        validates = (F.col("origin") >= instant(start)) & (F.col("origin") < instant(end))
        for condition, part in ((trains, "train"), (validates, "validation")):
            choices.append(
                F.when(
                    condition, F.struct(F.lit(number).alias("fold_no"), F.lit(part).alias("part"))
                )
            )
    return frame.select(*keys, "origin", F.inline(F.array_compact(F.array(*choices))))


def fold_bounds(
    membership: DataFrame, plan: SplitPlan, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Sizes and training range of every fold of every series; a fold may be empty."""
    sizes = membership.groupBy(*keys, "fold_no").agg(
        F.count_if(F.col("part") == "train").alias("train_rows"),
        F.count_if(F.col("part") == "validation").alias("evaluation_rows"),
        F.min(F.when(F.col("part") == "train", F.col("origin"))).alias("train_start"),
        F.max(F.when(F.col("part") == "train", F.col("origin"))).alias("train_end"),
    )
    folds = membership.select(*keys).distinct().select(
        *keys,
        F.explode(F.array(*(F.lit(n) for n in range(1, len(plan.validation) + 1)))).alias("fold_no"),
    )
    return folds.join(sizes, [*keys, "fold_no"], "left").fillna(
        0, ["train_rows", "evaluation_rows"]
    )


def empty_folds(bounds: DataFrame) -> DataFrame:
    """Folds that cannot be evaluated; a series with one fails as a whole."""
    return bounds.where((F.col("train_rows") == 0) | (F.col("evaluation_rows") == 0))


def final_test(frame: DataFrame, plan: SplitPlan) -> DataFrame:
    return frame.where(F.col("origin") >= instant(plan.test_start))


def final_training(frame: DataFrame, plan: SplitPlan) -> DataFrame:
    return frame.where(F.col("origin") < instant(plan.test_start - plan.purge))
