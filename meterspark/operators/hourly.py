"""Hourly facts from raw measurements.

Plan of :func:`hourly_transform`: one scan, then

1. rows of one instant are merged by a hash aggregation (copies collapse before the shuffle);
2. merged rows are shuffled by ``(series, day)`` with a few seconds of halo, and each reading sees
   the nearest valid reading before and after it. A day of one series has at most 86,400 slots;
3. the hour aggregation reuses that partitioning;
4. hours without rows are filled in from the step to the next stored hour.

The slots of the time grid are never materialised: short gaps, coverage and missing runs follow
from the distance between neighbouring readings. :func:`grid_fill` builds the grid when it is the
result that is wanted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterspark.functions.chunks import CHUNK, OWN, consecutive_pairs, with_halo
from meterspark.functions.clock import (
    DAY,
    HOUR,
    epoch,
    floor_div,
    floor_to,
    from_epoch,
    micros,
)
from meterspark.functions.parsing import is_finite
from meterspark.schemas import (
    DUPLICATE_POLICIES,
    TRAINING_READY,
    TRANSFORM_MEASURES,
)

SERIES = ("series_id",)
TARGETS = {"energy": "energy_kwh", "active_power": "active_power_kw"}
MARKS = ("conflict", "invalid_value", "has_energy", "has_active_power")


@dataclass(frozen=True)
class Policy:
    """How duplicates, short gaps and partial hours are treated."""

    short_gap_minutes: int = 5
    minimum_coverage: float = 0.9
    duplicates: str = "reject"

    def __post_init__(self) -> None:
        if not 0 <= self.short_gap_minutes <= 5:
            raise ValueError("short_gap_minutes must be between 0 and 5")
        if not 0.8 <= self.minimum_coverage <= 1:
            raise ValueError("minimum_coverage must be between 0.8 and 1")
        if self.duplicates not in DUPLICATE_POLICIES:
            raise ValueError(f"duplicates must be one of {DUPLICATE_POLICIES}")


def check_interval(interval: int) -> None:
    if interval <= 0 or HOUR % interval:
        raise ValueError("the source interval must divide one hour")


def target_semantics(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """``energy`` for a series with some finite energy and no finite power at all."""
    return df.groupBy(*keys).agg(
        F.when(
            F.max(is_finite(F.col("energy_kwh"))) & ~F.max(is_finite(F.col("active_power_kw"))),
            "energy",
        )
        .otherwise("active_power")
        .alias("semantic")
    )


def resolve_duplicates(
    df: DataFrame,
    policy: str = "reject",
    keys: Sequence[str] = SERIES,
    *,
    flags: bool = False,
    any_of: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per instant: measures, ``status_code``, ``conflict``; flags too when asked for.

    ``any_of`` adds named conditions that hold for at least one of the merged rows.

    Rows disagree when a measure or the parse status differs, null being equal to null. All
    aggregates have fixed-width buffers, so this is a hash aggregation with map-side combining.
    """
    if policy not in DUPLICATE_POLICIES:
        raise ValueError(f"policy must be one of {DUPLICATE_POLICIES}")
    code = F.when(F.col("parse_status") == "invalid", 2).when(
        F.col("parse_status") == "warning", 1
    ).otherwise(0)
    source = df.withColumn("status_code", code)
    differs = F.min("status_code") != F.max("status_code")
    for measure in TRANSFORM_MEASURES:
        # A missing value takes part as NaN, which parsing never lets through as a value.
        present = F.coalesce(measure, F.lit(float("nan")))
        differs = differs | (F.min(present) != F.max(present))

    def first(name: str) -> Column:
        return F.min_by(name, "source_row_number")

    def last(name: str) -> Column:
        return F.max_by(name, "source_row_number")

    chosen = []
    for name in (*TRANSFORM_MEASURES, "status_code"):
        if policy == "keep_last":
            pick = F.when(F.col("differs"), F.col(f"last_{name}")).otherwise(F.col(f"first_{name}"))
        elif policy == "mean" and name != "status_code":
            pick = F.when(F.col("differs"), F.col(f"mean_{name}")).otherwise(F.col(f"first_{name}"))
        else:
            pick = F.col(f"first_{name}")
        chosen.append(pick.alias(name))
    aggregates = [differs.alias("differs")]
    aggregates += [first(n).alias(f"first_{n}") for n in (*TRANSFORM_MEASURES, "status_code")]
    if policy == "keep_last":
        aggregates += [last(n).alias(f"last_{n}") for n in (*TRANSFORM_MEASURES, "status_code")]
    if policy == "mean":
        aggregates += [
            F.avg(F.when(is_finite(F.col(n)), F.col(n))).alias(f"mean_{n}")
            for n in TRANSFORM_MEASURES
        ]
    any_of = any_of or {}
    aggregates += [F.max(condition).alias(name) for name, condition in any_of.items()]
    extra = [F.col(name) for name in any_of]
    if flags:
        aggregates.append(first("quality_flags").alias("first_flags"))
        if policy == "keep_last":
            aggregates.append(last("quality_flags").alias("last_flags"))
            kept = F.when(F.col("differs"), F.col("last_flags")).otherwise(F.col("first_flags"))
        elif policy == "mean":
            # Flags are drawn from a small vocabulary; each task keeps only the distinct ones.
            aggregates.append(F.collect_set("quality_flags").alias("all_flags"))
            union = F.array_sort(F.array_distinct(F.flatten("all_flags")))
            kept = F.when(F.col("differs"), union).otherwise(F.col("first_flags"))
        else:
            kept = F.col("first_flags")
        extra.append(kept.alias("quality_flags"))
    return source.groupBy(*keys, "observed_at").agg(*aggregates).select(
        *keys,
        "observed_at",
        *chosen,
        (F.col("differs") if policy == "reject" else F.lit(False)).alias("conflict"),
        *extra,
    )


def usable(measure: str) -> Column:
    """A target value that counts: from a row that parsed, finite and not negative."""
    value = F.col(measure)
    return F.when((F.col("status_code") != 2) & is_finite(value) & (value >= 0), value)


def has_invalid_numeric() -> Column:
    """A row that did not parse or shows an impossible measure."""
    wrong = F.col("status_code") == 2
    for measure in TRANSFORM_MEASURES:
        value = F.col(measure)
        low = value <= 0 if measure == "voltage_v" else value < 0
        wrong = wrong | (value.isNotNull() & (~is_finite(value) | low))
    return wrong


def on_grid(interval: int) -> Column:
    """True for a time that is a whole number of intervals after the hour."""
    return micros(F.col("observed_at")) % (interval * 1_000_000) == 0


def slots(df: DataFrame, semantic: DataFrame, interval: int, keys: Sequence[str]) -> DataFrame:
    """Resolved on-grid rows with ``slot`` (intervals since 1970) and the usable target ``v``."""
    check_interval(interval)
    return (
        df.where(on_grid(interval))
        .join(semantic, list(keys))
        .select(
            *keys,
            floor_div(epoch(F.col("observed_at")), interval).alias("slot"),
            F.when(F.col("semantic") == "energy", usable("energy_kwh"))
            .otherwise(usable("active_power_kw"))
            .alias("v"),
        )
    )


def grid_bounds(df: DataFrame, interval: int, keys: Sequence[str] = SERIES) -> DataFrame:
    """First and last slot of each series: whole hours around all its rows, on grid or not."""
    per_hour = HOUR // interval
    return df.groupBy(*keys).agg(
        (floor_div(epoch(F.min("observed_at")), HOUR) * per_hour).alias("first_slot"),
        ((floor_div(epoch(F.max("observed_at")), HOUR) + 1) * per_hour - 1).alias("last_slot"),
    )


def grid_fill(
    resolved: DataFrame, semantic: DataFrame, interval: int, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Every expected slot of every series with its usable value or null.

    The grid is exploded day by day, so no array spans a series.
    """
    per_day = DAY // interval
    days = grid_bounds(resolved, interval, keys).select(
        *keys,
        "first_slot",
        "last_slot",
        F.explode(
            F.sequence(
                floor_div(F.col("first_slot"), per_day), floor_div(F.col("last_slot"), per_day)
            )
        ).alias("day"),
    )
    grid = days.select(
        *keys,
        F.explode(
            F.sequence(
                F.greatest(F.col("first_slot"), F.col("day") * per_day),
                F.least(F.col("last_slot"), F.col("day") * per_day + (per_day - 1)),
            )
        ).alias("slot"),
    )
    observed = slots(resolved, semantic, interval, keys)
    return grid.join(observed, [*keys, "slot"], "left").select(
        *keys,
        from_epoch(F.col("slot") * interval).alias("observed_at"),
        F.col("slot"),
        F.col("v").alias("value"),
    )


def missing_runs(
    resolved: DataFrame, semantic: DataFrame, interval: int, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Maximal runs of expected slots without a usable value: ``run_start`` and ``run_length``.

    Runs are the spaces between consecutive valid slots, plus those at both ends of the series.
    """
    per_day = DAY // interval
    valid = (
        slots(resolved, semantic, interval, keys)
        .where(F.col("v").isNotNull())
        .select(*keys, "slot", floor_div(F.col("slot"), per_day).alias(CHUNK))
    )
    inner = consecutive_pairs(valid, keys, "slot").select(
        *keys,
        (F.col("prev_slot") + 1).alias("start"),
        (F.col("slot") - F.col("prev_slot") - 1).alias("run_length"),
    )
    ends = grid_bounds(resolved, interval, keys).join(
        valid.groupBy(*keys).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi")),
        list(keys),
        "left",
    )
    whole = F.col("last_slot") - F.col("first_slot") + 1
    outer = ends.select(
        *keys,
        F.inline(
            F.array(
                F.struct(
                    F.col("first_slot").alias("start"),
                    F.coalesce(F.col("lo") - F.col("first_slot"), whole).alias("run_length"),
                ),
                F.struct(
                    (F.col("hi") + 1).alias("start"),
                    F.coalesce(F.col("last_slot") - F.col("hi"), F.lit(0)).alias("run_length"),
                ),
            )
        ),
    )
    return (
        inner.unionByName(outer)
        .where("run_length > 0")
        .select(*keys, from_epoch(F.col("start") * interval).alias("run_start"), "run_length")
    )


def interpolate_short_gaps(
    resolved: DataFrame,
    semantic: DataFrame,
    interval: int,
    limit_minutes: int,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """The slots filled on a straight line between the two readings around a short gap."""
    limit = limit_minutes * 60 // interval
    per_day = DAY // interval
    valid = slots(resolved, semantic, interval, keys).where(F.col("v").isNotNull())
    if limit == 0:
        return valid.where(F.lit(False)).select(
            *keys,
            from_epoch(F.col("slot") * interval).alias("observed_at"),
            F.col("v").alias("value"),
        )
    seen = with_halo(valid, F.col("slot"), per_day, back=limit + 1, ahead=0)
    by_slot = Window.partitionBy(*keys, CHUNK).orderBy("slot")
    gap = seen.select(
        *keys,
        "slot",
        "v",
        OWN,
        F.lag("slot").over(by_slot).alias("p_slot"),
        F.lag("v").over(by_slot).alias("p_v"),
    ).select("*", (F.col("slot") - F.col("p_slot") - 1).alias("n"))
    steps = gap.where(F.col(OWN) & F.col("n").between(1, limit)).select(
        "*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")
    )
    line = F.col("p_v") + (F.col("v") - F.col("p_v")) * F.col("k") / (F.col("n") + 1)
    return steps.select(
        *keys,
        from_epoch((F.col("p_slot") + F.col("k")) * interval).alias("observed_at"),
        line.alias("value"),
    )


def hourly_transform(
    df: DataFrame,
    interval: int,
    policy: Policy | None = None,
    *,
    timezone: str | None = None,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Hourly facts of every series. See the module text for the plan."""
    check_interval(interval)
    policy = policy or Policy()
    stored = _hour_rows(df, interval, policy, keys)
    hours = _fill_hours(stored, interval, keys)
    return _publish(hours, interval, policy, timezone, keys)


def _hour_rows(df: DataFrame, interval: int, policy: Policy, keys: Sequence[str]) -> DataFrame:
    """Aggregates of the hours that hold rows, for both possible targets."""
    per_hour = HOUR // interval
    limit = policy.short_gap_minutes * 60 // interval
    halo = limit + 1 if limit else 0
    # Off-grid rows only widen the range and decide the target, so they shrink to one row an hour.
    ready = df.withColumn("off_grid", ~on_grid(interval)).withColumn(
        "observed_at",
        F.when(F.col("off_grid"), floor_to(F.col("observed_at"), HOUR)).otherwise(
            F.col("observed_at")
        ),
    )
    merged = resolve_duplicates(
        ready,
        policy.duplicates,
        [*keys, "off_grid"],
        any_of={f"has_{name}": is_finite(F.col(m)) for name, m in TARGETS.items()},
    )
    seen = with_halo(
        _chunk_rows(merged, interval, keys), F.col("slot"), DAY // interval, back=halo, ahead=halo
    )
    inside = f"over (partition by {', '.join(keys)}, {CHUNK} order by slot)"
    linked = seen.select(
        "*",
        *(
            F.expr(f"{function}({name}{part}) ignore nulls {inside}").alias(f"{name}{part}_{function}")
            for name in TARGETS
            for part in ("", "_slot")
            for function in ("lag", "lead")
        ),
    ).where(OWN)
    linked = linked.withColumn("hour_slot", floor_div(F.col("slot"), per_hour) * per_hour)

    def marked(name: str) -> Column:
        return F.getbit(F.bit_or("marks"), F.lit(MARKS.index(name))) == 1

    aggregates = [marked(name).alias(name) for name in MARKS]
    for name in TARGETS:
        aggregates += _target_aggregates(name, limit, per_hour)
    for measure in ("active_power_kw", "reactive_power_kw", "voltage_v", "current_a"):
        good = F.col(f"good_{measure}")
        aggregates.append(F.avg(good).alias(f"mean_{measure}"))
        if measure == "voltage_v":
            aggregates.append(F.min(good).alias("min_voltage_v"))
        if measure in ("voltage_v", "current_a"):
            aggregates.append(F.max(good).alias(f"max_{measure}"))
    return linked.groupBy(*keys, CHUNK, "hour_slot").agg(*aggregates)


def _chunk_rows(merged: DataFrame, interval: int, keys: Sequence[str]) -> DataFrame:
    """What the chunk shuffle carries, and no more: conditions are bits, values are ready to use."""
    gridded = ~F.col("off_grid")
    conditions = {
        "conflict": F.col("conflict") & gridded,
        "invalid_value": has_invalid_numeric() & gridded,
        **{f"has_{name}": F.col(f"has_{name}") for name in TARGETS},
    }
    marks = sum(
        (F.when(conditions[name], 1 << place).otherwise(0) for place, name in enumerate(MARKS)),
        F.lit(0),
    )
    slot = floor_div(epoch(F.col("observed_at")), interval)
    targets, goods = [], []
    for name, measure in TARGETS.items():
        value = F.when(gridded, usable(measure))
        targets += [value.alias(name), F.when(value.isNotNull(), slot).alias(f"{name}_slot")]
    for measure in TRANSFORM_MEASURES[1:]:
        value = F.col(measure)
        fit = value > 0 if measure == "voltage_v" else value >= 0
        goods.append(F.when(gridded & is_finite(value) & fit, value).alias(f"good_{measure}"))
    return merged.select(*keys, slot.alias("slot"), marks.alias("marks"), *targets, *goods)


def _target_aggregates(name: str, limit: int, per_hour: int) -> list[Column]:
    """Hour aggregates of one target: count, sum, short-gap fill and missing run."""
    slot, start, value = F.col("slot"), F.col("hour_slot"), F.col(name)
    valid = value.isNotNull()
    left_slot, left = F.col(f"{name}_slot_lag"), F.col(f"{name}_lag")
    right_slot, right = F.col(f"{name}_slot_lead"), F.col(f"{name}_lead")

    # The part of a short gap before this reading that lies in its hour.
    gap = slot - left_slot - 1
    k_first = F.greatest(left_slot + 1, start) - left_slot
    short = valid & gap.between(1, limit)
    slope = (value - left) / (gap + 1)
    n_before = F.when(short, gap - k_first + 1).otherwise(0)
    fill_before = F.when(
        short, n_before * left + slope * (gap * (gap + 1) - (k_first - 1) * k_first) / 2
    ).otherwise(0.0)

    # The part after it, where the gap leaves the hour; no short gap spans a whole hour.
    gap_after = right_slot - slot - 1
    end = start + per_hour
    crosses = valid & gap_after.between(1, limit) & (right_slot >= end)
    n_after = F.when(crosses, end - slot - 1).otherwise(0)
    slope_after = (right - value) / (gap_after + 1)
    fill_after = F.when(
        crosses, n_after * value + slope_after * n_after * (n_after + 1) / 2
    ).otherwise(0.0)

    run_before = F.when(valid, slot - F.greatest(F.coalesce(left_slot + 1, start), start))
    return [
        F.count(value).alias(f"{name}_observed"),
        F.sum(value).alias(f"{name}_sum"),
        F.sum(n_before + n_after).alias(f"{name}_imputed"),
        F.sum(fill_before + fill_after).alias(f"{name}_fill"),
        F.max(run_before).alias(f"{name}_run"),
        F.max(f"{name}_slot").alias(f"{name}_last"),
    ]


def _fill_hours(stored: DataFrame, interval: int, keys: Sequence[str]) -> DataFrame:
    """Add the hours between stored ones and pick the target of each series.

    One row an hour is left here: at most 8,784 a year for a series.
    """
    per_hour = HOUR // interval
    series = Window.partitionBy(*keys)
    following = F.lead("hour_slot").over(series.orderBy("hour_slot"))
    power_seen = F.max("has_active_power").over(series)
    energy_seen = F.max("has_energy").over(series)
    linked = stored.select(
        "*",
        F.coalesce(following - per_hour, F.col("hour_slot")).alias("until"),
        (energy_seen & ~power_seen).alias("by_energy"),
    )
    hours = linked.select(
        "*",
        F.explode(
            F.sequence(F.col("hour_slot"), F.col("until"), F.lit(per_hour).cast("long"))
        ).alias("slot"),
    )
    here = F.col("slot") == F.col("hour_slot")

    def target(name: str) -> Column:
        return F.when(
            here,
            F.when(F.col("by_energy"), F.col(f"energy_{name}")).otherwise(
                F.col(f"active_power_{name}")
            ),
        )

    observed = F.coalesce(target("observed"), F.lit(0))
    run_after = F.col("slot") + per_hour - 1 - target("last")
    return hours.select(
        *keys,
        from_epoch(F.col("slot") * interval).alias("hour_start"),
        F.when(F.col("by_energy"), F.lit(1.0)).otherwise(F.lit(interval / HOUR)).alias("kwh_per"),
        "by_energy",
        F.lit(per_hour).cast("long").alias("expected_samples"),
        observed.alias("observed_samples"),
        F.coalesce(target("imputed"), F.lit(0)).alias("imputed_samples"),
        (target("sum") + target("fill")).alias("filled_sum"),
        F.coalesce(F.greatest(target("run"), run_after), F.lit(per_hour))
        .cast("long")
        .alias("max_missing_run"),
        F.coalesce(here & F.col("conflict"), F.lit(False)).alias("conflict"),
        F.coalesce(here & F.col("invalid_value"), F.lit(False)).alias("invalid_value"),
        *(
            F.when(here, F.col(name)).alias(name)
            for name in (
                "mean_active_power_kw",
                "mean_reactive_power_kw",
                "mean_voltage_v",
                "min_voltage_v",
                "max_voltage_v",
                "mean_current_a",
                "max_current_a",
            )
        ),
    )


def _publish(
    hours: DataFrame, interval: int, policy: Policy, timezone: str | None, keys: Sequence[str]
) -> DataFrame:
    expected = HOUR // interval
    threshold = math.ceil(policy.minimum_coverage * expected)
    observed, imputed = F.col("observed_samples"), F.col("imputed_samples")
    present = observed + imputed
    conflict, invalid = F.col("conflict"), F.col("invalid_value")
    status = (
        F.when(conflict, "invalid_conflict")
        .when(invalid, "invalid_value")
        .when(observed == expected, "complete")
        .when((observed >= threshold) & (present == expected), "imputed_short_gap")
        .when(observed >= threshold, "valid_partial")
        .otherwise("invalid_missing")
    )
    flags = F.array_compact(
        F.array(
            F.when(conflict, "conflicting_duplicate"),
            F.when(invalid, "invalid_target_value"),
            F.when(observed < expected, "missing_samples"),
            F.when(imputed > 0, "short_gap_interpolated"),
        )
    )
    return hours.select(
        *keys,
        "hour_start",
        F.lit(timezone).cast("string").alias("timezone_context"),
        F.when(present > 0, F.col("filled_sum") * F.col("kwh_per")).alias("energy_kwh"),
        F.when(F.col("by_energy"), F.col("mean_active_power_kw"))
        .otherwise(F.when(present > 0, F.col("filled_sum") / present))
        .alias("mean_active_power_kw"),
        "mean_reactive_power_kw",
        "mean_voltage_v",
        "min_voltage_v",
        "max_voltage_v",
        "mean_current_a",
        "max_current_a",
        "observed_samples",
        "expected_samples",
        (observed / F.lit(expected)).alias("coverage_ratio"),
        "imputed_samples",
        "max_missing_run",
        status.alias("quality_status"),
        flags.alias("quality_flags"),
    )


def transform_summary(hourly: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Hours, training-ready hours and hours per status of each series."""
    per_status = hourly.groupBy(*keys, "quality_status").agg(F.count(F.lit(1)).alias("hours"))
    return per_status.groupBy(*keys).agg(
        F.sum("hours").alias("hour_count"),
        F.coalesce(
            F.sum(F.when(F.col("quality_status").isin(*TRAINING_READY), F.col("hours"))), F.lit(0)
        ).alias("training_ready_hours"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("quality_status", "hours")))
        ).alias("status_counts"),
    )


def infer_cadence(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Source interval of each series from the steps between all its distinct times, or null.

    Steps inside an hour are windowed by (series, hour); those from one hour to the next come from
    one row per hour. A series is never one task's rows.
    """
    times = df.select(
        *keys, floor_div(epoch(F.col("observed_at")), HOUR).alias("hour"), "observed_at"
    ).distinct()
    by_time = Window.partitionBy(*keys, "hour").orderBy("observed_at")
    inside = times.select(*keys, "observed_at", F.lag("observed_at").over(by_time).alias("before"))
    edges = times.groupBy(*keys, "hour").agg(
        F.min("observed_at").alias("observed_at"), F.max("observed_at").alias("last")
    )
    by_hour = Window.partitionBy(*keys).orderBy("hour")
    across = edges.select(*keys, "observed_at", F.lag("last").over(by_hour).alias("before"))
    steps = inside.unionByName(across).where(F.col("before").isNotNull())
    delta = micros(F.col("observed_at")) - micros(F.col("before"))
    counted = steps.groupBy(*keys, delta.alias("delta")).agg(
        F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("seen")
    )
    seconds = floor_div(F.col("delta"), 1_000_000)
    whole = F.col("delta") % 1_000_000 == 0
    candidate = whole & (seconds <= HOUR) & (F.lit(HOUR) % seconds == 0)
    best = counted.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.min(whole).alias("all_whole"),
        # The most frequent candidate; the one met first on a tie.
        F.min_by(
            F.struct(seconds.alias("step"), F.col("n")),
            F.when(candidate, F.struct(-F.col("n"), F.col("seen"))),
        ).alias("best"),
        # A candidate divides the hour, so the remainders by the hour tell all it must divide.
        F.collect_set(F.when(whole, seconds % HOUR)).alias("steps"),
    )
    usable_step = (
        F.col("all_whole")
        & F.col("best").isNotNull()
        & (F.col("best.n") * 2 >= F.col("total"))
        & F.forall("steps", lambda step: step % F.col("best.step") == 0)
    )
    series = df.select(*keys).distinct()
    return series.join(
        best.select(*keys, F.when(usable_step, F.col("best.step")).alias("interval_seconds")),
        list(keys),
        "left",
    )
