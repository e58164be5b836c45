"""Leakage-safe features, direct targets and seasonal lookups on a gap-free series.

Input: one row per series and step (an hour unless ``step`` says otherwise), so a series has at
most 8,784 rows a year and its windows fit one task. Every past window is built from lags by
doubling: a sum over six rows is a sum over three plus the same sum three rows earlier. Work per
row does not grow with the window length, and a missing value anywhere in a window makes the
result null, which is exactly the full-window rule.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterspark.functions.clock import HOUR, epoch, from_epoch, local
from meterspark.functions.parsing import is_finite
from meterspark.schemas import (
    HORIZONS,
    LAGS,
    SEASONAL_PERIODS,
    VALID_HOUR,
    feature_names,
    target_names,
)

SERIES = ("series_id",)


def quality_view(hourly: DataFrame, mode: str) -> DataFrame:
    """Sensitivity view: energy of ineligible hours becomes null, the row stays."""
    if mode == "complete_only":
        eligible = F.col("quality_status") == "complete"
    elif mode == "coverage_90":
        eligible = (F.col("coverage_ratio") >= 0.9) & F.col("quality_status").isin(*VALID_HOUR)
    else:
        raise ValueError("mode must be complete_only or coverage_90")
    return hourly.withColumn("energy_kwh", F.when(eligible, F.col("energy_kwh")))


def invalid_hourly(hourly: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Rows that make a series unfit: duplicate hours, negative or non-finite energy."""
    per_hour = hourly.groupBy(*keys, "hour_start").agg(
        F.count(F.lit(1)).alias("copies"),
        F.max(
            F.col("energy_kwh").isNotNull()
            & (~is_finite(F.col("energy_kwh")) | (F.col("energy_kwh") < 0))
        ).alias("bad_energy"),
    )
    return per_hour.where((F.col("copies") > 1) | F.col("bad_energy")).select(
        *keys,
        "hour_start",
        F.when(F.col("copies") > 1, "duplicate_hour").otherwise("energy_invalid").alias("problem"),
    )


def regular(hourly: DataFrame, step: int = HOUR, keys: Sequence[str] = SERIES) -> DataFrame:
    """Add a row with nulls for every absent step between the first and last of a series."""
    carried = [c for c in hourly.columns if c not in (*keys, "hour_start")]
    by_time = Window.partitionBy(*keys).orderBy("at")
    linked = hourly.withColumn("at", epoch(F.col("hour_start"))).withColumn(
        "until", F.coalesce(F.lead("at").over(by_time) - step, F.col("at"))
    )
    filled = linked.select(
        "*", F.explode(F.sequence("at", "until", F.lit(step).cast("long"))).alias("slot")
    )
    return filled.select(
        *keys,
        from_epoch(F.col("slot")).alias("origin"),
        *(F.when(F.col("slot") == F.col("at"), F.col(c)).alias(c) for c in carried),
    )


def calendar_features(origin: Column, timezone: str) -> dict[str, Column]:
    civil = local(origin, timezone)
    hour = F.hour(civil).cast("double")
    weekday = F.weekday(civil).cast("double")
    month = F.month(civil).cast("double")
    turn = 2 * math.pi
    return {
        "hour": hour,
        "day_of_week": weekday,
        "day_of_month": F.dayofmonth(civil).cast("double"),
        "month": month,
        "is_weekend": (weekday >= 5).cast("double"),
        "hour_sin": F.sin(turn * hour / 24),
        "hour_cos": F.cos(turn * hour / 24),
        "day_of_week_sin": F.sin(turn * weekday / 7),
        "day_of_week_cos": F.cos(turn * weekday / 7),
        "month_sin": F.sin(turn * (month - 1) / 12),
        "month_cos": F.cos(turn * (month - 1) / 12),
    }


def build_features(
    hourly: DataFrame,
    *,
    timezone: str = "UTC",
    quality: bool = False,
    targets: bool = False,
    naive: bool = False,
    step: int = HOUR,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """All features of every step, eligible or not.

    ``targets`` adds the array of the next 24 values and ``has_targets``, true when all of them
    exist; ``naive`` adds the arrays ``naive_24`` and ``naive_168``. Neighbouring values are
    collected as one array rather than by 24 offsets each: every offset is a piece of code that
    each executor has to compile.
    """
    wanted = ["energy_kwh", *(["coverage_ratio", "quality_status"] if quality else [])]
    frame = regular(hourly.select(*keys, "hour_start", *wanted), step, keys)
    order = Window.partitionBy(*keys).orderBy("origin")

    def back(name: str, rows: int) -> Column:
        return F.lag(name, rows).over(order)

    first = [back("energy_kwh", n).alias(f"lag_{n}") for n in LAGS]

    def span(start: int, end: int) -> Column:
        """Values of consecutive rows, nulls included; shorter where the series ends."""
        return F.collect_list(F.struct("energy_kwh")).over(order.rowsBetween(start, end))

    if targets:
        ahead = order.rowsBetween(1, HORIZONS)
        first.append(span(1, HORIZONS)["energy_kwh"].alias("targets"))
        first.append((F.count("energy_kwh").over(ahead) == HORIZONS).alias("has_targets"))
    if naive:
        for period in SEASONAL_PERIODS:
            seen = span(1 - period, HORIZONS - period)["energy_kwh"]
            before = F.array_repeat(F.lit(None).cast("double"), HORIZONS - F.size(seen))
            first.append(F.concat(before, seen).alias(f"naive_{period}"))
    if quality:
        frame = frame.withColumn("gap", F.col("energy_kwh").isNull().cast("double"))
        first += [back("coverage_ratio", n).alias(f"covered_{n}") for n in (1, 2, 3)]
        first += [back("gap", n).alias(f"gap_{n}") for n in (1, 2, 3)]
        first.append(
            F.coalesce((back("quality_status", 1) == "imputed_short_gap").cast("double"), F.lit(0.0))
            .alias("last_hour_imputed")
        )
    frame = frame.select("*", *first)

    # Blocks over the last three rows: sum, squared deviations, extremes.
    l1, l2, l3 = (F.col(f"lag_{n}") for n in (1, 2, 3))
    total = l1 + l2 + l3
    blocks = {
        "s": total,
        "q": sum((x - total / 3) * (x - total / 3) for x in (l1, l2, l3)),
        "lo": F.least(l1, l2, l3),
        "hi": F.greatest(l1, l2, l3),
    }
    sums = ["s"]
    if quality:
        blocks["c"] = F.col("covered_1") + F.col("covered_2") + F.col("covered_3")
        blocks["g"] = F.col("gap_1") + F.col("gap_2") + F.col("gap_3")
        sums += ["c", "g"]
    frame = frame.select("*", *(e.alias(f"{n}_3") for n, e in blocks.items()))
    for half in (3, 6, 12):
        old = frame.select("*", *(back(f"{n}_{half}", half).alias(f"old_{n}") for n in blocks))
        shift = (F.col(f"s_{half}") - F.col("old_s")) / half
        merged = {n: F.col(f"{n}_{half}") + F.col(f"old_{n}") for n in sums}
        merged["q"] = F.col(f"q_{half}") + F.col("old_q") + shift * shift * (half / 2)
        merged["lo"] = F.least(f"lo_{half}", "old_lo")
        merged["hi"] = F.greatest(f"hi_{half}", "old_hi")
        spent = [f"{n}_{half}" for n in ("q", "lo", "hi")] + [f"old_{n}" for n in blocks]
        frame = old.select("*", *(e.alias(f"{n}_{2 * half}") for n, e in merged.items())).drop(*spent)

    def week(name: str) -> Column:
        return sum((back(f"{name}_24", 24 * day) for day in range(1, 7)), F.col(f"{name}_24"))

    frame = frame.select("*", *(week(n).alias(f"{n}_168") for n in sums if n != "c"))
    full_day = F.col("s_24").isNotNull()
    columns = {f"lag_{n}": F.col(f"lag_{n}") for n in LAGS}
    columns |= {f"rolling_mean_{n}": F.col(f"s_{n}") / n for n in (3, 6, 12, 24, 168)}
    columns["rolling_std_24"] = F.sqrt(F.col("q_24") / 24)
    columns["rolling_min_24"] = F.when(full_day, F.col("lo_24"))
    columns["rolling_max_24"] = F.when(full_day, F.col("hi_24"))
    columns |= calendar_features(F.col("origin"), timezone)
    if quality:
        columns["past_24h_coverage_mean"] = F.col("c_24") / 24
        columns["past_168h_missing_hours"] = F.col("g_168")
        columns["last_hour_imputed"] = F.col("last_hour_imputed")
    extra = ["targets", "has_targets"] if targets else []
    extra += [f"naive_{p}" for p in SEASONAL_PERIODS] if naive else []
    return frame.select(
        *keys,
        "origin",
        "energy_kwh",
        *(columns[name].alias(name) for name in feature_names(quality)),
        *extra,
    )


def eligible_features(frame: DataFrame, quality: bool = False) -> DataFrame:
    """Rows with every feature present.

    All lags and windows lie in the last 168 rows and the 168-row mean needs every one of them.
    """
    rows = frame.where(F.col("rolling_mean_168").isNotNull())
    return rows.where(F.col("past_24h_coverage_mean").isNotNull()) if quality else rows


def eligible_supervised(frame: DataFrame, quality: bool = False) -> DataFrame:
    """Rows with every feature and all 24 targets present."""
    return eligible_features(frame, quality).where("has_targets")


def target_columns() -> list[Column]:
    """The targets as ``target_h01`` to ``target_h24``."""
    return [
        F.get("targets", F.lit(place)).alias(name) for place, name in enumerate(target_names())
    ]


def origins_fingerprint(frame: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """SHA-256 of the eligible origins of each series, ISO texts joined by newlines.

    One short text per hour of a series: bounded by the calendar, not by the table.
    """
    stamp = F.date_format("origin", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    joined = F.array_join(F.array_sort(F.collect_list(stamp)), "\n")
    return frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("origin_count"),
        F.sha2(joined, 256).alias("eligible_origins_sha256"),
    )
