"""Direct ridge regression for every series, fold, penalty and horizon from one pass.

The rows are read once. Each task sums, per series and training segment, the count, mean and
centred cross products of the features and 24 targets (a block of fixed size). Blocks of a series
are merged, the expanding training sets are the running merges of its segments, and all penalties
and horizons are solved from them. The number of folds and penalties does not add passes.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterspark.operators.splits import (
    SplitPlan,
    fold_membership,
    training_segment,
    validation_fold,
)
from meterspark.schemas import HORIZONS, feature_names

# The functions below run in Python workers, which need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SERIES = ("series_id",)
# Penalties searched, default penalty.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
DEFAULT_ALPHA = 1.0
# A task keeps this many unmerged blocks (about 20 kB each) before it emits them.
OPEN_BLOCKS = 256
FINAL_FOLD = 0


def merge_moments(a, b):
    """Count, mean and centred cross products of two disjoint sets of rows together."""
    if a is None:
        return b
    n_a, mean_a, cross_a = a
    n_b, mean_b, cross_b = b
    n = n_a + n_b
    shift = mean_b - mean_a
    return (
        n,
        mean_a + shift * (n_b / n),
        cross_a + cross_b + np.outer(shift, shift) * (n_a * n_b / n),
    )


def moment_blocks(
    frame: DataFrame, plan: SplitPlan, keys: Sequence[str] = SERIES, *, quality: bool = False
) -> DataFrame:
    """``keys, segment, n, mean, cross``: one or more blocks per series and training segment."""
    values = F.concat(F.array(*feature_names(quality)), F.col("targets"))
    last = len(plan.cutoffs)
    rows = frame.select(
        *keys, training_segment(plan).cast("int").alias("segment"), values.alias("row")
    ).where(F.col("segment") < last)
    names = [*keys, "segment"]

    def flush(open_blocks: dict) -> pd.DataFrame:
        out = pd.DataFrame(list(open_blocks), columns=names)
        out["n"] = [b[0] for b in open_blocks.values()]
        out["mean"] = [b[1] for b in open_blocks.values()]
        out["cross"] = [b[2].ravel() for b in open_blocks.values()]
        open_blocks.clear()
        return out

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_blocks: dict = {}
        for batch in batches:
            for key, group in batch.groupby(names, sort=False):
                values = np.stack(group["row"].to_numpy())
                mean = values.mean(axis=0)
                centred = values - mean
                block = (len(values), mean, centred.T @ centred)
                open_blocks[key] = merge_moments(open_blocks.get(key), block)
            if len(open_blocks) > OPEN_BLOCKS:
                yield flush(open_blocks)
        if open_blocks:
            yield flush(open_blocks)

    fields = ", ".join(f"{frame.schema[k].name} {frame.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{fields}, segment int, n long, mean array<double>, cross array<double>"
    return rows.mapInPandas(accumulate, schema)


def solve(moments, alphas: Sequence[float], width: int):
    """Raw-scale weights ``(alpha, horizon, feature)`` and intercepts ``(alpha, horizon)``."""
    n, mean, cross = moments
    x_mean, y_mean = mean[:width], mean[width:]
    variance = np.diag(cross)[:width] / n
    constant = variance <= 10 * np.finfo(float).eps * np.maximum(x_mean * x_mean, variance)
    scale = np.where(constant, 1.0, np.sqrt(np.where(constant, 1.0, variance)))
    gram = cross[:width, :width] / np.outer(scale, scale)
    right = cross[:width, width:] / scale[:, None]
    weights, intercepts = [], []
    for alpha in alphas:
        scaled = np.linalg.solve(gram + alpha * np.eye(width), right)
        raw = (scaled / scale[:, None]).T
        weights.append(raw)
        intercepts.append(y_mean - raw @ x_mean)
    return np.array(weights), np.array(intercepts), x_mean, scale


def fit_ridge(
    frame: DataFrame,
    plan: SplitPlan,
    alphas: Sequence[float] = ALPHAS,
    keys: Sequence[str] = SERIES,
    *,
    quality: bool = False,
) -> DataFrame:
    """``keys, fold_no, alpha, train_rows, weights, intercepts, x_mean, x_scale``.

    ``fold_no`` 0 is the final model, trained on everything before the test period's purge.
    ``weights`` holds 24 rows of feature weights one after another.
    """
    width = len(feature_names(quality))
    folds = len(plan.validation)
    alphas = tuple(float(a) for a in alphas)
    blocks = moment_blocks(frame, plan, keys, quality=quality)
    keys = list(keys)

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        size = width + HORIZONS
        segments: dict[int, tuple] = {}
        for row in group.sort_values(["segment", "n"]).itertuples(index=False):
            block = (row.n, np.asarray(row.mean), np.asarray(row.cross).reshape(size, size))
            segments[row.segment] = merge_moments(segments.get(row.segment), block)
        records, running = [], None
        for fold in range(1, folds + 2):
            if fold - 1 in segments:
                running = merge_moments(running, segments[fold - 1])
            if running is None:
                continue
            weights, intercepts, x_mean, scale = solve(running, alphas, width)
            for i, alpha in enumerate(alphas):
                records.append(
                    (
                        *key,
                        fold if fold <= folds else FINAL_FOLD,
                        alpha,
                        running[0],
                        weights[i].ravel(),
                        intercepts[i],
                        x_mean,
                        scale,
                    )
                )
        return pd.DataFrame(records, columns=columns)

    columns = [
        *keys, "fold_no", "alpha", "train_rows", "weights", "intercepts", "x_mean", "x_scale"
    ]
    fields = ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys)
    schema = (
        f"{fields}, fold_no int, alpha double, train_rows long, weights array<double>, "
        "intercepts array<double>, x_mean array<double>, x_scale array<double>"
    )
    return blocks.groupBy(*keys).applyInPandas(fit, schema)


def predict_ridge(
    rows: DataFrame,
    models: DataFrame,
    keys: Sequence[str] = SERIES,
    *,
    quality: bool = False,
    actual: bool = False,
) -> DataFrame:
    """``keys, fold_no, alpha, origin, predicted, predict_ms`` for rows that have a ``fold_no``.

    Rows of one series and fold meet that fold's models in one group, at most a few thousand
    origins; ``predict_ms`` is the time the prediction took per origin. With ``actual`` the targets
    travel along as an array, which saves joining them back to the predictions.
    """
    names = feature_names(quality)
    width = len(names)
    keys = list(keys)
    group = [*keys, "fold_no"]
    kept = [*group, "origin", *(["actual"] if actual else [])]
    targets = [F.col("targets").alias("actual")] if actual else []
    wanted = rows.select(*group, "origin", *targets, F.array(*names).alias("x"))
    fitted = models.select(*group, "alpha", "weights", "intercepts")
    columns = [*kept, "alpha", "predicted", "predict_ms"]

    def predict(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        x = np.stack(left["x"].to_numpy())
        parts = []
        for model in right.itertuples(index=False):
            started = time.perf_counter()
            weights = np.asarray(model.weights).reshape(HORIZONS, width)
            values = x @ weights.T + np.asarray(model.intercepts)
            spent = (time.perf_counter() - started) * 1000 / len(x)
            part = left[kept].copy()
            part["alpha"] = model.alpha
            part["predicted"] = list(values)
            part["predict_ms"] = spent
            parts.append(part[columns])
        return pd.concat(parts)

    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    truth = "actual array<double>, " if actual else ""
    schema = (
        f"{fields}, fold_no int, origin timestamp_ntz, {truth}alpha double, "
        "predicted array<double>, predict_ms double"
    )
    return (
        wanted.groupBy(*group)
        .cogroup(fitted.groupBy(*group))
        .applyInPandas(predict, schema)
    )


def scaled_features(
    frame: DataFrame, plan: SplitPlan, keys: Sequence[str] = SERIES, *, quality: bool = False
) -> DataFrame:
    """Features of every origin scaled by the training part of each fold it belongs to."""
    names = feature_names(quality)
    membership = fold_membership(frame, plan, keys)
    training = frame.join(membership.where("part = 'train'"), [*keys, "origin"])
    moments = training.groupBy(*keys, "fold_no").agg(
        *(F.avg(n).alias(f"{n}__mean") for n in names),
        *(F.stddev_pop(n).alias(f"{n}__std") for n in names),
    )

    def scaled(name: str):
        mean, std = F.col(f"{name}__mean"), F.col(f"{name}__std")
        return ((F.col(name) - mean) / F.when(std > F.abs(mean) * 1e-12, std).otherwise(1.0)).alias(name)

    return (
        membership.join(frame.select(*keys, "origin", *names), [*keys, "origin"])
        .join(moments, [*keys, "fold_no"])
        .select(*keys, "fold_no", "part", "origin", *(scaled(n) for n in names))
    )


def validation_rows(frame: DataFrame, plan: SplitPlan) -> DataFrame:
    return frame.withColumn("fold_no", validation_fold(plan)).where(F.col("fold_no").isNotNull())
