"""Cross-validation of all algorithms, selection, and the held-out test."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterspark.operators import metrics as M
from meterspark.operators.ridge import (
    ALPHAS,
    FINAL_FOLD,
    fit_ridge,
    predict_ridge,
    validation_rows,
)
from meterspark.operators.splits import (
    SplitPlan,
    empty_folds,
    final_test,
    final_training,
    fold_bounds,
    fold_membership,
    instant,
)
from meterspark.operators.trees import fit_trees, predict_trees
from meterspark.schemas import SEASONAL_PERIODS

SERIES = ("series_id",)
NAIVE = {f"seasonal_naive_{p}": f"naive_{p}" for p in SEASONAL_PERIODS}
TREES = ("random_forest", "hist_gradient_boosting")
SCOPE_CV = "cv"
SCOPE_TEST = "final_test"


@dataclass
class Experiment:
    """Result tables of one experiment per series."""

    model_runs: DataFrame
    fold_metrics: DataFrame
    horizon_metrics: DataFrame
    frames: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for frame in self.frames:
            frame.unpersist()


def naive_scored(
    rows: DataFrame, keep: Sequence[str], algorithms: Sequence[str] = tuple(NAIVE)
) -> DataFrame:
    """Long actual and predicted values of the seasonal baselines on the given origins.

    Baseline values were looked up in the same pass as the features, so both baselines and every
    other model score the same origins without a join.
    """
    lookups = F.array(
        *(
            F.struct(F.lit(a).alias("algorithm"), F.col(NAIVE[a]).alias("lookup"))
            for a in algorithms
        )
    )
    each = rows.select(*keep, "targets", F.inline(lookups))
    return M.pairs(each, "targets", "lookup", [*keep, "algorithm"])


def naive_missing_history(
    rows: DataFrame, period: int, step: int, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Origins and horizons whose seasonal source value is absent, with its time."""
    values = F.posexplode(f"naive_{period}").alias("place", "value")
    offset = (F.col("place") + 1 - period) * step
    return (
        rows.select(*keys, "origin", values)
        .where(F.col("value").isNull())
        .select(
            *keys,
            "origin",
            (F.col("place") + 1).cast("long").alias("horizon"),
            (F.col("origin") + F.make_dt_interval(secs=offset)).cast("timestamp_ntz").alias(
                "source_time"
            ),
        )
    )


def ridge_scored(
    frame: DataFrame,
    plan: SplitPlan,
    alphas: Sequence[float] = ALPHAS,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Validation predictions of every penalty: long rows with ``params`` and ``predict_ms``."""
    models = fit_ridge(frame, plan, alphas, keys)
    predicted = predict_ridge(validation_rows(frame, plan), models, keys, actual=True)
    keep = [*keys, "fold_no", "origin", "alpha", "predict_ms"]
    return M.pairs(predicted, "actual", "predicted", keep).withColumn(
        "params", F.to_json(F.struct("alpha"))
    )


def run_experiment(
    frame: DataFrame,
    plan: SplitPlan,
    algorithms: Sequence[str] = (*NAIVE, "ridge"),
    *,
    keys: Sequence[str] = SERIES,
    alphas: Sequence[float] = ALPHAS,
    tree_candidates: Mapping[str, Sequence[Mapping[str, Any]]] | None = None,
    is_failed: Sequence[str] = (),
) -> Experiment:
    """Cross-validate, select one model per series, then score only that one on the test period.

    ``frame`` holds eligible supervised rows with both naive arrays. It is read once per model
    family, so it is persisted (on disk where memory is short; a lost part is recomputed).
    ``is_failed`` names algorithms to record as failed without running them. An algorithm that raises
    is recorded as failed with the reason and the others go on; a series with an empty fold fails with
    all of them. Only where every algorithm raised, the experiment raises.
    """
    unknown = [a for a in algorithms if a not in NAIVE and a not in TREES and a != "ridge"]
    if unknown:
        raise ValueError(f"unknown algorithm: {unknown[0]}")
    frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
    by = [*keys, "algorithm"]
    unfit = unfit_series(frame, plan, keys).persist(StorageLevel.MEMORY_AND_DISK)  # one row a series
    fold_parts, horizon_parts, summaries, tests = [], [], [], []
    failures = dict.fromkeys(is_failed, "not run")
    held = [frame, unfit]
    for algorithm in algorithms:
        if algorithm in failures:
            continue
        try:
            scored = _validation_scores(frame, plan, algorithm, keys, alphas, tree_candidates or {})
            per_fold = M.error_metrics(
                scored, [*by, "params", "fold_no"], by, predict_ms=F.max("predict_ms")
            )
            complete = per_fold.groupBy(*by, "params").agg(F.count(F.lit(1)).alias("folds")).where(
                F.col("folds") == len(plan.validation)
            )
            per_fold = per_fold.join(complete.drop("folds"), [*by, "params"], "left_semi")
            per_fold = per_fold.join(unfit, list(keys), "left_anti")
            # One row per series, parameters and fold is left; later steps read it many times.
            per_fold = per_fold.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(per_fold)
            per_fold.count()  # what this algorithm raises is raised here
        except Exception as error:
            failures[algorithm] = _reason(error)
            continue
        best = M.best_candidate(M.cv_summary(per_fold, [*by, "params"]), by)
        chosen = best.select(*by, "params")
        summaries.append(best)
        fold_parts.append(per_fold.join(chosen, [*by, "params"], "left_semi"))
        horizon_parts.append(
            M.horizon_metrics(scored.join(chosen, [*by, "params"], "left_semi"), by).withColumn(
                "evaluation_scope", F.lit(SCOPE_CV)
            )
        )
    if not summaries:
        for part in held:
            part.unpersist()
        raise RuntimeError(f"all configured model runs failed: {failures}")
    runs = M.select_recommended(reduce(DataFrame.unionByName, summaries), keys)
    runs = runs.persist(StorageLevel.MEMORY_AND_DISK)
    runs.count()  # selection is settled before any test row is touched
    chosen = runs.where("is_recommended").select(*by, "params")
    for algorithm in algorithms:
        if algorithm not in failures:
            tests.append(_test_scores(frame, plan, algorithm, chosen, keys, alphas))
    scored = reduce(DataFrame.unionByName, tests)
    final = M.error_metrics(scored, by).select(
        *by,
        F.col("mae").alias("final_mae"),
        F.col("rmse").alias("final_rmse"),
        F.col("smape").alias("final_smape"),
    )
    test_horizons = M.horizon_metrics(scored, by).withColumn(
        "evaluation_scope", F.lit(SCOPE_TEST)
    )
    planned = frame.select(*keys).distinct().select(
        *keys, F.explode(F.array(*(F.lit(a) for a in algorithms))).alias("algorithm")
    )
    reasons = F.create_map(*(F.lit(x) for pair in failures.items() for x in pair)).cast("map<string,string>")
    detail = F.coalesce(reasons[F.col("algorithm")], F.col("unfit"), F.lit("a fold has no prediction"))
    model_runs = (
        planned.join(runs, by, "left")
        .join(final, by, "left")
        .join(unfit, list(keys), "left")
        .withColumn("is_recommended", F.coalesce("is_recommended", F.lit(False)))
        .withColumn("status", F.when(F.col("params").isNull(), "failed").otherwise("completed"))
        .withColumn(
            "failure_code", F.when(F.col("params").isNull(), "model_evaluation_failed")
        )
        .withColumn("failure_detail", F.when(F.col("params").isNull(), detail))
        .drop("unfit")
    )
    return Experiment(
        model_runs,
        reduce(DataFrame.unionByName, fold_parts),
        reduce(DataFrame.unionByName, horizon_parts).unionByName(test_horizons),
        [*held, runs],
    )


def unfit_series(frame: DataFrame, plan: SplitPlan, keys: Sequence[str] = SERIES) -> DataFrame:
    """``keys, unfit``: series with a fold that has no training or no validation origins, and the first such fold."""
    empty = empty_folds(fold_bounds(fold_membership(frame.select(*keys, "origin"), plan, keys), plan, keys))
    first = empty.groupBy(*keys).agg(F.min("fold_no").alias("fold_no"))
    return first.select(*keys, F.format_string("fold %d has no training or validation origins", "fold_no").alias("unfit"))


def _reason(error: Exception) -> str:
    """First line of an error's message, or its kind."""
    lines = str(error).strip().splitlines()
    return lines[0] if lines else type(error).__name__


def _validation_scores(
    frame: DataFrame,
    plan: SplitPlan,
    algorithm: str,
    keys: Sequence[str],
    alphas: Sequence[float],
    tree_candidates: Mapping[str, Sequence[Mapping[str, Any]]],
) -> DataFrame:
    keep = [*keys, "fold_no", "origin"]
    if algorithm in NAIVE:
        scored = naive_scored(validation_rows(frame, plan), keep, [algorithm])
        return scored.withColumn("params", F.lit("{}")).withColumn("predict_ms", F.lit(0.0))
    if algorithm == "ridge":
        scored = ridge_scored(frame, plan, alphas, keys)
        return scored.drop("alpha").withColumn("algorithm", F.lit(algorithm))
    if algorithm not in TREES:
        raise ValueError(f"unknown algorithm: {algorithm}")
    parts = []
    for params in tree_candidates.get(algorithm, ({},)):
        for fold_no, (start, end) in enumerate(plan.validation, 1):
            training = frame.where(F.col("origin") < instant(start - plan.purge))
            rows = frame.where(
                (F.col("origin") >= instant(start)) & (F.col("origin") < instant(end))
            ).withColumn("fold_no", F.lit(fold_no))
            models = fit_trees(training, algorithm, params)
            wanted = [*keep, "targets"]
            predicted = predict_trees(rows, models, wanted).persist(StorageLevel.MEMORY_AND_DISK)
            started = time.perf_counter()
            count = max(1, predicted.count())
            spent = (time.perf_counter() - started) * 1000 / count
            parts.append(
                M.pairs(predicted, "targets", "predicted", keep)
                .withColumn("params", F.to_json(_params(params), {"ignoreNullFields": "false"}))
                .withColumn("predict_ms", F.lit(spent))
            )
    return reduce(DataFrame.unionByName, parts).withColumn("algorithm", F.lit(algorithm))


def _test_scores(
    frame: DataFrame,
    plan: SplitPlan,
    algorithm: str,
    chosen: DataFrame,
    keys: Sequence[str],
    alphas: Sequence[float],
) -> DataFrame:
    """Test-period errors of the series for which this algorithm was recommended."""
    mine = chosen.where(F.col("algorithm") == algorithm).select(*keys, "params")
    own = frame.join(mine, list(keys))
    rows = final_test(own, plan)
    keep = [*keys, "origin"]
    if algorithm in NAIVE:
        return naive_scored(rows, keep, [algorithm])
    if algorithm == "ridge":
        models = fit_ridge(own, plan, alphas, keys).where(F.col("fold_no") == FINAL_FOLD)
        picked = models.join(mine, list(keys)).where(
            F.get_json_object("params", "$.alpha").cast("double") == F.col("alpha")
        )
        joined = predict_ridge(
            rows.withColumn("fold_no", F.lit(FINAL_FOLD)), picked, keys, actual=True
        )
        scored = M.pairs(joined, "actual", "predicted", keep)
        return scored.withColumn("algorithm", F.lit(algorithm))
    else:
        # One global model per parameter set in use; the sets come from a short candidate list.
        parts = []
        for row in mine.select("params").distinct().collect():
            params = _read_params(row.params)
            models = fit_trees(final_training(frame, plan), algorithm, params)
            parts.append(
                predict_trees(
                    rows.where(F.col("params") == row.params), models, [*keep, "targets"]
                )
            )
        if not parts:
            parts = [rows.select(*keep, "targets", F.array().cast("array<double>").alias("predicted")).limit(0)]
        joined = reduce(DataFrame.unionByName, parts)
    scored = M.pairs(joined, "targets", "predicted", keep)
    return scored.withColumn("algorithm", F.lit(algorithm))


def _params(params: Mapping[str, Any]):
    if not params:
        return F.create_map().cast("map<string,string>")
    # A null is a choice of its own (no limit), so it is written and read back as null.
    values = {k: F.lit(None).cast("string") if v is None else F.lit(v) for k, v in params.items()}
    return F.struct(*(values[name].alias(name) for name in sorted(params)))


def _read_params(text: str) -> dict[str, Any]:
    import json

    return json.loads(text)
