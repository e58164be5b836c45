"""Direct tree ensembles: one Spark ML regressor per horizon.

Intent equals the published configurations, numbers do not: splits are binned, growth is by depth
rather than by leaves, and there is no L2 term on leaves. One model is trained over all rows given;
filter to one series for a model of its own.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterspark.operators.features import target_columns
from meterspark.schemas import HORIZONS, feature_names, target_names

# Default parameters and search spaces.
SEED = 42
FOREST_DEFAULTS = {
    "n_estimators": 300,
    "max_depth": 12,
    "min_samples_leaf": 1,
    "max_features": "sqrt",
    "max_samples": None,
}
FOREST_SPACE = {
    "n_estimators": (300, 600),
    "max_depth": (12, 24, None),
    "min_samples_leaf": (1, 3, 6),
    "max_features": ("sqrt", 0.7),
    "max_samples": (None, 0.8),
}
BOOSTING_DEFAULTS = {
    "learning_rate": 0.05,
    "max_iter": 200,
    "max_leaf_nodes": 31,
    "min_samples_leaf": 20,
}
BOOSTING_SPACE = {
    "learning_rate": (0.03, 0.05, 0.1),
    "max_iter": (200, 400),
    "max_leaf_nodes": (15, 31, 63),
    "min_samples_leaf": (20, 50, 100),
}
DEEPEST = 30
MAX_CANDIDATES = 20


def search_candidates(space: Mapping[str, Sequence[Any]], limit: int = 1) -> list[dict[str, Any]]:
    """Up to ``limit`` distinct parameter sets, drawn with a fixed seed."""
    if not 1 <= limit <= MAX_CANDIDATES:
        raise ValueError(f"limit must be between 1 and {MAX_CANDIDATES}")
    sizes = [len(values) for values in space.values()]
    total = math.prod(sizes)
    chosen = random.Random(SEED).sample(range(total), min(limit, total))
    candidates = []
    for number in chosen:
        candidate = {}
        for name, values in space.items():
            number, place = divmod(number, len(values))
            candidate[name] = values[place]
        candidates.append(candidate)
    return candidates


def regressor(algorithm: str, params: Mapping[str, Any], seed: int = SEED):
    """An unfitted Spark ML regressor for one horizon."""
    if algorithm == "random_forest":
        p = {**FOREST_DEFAULTS, **params}
        features = p["max_features"]
        return RandomForestRegressor(
            numTrees=p["n_estimators"],
            maxDepth=min(p["max_depth"] or DEEPEST, DEEPEST),
            minInstancesPerNode=p["min_samples_leaf"],
            featureSubsetStrategy=features if isinstance(features, str) else str(features),
            subsamplingRate=p["max_samples"] or 1.0,
            bootstrap=True,
            seed=seed,
        )
    if algorithm == "hist_gradient_boosting":
        p = {**BOOSTING_DEFAULTS, **params}
        return GBTRegressor(
            stepSize=p["learning_rate"],
            maxIter=p["max_iter"],
            maxDepth=math.ceil(math.log2(p["max_leaf_nodes"])),
            minInstancesPerNode=p["min_samples_leaf"],
            lossType="squared",
            seed=seed,
        )
    raise ValueError(f"not a tree algorithm: {algorithm}")


def _assembled(frame: DataFrame, quality: bool) -> DataFrame:
    assembler = VectorAssembler(inputCols=list(feature_names(quality)), outputCol="features")
    return assembler.transform(frame)


def fit_trees(
    training: DataFrame,
    algorithm: str,
    params: Mapping[str, Any] | None = None,
    *,
    quality: bool = False,
    parallel_fits: int = 8,
) -> list:
    """24 fitted models in horizon order; ``training`` should be persisted by the caller.

    The driver only submits the fits; a few run at once so that small stages overlap.
    """
    rows = _assembled(training, quality).select("features", *target_columns())

    def fit(name: str):
        model = regressor(algorithm, params or {})
        return model.setLabelCol(name).setPredictionCol(f"p_{name}").fit(rows)

    with ThreadPoolExecutor(parallel_fits) as pool:
        return list(pool.map(fit, target_names()))


def predict_trees(
    rows: DataFrame, models: Sequence, keep: Sequence[str], *, quality: bool = False
) -> DataFrame:
    """``keep`` columns and the array ``predicted`` of 24 values."""
    if len(models) != HORIZONS:
        raise ValueError("one fitted model per horizon is required")
    scored = _assembled(rows, quality)
    for model in models:
        scored = model.transform(scored)
    return scored.select(
        *keep, F.array(*(f"p_{name}" for name in target_names())).alias("predicted")
    )
