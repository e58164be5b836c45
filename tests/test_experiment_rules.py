"""Parameters of an experiment survive their round trip."""

import json

import pytest
from pyspark.sql import functions as F

from meterspark.operators.experiment import _params, _read_params


@pytest.mark.parametrize(
    "params", [{"max_depth": None, "n_estimators": 7}, {"max_samples": None}, {"rate": 0.5, "max_features": "sqrt"}]
)
def test_parameters_with_null_come_back(spark, params):
    text = spark.range(1).select(F.to_json(_params(params), {"ignoreNullFields": "false"}).alias("j")).first().j
    assert _read_params(text) == params


def test_hyperparameters_of_any_kind_stay_in_json(spark):
    given = {"max_features": "sqrt", "n_estimators": 300, "max_depth": None}
    frame = spark.createDataFrame([(json.dumps(given),)], "h string")
    text = frame.select(F.to_json(F.struct(F.parse_json("h").alias("h")), {"ignoreNullFields": "false"}).alias("j")).first().j
    assert json.loads(text)["h"] == given
