"""Small DataFrame helpers of the text operators: shared folder, staged tables, kept columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UNSET = "spark.checkpoint.dir is unset; name a folder that the driver and all executors share"


def shared_folder(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as the session names it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError(_UNSET)
        folder = f"file://{tempfile.mkdtemp(prefix='meterspark-')}"  # one machine, as in tests
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: cut lineage, and a size Spark knows.

    With a known size Spark itself broadcasts the table only where it is below its own threshold.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but the ``used`` ones under names no operator has, and how to get the old ones back.

    So extra columns may be named like an operator's own or its results and still pass through.
    """
    names = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c not in used}
    inner = docs.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns))
    return inner, [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def keep_columns(docs: DataFrame, text: str, results: list[str]) -> tuple[DataFrame, list[str]]:
    """``docs`` with its text also as ``__text``, and the columns that pass through beside results."""
    passed = [c for c in docs.columns if c not in results and c != "__text"]
    return docs.select(*passed, F.col(text).alias("__text")), passed
