"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UTC_CONF = "spark.sql.session.timeZone"
# The JVM never compiles a method over 8,000 bytes, so a larger generated stage would run
# interpreted; Spark then evaluates its projections in small methods instead.
METHOD_CONF = "spark.sql.codegen.hugeMethodLimit"
METHOD_LIMIT = "8000"


def build_session(app: str = "meterspark", *, master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator expects (UTC, adaptive execution).

    Nothing here is sized for one machine: shuffle partition counts, memory and split sizes
    come from the cluster unless passed in ``conf`` (dots written as double underscores).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        UTC_CONF: "UTC",
        METHOD_CONF: METHOD_LIMIT,
        # Do not record a Python call site for every column expression while plans are built.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Room for the generated classes of several wide plans; the default holds 100.
        "spark.sql.codegen.cache.maxEntries": "1000",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Set what a session built elsewhere needs: UTC, and stages the JVM can compile.

    Timestamps are zone-less UTC instants; casts between the two types must agree on that.
    """
    for name, value in ((UTC_CONF, "UTC"), (METHOD_CONF, METHOD_LIMIT)):
        if spark.conf.get(name) != value:
            spark.conf.set(name, value)
    return spark


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a fresh one only on a single machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fresh = tempfile.mkdtemp(prefix="meterspark-ckpt-")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """A path not used before, below the folder every executor can reach."""
    return f"{shared_checkpoint_dir(spark)}/meterspark-{kind}-{uuid.uuid4()}"


def staged(df: DataFrame, kind: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: computed once, and its size is known to Spark."""
    path = scratch_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """One task per core for a scan with fewer splits than cores; larger scans stay as they are.

    For work that is heavy per row on a small file. It reads no data to decide.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    # The filter is always true; it keeps later filters from moving in front of the exchange, back
    # into the few tasks of the scan.
    place = df.repartition(cores).withColumn("_place", F.monotonically_increasing_id())
    return place.where("_place >= 0").drop("_place")
