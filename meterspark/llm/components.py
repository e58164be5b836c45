"""Connected components of an edge table by label passing with pointer jumping, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterspark.llm.frames import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b); label is the smallest vertex of its component.

    Each round takes the smallest label among a vertex's neighbours (a partial aggregation, so a vertex
    with very many edges is no single task's work), then replaces labels by their label's label. A
    round's table is written to the shared folder.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("v"), F.least("a", "low").alias("label")), "labels")
    while True:
        seen = both.join(labels.withColumnsRenamed({"v": "b", "label": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(seen.withColumnRenamed("a", "v"), "v").select("v", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("further"))
        step = staged(
            lower.join(jump, "next", "left").select("v", "label", F.least("next", F.coalesce("further", "next")).alias("next")), "labels"
        )
        labels = step.select("v", F.col("next").alias("label"))
        if step.where("label <> next").isEmpty():
            return labels


def extend_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (v, label) once ``edges`` (a, b) join some of the components ``labels``.

    Only edges between components matter, so label passing runs over these alone; it needs fewer
    rounds than over all edges, as a component counts as one vertex. A vertex missing in ``labels``
    is its own component.
    """
    near, far = (labels.select(F.col("v").alias(end), F.col("label").alias(f"of_{end}")) for end in ("a", "b"))
    ends = edges.join(near, "a", "left").join(far, "b", "left")
    between = ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b")
    merged = connected_components(between)
    known = labels.unionByName(merged.select("v", F.col("v").alias("label"))).distinct()
    lower = merged.select(F.col("v").alias("label"), F.col("label").alias("low"))
    return staged(known.join(lower, "label", "left").select("v", F.coalesce("low", "label").alias("label")), "labels")
