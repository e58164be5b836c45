"""Window work on long series, split by time.

A window partitioned by series alone puts a whole series in one task. Everything that looks a
bounded distance back or ahead is instead partitioned by ``(series, chunk)`` where a chunk is a
fixed span of time (or of row numbers), and rows near an edge are copied into the neighbouring
chunk first. What looks an unbounded distance back uses one small row per chunk: the last value
of each chunk, carried to the next non-empty chunk of the series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterspark.functions.clock import floor_div

CHUNK = "chunk"
OWN = "own_row"


def with_halo(df: DataFrame, position: Column, size: int, *, back: int, ahead: int) -> DataFrame:
    """Copy each row into its chunk and into a neighbour chunk that must see it.

    ``position`` is a long on the scale of ``size``; a chunk sees ``back`` positions before its
    start and ``ahead`` positions after its end. The copies are made before any shuffle.
    """
    if max(back, ahead) > size:
        raise ValueError("a chunk must be at least as long as its halo")
    home = floor_div(position, size)
    offset = position - home * F.lit(size)
    late = (offset >= size - back) if back else F.lit(False)
    early = (offset < ahead) if ahead else F.lit(False)

    def copies(*places: int) -> Column:
        return F.array(*(F.lit(p).cast("long") for p in places))

    # Constant arrays: nearly every row takes the last branch and is emitted once.
    places = (
        F.when(late & early, copies(0, 1, -1))
        .when(late, copies(0, 1))
        .when(early, copies(0, -1))
        .otherwise(copies(0))
    )
    return (
        df.select("*", home.alias(CHUNK), F.explode(places).alias("_place"))
        .withColumn(CHUNK, F.col(CHUNK) + F.col("_place"))
        .withColumn(OWN, F.col("_place") == 0)
        .drop("_place")
    )


def edge_pairs(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str] = ()
) -> DataFrame:
    """Last row of each chunk paired with the first row of the next non-empty chunk.

    Returns ``keys, prev_<order>, <order>`` plus ``prev_<v>, <v>`` for the named values. The
    aggregation leaves one row per chunk, so the window over chunks is small.
    """
    columns = [order, *values]
    edges = df.groupBy(*keys, CHUNK).agg(
        *(F.min_by(c, order).alias(f"first_{c}") for c in values),
        *(F.max_by(c, order).alias(f"last_{c}") for c in values),
        F.min(order).alias(f"first_{order}"),
        F.max(order).alias(f"last_{order}"),
    )
    by_chunk = Window.partitionBy(*keys).orderBy(CHUNK)
    return (
        edges.select(
            *keys,
            *(F.lag(f"last_{c}").over(by_chunk).alias(f"prev_{c}") for c in columns),
            *(F.col(f"first_{c}").alias(c) for c in columns),
        )
        .where(F.col(f"prev_{order}").isNotNull())
    )


def consecutive_pairs(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str] = ()
) -> DataFrame:
    """Every row of a series paired with the row before it, chunk by chunk.

    ``df`` has a ``chunk`` column that grows with ``order``. Output as :func:`edge_pairs`.
    """
    columns = [order, *values]
    inside = Window.partitionBy(*keys, CHUNK).orderBy(order)
    within = df.select(
        *keys,
        *(F.lag(c).over(inside).alias(f"prev_{c}") for c in columns),
        *columns,
    ).where(F.col(f"prev_{order}").isNotNull())
    return within.unionByName(edge_pairs(df, keys, order, values))
