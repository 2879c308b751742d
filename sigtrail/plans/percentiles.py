"""Exact interpolated percentiles of integers without gathering a group.

Equal values are counted first.  A block of ``2**BLOCK_BITS`` neighbouring
values then has at most that many rows, whatever the group's size, so ranks are
running counts inside blocks on top of the blocks before them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 20


def exact_percentiles(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float], weight: str | None = None
) -> DataFrame:
    """``keys`` plus one column per point (0..1), linearly interpolated between ranks.

    ``value`` holds integers; with ``weight`` a row stands for that many values.
    """
    counted = df if weight else df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    if weight:
        counted = counted.withColumnRenamed(weight, "_n")
    placed = counted.select(*keys, F.col(value).alias("_v"), "_n").withColumn(
        "_block", F.shiftright(F.col("_v").cast("long"), BLOCK_BITS)
    )
    blocks = placed.groupBy(*keys, "_block").agg(F.sum("_n").alias("_in_block"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select(
        *keys,
        "_block",
        F.coalesce(F.sum("_in_block").over(before), F.lit(0)).alias("_base"),
        F.sum("_in_block").over(by_key).alias("_total"),
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = placed.join(bases, [*keys, "_block"]).withColumn(
        "_upto", F.col("_base") + F.sum("_n").over(inside)
    )
    out = []
    for name, p in points.items():
        rank = F.lit(p) * (F.col("_total") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(rank), F.col("_v")))
        high = F.min(F.when(F.col("_upto") > F.ceil(rank), F.col("_v")))
        share = F.max(rank - F.floor(rank))
        out.append((low + (high - low) * share).cast("double").alias(name))
    return ranked.groupBy(*keys).agg(*out)
