"""Connected components on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, root for every node of edges (a, b) but the roots themselves; root is the least node of its component.

    Rounds of large and small stars: each hooks a node's neighbours to the least of them, so edges never grow in number and stars
    remain after a few rounds, whatever the shape. A node of many edges is pre-aggregated, and its join is one that Spark splits.
    Every round is written to the shared folder. No edges: no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), shared_dir(edges.sparkSession))
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(lowest.select("hi", F.col("m").alias("lo"))).distinct()
        now = written(small, shared_dir(edges.sparkSession))
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)
