"""Observed values held against the distributions that they should come from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist as D
from .rank import counts_below, share_within


def goodness_of_fit(rows: DataFrame, keys: Sequence[str], value: str, model: DataFrame, clip: str | None = None, bins: int = 10) -> DataFrame:
    """keys, n, distinct_values, out_of_support, unresolved, unique_clips (if clip is named), cdf_distance, occupied_bins, total_bins,
    coverage of a continuous prior (one component row of a closed family, under any name).

    Null values are unresolved and count in n only. The distance is the largest between the observed and the model's distribution
    function, on both sides of each step; bins are of equal probability. Groups without values have a null distance.
    """
    model = model.select(*[F.col(c).alias(f"_{c}") for c in ("family", "scale", "low", "high", "exponent", "edges", "bin_weights")])
    below = counts_below(rows, value, keys).crossJoin(F.broadcast(model))
    below = below.withColumn("_f", D.closed_cdf(F.col(value).cast("double"), lambda c: F.col(f"_{c}"))).withColumn("_in", F.col(value).between(F.col("_low"), F.col("_high")))
    step = F.greatest((F.col("below") + F.col("n")) / F.col("total") - F.col("_f"), F.col("_f") - F.col("below") / F.col("total"))
    found = below.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum(F.when(F.col("_in"), 0).otherwise(F.col("n"))).alias("out_of_support"), F.max(step).alias("cdf_distance"),
        F.size(F.collect_set(F.when(F.col("_in"), F.least(F.floor(F.col("_f") * bins), F.lit(bins - 1))))).alias("occupied_bins"),
    )
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("unresolved"))
    if clip:
        totals = totals.join(rows.select(*keys, clip).distinct().groupBy(*keys).agg(F.count(clip).alias("unique_clips")), list(keys))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    occupied = F.coalesce("occupied_bins", F.lit(0))
    return totals.join(found, list(keys), "left").select(
        *keys, "n", zero("distinct_values"), zero("out_of_support"), "unresolved", *(["unique_clips"] if clip else []), "cdf_distance",
        zero("occupied_bins"), F.lit(bins).cast("long").alias("total_bins"), (occupied / bins).alias("coverage"),
    )


def total_variation(rows: DataFrame, keys: Sequence[str], value: str, expected: DataFrame, p: str = "p") -> DataFrame:
    """keys, total_variation: half the summed difference between a group's shares and a discrete prior (value, p), what lies outside
    the prior included. The prior is configuration."""
    shares = share_within(rows, [*keys, value], keys)
    due = rows.select(*keys).distinct().crossJoin(F.broadcast(expected.select(value, F.col(p).alias("_p"))))
    both = shares.join(due, [*keys, value], "full_outer")
    return both.groupBy(*keys).agg((F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("_p", F.lit(0.0)))) / 2).alias("total_variation"))
