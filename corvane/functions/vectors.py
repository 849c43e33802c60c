"""Columns over arrays of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def rms(frame: Column) -> Column:
    return F.sqrt(F.try_divide(dot(frame, frame), F.size(frame)))


def peak(frame: Column) -> Column:
    return F.array_max(F.transform(frame, lambda x: F.abs(x.cast("double"))))


def crest_db(frame: Column) -> Column:
    """Peak over RMS in decibels; null for silence."""
    return F.when((peak(frame) > 0) & (rms(frame) > 0), 20 * F.log10(peak(frame) / rms(frame)))


def mixture_rms(rows: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """keys, mixture_rms: the RMS of the sum of a group's frames, place by place; a frame that is shorter adds nothing beyond its end.
    Sums are made before frames meet, so a large group is no large row."""
    places = rows.select(*keys, F.posexplode(frame).alias("_at", "_x")).groupBy(*keys, "_at").agg(F.sum(F.col("_x").cast("double")).alias("_s"))
    return places.groupBy(*keys).agg(F.sqrt(F.avg(F.col("_s") * F.col("_s"))).alias("mixture_rms"))


def source_levels(rows: DataFrame, keys: Sequence[str], frame: str, least: float, least_ratio: float) -> DataFrame:
    """rows with rms, rms_ratio to their group's mixture (of at least ``least``) and active: loud enough by itself and in the mixture."""
    joined = rows.join(mixture_rms(rows, keys, frame), list(keys), "left").withColumn("rms", rms(F.col(frame)))
    ratio = F.col("rms") / F.greatest("mixture_rms", F.lit(least))
    return joined.withColumn("rms_ratio", ratio).withColumn("active", (F.col("rms") >= least) & (F.col("rms_ratio") >= least_ratio)).drop("mixture_rms")
