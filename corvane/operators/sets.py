"""Set operations on keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import first_per_key


def dead(configured: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Configured keys that nothing uses."""
    return configured.select(*keys).distinct().join(used.select(*keys).distinct(), list(keys), "left_anti")


def union_first(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows of the parts, missing columns null; of equal keys the first, earlier parts before later ones."""
    marked = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)
    return first_per_key(rows, keys, ["_part", *order]).drop("_part")


def touches(values: Column, wanted: Sequence[str]) -> Column:
    """Is any value among the wanted ones? Null is no value."""
    return F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, wanted))), F.lit(False))


def covers(values: Column, required: Sequence[str]) -> Column:
    """Are all required ones among the values?"""
    return F.size(F.array_except(F.array(*map(F.lit, required)), F.coalesce(values, F.array().cast("array<string>")))) == 0


def drift(rows: DataFrame, column: str, expected) -> DataFrame:
    """Distinct values other than the expected one and null."""
    return rows.where(F.col(column) != F.lit(expected)).select(column).distinct()
