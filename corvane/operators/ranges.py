"""Work in order over groups of any size: rows are dealt to ranges of their order, each range is worked on alone, and what passes from one
range of a group to the next is carried over by a small table.

Ranges are cut by (groups, order), so at most one group spans the border of two neighbouring ranges. The pairs of such a group and a
range are therefore at most two for each range: their table is bounded by the number of partitions, whatever the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.writers import scratch

RANGE = "_range"


def dealt(rows: DataFrame, groups: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """rows with their range: as many of about equal size as a shuffle has partitions, or as asked for. Rows that are equal in groups
    and order share one. Written, so that everything that reads them sees the same borders."""
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark)
    rows.repartitionByRange(n, *groups, *order).withColumn(RANGE, F.spark_partition_id()).write.parquet(path)
    return spark.read.parquet(path)


def carried(parts: DataFrame, groups: Sequence[str], **columns: Column) -> DataFrame:
    """groups, range and columns (window expressions over ``across``) of the groups that lie in several ranges. parts has a row for each
    group and range; a group in one range has nothing to carry, and none of its rows is here."""
    return parts.withColumn("_ranges", F.count(F.lit(1)).over(Window.partitionBy(*groups))).where("_ranges > 1").select(*groups, RANGE, *[c.alias(n) for n, c in columns.items()])


def across(groups: Sequence[str], forward: bool = True):
    """The ranges of a group in order (or from the last on)."""
    return Window.partitionBy(*groups).orderBy(F.col(RANGE) if forward else F.desc(RANGE))


def within(groups: Sequence[str]):
    """The rows of a group in one range."""
    return Window.partitionBy(*groups, RANGE)


def with_carried(rows: DataFrame, table: DataFrame, groups: Sequence[str]) -> DataFrame:
    """rows joined with what is carried to their group and range, null if nothing is. table has two rows for each range at most, so it
    is broadcast; null groups are groups."""
    names = {c: f"_c_{c}" for c in (*groups, RANGE)}
    small = table.select(*[F.col(c).alias(n) for c, n in names.items()], *[c for c in table.columns if c not in names])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return rows.join(F.broadcast(small), same, "left").drop(*names.values())


BEFORE = (Window.unboundedPreceding, -1)


def prefix_sums(rows: DataFrame, groups: Sequence[str], value: str, sums: Mapping[str, Column], ranges: int | None = None) -> DataFrame:
    """groups, value, and for each name of sums the sum of the value's rows, of those below it in its group (name_below) and of the
    whole group (name_total); a row for each distinct value that isn't null.

    Rows are summed by value first. No task holds a group, no row holds more than one value.
    """
    masses = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    placed = dealt(masses, groups, [value], ranges)
    parts = placed.groupBy(*groups, RANGE).agg(*[F.sum(n).alias(n) for n in sums])
    every = Window.partitionBy(*groups)
    carry = carried(parts, groups, **{f"_{n}_before": F.sum(n).over(across(groups).rowsBetween(*BEFORE)) for n in sums}, **{f"_{n}_all": F.sum(n).over(every) for n in sums})
    inside = within(groups)
    local = placed.withColumns({f"_{n}_own": F.sum(n).over(inside.orderBy(value).rowsBetween(*BEFORE)) for n in sums} | {f"_{n}_range": F.sum(n).over(inside) for n in sums})
    none = lambda n: F.col(n) - F.col(n)  # noqa: E731  zero of the sum's own type
    told = []
    for n in sums:
        below = F.coalesce(F.col(f"_{n}_own"), none(n)) + F.coalesce(F.col(f"_{n}_before"), none(n))
        told += [F.col(n), below.alias(f"{n}_below"), F.coalesce(F.col(f"_{n}_all"), F.col(f"_{n}_range")).alias(f"{n}_total")]
    return with_carried(local, carry, groups).select(*groups, value, *told)


def quantiles(counted: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float], n: str = "n", out: str = "quantiles", **further: Column) -> DataFrame:
    """groups, out: exact quantiles, interpolated between neighbours, of prefix_sums with counts named n; and further aggregates."""
    below, total = F.col(f"{n}_below"), F.col(f"{n}_total")
    found = []
    for p in probabilities:
        at = F.lit(float(p)) * (total - 1)
        holds = lambda k: F.max(F.when((below <= k) & (k < below + F.col(n)), F.col(value).cast("double")))
        low, high = holds(F.floor(at)), holds(F.ceil(at))
        found.append(low + (high - low) * F.max(at - F.floor(at)))
    return counted.groupBy(*groups).agg(F.array(*found).alias(out), *[c.alias(name) for name, c in further.items()])


def first_smallest(rows: DataFrame, n: int, noise: str, *identity: str, border: int = 10_000, digits: int = 12) -> DataFrame:
    """The n rows of the smallest noise (a column of numbers from 0 up to 1; ties by identity), all rows if they are fewer.

    Rounds of counts find the border: each looks at the part of [0, 1) in which the n-th row lies, cut into 2^digits, until at most
    ``border`` rows lie in it. Rows below it are a filter, only the border's rows are put in order. A round brings 2^digits counts
    to the driver.
    """
    if n <= 0:
        return rows.limit(0)
    low, width, taken = 0.0, 1.0, 0
    while True:
        step = width / (1 << digits)
        slot = F.floor((F.col(noise) - low) / step).cast("int")
        part = rows if width == 1.0 else rows.where((F.col(noise) >= low) & (F.col(noise) < low + width))
        counts = sorted(part.where(F.col(noise).isNotNull()).groupBy(slot.alias("k")).agg(F.count(F.lit(1)).alias("c")).collect())
        for k, c in counts:
            if taken + c >= n:
                low, width = low + k * step, step
                break
            taken += c
        else:
            return rows.where(F.col(noise).isNotNull())
        if c <= border or step <= 2.0**-52:
            below = rows.where(F.col(noise) < low)
            here = rows.where((F.col(noise) >= low) & (F.col(noise) < low + width)).orderBy(noise, *identity)
            return below.unionByName(here.limit(n - taken))


def first_in_order(rows: DataFrame, n: int, *order: Column | str, most: int = 10_000) -> DataFrame:
    """The first n rows of an order. Up to ``most`` of them every task keeps its own first n; beyond that rows are dealt to ranges of the
    order, ranges before the n-th row are taken whole and only that row's own range is put in order."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    if n <= most:
        return rows.orderBy(*columns).limit(n)
    spark = rows.sparkSession
    path = scratch(spark)
    rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *columns).withColumn(RANGE, F.spark_partition_id()).write.parquet(path)
    placed, taken = spark.read.parquet(path), 0
    for k, c in sorted(placed.groupBy(RANGE).count().collect()):  # a row for each range
        if taken + c >= n:
            border = placed.where(F.col(RANGE) == k).withColumn("_at", F.row_number().over(Window.partitionBy(RANGE).orderBy(*columns)))
            return placed.where(F.col(RANGE) < k).unionByName(border.where(F.col("_at") <= n - taken).drop("_at")).drop(RANGE)
        taken += c
    return placed.drop(RANGE)
