"""Ranks, percentiles, islands, caps and ordered samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_noise
from ..sources.writers import scratch
from .ranges import BEFORE, RANGE, across, carried, dealt, first_in_order, first_smallest, prefix_sums, with_carried, within

#: Name of the bucket below each percentile. Fixed values.
BUCKETS = {25.0: "most_audible", 50.0: "audible", 75.0: "subtle", float("inf"): "least_audible"}


def counts_below(rows: DataFrame, value: str, groups: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """groups, value, n, below, total for each distinct value: its rows, the group's rows under it, all the group's rows. Null values
    are left out; prefix_sums does it range by range."""
    found = prefix_sums(rows, groups, value, {"n": F.lit(1)}, ranges)
    return found.select(*groups, value, "n", F.col("n_below").alias("below"), F.col("n_total").alias("total"))


def mid_rank(rows: DataFrame, value: str, buckets: Mapping[float, str] = BUCKETS) -> DataFrame:
    """rows with percentile (share below plus half the ties, four places), percentile_bucket, percentile_n; null values get nulls."""
    found = counts_below(rows, value).withColumnRenamed(value, "_v")
    exact = F.round(100.0 * (F.col("below") + 0.5 * F.col("n")) / F.col("total"), 4)
    name = F.lit(None).cast("string")
    for upper, label in sorted(buckets.items(), reverse=True):
        name = F.when(F.col("percentile") < upper, F.lit(label)).otherwise(name)
    joined = rows.join(found, F.col(value) == F.col("_v"), "left").withColumn("percentile", exact)
    return joined.withColumn("percentile_bucket", F.when(F.col("percentile").isNotNull(), name)).withColumnRenamed("total", "percentile_n").drop("_v", "n", "below")


def stale(rows: DataFrame, value: str, recorded: str = "percentile_n") -> DataFrame:
    """recorded, current, stale: does the recorded population differ from the values that there are?"""
    return rows.agg(F.max(recorded).alias("recorded"), F.count(value).alias("current")).withColumn("stale", ~F.col("recorded").eqNullSafe(F.col("current")))


def share_within(rows: DataFrame, keys: Sequence[str], within: Sequence[str], share: str = "share") -> DataFrame:
    """keys, n, share: rows by key and their part of the rows of ``within``."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn(share, F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "variant") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the order given. A key of any size is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return kept.select(*[F.col(k) if k in keys else F.col(f"_r.{k}").alias(k) for k in rows.columns])


def sample_per_group(rows: DataFrame, keys: Sequence[str], n: int, seed: str, *identity: str) -> DataFrame:
    """n rows of each group by seeded noise of their identity: the same on every run."""
    w = Window.partitionBy(*keys).orderBy("_noise", *identity)
    return rows.withColumn("_noise", stable_noise(F.lit(seed), *map(F.col, identity))).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_noise", "_k")


def sample_exact(rows: DataFrame, n: int, seed: str, *identity: str) -> DataFrame:
    """Exactly n rows (all, if fewer) by seeded noise."""
    return first_smallest(rows.withColumn("_noise", stable_noise(F.lit(seed), *map(F.col, identity))), n, "_noise", *identity).drop("_noise")


def hold_out(rows: DataFrame, n: int, seed: str, key: str, out: str = "held_out") -> DataFrame:
    """rows with a flag on exactly n of them, by seeded noise of a unique key."""
    marked = sample_exact(rows.select(key), n, seed, key).withColumn(out, F.lit(True))
    return rows.join(marked, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def weighted_sample(rows: DataFrame, keys: Sequence[str], weight: str, n: int, seed: str, *identity: str) -> DataFrame:
    """n rows of each group without replacement, likelier by weight: those of the least -ln(u) / weight, in this order. Rows without
    a positive weight are never drawn."""
    u = stable_noise(F.lit(seed), *map(F.col, identity))
    scored = rows.where(F.col(weight) > 0).withColumn("_e", -F.ln(u + F.lit(2.0**-53)) / F.col(weight))
    return scored.withColumn("draw", F.row_number().over(Window.partitionBy(*keys).orderBy("_e", *identity))).where(F.col("draw") <= n).drop("_e")


def islands(rows: DataFrame, keys: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """keys, first, last, size of each run of consecutive whole numbers. A key's numbers are counted range by range."""
    placed = dealt(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).distinct(), keys, ["_v"], ranges)
    parts = placed.groupBy(*keys, RANGE).agg(F.count(F.lit(1)).alias("_n"))
    carry = carried(parts, keys, _before=F.sum("_n").over(across(keys).rowsBetween(*BEFORE)))
    local = placed.withColumn("_k", F.row_number().over(within(keys).orderBy("_v")))
    run = F.col("_v") - F.col("_k") - F.coalesce("_before", F.lit(0))
    return with_carried(local, carry, keys).withColumn("_g", run).groupBy(*keys, "_g").agg(F.min("_v").alias("first"), F.max("_v").alias("last"), F.count(F.lit(1)).alias("size")).drop("_g")


def ranges_text(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, ranges: islands as ``a-b`` or ``a``, in order."""
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    return found.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("first", text.alias("t")))), lambda x: x["t"]).alias("ranges"))


def runs_of_equal(rows: DataFrame, keys: Sequence[str], order: str, value: str, ranges: int | None = None) -> DataFrame:
    """rows with run: the number, from 1, of the run of equal neighbouring values that a row is in; nulls are equal.

    Runs are numbered range by range; a range adds the runs of those before it, less one for each border that a run goes over.
    """
    placed = dealt(rows, keys, [order], ranges)
    w = within(keys).orderBy(order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    local = placed.withColumn("_c", change).withColumn("_run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct("_run", order)
    parts = local.groupBy(*keys, RANGE).agg(F.max("_run").alias("_runs"), F.min_by(F.struct(value), at)[value].alias("_first"), F.max_by(F.struct(value), at)[value].alias("_last"))
    over = across(keys)
    goes_on = ((F.row_number().over(over) > 1) & F.col("_first").eqNullSafe(F.lag("_last").over(over))).cast("int")
    carry = carried(parts.withColumn("_joined", goes_on), keys, _offset=F.coalesce(F.sum("_runs").over(over.rowsBetween(*BEFORE)), F.lit(0)) - F.sum("_joined").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return with_carried(local, carry, keys).select(*rows.columns, (F.col("_run") + F.coalesce("_offset", F.lit(0))).alias("run"))


def capped(rows: DataFrame, keys: Sequence[str], cap: int, limit: int, random_flag: str, fraction: float, seed: str, *identity: str) -> DataFrame:
    """At most cap rows of each key (0: no cap) and limit rows in all, of which at most the fraction are random ones; in seeded order.

    The quotas come from counts first; if authored rows run short, the total shrinks with them.
    """
    noise = stable_noise(F.lit(seed), *map(F.col, identity))
    kept = rows.withColumn("_noise", noise)
    if cap:
        kept = kept.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_noise", *identity))).where(F.col("_k") <= cap).drop("_k")
    path = scratch(rows.sparkSession)
    kept.write.parquet(path)
    kept = rows.sparkSession.read.parquet(path)
    row = kept.agg(F.count_if(F.col(random_flag)), F.count_if(~F.col(random_flag))).first()
    random_n, authored_n = row[0], row[1]
    total = min(limit, random_n + authored_n)
    while total and (min(random_n, int(total * fraction)) + authored_n) < total:
        total = min(total - 1, min(random_n, int(total * fraction)) + authored_n)
    take_random = min(random_n, int(total * fraction))
    part = lambda flag, n: first_smallest(kept.where(flag), n, "_noise", *identity)
    return part(~F.col(random_flag), total - take_random).unionByName(part(F.col(random_flag), take_random)).drop("_noise")


def repair_order(steps: Column, rank: Mapping[str, int]) -> Column:
    """Steps (array of names) stably sorted by their rank; unknown names rank last."""
    ranks = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    indexed = F.transform(steps, lambda s, i: F.struct(F.coalesce(ranks[s], F.lit(1 << 30)).alias("r"), i.alias("i"), s.alias("s")))
    return F.transform(F.sort_array(indexed), lambda x: x["s"])


def ordered_targets(targets: Column) -> Column:
    """array of struct(priority, stem, tag), higher priority first, then by stem and tag."""
    return F.transform(F.sort_array(F.transform(targets, lambda t: F.struct((-t["priority"]).alias("p"), t["stem"].alias("s"), t["tag"].alias("t")))), lambda x: F.struct((-x["p"]).alias("priority"), x["s"].alias("stem"), x["t"].alias("tag")))


def ranked_targets(rows: DataFrame, keys: Sequence[str], classes: Sequence[str], value: str, order: Sequence[Column]) -> DataFrame:
    """rows with rank, from 1, within keys: by ``order`` over columns of few values (classes), then by a number. Rows of one number
    share the first of their ranks; rows without one have none. Classes are summed up and ranks inside a class counted by buckets, so a
    key may have any number of rows."""
    by = [*keys, *classes]
    inside = counts_below(rows, value, by)
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sizes = inside.select(*by, F.col("total").alias("_rows")).distinct()
    offsets = sizes.select(*by, F.coalesce(before, F.lit(0)).alias("_before"))
    placed = inside.join(offsets, by).select(*by, value, (F.col("_before") + F.col("below") + 1).alias("rank"))
    return rows.join(placed, [*by, value], "left")


def first_rows(rows: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of an explicit order, without bringing them to one task if they are many."""
    return first_in_order(rows, n, *order)


def batches_by(rows: DataFrame, path: str, seed: str, partitions: int | None = None) -> DataFrame:
    """Rows of one path next to each other in one partition; paths in seeded order."""
    dealt = rows.withColumn("_n", stable_noise(F.lit(seed), F.col(path)))
    dealt = dealt.repartition(partitions, path) if partitions else dealt.repartition(path)
    return dealt.sortWithinPartitions("_n", path).drop("_n")
