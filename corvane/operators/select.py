"""Greedy selections in rounds, and diverse variants.

A gain only falls while rows are chosen, so one that was computed earlier is an upper bound. Rows of equal features have equal gains; a
round computes them on Spark and brings the first rows of each of the best sets of features to the driver, with the next set's gain
as a bound. The driver chooses among them as long as no set that it has used up, and none beyond the bound, could come first. The
result is that of choosing one row at a time.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stable_noise
from ..sources.writers import scratch


def added(values: Iterable[float]) -> float:
    """The plain sum in order, as Spark makes it; sum() rounds differently."""
    total = 0.0
    for v in values:
        total += v
    return total


#: Rows of a set of equal features that a round brings to the driver.
DEEP = 16
#: Sets of equal features that are brought for each feature that is covered first.
SEEDS = 50


def heads(rows: DataFrame, key: str, alike: Sequence[str]) -> DataFrame:
    """alike, _rows: the first DEEP rows of each set, by _tie and key. Rows are cut to DEEP of a set before they are gathered."""
    rest = ["_tie", key, *[c for c in rows.columns if c not in (*alike, "_tie", key)]]
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*alike).orderBy("_tie", key))).where(F.col("_n") <= DEEP)
    return first.groupBy(*alike).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("_rows"))


def in_order(key: str) -> list[Column]:
    return [F.desc("_score"), F.col("_rows")[0]["_tie"], F.col("_rows")[0][key]]


def settle(top: Sequence, bound: tuple | None, key: str, alike: Sequence[str], done: set, limit: int, rescore: Callable[[Mapping], float], allowed: Callable[[Mapping], bool], take: Callable[[Mapping, float], None]) -> tuple[list[Mapping], bool]:
    """Rows chosen among the heads in top (alike, _rows, _score: an upper bound of the score now) as long as nothing beyond ``bound``, the
    first set left out, could come first; and whether all heads were looked through without that, so that no row is left."""
    sets = [[{**{c: r[c] for c in alike}, **x.asDict()} for x in r["_rows"]] for r in top]
    at = [0] * len(sets)
    heap = [(-r["_score"], s[0]["_tie"], n) for n, (r, s) in enumerate(zip(top, sets))]
    heapq.heapify(heap)
    chosen: list[Mapping] = []
    while heap and len(chosen) < limit:
        n = heapq.heappop(heap)[2]
        mine = sets[n]
        while at[n] < len(mine) and (mine[at[n]][key] in done or not allowed(mine[at[n]])):
            at[n] += 1
        spent = at[n] == len(mine)
        if spent and len(mine) < DEEP:
            continue  # the set has no other rows
        row = mine[-1 if spent else at[n]]
        fresh = (-rescore(row), row["_tie"], n)
        if heap and fresh > heap[0]:
            heapq.heappush(heap, fresh)
            continue
        if spent or bound is not None and fresh[:2] > bound:
            return chosen, False
        chosen.append(row)
        done.add(row[key])
        take(row, -fresh[0])
        heapq.heappush(heap, (-rescore(row), row["_tie"], n))
    return chosen, not heap and bound is None


def lazy_greedy(rows: DataFrame, key: str, alike: Sequence[str], score: Callable[[], Column], rescore: Callable[[Mapping], float], allowed: Callable[[Mapping], bool], open_: Callable[[DataFrame], DataFrame], take: Callable[[Mapping, float], None], limit: int, batch: int = 1000) -> list[Mapping]:
    """Chosen rows in order. score gives a column under the present state and open_ the rows that it allows, rescore and allowed the
    same for one row, take changes the state; a row that isn't allowed never is again. Rows that are alike in these columns have one
    score, and callers leave few of them. Ties go to the smaller _tie, then key. The driver holds DEEP rows of each of batch sets, and
    the chosen ones (at most limit)."""
    chosen: list[Mapping] = []
    done: set = set()
    while len(chosen) < limit:
        left = open_(rows)
        if done:
            taken = rows.sparkSession.createDataFrame([(k,) for k in done], rows.select(key).schema)
            left = left.join(F.broadcast(taken), key, "left_anti")
        top = heads(left, key, alike).withColumn("_score", score()).orderBy(*in_order(key)).limit(batch + 1).collect()
        bound = (-top[batch]["_score"], top[batch]["_rows"][0]["_tie"]) if len(top) > batch else None
        more, _ = settle(top[:batch], bound, key, alike, done, limit - len(chosen), rescore, allowed, take)
        chosen += more
        if not more:
            break
    return chosen


def first_with(rows: DataFrame, key: str, features: str, wanted: Sequence[str], score: Column, batch: int) -> dict[str, list]:
    """For each wanted feature the heads of the best batch + 1 sets that have it, of all features in one job."""
    each = heads(rows, key, [features]).withColumn("_score", score).withColumn("_of", F.explode(F.array_intersect(features, F.array(*map(F.lit, wanted)))))
    best = each.withColumn("_n", F.row_number().over(Window.partitionBy("_of").orderBy(*in_order(key)))).where(F.col("_n") <= batch + 1)
    out: dict[str, list] = {w: [] for w in wanted}
    for r in sorted(best.collect(), key=lambda r: r["_n"]):
        out[r["_of"]].append(r)
    return out


def first_of_class(rows: DataFrame, classes: Sequence[str], n: int, order: Sequence[str], buckets: int = 64) -> DataFrame:
    """The first n rows of each class, first within hashed parts of a class, so that no task holds a large one whole."""
    part = F.pmod(F.xxhash64(*order), F.lit(buckets))
    for by in ([*classes, "_part"], list(classes)):
        ranked = rows.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        rows = ranked.where(F.col("_n") <= n).drop("_part", "_n")
    return rows


def coverage_selection(plans: DataFrame, limit: int, cap: int = 3, random_fraction: float = 0.15, poison_fraction: float = 0.0, seed: str = "select", seed_dims: Sequence[str] = ("recipe", "target_family"), batch: int = 4000) -> DataFrame:
    """plan_id, rank, score of plans (plan_id, clip_id, recipe_id, random, poisoned, features: array of struct(dim, bin)) that cover
    features best: each adds weight / (1 + times covered) of its features, a dimension weighing one over its bins.

    At most cap plans of a clip and recipe (0: no cap), and no more random or poisoned ones than their shares of the result; rare
    features of seed_dims are covered first. Features are as many as the configuration has, so their counts fit the driver.
    """
    spark = plans.sparkSession
    rows = plans.where(~F.coalesce("poisoned", F.lit(False))) if poison_fraction == 0 else plans
    rows = rows.withColumn("_tie", stable_noise(F.lit(seed), F.col("plan_id"))).withColumn("_f", F.array_sort(F.array_distinct(F.transform("features", lambda f: F.concat_ws("\x1f", f["dim"], f["bin"])))))
    groups = rows.groupBy("clip_id", "recipe_id", "random").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.least("n", F.lit(cap)) if cap else F.col("n"))
    have = {r["random"]: r["n"] for r in groups.groupBy("random").agg(F.sum("n").alias("n")).collect()}
    target = min(limit, sum(have.values()))
    # Of equal plans of one clip and recipe only the first cap can be chosen; of equal plans at most limit are chosen and as many more
    # closed by their cap. All others could never come first, so the rounds don't see them.
    rows = rows.drop("features")
    if cap:
        rows = first_of_class(rows, ["clip_id", "recipe_id", "random", "poisoned", "_f"], cap, ["_tie", "plan_id"])
    rows = _stored(spark, first_of_class(rows, ["random", "poisoned", "_f"], 2 * max(limit, 1), ["_tie", "plan_id"]))
    if random_fraction < 1:
        target = min(target, int(have.get(False, 0) / (1 - random_fraction) + 1e-9))
    sizes = rows.select(F.explode("_f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()
    bins = Counter(r["f"].split("\x1f")[0] for r in sizes)
    weights = {r["f"]: 1.0 / bins[r["f"].split("\x1f")[0]] for r in sizes}

    def run(target: int) -> list[tuple]:
        most_random, most_poison = int(target * random_fraction + 1e-9), int(target * poison_fraction + 1e-9)
        counts: Counter = Counter()
        used: Counter = Counter()
        picked: list[tuple] = []
        state = {"random": 0, "poisoned": 0}

        def gain(features: Iterable[str]) -> float:
            return added(weights[f] / (1 + counts[f]) for f in features)

        def score() -> Column:
            worth = F.map_from_arrays(F.array(*[F.lit(f) for f in weights]), F.array(*[F.lit(w / (1 + counts[f])) for f, w in weights.items()])) if weights else None
            return F.aggregate("_f", F.lit(0.0), lambda s, f: s + worth[f]) if weights else F.lit(0.0)

        def allowed(r: Mapping) -> bool:
            return (not cap or used[r["clip_id"], r["recipe_id"]] < cap) and (not r["random"] or state["random"] < most_random) and (not r["poisoned"] or state["poisoned"] < most_poison)

        def open_(frame: DataFrame) -> DataFrame:
            if state["random"] >= most_random:
                frame = frame.where(~F.col("random"))
            if state["poisoned"] >= most_poison:
                frame = frame.where(~F.coalesce("poisoned", F.lit(False)))
            full = [k for k, n in used.items() if cap and n >= cap]
            if full:
                frame = frame.join(F.broadcast(spark.createDataFrame(full, rows.select("clip_id", "recipe_id").schema)), ["clip_id", "recipe_id"], "left_anti")
            return frame

        def take(r: Mapping, worth: float) -> None:
            picked.append((r["plan_id"], len(picked) + 1, worth))
            counts.update(r["_f"])
            used[r["clip_id"], r["recipe_id"]] += 1
            state["random"] += bool(r["random"])
            state["poisoned"] += bool(r["poisoned"])

        seeds = [f for _, f in sorted((r["n"], r["f"]) for r in sizes if r["f"].split("\x1f")[0] in seed_dims)]
        known = first_with(open_(rows), "plan_id", "_f", seeds, score(), SEEDS) if seeds and target else {}
        done: set = set()
        for feature in seeds:
            if len(picked) < target and not counts[feature]:
                top = known[feature]
                bound = (-top[SEEDS]["_score"], top[SEEDS]["_rows"][0]["_tie"]) if len(top) > SEEDS else None
                found, none_left = settle(top[:SEEDS], bound, "plan_id", ["_f"], done, 1, lambda r: gain(r["_f"]), allowed, take)
                if not found and not none_left:  # what came with the others doesn't tell: one more job
                    mine = rows.where(F.array_contains("_f", feature))
                    lazy_greedy(mine, "plan_id", ["_f"], score, lambda r: gain(r["_f"]), lambda r: allowed(r) and r["plan_id"] not in done, open_, take, 1, SEEDS)
                done.update(p[0] for p in picked)
        left = rows
        if picked:
            left = rows.join(F.broadcast(spark.createDataFrame([(p[0],) for p in picked], rows.select("plan_id").schema)), "plan_id", "left_anti")
        lazy_greedy(left, "plan_id", ["_f"], score, lambda r: gain(r["_f"]), allowed, open_, take, target - len(picked), batch)
        if state["random"] > int(len(picked) * random_fraction + 1e-9) or state["poisoned"] > int(len(picked) * poison_fraction + 1e-9):
            return run(len(picked)) if len(picked) < target else picked
        return picked

    kind = rows.schema["plan_id"].dataType.simpleString()
    return spark.createDataFrame(run(target), f"plan_id {kind}, rank int, score double")


def coverage_table(plans: DataFrame, chosen: DataFrame) -> DataFrame:
    """dim, bin, available, selected."""
    spread = plans.select("plan_id", F.explode(F.array_distinct("features")).alias("f")).select("plan_id", "f.dim", "f.bin")
    marked = spread.join(chosen.select("plan_id", F.lit(1).alias("_s")), "plan_id", "left")
    return marked.groupBy("dim", "bin").agg(F.count(F.lit(1)).alias("available"), F.count("_s").alias("selected"))


def stratified_cover(rows: DataFrame, key: str, weights: Mapping[str, float], limit: int, caps: Mapping[str, int], base: str | None = None, seed: str = "cover", batch: int = 2000) -> DataFrame:
    """key, rank, score: rows with the most new values in their array columns, weighted by column, plus a base score; ties by seeded
    noise. caps limit the rows of a column's value; they are lifted once nothing else is left."""
    spark = rows.sparkSession
    rows = rows.withColumn("_tie", -stable_noise(F.lit(seed), F.col(key)))
    # Rows alike in all that decides are closed together, and at most limit of them are chosen.
    alike = [*weights, *([base] if base else [])]
    rows = _stored(spark, first_of_class(rows, [*alike, *[c for c in caps if c not in alike]], max(limit, 1), ["_tie", key]))
    covered: dict[str, set] = {c: set() for c in weights}
    used: dict[str, Counter] = {c: Counter() for c in caps}
    picked: list[tuple] = []
    relaxed = False

    def score() -> Column:
        new = F.lit(0.0)
        for c, w in weights.items():
            fresh = F.array_except(F.col(c), F.array(*map(F.lit, sorted(covered[c]))).cast(rows.schema[c].dataType)) if covered[c] else F.array_distinct(c)
            new = new + F.size(fresh) * w
        return new + (F.col(base) if base else F.lit(0.0))

    def rescore(r: Mapping) -> float:
        return added(len(set(r[c]) - covered[c]) * w for c, w in weights.items()) + (r[base] if base else 0.0)

    def allowed(r: Mapping) -> bool:
        return relaxed or all(used[c][r[c]] < n for c, n in caps.items())

    def open_(frame: DataFrame) -> DataFrame:
        for c, n in caps.items() if not relaxed else ():
            full = [(v,) for v, k in used[c].items() if k >= n]
            if full:
                frame = frame.join(F.broadcast(spark.createDataFrame(full, rows.select(c).schema)), c, "left_anti")
        return frame

    def take(r: Mapping, worth: float) -> None:
        picked.append((r[key], len(picked) + 1, float(worth)))
        for c in weights:
            covered[c].update(r[c])
        for c in caps:
            used[c][r[c]] += 1

    for relaxed in (False, True):
        if len(picked) < limit:
            left = rows
            if picked:
                left = rows.join(F.broadcast(spark.createDataFrame([(p[0],) for p in picked], rows.select(key).schema)), key, "left_anti")
            lazy_greedy(left, key, alike, score, rescore, allowed, open_, take, limit - len(picked), batch)
    return spark.createDataFrame(picked, f"{key} {rows.schema[key].dataType.simpleString()}, rank int, score double")


def diverse_variants(plans: DataFrame, keys: Sequence[str], limit: int, seed: str = "diverse") -> DataFrame:
    """keys, plan_id, rank of up to limit plans (keys, plan_id, weight, params: map of numbers) of each group: the most extreme
    first, then the farthest from those chosen, then the heaviest, then by seeded noise. plan_id is unique within a group.

    Extreme is the mean distance of a plan's parameters from the middle of their range in the group, as a part of half the range; far
    is the mean gap over parameters that either plan has, as a part of the range, a missing one at its low end. One round of an
    aggregate and a join for each rank, so a group may have any size; only what is chosen, one row a group, is written between them.
    """
    if limit < 1:
        return plans.select(*keys, "plan_id", F.lit(0).alias("rank")).where(F.lit(False))
    spark = plans.sparkSession
    stored = lambda d: _stored(spark, d)
    params = F.coalesce(F.col("params").cast("map<string,double>"), F.create_map().cast("map<string,double>"))
    rows = plans.select(*keys, "plan_id", "weight", F.map_filter(params, lambda _, v: v.isNotNull() & ~F.isnan(v)).alias("_p"), stable_noise(F.lit(seed), F.col("plan_id")).alias("_noise"))
    seen = rows.select(*keys, F.explode("_p").alias("_name", "_v")).groupBy(*keys, "_name").agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("_v").alias("n"))
    spans = seen.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_name", F.struct("low", "high", "n")))).alias("_spans"))
    span = lambda name: F.try_element_at("_spans", name)
    mean = lambda parts: F.coalesce(F.try_divide(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x), F.size(parts)), F.lit(0.0))
    wide = F.filter(F.map_entries("_p"), lambda e: (span(e["key"])["high"] > span(e["key"])["low"]) & (span(e["key"])["n"] > 1))
    off = lambda e: F.abs(e["value"] - (span(e["key"])["low"] + span(e["key"])["high"]) / 2) / ((span(e["key"])["high"] - span(e["key"])["low"]) / 2)
    rows = stored(_beside(rows, spans, keys).withColumn("_extreme", mean(F.transform(wide, lambda e: F.least(off(e), F.lit(1.0))))))

    def gap(other: Column) -> Column:
        at = lambda values, n: F.coalesce(F.try_element_at(values, n), span(n)["low"])
        names = F.array_union(F.map_keys("_p"), F.map_keys(other))
        return mean(F.transform(names, lambda n: F.abs(at(F.col("_p"), n) - at(other, n)) / F.greatest(span(n)["high"] - span(n)["low"], F.lit(1e-9))))

    chosen = None
    for _ in range(limit):
        left = rows.withColumn("_distance", F.lit(1.0))
        if chosen is not None:
            left = _beside(rows, chosen, keys).where(~F.exists("_picked", lambda x: x["plan_id"].eqNullSafe(F.col("plan_id"))))
            left = left.withColumn("_distance", F.array_min(F.transform("_picked", lambda x: gap(x["_p"]))))
        best = left.groupBy(*keys).agg(F.max_by(F.struct("plan_id", "_p"), F.struct("_extreme", "_distance", "weight", "_noise")).alias("_best"))
        if chosen is None:
            chosen = stored(best.select(*keys, F.array("_best").alias("_picked")))
        else:
            more = F.when(F.col("_best").isNull(), F.col("_picked")).otherwise(F.concat("_picked", F.array("_best")))
            chosen = stored(_beside(chosen, best, keys).select(*keys, more.alias("_picked")))
    return chosen.select(*keys, F.posexplode("_picked").alias("_at", "_x")).select(*keys, F.col("_x.plan_id").alias("plan_id"), (F.col("_at") + 1).alias("rank"))


def _beside(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the columns of the one row that side has for their keys, null without one; null keys are equal."""
    named = side.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in side.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return rows.join(named, same, "left").drop(*[f"_key{i}" for i in range(len(keys))])


def _stored(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = scratch(spark)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)

