import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.functions.text import stable_noise
from corvane.operators import select as G


def frame(spark, rows):
    return spark.createDataFrame(rows, "plan_id long, clip_id long, recipe_id string, random boolean, poisoned boolean, features array<struct<dim:string,bin:string>>")


def slow_selection(rows, ties, target, cap, fraction):
    bins = {}
    for r in rows:
        for d, b in r[5]:
            bins.setdefault(d, set()).add(b)
    counts, used, picked, n_random = Counter(), Counter(), [], 0

    def gain(r):
        return G.added(1 / len(bins[d]) / (1 + counts[d, b]) for d, b in sorted(set(r[5])))

    def take(r):
        nonlocal n_random
        picked.append(r[0])
        counts.update(set(r[5]))
        used[r[1], r[2]] += 1
        n_random += r[3]

    def best(pool):
        pool = [r for r in pool if r[0] not in picked and used[r[1], r[2]] < cap and (not r[3] or n_random < int(target * fraction))]
        return min(pool, key=lambda r: (-gain(r), ties[r[0]], r[0])) if pool else None

    groups = Counter((d, b) for r in rows for d, b in set(r[5]) if d == "recipe")
    for (d, b), _ in sorted(groups.items(), key=lambda g: (g[1], g[0])):
        if len(picked) < target and not counts[d, b] and (r := best([r for r in rows if (d, b) in r[5]])):
            take(r)
    while len(picked) < target and (r := best(rows)):
        take(r)
    return picked


def test_rounds_equal_one_by_one(spark):
    rng = random.Random(1)
    rows = []
    for i in range(150):
        recipe = rng.choice("abcd")
        rows.append((i, rng.randrange(12), recipe, False, False, [("recipe", recipe), ("x", str(rng.randrange(9))), ("y", str(int(rng.expovariate(0.3))))]))
    plans = frame(spark, rows)
    ties = {r.plan_id: r.t for r in plans.select("plan_id", stable_noise(F.lit("select"), F.col("plan_id")).alias("t")).collect()}
    got = [r.plan_id for r in G.coverage_selection(plans, 40, cap=2, batch=7, seed_dims=("recipe",)).orderBy("rank").collect()]
    assert got == slow_selection(rows, ties, 40, 2, 0.15)


def test_four_bins_of_eight_plans(spark):
    rows = [(i, i // 2, "r", False, False, [("d", str(i % 4))]) for i in range(8)]
    one, two = (sorted(r.plan_id for r in G.coverage_selection(frame(spark, rows), 4, cap=1).collect()) for _ in range(2))
    assert one == two and len(one) == 4 and {i // 2 for i in one} == {0, 1, 2, 3} and {i % 4 for i in one} == {0, 1, 2, 3}


@pytest.mark.parametrize("authored", [0, 5, 30])
@pytest.mark.parametrize("fraction", [0.0, 0.25, 1.0])
def test_share_of_random_plans(spark, authored, fraction):
    rows = [(i, i, "authored", False, False, [("d", str(i % 7))]) for i in range(authored)] + [(100 + i, i, "random", True, False, [("d", str(i % 5))]) for i in range(50)]
    got = [r.plan_id for r in G.coverage_selection(frame(spark, rows), 20, cap=3, random_fraction=fraction).collect()]
    n_random = sum(i >= 100 for i in got)
    assert n_random <= len(got) * fraction
    if authored >= 20 or fraction == 1:
        assert len(got) == 20
    if authored == 0 and fraction < 1:
        assert not got


@pytest.mark.parametrize(("clean", "share"), [(0, 0.2), (3, 0.2), (30, 0.2), (30, 1.0)])
def test_share_of_poisoned_plans(spark, clean, share):
    rows = [(i, i, "r", False, False, [("d", str(i % 7))]) for i in range(clean)] + [(100 + i, i, "r", False, True, [("d", str(i % 5))]) for i in range(40)]
    got = [r.plan_id for r in G.coverage_selection(frame(spark, rows), 20, cap=0, poison_fraction=share).collect()]
    assert sum(i >= 100 for i in got) <= len(got) * share
    assert len(got) == 20 if share == 1.0 or clean == 30 else True


def test_stratified_cover_takes_what_is_new(spark):
    rows = [(i, [f"g{i % 4}"], [f"m{i % 3}"], f"artist{i % 2}", 0.0) for i in range(24)]
    data = spark.createDataFrame(rows, "id long, genres array<string>, moods array<string>, artist string, base double")
    got = G.stratified_cover(data, "id", {"genres": 4.0, "moods": 3.0}, 4, {"artist": 2}, "base").orderBy("rank").collect()
    picked = [rows[r.id] for r in got]
    assert {r[1][0] for r in picked} == {"g0", "g1", "g2", "g3"} and {r[2][0] for r in picked} == {"m0", "m1", "m2"}
    assert max(Counter(r[3] for r in picked).values()) == 2
    assert len(G.stratified_cover(data, "id", {"genres": 4.0}, 10, {"artist": 2}, "base").collect()) == 10


def test_diverse_variants_start_at_the_extremes(spark):
    rows = [("g", i, 1.0, {"a": float(i), "b": float(i % 3)}) for i in range(9)]
    data = spark.createDataFrame(rows, "g string, plan_id long, weight double, params map<string,double>")
    got = [r.plan_id for r in G.diverse_variants(data, ["g"], 3).orderBy("rank").collect()]
    assert set(got[:2]) == {0, 8} and math.prod(got) == 0


def slow_variants(rows, limit, noise):
    """rows: (plan_id, weight, params) of one group."""
    clean = {i: {n: v for n, v in (p or {}).items() if v is not None and v == v} for i, _, p in rows}
    spans = {n: (min(vs), max(vs), len(vs)) for n in {n for p in clean.values() for n in p} for vs in [[p[n] for p in clean.values() if n in p]]}
    weight = {i: w for i, w, _ in rows}

    def extreme(p):
        parts = [min(abs(v - (spans[n][0] + spans[n][1]) / 2) / ((spans[n][1] - spans[n][0]) / 2), 1.0) for n, v in p.items() if spans[n][1] > spans[n][0] and spans[n][2] > 1]
        return sum(parts) / len(parts) if parts else 0.0

    def gap(p, q):
        names = set(p) | set(q)
        return sum(abs(p.get(n, spans[n][0]) - q.get(n, spans[n][0])) / max(spans[n][1] - spans[n][0], 1e-9) for n in names) / len(names) if names else 0.0

    out = []
    while len(out) < min(limit, len(rows)):
        left = [i for i in clean if i not in out]
        out.append(max(left, key=lambda i: (round(extreme(clean[i]), 9), round(min((gap(clean[i], clean[j]) for j in out), default=1.0), 9), weight[i], noise[i])))
    return out


def test_diverse_variants_against_a_slow_version(spark):
    rng = random.Random(5)
    rows = []
    for g, size in (("a", 40), ("b", 3), (None, 12), ("d", 1)):
        for i in range(size):
            params = {n: float(rng.randrange(64)) for n in "xyz" if rng.random() < 0.7}
            rows.append((g, i, float(rng.randrange(3)), params))
    rows += [("e", 0, 1.0, None), ("e", 1, 2.0, {}), ("e", 2, 1.0, {"x": None}), ("e", 3, 1.0, {"x": float("nan")})]
    data = spark.createDataFrame(rows, "g string, plan_id long, weight double, params map<string,double>")
    noise = {r.plan_id: r.n for r in data.select("plan_id", stable_noise(F.lit("diverse"), F.col("plan_id")).alias("n")).distinct().collect()}
    got = {}
    for r in G.diverse_variants(data, ["g"], 5).orderBy("rank").collect():
        got.setdefault(r.g, []).append(r.plan_id)
    assert got == {g: slow_variants([(i, w, p) for h, i, w, p in rows if h == g], 5, noise) for g in ("a", "b", None, "d", "e")}
    assert G.diverse_variants(data.limit(0), ["g"], 2).collect() == [] and G.diverse_variants(data, ["g"], 0).collect() == []
