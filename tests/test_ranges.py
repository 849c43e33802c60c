"""Order over groups of any size: the same results at any number of ranges, and no task that holds a group."""

import bisect
import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corvane.operators import joins as J
from corvane.operators import rank as K
from corvane.operators import ranges as G
from corvane.operators import stats as S

SF = "/root/testdata/sf0.001"
RANGES = [1, 3, 17]


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # One group holds most rows, one is null, some are small; values repeat, some are null.
    data = [(rng.choice(["big"] * 30 + ["b", "c", None]), i, rng.choice([None] + [rng.randint(0, 60)] * 9), float(rng.randint(1, 9))) for i in range(900)]
    return data, spark.createDataFrame(data, "g string, id int, v int, w double").repartition(5).cache()


def by_group(data):
    groups = {}
    for g, i, v, w in data:
        groups.setdefault(g, []).append((i, v, w))
    return groups


@pytest.mark.parametrize("n", RANGES)
def test_prefix_sums_and_quantiles(rows, n):
    data, df = rows
    found = G.prefix_sums(df, ["g"], "v", {"n": F.lit(1), "m": F.col("w")}, n)
    want = []
    for g, items in by_group(data).items():
        known = [(v, w) for _, v, w in items if v is not None]
        for v in {v for v, _ in known}:
            of = lambda test: (sum(test(x) for x, _ in known), sum(w for x, w in known if test(x)))
            (a, b), (c, d) = of(lambda x, v=v: x == v), of(lambda x, v=v: x < v)
            want.append((g, v, a, c, len(known), b, d, sum(w for _, w in known)))
    assert sorted_rows(found.select("g", "v", "n", "n_below", "n_total", "m", "m_below", "m_total")) == sorted(want, key=repr)
    got = {r.g: r.quantiles for r in G.quantiles(found, ["g"], "v", [0.0, 0.13, 0.5, 1.0]).collect()}
    for g, items in by_group(data).items():
        values = sorted(v for _, v, _ in items if v is not None)
        for p, q in zip([0.0, 0.13, 0.5, 1.0], got[g]):
            at = p * (len(values) - 1)
            low = int(at)
            assert q == pytest.approx(values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low]))


def test_sums_without_groups_and_of_nothing(rows):
    data, df = rows
    found = {r.v: (r.n_below, r.n_total) for r in G.prefix_sums(df, [], "v", {"n": F.lit(1)}, 6).collect()}
    values = sorted(v for _, _, v, _ in data if v is not None)
    assert found == {v: (bisect.bisect_left(values, v), len(values)) for v in set(values)}
    assert G.prefix_sums(df.where("false"), ["g"], "v", {"n": F.lit(1)}).collect() == []


@pytest.mark.parametrize("n", RANGES)
def test_islands_and_runs(rows, n):
    data, df = rows
    want_islands, want_runs = [], []
    for g, items in by_group(data).items():
        numbers = sorted({v for _, v, _ in items if v is not None})
        for _, part in groupby(enumerate(numbers), lambda x: x[1] - x[0]):
            part = [v for _, v in part]
            want_islands.append((g, part[0], part[-1], len(part)))
        run, before = 0, object()
        for i, v, _ in sorted(items):
            kind = None if v is None else v % 2
            run, before = run + (kind != before), kind
            want_runs.append((g, i, kind, run))
    assert sorted_rows(K.islands(df, ["g"], "v", n)) == sorted(want_islands, key=repr)
    runs = K.runs_of_equal(df.select("g", "id", (F.col("v") % 2).alias("kind")), ["g"], "id", "kind", n)
    assert sorted_rows(runs) == sorted(want_runs, key=repr)


@pytest.mark.parametrize("n", RANGES)
def test_a_run_goes_over_borders(spark, n):
    df = spark.range(500).select(F.lit("one").alias("g"), F.col("id"), F.when(F.col("id") < 450, F.lit("x")).alias("kind"))
    found = K.runs_of_equal(df, ["g"], "id", "kind", n)
    assert {tuple(r) for r in found.groupBy("run").agg(F.count("*"), F.min("id")).collect()} == {(1, 450, 0), (2, 50, 450)}
    assert sorted_rows(K.islands(df, ["g"], "id", n)) == [("one", 0, 499, 500)]


@pytest.mark.parametrize("n", RANGES)
def test_next_after_over_borders(spark, n):
    rng = random.Random(7)
    events = [(rng.choice(["big"] * 9 + ["b", None]), rng.randint(0, 400), i) for i in range(300)]
    targets = [(rng.choice(["big"] * 9 + ["b", None]), rng.randint(0, 400), 1000 + i) for i in range(12)] + [("big", 401, 2000)]
    e, t = (spark.createDataFrame(x, "g string, at int, id int") for x in (events, targets))
    found = {r.id: (r.next_at, r.next_target) for r in J.next_after(e, t, ["g"], "at", "id", F.col("at") + 150, n).collect()}
    for g, at, i in events:
        after = sorted((a, x) for h, a, x in targets if h == g and a > at)
        if not after or after[0][0] >= at + 150:
            assert found[i] == (None, None)
        else:
            assert found[i][0] == after[0][0] and found[i][1] in {x for a, x in after if a == after[0][0]}
    assert len(found) == len(events)


def test_ecdf_ranks_and_chains_with_null_groups(rows):
    data, df = rows
    for g, items in by_group(data).items():
        known = [(v, w) for _, v, w in items if v is not None]
        mine = df.where(F.col("g").eqNullSafe(F.lit(g)))
        total = sum(w for _, w in known)
        assert {r.v: r.ecdf for r in S.weighted_ecdf(mine, ["g"], "v", "w").collect()} == pytest.approx({v: sum(w for x, w in known if x <= v) / total for v in {v for v, _ in known}})
        ranks = S.weighted_mid_ranks(mine, ["g"], "v", "w", "r").collect()
        assert len(ranks) == len(known)
        assert all(r.r == pytest.approx(sum(w for x, w in known if x < r.v) + sum(w for x, w in known if x == r.v) / 2) for r in ranks)
    chains = S.chains(df.select("g", F.array("v").alias("c")), "c", ["g"]).groupBy("g").agg(F.sum("probability").alias("p")).collect()
    assert {r.g for r in chains} == {"big", "b", "c", None} and all(r.p == pytest.approx(1) for r in chains)


def test_one_group_of_many_values_is_spread(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("one").alias("g"), ((F.col("id") * 7919) % n).alias("v"), F.lit(1.0).alias("w"))
    placed = G.dealt(df.groupBy("g", "v").agg(F.sum("w").alias("w")), ["g"], ["v"], 8)
    sizes = [r["count"] for r in placed.groupBy(G.RANGE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * n / 8
    found = S.weighted_ecdf(df, ["g"], "v", "w").agg(F.max(F.abs(F.col("ecdf") - (F.col("v") + 1) / n)).alias("off"), F.count("*").alias("n")).first()
    assert found.n == n and found.off < 1e-9
    summary = S.parameter_summary(df, ["g"], "v", {}).first()
    assert summary.support == n and summary.quantiles == pytest.approx([p * (n - 1) for p in S.QUANTILES])


@pytest.mark.parametrize("n", [0, 1, 37, 899, 900, 2000])
@pytest.mark.parametrize("border,digits", [(10_000, 12), (1, 3)])
def test_first_smallest_by_rounds(spark, n, border, digits):
    rows = spark.range(900).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(400)) / 400.0).alias("u"))  # many ties
    want = [(u, i) for u, i in sorted((r.u, r.id) for r in rows.collect())][:n]
    assert sorted((r.u, r.id) for r in G.first_smallest(rows, n, "u", "id", border=border, digits=digits).collect()) == want


def test_first_in_order_over_ranges(spark):
    rows = spark.range(3000).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("x"))
    want = sorted((-r.x, r.id) for r in rows.collect())[:1234]
    for most in (10, 10_000):
        assert sorted((-r.x, r.id) for r in G.first_in_order(rows, 1234, F.desc("x"), "id", most=most).collect()) == want
    assert G.first_in_order(rows, 5000, "id", most=10).count() == 3000


def test_no_single_partition_in_selections(spark):
    for name in ("held_out_orders", "capped_orders"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, plan


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(9)
    data = [(rng.choice("ab"), i, lo, lo + rng.choice([0.0, 0.5, 3.0, 40.0, 900.0])) for i in range(120) for lo in [float(rng.randint(-300, 300)) / 2]]
    data += [("a", 500, -400.0, 2000.0), ("a", 501, -400.0, -400.0)]
    df = spark.createDataFrame(data, "k string, id int, lo double, hi double")
    want = sorted((a[1], b[1]) for a in data for b in data if a[0] == b[0] and a[2] < b[3] and b[2] < a[3])
    for width in (0.3, 4.0, 5000.0):
        assert sorted((r.id, r.r_id) for r in J.overlaps(df, df, ["k"], width).collect()) == want


def test_a_long_interval_makes_few_slots(spark):
    slots = spark.range(1).select(J._slots(F.lit(-1e9), F.lit(1e9), 1.0, 31).alias("s")).first().s
    assert len(slots) <= 2 * 32
    covered = sorted((x.slot << x.level, (x.slot + 1) << x.level) for x in slots)
    assert covered[0][0] == -(10**9) and covered[-1][1] == 10**9 + 1 and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    assert J.overlaps(*[spark.createDataFrame([], "k int, lo double, hi double")] * 2, ["k"], 1.0).collect() == []


def test_quantiles_to_the_last_bit_of_their_sql(spark, tmp_path):
    import random

    import duckdb

    from corvane import registry

    registry.load()
    rng = random.Random(8)
    rows = [(rng.choice("FOP"), round(rng.uniform(900, 500_000), 2)) for _ in range(4000)] + [("N", None), (None, 5.25), (None, 7.75)]
    spark.createDataFrame(rows, "o_orderstatus string, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = {part: q for part, q in con.execute(registry.ORACLE_SQL["ordered_quantiles"]).fetchall()}
    got = {r.part: r.quantiles for r in registry.QUERIES["ordered_quantiles"](spark, str(tmp_path)).collect()}
    assert got == want and set(got) == {"all", "F", "O", "P", "N", None} and got["N"] is None


def test_weights_join_no_source_as_one_key(spark):
    rows = spark.createDataFrame([("a", i // 2, i) for i in range(40)] + [("b", 1, 0), (None, 1, 1)], "source string, cluster long, row int")
    found = S.observation_weights(rows, "source", "cluster")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(_salt#" in plan and all("cluster" in line or "_salt" in line or "Cross" in line for line in plan.splitlines() if "Join " in line)
    got = {(r.source, r.row): r.weight for r in found.collect()}
    assert got == {("a", i): 1 / (2 * 20 * 3) for i in range(40)} | {("b", 0): 1 / 3}
