"""Poisons, sampled plans, graphs, bands by label, families of observations, residuals of set sizes."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corvane.functions import nested as N
from corvane.functions import text as T
from corvane.operators import fit as X
from corvane.operators import joins as J
from corvane.operators import rank as K

SF = "/root/testdata/sf0.001"


def test_recipe_whose_poisons_all_fail_has_no_plan(spark):
    rows = spark.createDataFrame([(1, 5), (2, None)], "id int, level int")
    recipes = spark.createDataFrame([("plain",), ("dirty",)], "recipe string")
    poisons = spark.createDataFrame([("dirty", "hum", 3), ("dirty", "hiss", 9)], "recipe string, poison string, floor int")
    found = J.expand(rows, recipes, {"gain": [1, 2]}, cap=None, poisons=poisons, poison_when=F.col("level") >= F.col("floor"))
    assert sorted((r.id, r.recipe, r.poison, r.gain) for r in found.collect() if r.poison) == [(1, "dirty", "hum", 1), (1, "dirty", "hum", 2)]
    assert sorted((r.id, r.gain) for r in found.where("recipe = 'plain'").collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_graphs_keep_their_constraints(spark):
    graphs = defaultdict(list)
    for r in entry.queries()["random_graphs"](spark, SF).collect():
        graphs[r.c_custkey].append(r)
    assert {r.topology for rows in graphs.values() for r in rows} == {"serial", "send_return", "serial_plus_send"}
    for rows in graphs.values():
        (topology,) = {r.topology for r in rows}
        blocks = {r.block for r in rows}
        assert blocks == {"serial": {"serial"}, "send_return": {"send"}, "serial_plus_send": {"serial", "send"}}[topology]
        serial = sorted((r.position, r.operator) for r in rows if r.block == "serial")
        steps = [o for _, o in serial]
        assert not serial or 2 <= len(steps) <= 3 and steps == sorted(steps, key=["eq", "comp", "gain", "room"].index)
        assert topology != "serial_plus_send" or "room" not in steps
        bus = [r for r in rows if r.operator == "send_bus"]
        assert {r.parameter for r in bus} == ({"send", "return"} if "send" in blocks else set())
        assert all(r.value is not None and r.prior for r in rows)


def test_graphs_are_the_same_again(spark):
    one, two = (sorted(map(tuple, entry.queries()["random_graphs"](spark, SF).select("c_custkey", "block", "position", "operator", "parameter", "value_text").collect())) for _ in range(2))
    assert one == two


def test_labels_have_bands_of_their_own(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0, "a", "eq", "gain", 5.0), (1, 0, 1, "b", "eq", "gain", -5.0), (1, 1, 0, "b", "eq", "gain", 50.0), (1, 1, 1, "c", "eq", "q", 1.0), (1, 1, 2, "d", "eq", "gain", None), (2, 0, 0, "c", "eq", "q", 1.0)],
        "plan_id int, node int, step int, label string, operator string, parameter string, value double",
    )
    bands = spark.createDataFrame([("eq", "gain", None, [3.0, 6.0], "absolute", ["soft", "firm"]), ("eq", "gain", "b", [0.0, 10.0], "ascending", ["down", "up"])], "operator string, parameter string, label string, uppers array<double>, direction string, terms array<string>")
    assert {r.plan_id: r.terms for r in N.band_terms(rows, bands, ["plan_id"]).collect()} == {1: {"a.gain": "firm", "b.gain": "up"}}


def test_claimed_phrases_and_stop_words_go(spark):
    rows = spark.createDataFrame([(["classical guitars", "noisy room", "rock", None],), ([],), (None,)], "p array<string>")
    found = [r.x for r in rows.select(T.unclaimed(F.col("p"), ["guitar"], ["noisy"]).alias("x")).collect()]
    assert found == [["rock", None], [], None]


def test_files_that_are_there(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, file string")
    listing = spark.createDataFrame([("a",), ("a",), ("c",)], "path string")
    assert sorted(r.id for r in J.present_only(rows, listing, "file").collect()) == [1, 3]


def test_more_full_sets_than_predicted(spark):
    counts = spark.createDataFrame([("s", 0, 5), ("s", 7, 5), ("t", 1, 4)], "segment string, mask int, n long")
    predicted = spark.createDataFrame([("s", 0, 0.5), ("s", 1, 0.25), ("s", 7, 0.25), ("t", 3, 1.0)], "segment string, mask int, p double")
    found = {r.segment: r for r in X.cardinality_residuals(counts, predicted, ["segment"], 3).collect()}
    assert (found["s"].worst_size, found["s"].worst_residual, found["s"].direction, found["s"].overstated) == (1, -0.25, "overstates", None)
    assert (found["t"].worst_size, found["t"].worst_relative, found["t"].direction, found["t"].overstated) == (1, 0.0, "understates", "sparse")
    assert [x.size for x in found["s"].residuals] == [0, 1, 2, 3]


def test_ranks_of_a_large_key(spark):
    rows = spark.range(500).select(F.lit("k").alias("key"), (F.col("id") % 7).alias("c"), F.col("id").alias("v"))
    got = {r.v: r.rank for r in K.ranked_targets(rows, ["key"], ["c"], "v", [F.desc("c")]).collect()}
    assert got == {v: n + 1 for n, v in enumerate(sorted(range(500), key=lambda v: (-(v % 7), v)))}


@pytest.mark.parametrize("name", ["random_chains", "random_graphs", "graph_parameters", "special_values", "expanded_plans", "first_valid_attempts", "omitted_facts", "captioned_clips"])
def test_rows_of_a_small_file_are_dealt_to_tasks_before_work(spark, tmp_path, name):
    from corvane import registry

    registry.load()
    n = 25_000
    spark.range(n).selectExpr("id as c_custkey", "'BUILDING' as c_mktsegment", "id * 1.0D as c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).selectExpr("id as p_partkey", "'red ring' as p_name", "'SMALL' as p_type", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = registry.QUERIES[name](spark, str(tmp_path))
    if name == "captioned_clips":
        assert len(found.inputFiles()) == 3
    else:
        assert "3), REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()


def test_attempts_make_no_rows(spark):
    from corvane.plans.chains import chosen_chains

    pool = spark.createDataFrame([("a", o, 1.0, o) for o in "xyz"], "family string, operator string, weight double, tag string")
    found = chosen_chains(spark.range(50), "id", {"a": 1.0}, pool, (2, 3), {"z": 0}, {"x": 0}, "s")
    assert "Window" not in found._jdf.queryExecution().toString()
    chains = {}
    for r in found.orderBy("id", "position").collect():
        chains.setdefault(r.id, []).append(r.operator)
    assert len(chains) == 50 and all(sorted(c) == ["y", "z"] and c[0] == "z" for c in chains.values())


def test_profiles_with_terms_are_those_of_two_passes(spark):
    data = [
        (1, 0, 0, "eq", "a", "gain", 1.0), (1, 0, 1, "eq", "a", "gain", 9.0), (1, 0, 2, "comp", "b", "gain", 2.0), (1, 1, 0, "bus", "bus", "level", 1.0), (2, 0, 0, "eq", "b", "gain", float("nan")),
        (2, 0, 1, "no", None, "q", None), (3, 0, 0, "bus", "bus", "level", 1.0), (4, 0, 0, "comp", "c", "gain", -7.0), (4, 1, 0, "eq", None, "gain", 3.0), (5, 0, 0, None, "a", "gain", 1.0),
    ]
    rows = spark.createDataFrame(data, "plan_id long, node int, step int, operator string, label string, parameter string, value double").repartition(3, "plan_id")
    registry = spark.createDataFrame([("eq", ["x", "a"]), ("comp", ["d", "a"])], "operator string, tags array<string>")
    bands = spark.createDataFrame(
        [("eq", "gain", None, [2.0, 5.0], "ascending", ["low", "high"]), ("eq", "gain", "b", [2.0], "ascending", ["own"]), ("comp", "gain", None, [5.0, 8.0], "absolute", ["near", "far"])],
        "operator string, parameter string, label string, uppers array<double>, direction string, terms array<string>",
    )
    found = N.profile_with_terms(rows, registry, bands, ["plan_id"], ["bus"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    two = N.profile(rows, registry, ["plan_id"], ["bus"]).join(N.band_terms(rows, bands, ["plan_id"]), "plan_id", "left")
    assert found.columns == two.columns
    got = {r.plan_id: tuple(r)[1:] for r in found.collect()}
    assert got == {r.plan_id: tuple(r)[1:] for r in two.collect()} and set(got) == {1, 2, 4}
    assert got[1] == (["eq", "comp"], ["a", "d", "x"], {"a.gain": "high", "b.gain": "near"}) and got[4][2] == {"c.gain": "far", "gain": "high"}
