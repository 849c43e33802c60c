import pytest
from pyspark.sql import functions as F

from corvane.functions import dist as D
from corvane.functions import nested as N
from corvane.functions import text as T
from corvane.operators import joins as J
from corvane.operators import rules as R
from corvane.operators import sampling as P
from corvane.operators import stats as S


def test_registry_refuses_what_is_ambiguous(spark):
    with pytest.raises(ValueError, match="both called"):
        R.operator_registry(spark, {"a": {"aliases": ["x"]}, "b": {"aliases": ["x"]}})
    with pytest.raises(ValueError, match="both called"):
        R.operator_registry(spark, {"a": {"aliases": ["b"]}, "b": {}})
    with pytest.raises(ValueError, match="no operator"):
        R.operator_registry(spark, {})
    names = {(r.operator, r.name) for r in R.operator_registry(spark, {"a": {"aliases": ["x", "a"]}, "b": {}}).collect()}
    assert names == {("a", "a"), ("x", "a"), ("b", "b")}


def test_chains(spark):
    registry = R.operator_registry(spark, {"eq": {"tags": ["eq"], "params": ["f", "g"]}, "comp": {"aliases": ["c"], "tags": ["dyn"], "params": ["r"]}, "any": {}})
    rows = [(1, 1, "eq", ["f"]), (1, 2, "c", ["r", "q", "a"]), (1, 3, "any", None), (1, 4, "eq", None), (2, 1, "c", []), (2, 1, "eq", []), (2, 2, "nope", ["z"]), (2, 3, None, None)]
    steps = spark.createDataFrame(rows, "plan_id long, step long, operator string, given array<string>")
    got = sorted(map(tuple, R.chain_violations(steps, registry, ["eq", "dyn"], parameters="given").collect()))
    assert got == [(1, 2, "unknown parameter: a, q"), (1, 4, "out of order"), (2, 2, "unknown operator"), (2, 3, "unknown operator")]


def test_null_is_not_absent(spark):
    rows = spark.createDataFrame([('{"a": {"b": null}}',), ('{"a": {}}',), ('{"a": {"b": "x"}}',), ('{"a": 3}',), (None,)], "t string").withColumn("v", F.parse_json("t"))
    fields = N.variant_fields(F.col("v"), ["a.b"])
    of = lambda c: [r[0] for r in rows.select(R.condition_column(rows, c, fields=fields)).collect()]
    leaf = lambda **k: {"path": "a.b", **k}
    assert of({"exists": leaf()}) == [True, False, True, False, False]
    assert of({"eq": leaf(value=None)}) == [True, False, False, False, False]
    assert of({"neq": leaf(value="x")}) == [True, False, False, False, False]
    assert of({"not": {"eq": leaf(value="x")}}) == [True, True, False, True, True]
    assert of({"in": leaf(values=[])}) == [False] * 5 and of({"in": leaf(values=["x", None])}) == [True, False, True, False, False]
    assert of({"contains_all": leaf(values=["x"])}) == [False, False, True, False, False]
    assert of({"gt": leaf(value="a")}) == [False, False, True, False, False]


def test_settings_follow_references():
    uniform = {"type": "uniform", "low": 0, "high": 1}
    priors = {"a": {"sample": "b"}, "b": uniform, "loop": {"type": "parameters", "parameters": {"x": {"sample": "loop"}}}}
    assert D.settings({"sample": "a"}, priors) == [(1.0, {"": uniform})]
    both = {"type": "parameters", "parameters": {"p": {"sample": "b"}, "q": {"type": "joint", "components": [{"weight": 1, "parameters": {"r": uniform}}, {"weight": 3, "parameters": {"r": {"type": "choice", "values": [1]}}}]}}}
    found = D.settings(both, priors)
    assert [w for w, _ in found] == [0.25, 0.75] and all(set(s) == {"p", "q.r"} for _, s in found)
    with pytest.raises(ValueError, match="itself"):
        D.settings(priors["loop"], priors)
    assert set(D.distribution_tree({"x": {"y": uniform, "z": {"values": [1]}}, "w": uniform})) == {"x.y", "x.z", "w"}


def test_marginals_merge_categories(spark):
    joint = {"type": "joint", "components": [{"weight": 1, "parameters": {"m": {"type": "choice", "values": ["a", "b"]}}}, {"weight": 1, "parameters": {"m": {"type": "choice", "values": ["b"]}}}]}
    rows = D.component_table(spark, {"j": joint}).collect()
    assert {(r.prior, r.value): r.weight for r in rows} == {("j.m", "a"): 0.25, ("j.m", "b"): 0.75}


def test_draws_of_a_setting_come_from_one_option(spark):
    joint = {"type": "joint", "components": [{"weight": 1, "parameters": {"m": {"type": "choice", "values": ["a"]}, "n": {"type": "uniform", "low": 0, "high": 1}}}, {"weight": 2, "parameters": {"m": {"type": "choice", "values": ["b"]}, "n": {"type": "uniform", "low": 5, "high": 6}}}]}
    options, components = P.setting_table(spark, {"j": joint})
    rows = spark.range(600).select("id", F.lit("j").alias("prior"))
    found = {}
    for r in P.drawn_settings(rows, options, components, ["id"], "s").collect():
        found.setdefault(r.id, {})[r.parameter] = r.value_text
    assert len(found) == 600 and all((x["m"] == "a") == (float(x["n"]) < 1) for x in found.values())
    assert 140 < sum(x["m"] == "a" for x in found.values()) < 260


def test_samplers_that_do_not_fit(spark):
    components = D.component_table(spark, {"u": {"type": "uniform", "low": 0, "high": 1}, "c": {"type": "choice", "values": ["a", "b"]}})
    rows = [("u", None, (i + 0.5) / 400) for i in range(400)] + [("c", "ab"[i % 2], None) for i in range(400)]
    draws = spark.createDataFrame(rows, "prior string, value_text string, value double")
    assert {r.prior: (r.n, r.outside, r.fits) for r in P.sampler_check(draws, components).collect()} == {"u": (400, 0, True), "c": (400, 0, True)}
    odd = draws.unionByName(spark.createDataFrame([("u", None, 1.5), ("c", "z", None)], draws.schema))
    assert {r.prior: (r.outside, r.fits) for r in P.sampler_check(odd, components).collect()} == {"u": (1, False), "c": (1, False)}


def test_quantiles_of_mixtures_of_any_family(spark):
    spec = {"type": "mixture", "components": [{"weight": 1, "distribution": {"type": "normal", "low": -3, "high": 3, "mean": 0, "std": 1}}, {"weight": 1, "distribution": {"type": "beta", "low": 10, "high": 20, "alpha": 2, "beta": 2}}]}
    got = {r.p: r.value for r in D.mixture_quantiles(D.component_table(spark, {"m": spec}), [0.25, 0.75, 1.0]).collect()}
    assert abs(got[0.25]) < 0.01 and abs(got[0.75] - 15) < 0.02 and 19.5 < got[1.0] <= 20


def test_small_operators(spark):
    grid = J.common_grid(spark, 1.0, 16.0, 4, "log")
    assert [(round(r.b_lo, 9), round(r.b_hi, 9)) for r in grid.orderBy("bin").collect()] == [(1, 2), (2, 4), (4, 8), (8, 16)]
    points = spark.createDataFrame([("k", 4.0, 4.0, 2.0), ("k", 1.0, 3.0, 4.0)], "k string, lo double, hi double, mass double")
    assert {r.bin: r.mass for r in J.redistribute(points, grid, ["k"]).collect()} == {0: 2.0, 1: 2.0, 2: 2.0}
    values = spark.createDataFrame([(0.5,), (1.0,), (9.9,), (100.0,), (101.0,), (None,)], "x double")
    assert [r[0] for r in values.select(S.bin_of(F.col("x"), 1.0, 100.0, 2, "log")).collect()] == [None, 0, 0, 1, None, None]
    assert sum(r.p for r in S.uniform_joint(spark, 3).collect()) == 1
    spans = spark.createDataFrame([("1.5", "3.75049"), ("x", "2"), (None, "2")], "a string, b string")
    assert [r[0] for r in spans.select(T.duration(F.col("a"), F.col("b"))).collect()] == [2.25, None, None]
    band = D.labelled_band(F.col("x"), F.lit("odd"), [1.0, 50.0], of_labels={"odd": ([100.5, 200.0], "descending")})
    assert [r[0] for r in values.where("x is not null").select(band["band"]).collect()] == [0, 0, 0, 0, 1]


def test_steps_are_not_dealt_by_operator(spark):
    steps = spark.createDataFrame([(1, 1, "eq"), (1, 2, "no"), (1, 3, "comp"), (1, 4, "eq")], "plan_id long, step int, operator string")
    registry = R.operator_registry(spark, {"eq": {"tags": ["eq"]}, "comp": {"tags": ["dyn"]}})
    found = R.chain_violations(steps, registry, ["eq", "dyn"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(operator" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, 2, "unknown operator"), (1, 4, "out of order")]


def test_intents_read_their_rows_once(spark):
    data = [("s", "r", "i", "a", 1.0), ("s", "r", "i", "a", 99.0), ("s", "r", "j", "a", 2.0), ("s", None, "i", "a", 3.0), ("s", None, "i", "a", 98.0), ("s", "r", "k", "b", 4.0)]
    rows = spark.createDataFrame([(*x, "insert") for x in data], "source string, record string, instance string, parameter string, value double, routing string").repartition(3, "record")
    policy = spark.createDataFrame([("a", 0.0, 10.0, [])], "parameter string, low double, high double, blocked array<string>")
    found = R.intent_filter(rows, policy)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert found.columns == ["source", "record", "instance", "parameter", "value", "routing"]
    assert sorted((r.instance, r.value) for r in found.collect()) == [("i", 3.0), ("j", 2.0)]
