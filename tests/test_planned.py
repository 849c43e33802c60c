"""Special values, registered handlers, and the array arithmetic of normal and beta distributions."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corvane.functions import dist as D
from corvane.functions import kernels
from corvane.operators import rules as R
from corvane.operators.sampling import drawn
from corvane.plans import values as V
from corvane.queries import planned as P

SF = "/root/testdata/sf0.001"
PRIORS = {
    "beats": {"type": "choice", "values": [0.25, 0.5, 1.0]},
    "tone": {"type": "mixture", "components": [{"weight": 1, "model": {"type": "normal", "low": 1.0, "high": 9.0, "mean": 3.0, "std": 1.0}}, {"weight": 2, "model": {"type": "log_uniform", "low": 20.0, "high": 200.0}}, {"weight": 1, "model": {"type": "choice", "values": [7.0]}}]},
    "bend": {"type": "beta", "low": 0.0, "high": 1.0, "alpha": 2.0, "beta": 5.0},
    "shape": {"type": "choice", "values": ["soft", "hard"]},
}


def values_of(spark, spec, rows, schema, context, name="x"):
    frame = spark.createDataFrame(rows, schema).withColumn("operator", F.lit("op"))
    return {r.id: r for r in V.with_parameters(frame, ["id"], {"op": {name: spec}}, PRIORS, context, "s").collect()}


def test_nested_specs_follow_what_can_be_resolved(spark):
    rows, schema = [(1, 120.0, None), (2, None, 3.0), (3, None, None), (4, 0.0, 1.0)], "id int, bpm double, depth double"
    tempo = {"coalesce": [{"ref": "bpm"}, {"ref": "depth"}, None]}
    found = values_of(spark, tempo, rows, schema, ["bpm", "depth"])
    assert {k: r.value for k, r in found.items()} == {1: 120.0, 2: 3.0, 3: None, 4: 0.0}
    assert {r.prior for r in found.values()} == {None}
    found = values_of(spark, {"tempo_sync": {"bpm": {"ref": "bpm"}, "beats": 2}}, rows, schema, ["bpm", "depth"])
    assert {k: r.value for k, r in found.items()} == {1: 1.0, 2: None, 3: None, 4: None}
    found = values_of(spark, {"scale": {"value": {"coalesce": [{"ref": "depth"}, 10]}, "factor": 2, "offset": 1}}, rows, schema, ["bpm", "depth"])
    assert {k: r.value for k, r in found.items()} == {1: 21.0, 2: 7.0, 3: 21.0, 4: 3.0}
    found = values_of(spark, "at ${bpm} of ${depth}", rows, schema, ["bpm", "depth"])
    assert {k: r.value_text for k, r in found.items()} == {1: None, 2: None, 3: None, 4: "at 0.0 of 1.0"}
    assert values_of(spark, "${depth}", rows, schema, ["depth"])[2].value == 3.0


def test_draws_are_those_of_the_join(spark):
    rows = spark.range(400).select(F.col("id").cast("int").alias("id")).withColumn("operator", F.lit("op"))
    definitions = {"op": {p: {"sample": p} for p in PRIORS}}
    one = {(r.id, r.parameter): (r.value_text, r.value) for r in V.with_parameters(rows, ["id"], definitions, PRIORS, [], "s").collect()}
    long = rows.select("id", "operator", F.explode(F.array(*map(F.lit, PRIORS))).alias("parameter")).withColumn("prior", F.col("parameter"))
    other = {(r.id, r.parameter): (r.value_text, r.value) for r in drawn(long, D.component_table(spark, PRIORS), ["id", "operator", "parameter"], "s").collect()}
    assert one.keys() == other.keys()
    for key, (text, value) in one.items():
        assert value is None and other[key] == (text, None) or value == pytest.approx(other[key][1], rel=1e-12)


def test_choice_branches_and_errors(spark):
    rows, schema = [(i, 100.0 if i % 2 else None) for i in range(300)], "id int, bpm double"
    found = values_of(spark, {"sample_choice": ["beats", "bend"]}, rows, schema, ["bpm"])
    shares = [sum(r.prior == p for r in found.values()) for p in ("beats", "bend")]
    assert sum(shares) == 300 and min(shares) > 110
    found = values_of(spark, {"either": {"when": {"exists": {"path": "bpm"}}, "chance": 0.5, "then": {"values": [1, 2]}, "otherwise": 9}}, rows, schema, ["bpm"])
    assert {r.value for k, r in found.items() if k % 2 == 0} == {9.0} and {r.value for k, r in found.items() if k % 2} == {1.0, 2.0, 9.0}
    for spec in ({"ref": "nowhere"}, {"unheard": 1}, {"sample": "beats", "scale": 1}, {"either": {"when": {"exists": {"path": "nowhere"}}, "then": 1, "otherwise": 2}}):
        with pytest.raises(ValueError):
            values_of(spark, spec, rows, schema, ["bpm"])


def test_every_parameter_of_a_graph_has_a_prior_and_lies_in_it(spark):
    rows = entry.queries()["graph_parameters"](spark, SF).collect()
    assert {(r.family, r.has_tempo) for r in rows} == {(f, t) for f in P.FAMILIES for t in (True, False)}
    assert all(r.prior is not None and r["values"] == r.in_support > 0 for r in rows)
    by = {(r.operator, r.parameter, r.prior, r.has_tempo) for r in rows}
    assert ("delay", "seconds", "beats", True) in by and ("delay", "seconds", "seconds", True) in by and ("delay", "seconds", "beats", False) not in by
    assert {r.family for r in rows if r.prior == "parallel_ratio"} == {"drums"} and "drums" not in {r.family for r in rows if r.prior == "ratio"}
    assert {r.prior for r in rows if r.parameter == "gain_db" and r.operator == "gain"} == {"up_db", "down_db"}


def test_names_of_handlers_clash(spark):
    P.registered()
    for add in (
        lambda: R.register_condition("between", None), lambda: R.register_condition("all", None), lambda: R.register_action("multiply", None), lambda: D.register_family("normal", None), lambda: D.register_family("choice", None),
        lambda: D.register_distribution("uniform", None), lambda: D.register_distribution("mixture", None), lambda: V.register_special("ref", None),
    ):
        with pytest.raises(ValueError):
            add()
    with pytest.raises(ValueError):
        list(D.leaves({"type": "unheard", "low": 0, "high": 1}))
    frame = spark.createDataFrame([(5.0,), (None,)], "x double")
    assert [r[0] for r in frame.select(R.condition_column(frame, {"not": {"between": {"path": "x", "low": 0, "high": 9}}})).collect()] == [False, True]


def test_registered_family_serves_mixtures(spark):
    P.registered()
    components = D.component_table(spark, {"m": {"type": "mixture", "components": [{"weight": 1, "model": {"type": "triangle", "low": 0.0, "mean": 2.0, "high": 4.0}}, {"weight": 1, "model": {"type": "uniform", "low": 0.0, "high": 4.0}}]}})
    rows = spark.createDataFrame([(1, "m", 2.0), (2, "m", 1.0)], "id int, prior string, value double")
    assert {r.id: r.cdf for r in D.mixture_cdf(rows, components, ["id"]).collect()} == pytest.approx({1: 0.5, 2: (1 / 8 + 1 / 4) / 2})


def by_simpson(x, a, b, n=20_000):
    """The incomplete beta function of one value; a below one is put as t = s^(1/a), which has no pole."""
    f, top = (lambda t: t ** (a - 1) * (1 - t) ** (b - 1), x) if a >= 1 else (lambda s: (1 - s ** (1 / a)) ** (b - 1) / a, x**a)
    h = top / n
    total = f(0.0) + f(top) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n))
    return total * h / 3 * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))


def test_kernels_against_scalar_functions():
    x = np.concatenate([np.linspace(-7, 7, 3001), [0.0, 1e-12, 2.999999, 3.0, -3.0, 40.0]])
    erf, rest = kernels.erf_pair(x)
    assert np.abs(erf - [math.erf(v) for v in x]).max() < 1e-14
    assert all(abs(r - math.erfc(abs(v))) <= 1e-9 * math.erfc(abs(v)) for r, v in zip(rest, x))
    g = np.geomspace(1e-3, 1e5, 2000)
    assert np.allclose(kernels.lgamma(g), [math.lgamma(v) for v in g], rtol=1e-13, atol=1e-13)
    for u, a, b in ((0.3, 2.0, 3.5), (0.9, 2.0, 3.5), (0.2, 0.7, 4.0), (0.5, 30.0, 25.0), (0.01, 1.5, 8.0)):
        got = kernels.beta_cdf(*(np.array([v]) for v in (u, a, b)))[0]
        assert got == pytest.approx(by_simpson(u, a, b), abs=1e-6)
        assert got == pytest.approx(1 - kernels.beta_cdf(*(np.array([v]) for v in (1 - u, b, a)))[0], abs=1e-12)
    assert kernels.beta_cdf(np.array([0.25]), np.array([1.0]), np.array([3.0]))[0] == pytest.approx(1 - 0.75**3, abs=1e-14)
    odd = kernels.beta_cdf(np.array([-1.0, 0.0, 1.0, 2.0, np.nan]), np.full(5, 2.0), np.full(5, 3.0))
    assert odd[:4].tolist() == [0.0, 0.0, 1.0, 1.0] and np.isnan(odd[4])


def bisected(p, low, high, cdf):
    left, right = low.copy(), high.copy()
    for _ in range(80):
        middle = (left + right) / 2
        below = cdf(middle) < p
        left, right = np.where(below, middle, left), np.where(below, right, middle)
    return (left + right) / 2


@pytest.mark.parametrize("a,b", [(2.0, 3.5), (0.6, 0.8), (40.0, 3.0), (1.0, 1.0)])
def test_quantiles_against_bisection(a, b):
    p = np.concatenate([np.linspace(0.001, 0.999, 500), [1e-9, 1 - 1e-9]])
    one, zero = np.ones_like(p), np.zeros_like(p)
    found = kernels.beta_quantile(p, -2 * one, 3 * one, a * one, b * one)
    assert np.abs(found - (-2 + 5 * bisected(p, zero, one, lambda x: kernels.beta_cdf(x, a * one, b * one)))).max() < 1e-10 * 5
    parameters = (zero, 10 * one, a * one, b * one)
    found = kernels.truncated_normal_quantile(p, *parameters)
    off = np.abs(found - bisected(p, zero, 10 * one, lambda x: kernels.truncated_normal_cdf(x, *parameters)))
    assert off[:500].max() < 1e-10 and off.max() < 1e-7  # the last probability is only known to 10^-7 of its own distance from one
    # Far from the mean both ends of the support lie in one tail.
    far = (30 * one, 31 * one, zero, one)
    found = kernels.truncated_normal_quantile(p, *far)
    assert (np.diff(found[:500]) > 0).all() and found.min() >= 30 and np.abs(kernels.truncated_normal_cdf(found, *far) - p).max() < 1e-9


def test_kernels_do_many_rows_a_second():
    p = np.random.default_rng(1).uniform(0, 1, 100_000)
    one = np.ones_like(p)
    for quantile, parameters in ((kernels.truncated_normal_quantile, (0 * one, 10 * one, 4 * one, 3 * one)), (kernels.beta_quantile, (0 * one, one, 2 * one, 3.5 * one))):
        began = time.thread_time()
        quantile(p, *parameters)
        assert len(p) / (time.thread_time() - began) > 20_000  # 80 halvings value by value made some 1,500
