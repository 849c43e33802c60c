"""Queries over selections, fits and generated plans. Those without SQL are tested against slow versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dist as D
from ..operators import fit as X
from ..operators import sampling as P
from ..operators import select as G
from ..operators import stats as S
from ..plans.chains import random_chains, random_graphs
from ..registry import register
from .nested import spread, table
from .ranked import NOISE, PRIORS
from .statistics import MASKS, day_masks


def candidates(spark, sf_dir):
    """Plans with features from orders."""
    o = table(spark, sf_dir, "orders")
    feature = lambda d, b: F.struct(F.lit(d).alias("dim"), b.cast("string").alias("bin"))
    features = F.array(feature("recipe", F.col("o_orderpriority")), feature("price", F.floor(F.col("o_totalprice") / 20000)), feature("month", F.month("o_orderdate")))
    return o.select(F.col("o_orderkey").alias("plan_id"), (F.col("o_custkey") % 200).alias("clip_id"), F.col("o_orderpriority").alias("recipe_id"), (F.col("o_orderstatus") == "P").alias("random"), F.lit(False).alias("poisoned"), features.alias("features"))


@register("coverage_selection", None)
def coverage_selection(spark, sf_dir):
    """A selection that covers features; what was there and what was taken."""
    plans = candidates(spark, sf_dir)
    return G.coverage_table(plans, G.coverage_selection(plans, 300, cap=2, random_fraction=0.15))


@register("stratified_cover", None)
def stratified_cover(spark, sf_dir):
    """parts that bring most that is new."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"), F.array("p_brand").alias("brands"), F.array("p_type").alias("types"), "p_type", (F.col("p_size") / 100).alias("base"))
    return G.stratified_cover(part, "p_partkey", {"brands": 100.0, "types": 35.0, "words": 10.0}, 60, {"p_type": 12}, "base")


@register("diverse_variants", None)
def diverse_variants(spark, sf_dir):
    """extreme and distant variants of each group."""
    part = table(spark, sf_dir, "part")
    params = F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("price"), "p_retailprice")
    return G.diverse_variants(part.select("p_brand", F.col("p_partkey").alias("plan_id"), F.lit(1.0).alias("weight"), params.alias("params")), ["p_brand"], 4)


@register("fitted_families", None)
def fitted_families(spark, sf_dir):
    """The best family for each group."""
    rows = S.observation_weights(table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", "o_orderkey", "o_totalprice"), "o_orderpriority", "o_custkey")
    return X.fit_families(rows, ["o_orderpriority"], "o_totalprice", "weight", "o_orderkey", "o_custkey", 500.0, 600000.0)


@register("unthinned_sets", None)
def unthinned_sets(spark, sf_dir):
    """The sets behind thinned observations, and how many are in use in effect."""
    counts = S.mask_counts(day_masks(spark, sf_dir)).withColumn("segment", F.lit("all")).drop("size")
    joint = X.unthinned(counts, ["segment"], [0.9, 0.8, 0.7, 0.95], 5.0, 300)
    seen = X.thinned(joint, ["segment"], [0.9, 0.8, 0.7, 0.95]).withColumnRenamed("p", "seen")
    return joint.join(seen, ["segment", "mask"]).select("mask", F.round("p", 9).alias("p"), F.round("seen", 9).alias("seen"))


S4 = (0.9, 0.8, 0.7, 0.95)
THINNED = " * ".join(f"CASE WHEN (n.mask >> {k}) & 1 = 0 THEN 1.0 WHEN (s >> {k}) & 1 = 1 THEN {x} ELSE 1 - {x} END::DOUBLE" for k, x in enumerate(S4))


@register("size_residuals", f"""
WITH {MASKS}, n AS (SELECT mask, count(*) AS n FROM m GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS t FROM n),
o AS (SELECT bit_count(mask::BIGINT)::INT AS size, sum(n) / any_value(t) AS p FROM n, t GROUP BY 1),
e AS (SELECT bit_count(s)::INT AS size, sum(n / t * {THINNED}) AS p FROM n, t, range(16) r(s) WHERE s & n.mask = s GROUP BY 1),
d AS (SELECT k::INT AS size, coalesce(o.p, 0) AS observed, coalesce(e.p, 0) AS predicted FROM range(5) g(k) LEFT JOIN o ON o.size = k LEFT JOIN e ON e.size = k),
w AS (SELECT size AS worst_size, observed - predicted AS off, predicted FROM d ORDER BY abs(observed - predicted) DESC, size LIMIT 1)
SELECT size, round(observed, 9) AS observed, round(d.predicted, 9) AS predicted, worst_size, round(abs(off) / w.predicted, 9) AS worst_relative,
  CASE WHEN off > 0 AND (worst_size >= 3 OR worst_size <= 1) THEN 'understates' ELSE 'overstates' END AS direction, CASE WHEN off > 0 AND worst_size >= 3 THEN 'dense' WHEN off > 0 AND worst_size <= 1 THEN 'sparse' END AS overstated FROM d, w
""")  # fmt: skip
def size_residuals(spark, sf_dir):
    """Sizes of the sets seen against those that thinning predicts, and what the difference means."""
    counts = S.mask_counts(day_masks(spark, sf_dir)).withColumn("segment", F.lit("all")).drop("size")
    total = counts.groupBy("segment").agg(F.sum("n").alias("_t"))
    joint = counts.join(total, "segment").select("segment", "mask", (F.col("n") / F.col("_t")).alias("p"))
    found = X.cardinality_residuals(counts, X.thinned(joint, ["segment"], list(S4)), ["segment"], 4)
    rows = found.select(F.explode("residuals").alias("r"), "worst_size", F.round("worst_relative", 9).alias("worst_relative"), "direction", "overstated")
    return rows.select("r.size", F.round("r.observed", 9).alias("observed"), F.round("r.predicted", 9).alias("predicted"), "worst_size", "worst_relative", "direction", "overstated")


@register("raked_sets", None)
def raked_sets(spark, sf_dir):
    """A joint moved to target rates."""
    joint = S.smoothed_joint(S.mask_counts(day_masks(spark, sf_dir)), 4).withColumn("segment", F.lit("all"))
    return S.rounded_shares(X.raked(joint, ["segment"], {0: 0.5, 1: 0.4, 2: 0.3, 3: 0.2}), ["segment"], "p", "mask", 6).select("mask", "share")


@register("drawn_values", f"""
SELECT prior, count(*) AS n, round(sum(CASE prior WHEN 'total' THEN 1000 + u * 399000 ELSE exp(ln(1000.0::DOUBLE) + u * (ln(400000.0::DOUBLE) - ln(1000.0::DOUBLE))) END), 2) AS total
FROM (SELECT prior, {NOISE.format(seed='d|value', key="p_partkey || '|' || prior")} AS u FROM part, (SELECT unnest(['total', 'log_total']) AS prior)) GROUP BY 1
""")  # fmt: skip
def drawn_values(spark, sf_dir):
    """A component by weight, then a value of it."""
    components = D.component_table(spark, {k: PRIORS[k] for k in ("total", "log_total")})
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.lit("total"), F.lit("log_total"))).alias("prior"))
    return P.drawn(rows, components, ["p_partkey"], "d").groupBy("prior").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@register("sampled_plans", f"""
WITH p AS (SELECT * FROM (VALUES ('a', 'db', 'total'), ('a', 'hz', 'log_total'), ('b', 'db', 'total')) p(recipe, parameter, prior)),
r AS (SELECT c_custkey, recipe, unnest([1, 2, 3]) AS sample FROM customer, (VALUES ('a', 0), ('b', 5000)) r(recipe, least) WHERE c_acctbal >= least),
u AS (SELECT recipe, parameter, sample, {NOISE.format(seed='s|value', key="c_custkey || '|' || recipe || '|' || sample || '|' || parameter || '|' || prior")} AS u, prior FROM r JOIN p USING (recipe))
SELECT recipe, parameter, sample, count(*) AS n, round(sum(CASE prior WHEN 'total' THEN 1000 + u * 399000 ELSE exp(ln(1000.0::DOUBLE) + u * (ln(400000.0::DOUBLE) - ln(1000.0::DOUBLE))) END), 2) AS total FROM u GROUP BY 1, 2, 3
""")  # fmt: skip
def sampled_plans(spark, sf_dir):
    """Several plans of each customer and recipe, every parameter drawn anew."""
    recipes = spark.createDataFrame([("a", 0), ("b", 5000)], "recipe string, least int")
    parameters = spark.createDataFrame([("a", "db", "total"), ("a", "hz", "log_total"), ("b", "db", "total")], "recipe string, parameter string, prior string")
    components = D.component_table(spark, {k: PRIORS[k] for k in ("total", "log_total")})
    made = P.sampled_plans(table(spark, sf_dir, "customer"), recipes, parameters, components, ["c_custkey"], 3, "s", F.col("c_acctbal") >= F.col("least"))
    return made.groupBy("recipe", "parameter", "sample").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@register("synthetic_manifest", f"""
WITH u AS (SELECT c_custkey, {NOISE.format(seed='m|combination', key='c_custkey')} AS u, {NOISE.format(seed='m|rate noisy', key='c_custkey')} AS v FROM customer)
SELECT CASE WHEN u < 0.5 THEN 'drums+bass' WHEN u < 0.8 THEN 'vocals' ELSE '' END AS combination, v < 0.25 AS noisy, count(*) AS n FROM u GROUP BY 1, 2
""")  # fmt: skip
def synthetic_manifest(spark, sf_dir):
    """I4: a manifest row for every customer from a joint, tags and rates."""
    made = P.synthetic_manifest(table(spark, sf_dir, "customer"), "c_custkey", {"drums+bass": 5.0, "vocals": 3.0, "": 2.0}, {"drums": ["kick", "snare"], "bass": ["bass"], "vocals": ["voice", "choir"]}, {"noisy": 0.25}, "m")
    return made.groupBy("combination", "noisy").agg(F.count(F.lit(1)).alias("n"))


@register("first_valid_attempts", f"""
SELECT p_partkey, list(attempt ORDER BY attempt)[1:2] AS attempts FROM part, (SELECT unnest(range(1, 41))::INT AS attempt) WHERE {NOISE.format(seed='f', key="p_partkey || '|' || attempt")} < 0.3 GROUP BY 1
""")  # fmt: skip
def first_valid_attempts(spark, sf_dir):
    """F16: the first valid ones of numbered attempts."""
    from ..functions.text import stable_noise

    found = P.first_valid(spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey"), ["p_partkey"], 2, lambda d: d.withColumn("ok", stable_noise(F.lit("f"), F.col("p_partkey"), F.col("attempt")) < 0.3))
    return found.groupBy("p_partkey").agg(F.sort_array(F.collect_list("attempt")).alias("attempts"))


@register("random_chains", None)
def random_chains_of_customers(spark, sf_dir):
    """A constrained chain for every customer."""
    pool = spark.createDataFrame(
        [(f, o, w, t, p) for f in ("drums", "vocals") for o, w, t, p in (("gain", 3.0, "gain", "db"), ("eq", 2.0, "eq", "hz"), ("comp", 2.0, "dynamics", "db"), ("limit", 1.0, "dynamics", "db"), ("room", 1.0, "time", "mix")) if (f, o) != ("drums", "room")],
        "family string, operator string, weight double, tag string, prior string",
    )
    components = D.component_table(spark, {"db": {"type": "uniform", "low": -6.0, "high": 6.0}, "hz": {"type": "log_uniform", "low": 20.0, "high": 20000.0}, "mix": {"type": "choice", "values": [0.25, 0.5]}})
    return random_chains(spread(table(spark, sf_dir, "customer"), "c_custkey"), "c_custkey", {"drums": 2.0, "vocals": 1.0}, pool, (3, 4), {"eq": 0, "dynamics": 1, "gain": 2, "time": 3}, {"dynamics": 1}, components, "chain")


@register("random_graphs", None)
def random_graphs_of_customers(spark, sf_dir):
    """Graphs of serial and send blocks, their bus levels, and the prior of each value."""
    schema = "family string, operator string, weight double, tag string, prior string"
    serial = spark.createDataFrame([(f, o, w, t, p) for f in ("drums", "vocals") for o, w, t, p in (("gain", 3.0, "gain", "db"), ("eq", 2.0, "eq", "hz"), ("comp", 2.0, "dynamics", "db"), ("room", 1.0, "time", "mix"))], schema)
    send = spark.createDataFrame([(f, o, w, t, p) for f in ("drums", "vocals") for o, w, t, p in (("room", 3.0, "time", "mix"), ("echo", 2.0, "time", "mix"), ("cut", 1.0, "eq", "hz"))], schema)
    priors = {"db": {"type": "uniform", "low": -6.0, "high": 6.0}, "hz": {"type": "log_uniform", "low": 20.0, "high": 20000.0}, "mix": {"type": "choice", "values": [0.25, 0.5]}, "send": {"type": "choice", "values": [0.2, 0.35]}, "return": {"type": "choice", "values": [0.4, 0.65]}}
    levels = spark.createDataFrame([(t, p, p) for t in ("send_return", "serial_plus_send") for p in ("send", "return")], "topology string, parameter string, prior string")
    order = {"eq": 0, "dynamics": 1, "gain": 2, "time": 3}
    return random_graphs(
        spread(table(spark, sf_dir, "customer"), "c_custkey"), "c_custkey", {"drums": 2.0, "vocals": 1.0}, {"serial": 3.0, "send_return": 1.0, "serial_plus_send": 1.0},
        {"pool": serial, "lengths": (2, 3), "order": order, "most": {"dynamics": 1}}, {"pool": send, "lengths": (1, 2), "order": order, "most": {}}, levels, D.component_table(spark, priors), "graph", ["time"],
    )
