"""Queries over distributions of several parameters, their draws, and weighted or binned values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions import text as T
from ..operators import joins as J
from ..operators import sampling as P
from ..operators import stats as S
from ..registry import register
from .selected import NOISE


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PRIORS = {
    "wet": {"type": "uniform", "low": 0.0, "high": 0.5},
    "tone": {"type": "joint", "components": [
        {"weight": 3, "parameters": {"gain": {"type": "uniform", "low": -6.0, "high": 0.0}, "mix": {"sample": "wet"}}},
        {"weight": 1, "parameters": {"gain": {"type": "uniform", "low": 0.0, "high": 6.0}, "mix": {"type": "choice", "values": [1.0]}}},
    ]},
    "wide": {"type": "mixture", "components": [{"weight": 0.3, "distribution": {"type": "uniform", "low": 0.0, "high": 10.0}}, {"weight": 0.7, "distribution": {"type": "uniform", "low": 5.0, "high": 30.0}}]},
}
DRAWN = {name: NOISE.format(seed=f"j|{kind}", key=f"p_partkey || '|{tail}'") for name, kind, tail in (("o", "option", "tone"), ("g0", "value", "gain|tone#0.gain"), ("g1", "value", "gain|tone#1.gain"), ("m0", "value", "mix|tone#0.mix"))}


@register("joint_draws", f"""
WITH u AS (SELECT p_partkey, {", ".join(f"{sql} AS {name}" for name, sql in DRAWN.items())} FROM part)
SELECT p_partkey, CASE WHEN o < 0.75 THEN 0 ELSE 1 END AS option, round(CASE WHEN o < 0.75 THEN -6 + g0 * 6 ELSE g1 * 6 END, 6) AS gain, round(CASE WHEN o < 0.75 THEN m0 * 0.5::DOUBLE ELSE 1 END, 6) AS mix FROM u
""")  # fmt: skip
def joint_draws(spark, sf_dir):
    """A setting for each part, both parameters from one component, references followed."""
    options, components = P.setting_table(spark, {k: PRIORS[k] for k in ("tone", "wet")})
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("tone").alias("prior"))
    found = P.drawn_settings(rows, options, components, ["p_partkey"], "j")
    return found.groupBy("p_partkey", "option").agg(*[F.round(F.max(F.when(F.col("parameter") == n, F.col("value"))), 6).alias(n) for n in ("gain", "mix")])


@register("marginal_bins", """
WITH x AS (SELECT p_partkey, (p_size % 13 - 6)::DOUBLE AS v FROM part),
f AS (SELECT p_partkey, v, CASE WHEN v <= 0 THEN 0.75::DOUBLE * (v + 6) / 6 ELSE 0.75::DOUBLE + 0.25::DOUBLE * v / 6 END AS cdf FROM x)
SELECT p_partkey, round(cdf, 9) AS cdf FROM f
""")  # fmt: skip
def marginal_bins(spark, sf_dir):
    """Values against the marginal of one parameter of a joint distribution."""
    components = D.component_table(spark, {k: PRIORS[k] for k in ("tone", "wet")})
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("tone.gain").alias("prior"), (F.col("p_size") % 13 - 6).cast("double").alias("value"))
    return D.mixture_cdf(rows, components, ["p_partkey"]).select("p_partkey", F.round("cdf", 9).alias("cdf"))


@register("mixture_quantiles", """
WITH c AS (SELECT * FROM (VALUES (0.3::DOUBLE, 0.0::DOUBLE, 10.0::DOUBLE), (0.7::DOUBLE, 5.0::DOUBLE, 30.0::DOUBLE)) t(w, low, high)),
g AS (SELECT low + (k + 0.5::DOUBLE) / 1024 * (high - low) AS value, w / 1024 AS w FROM c, range(0, 1024) r(k)),
s AS (SELECT value, sum(w) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM g),
q AS (SELECT p, min(value) AS value FROM s, (SELECT unnest([0.1003::DOUBLE, 0.3707, 0.5201, 0.9309]) AS p) WHERE upto >= p GROUP BY p)
SELECT p_brand, p, round(value, 6) AS quantile, count(*) FILTER (WHERE p_size < value) AS n FROM part, q GROUP BY ALL
""")  # fmt: skip
def mixture_quantiles(spark, sf_dir):
    """Quantiles of a mixture, and the parts below each of them."""
    found = D.mixture_quantiles(D.component_table(spark, {"wide": PRIORS["wide"]}), [0.1003, 0.3707, 0.5201, 0.9309])
    rows = table(spark, sf_dir, "part").crossJoin(F.broadcast(found))
    return rows.groupBy("p_brand", "p", F.round("value", 6).alias("quantile")).agg(F.count_if(F.col("p_size") < F.col("value")).alias("n"))


@register("sampler_checks", f"""
WITH d AS (SELECT -6 + {NOISE.format(seed="check|value", key="p_partkey || '|tone#0.gain'")} * 6 AS v FROM part),
c AS (SELECT v, (v + 6) / 6 AS cdf, count(*) AS same, sum(count(*)) OVER (ORDER BY v) - count(*) AS below, sum(count(*)) OVER () AS n FROM d GROUP BY v),
g AS (SELECT max(n)::BIGINT AS n, max(greatest(abs(below / n - cdf), abs((below + same) / n - cdf))) AS distance FROM c)
SELECT 'tone#0.gain' AS prior, n, 0::BIGINT AS outside, round(distance, 6) AS distance, distance < 0.025 AS fits FROM g
""")  # fmt: skip
def sampler_checks(spark, sf_dir):
    """Draws of a prior against it, held to a distance of 0.025."""
    options, components = P.setting_table(spark, {k: PRIORS[k] for k in ("tone", "wet")})
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("tone#0.gain").alias("prior"))
    checked = P.sampler_check(P.drawn(rows, components, ["p_partkey"], "check"), components)
    return checked.select("prior", "n", "outside", F.round("distance", 6).alias("distance"), "fits")


@register("labelled_bands", """
SELECT p_partkey, CASE WHEN p_brand = 'Brand#4' THEN CASE WHEN p_size < 25 THEN 0 ELSE 1 END WHEN p_size < 10 THEN 0 WHEN p_size < 40 THEN 1 ELSE 2 END AS band,
  CASE WHEN p_brand = 'Brand#4' THEN p_size >= 45 ELSE p_size >= 50 END AS overflow FROM part
""")  # fmt: skip
def labelled_bands(spark, sf_dir):
    """Edges of their own for one label."""
    found = D.labelled_band(F.col("p_size"), F.col("p_brand"), [10, 40, 50], of_labels={"Brand#4": ([25, 45], "ascending")})
    return table(spark, sf_dir, "part").select("p_partkey", found["band"].alias("band"), found["overflow"].alias("overflow"))


@register("log_histogram", """
SELECT o_orderpriority, least(floor((ln(o_totalprice) - ln(100.0::DOUBLE)) / (ln(1000000.0::DOUBLE) - ln(100.0::DOUBLE)) * 9), 8)::INT AS bin, round(sum(o_custkey % 10), 6)::DOUBLE AS mass
FROM orders WHERE o_totalprice BETWEEN 100 AND 1000000 GROUP BY 1, 2
""")  # fmt: skip
def log_histogram(spark, sf_dir):
    """Weights on logarithmic edges."""
    rows = table(spark, sf_dir, "orders").withColumn("w", (F.col("o_custkey") % 10).cast("double"))
    return S.weighted_histogram(rows, ["o_orderpriority"], "o_totalprice", "w", 100.0, 1000000.0, 9, "log")


@register("log_grid_mass", """
WITH i AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(*)::DOUBLE AS mass FROM part GROUP BY 1 UNION ALL SELECT p_brand, max(p_retailprice), max(p_retailprice), 1 FROM part GROUP BY 1),
b AS (SELECT k AS bin, 500.0::DOUBLE * pow(8.0::DOUBLE, k / 12.0::DOUBLE) AS b_lo, 500.0::DOUBLE * pow(8.0::DOUBLE, (k + 1) / 12.0::DOUBLE) AS b_hi FROM range(0, 12) t(k))
SELECT p_brand, bin, round(sum(CASE WHEN lo = hi THEN mass ELSE mass * (least(hi, b_hi) - greatest(lo, b_lo)) / (hi - lo) END), 6) AS mass
FROM i JOIN b ON (lo < b_hi AND b_lo < hi) OR (lo = hi AND b_lo <= lo AND lo < b_hi) GROUP BY 1, 2
""")  # fmt: skip
def log_grid_mass(spark, sf_dir):
    """Masses on a logarithmic grid, points among the intervals."""
    part = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.count(F.lit(1)).cast("double").alias("mass"))
    points = part.select("p_brand", F.col("hi").alias("lo"), "hi", F.lit(1.0).alias("mass"))
    return J.redistribute(part.unionByName(points), J.common_grid(spark, 500.0, 4000.0, 12, "log"), ["p_brand"]).select("p_brand", "bin", F.round("mass", 6).alias("mass"))


@register("sign_partition", """
SELECT l_returnflag, CASE WHEN l_quantity < 25 THEN 'cut' WHEN l_quantity > 25 THEN 'boost' ELSE 'flat' END AS side, count(*) AS n, round(avg(l_quantity - 25), 6) AS mean FROM lineitem GROUP BY 1, 2
""")  # fmt: skip
def sign_partition(spark, sf_dir):
    """Settings by the sign of a control."""
    rows = table(spark, sf_dir, "lineitem").withColumn("gain", F.col("l_quantity") - 25)
    return S.sign_partition(rows, "gain", ["l_returnflag"]).select("l_returnflag", "side", "n", F.round("mean", 6).alias("mean"))


@register("cache_status", """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'miss' WHEN o_orderkey % 5 = 1 THEN 'stale' ELSE 'hit' END AS status, count(*) AS n FROM orders GROUP BY 1
""")  # fmt: skip
def cache_status(spark, sf_dir):
    """What a cache answers."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("v2").alias("version"))
    kind = F.col("o_orderkey") % 5
    cache = orders.where(kind > 0).withColumn("version", F.when(kind == 1, "v1").otherwise(F.col("version")))
    return J.cache_status(orders, cache.unionByName(cache.where(kind == 2).withColumn("version", F.lit("v1"))), "o_orderkey", "version")


@register("durations", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity, 3) AS duration FROM lineitem
""")  # fmt: skip
def durations(spark, sf_dir):
    """Lengths of spans from texts of seconds."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.duration(F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string")).alias("duration"))


@register("rendered_values", """
SELECT p_partkey, list_contains(list_distinct([p_size::VARCHAR]), p_size::VARCHAR) AS whole, p_retailprice = floor(p_retailprice) AS integral FROM part
""")  # fmt: skip
def rendered_values(spark, sf_dir):
    """Accepted spellings of numbers."""
    of = lambda v: T.value_renderings(v, 0)
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_contains(of(F.col("p_size")), F.col("p_size").cast("string")).alias("whole"), (F.array_contains(of(price), F.floor(price).cast("string")) & (price == F.floor(price))).alias("integral"))
