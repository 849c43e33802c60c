"""Queries over distributions, vectors, ranks and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions import vectors as V
from ..functions.text import stable_noise
from ..operators import rank as K
from ..registry import register
from .nested import table

NOISE = "('0x' || substr(sha256('{seed}|' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


def similarities(spark, sf_dir):
    """Cosine of each vector with the one of least id under its label."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", "label", F.round(V.cosine(F.col("embedding"), F.col("first")), 6).alias("similarity"))


SIMILAR = """
s AS (
  SELECT e.vec_id, e.label, round(coalesce(list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * f.first[i]::DOUBLE)), lambda a, x: a + x)
    / nullif(sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE)), lambda a, x: a + x))
      * sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(f.first, lambda x: x::DOUBLE * x::DOUBLE)), lambda a, x: a + x)), 0), 0), 6) AS similarity
  FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY label) f ON e.label = f.label)
"""


@register("similarity_percentiles", f"""
WITH {SIMILAR},
p AS (SELECT vec_id, similarity, round(100.0::DOUBLE * ((SELECT count(*) FROM s t WHERE t.similarity < s.similarity) + 0.5::DOUBLE * (SELECT count(*) FROM s t WHERE t.similarity = s.similarity)) / (SELECT count(*) FROM s), 4) AS percentile FROM s)
SELECT vec_id, similarity, percentile, CASE WHEN percentile < 25 THEN 'most_audible' WHEN percentile < 50 THEN 'audible' WHEN percentile < 75 THEN 'subtle' ELSE 'least_audible' END AS percentile_bucket,
  (SELECT count(*) FROM s) AS percentile_n FROM p
""")  # fmt: skip
def similarity_percentiles(spark, sf_dir):
    """Cosine, then its place in the population."""
    return K.mid_rank(similarities(spark, sf_dir), "similarity").drop("label")


@register("stale_population", "SELECT count(*) + 1 AS recorded, count(*) AS current, true AS stale FROM embeddings")
def stale_population(spark, sf_dir):
    """is the recorded population still the one that there is?"""
    rows = table(spark, sf_dir, "embeddings")
    total = rows.agg((F.count(F.lit(1)) + 1).alias("percentile_n"))
    return K.stale(rows.crossJoin(F.broadcast(total)), "vec_id")


@register("frame_levels", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 8) AS rms, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak,
  round(20 * log10(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding))), 6) AS crest FROM embeddings
""")  # fmt: skip
def frame_levels(spark, sf_dir):
    """Level statistics of frames."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.rms(e), 8).alias("rms"), V.peak(e).alias("peak"), F.round(V.crest_db(e), 6).alias("crest"))


@register("price_bands", """
SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 0 WHEN p_retailprice < 1020 THEN 1 ELSE 2 END AS band, p_retailprice >= 1080 AS overflow,
  1.0::DOUBLE - (CASE WHEN p_retailprice < 950 THEN 0 WHEN p_retailprice < 1020 THEN 1 ELSE 2 END + 0.5::DOUBLE) / 3 AS intensity FROM part
""")  # fmt: skip
def price_bands(spark, sf_dir):
    """Half-open bands, overflow and intensity."""
    found = D.band_of(F.col("p_retailprice"), [950.0, 1020.0, 1080.0], "descending")
    return table(spark, sf_dir, "part").select("p_partkey", found["band"].alias("band"), found["overflow"].alias("overflow"), found["intensity"].alias("intensity"))


PRIORS = {
    "total": {"type": "uniform", "low": 1000.0, "high": 400000.0},
    "log_total": {"type": "log_uniform", "low": 1000.0, "high": 400000.0},
    "power_total": {"type": "power_law", "low": 1000.0, "high": 400000.0, "exponent": 0.5},
    "bins_total": {"type": "histogram", "edges": [1000.0, 100000.0, 400000.0], "weights": [1.0, 3.0]},
    "mixed_total": {"type": "mixture", "components": [{"weight": 3, "model": {"type": "uniform", "low": 0.0, "high": 100000.0}}, {"weight": 1, "model": {"type": "uniform", "low": 200000.0, "high": 300000.0}}]},
}


@register("prior_bins", """
WITH x AS (SELECT o_orderkey, o_totalprice AS v FROM orders),
f AS (
  SELECT o_orderkey, v, 'total' AS prior, (v - 1000) / 399000.0::DOUBLE AS f, v BETWEEN 1000 AND 400000 AS s FROM x
  UNION ALL SELECT o_orderkey, v, 'log_total', (ln(v) - ln(1000.0::DOUBLE)) / (ln(400000.0::DOUBLE) - ln(1000.0::DOUBLE)), v BETWEEN 1000 AND 400000 FROM x
  UNION ALL SELECT o_orderkey, v, 'power_total', (exp(1.5 * ln(v / 1000.0)) - 1) / (exp(1.5 * ln(400.0::DOUBLE)) - 1), v BETWEEN 1000 AND 400000 FROM x
  UNION ALL SELECT o_orderkey, v, 'bins_total', CASE WHEN v < 100000 THEN 0.25 * (v - 1000) / 99000.0 ELSE 0.25 + 0.75 * (v - 100000) / 300000.0 END, v BETWEEN 1000 AND 400000 FROM x
  UNION ALL SELECT o_orderkey, v, 'mixed_total', 0.75 * least(v, 100000.0) / 100000.0 + 0.25 * greatest(0.0, least(1.0, (v - 200000) / 100000.0)), v <= 100000 OR v BETWEEN 200000 AND 300000 FROM x)
SELECT prior, CASE WHEN s THEN 'quantile:' || least(floor(f * 10), 9)::INT END AS bin, s AS in_support, count(*) AS n, round(sum(CASE WHEN s THEN f ELSE 0 END), 3) AS mass FROM f GROUP BY 1, 2, 3
""")  # fmt: skip
def prior_bins(spark, sf_dir):
    """Values against priors, closed families and a mixture, and the bins that they fall into."""
    components = D.component_table(spark, PRIORS)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"), F.col("o_totalprice").cast("string").alias("value_text"), F.explode(F.array(*map(F.lit, PRIORS))).alias("prior"))
    found = D.placed(rows, components, 10, ["o_orderkey"])
    return found.groupBy("prior", "bin", "in_support").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(F.col("in_support"), F.col("cdf")).otherwise(0.0)), 3).alias("mass"))


@register("category_bins", """
SELECT CASE WHEN l_quantity IN (10, 20, 30) THEN 'category:' || l_quantity::VARCHAR END AS bin, l_quantity IN (10, 20, 30) AS in_support, count(*) AS n FROM lineitem GROUP BY 1, 2
""")  # fmt: skip
def category_bins(spark, sf_dir):
    """Discrete priors; weights merged over a mixture."""
    prior = {"type": "mixture", "components": [{"weight": 1, "model": {"type": "choice", "values": [{"value": 10, "weight": 3}, 20]}}, {"weight": 1, "model": {"type": "choice", "values": [20, 30]}}]}
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("value"), F.col("l_quantity").cast("string").alias("value_text"), F.lit("q").alias("prior"))
    counted = rows.groupBy("value", "value_text", "prior").agg(F.count(F.lit(1)).alias("k"))
    found = D.placed(counted, D.component_table(spark, {"q": prior}), 10, ["value", "k"])
    return found.groupBy("bin", "in_support").agg(F.sum("k").alias("n"))


@register("quantile_round_trip", """
SELECT p_partkey, prior, CASE prior WHEN 'total' THEN round(1000 + u * 399000, 4) WHEN 'log_total' THEN round(exp(ln(1000.0::DOUBLE) + u * (ln(400000.0::DOUBLE) - ln(1000.0::DOUBLE))), 4)
  WHEN 'power_total' THEN round(exp(ln(1000.0::DOUBLE) + ln(1 + u * (exp(1.5 * ln(400.0::DOUBLE)) - 1)) / 1.5), 4) ELSE round(CASE WHEN u <= 0.25 THEN 1000 + u / 0.25 * 99000 ELSE 100000 + (u - 0.25) / 0.75 * 300000 END, 4) END AS x
FROM (SELECT p_partkey, (p_partkey % 97 + 0.5) / 97 AS u, unnest(['total', 'log_total', 'power_total', 'bins_total']) AS prior FROM part)
""")  # fmt: skip
def quantile_round_trip(spark, sf_dir):
    """Quantiles of the closed families."""
    components = D.component_table(spark, {k: v for k, v in PRIORS.items() if k != "mixed_total"})
    rows = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 97 + 0.5) / 97).alias("u"))
    return rows.crossJoin(F.broadcast(components)).select("p_partkey", "prior", F.round(D.closed_quantile(F.col("u")), 4).alias("x"))


@register("enumerated_supports", """
SELECT p_brand, count(*) * 5 AS n, sum(p_size * 1.0::DOUBLE + (p_size + p_size + 10) / 2.0 + p_size + 10) AS total FROM part GROUP BY 1
""")  # fmt: skip
def enumerated_supports(spark, sf_dir):
    """Declared values of supports that come from the data, one per part."""
    part = table(spark, sf_dir, "part")
    none = {f: F.lit(None) for f in ("mean", "std", "alpha", "beta", "exponent", "value", "edges", "bin_weights")}
    kinds = {"mean": "double", "std": "double", "alpha": "double", "beta": "double", "exponent": "double", "value": "string", "edges": "array<double>", "bin_weights": "array<double>"}
    empty = [none[f].cast(k).alias(f) for f, k in kinds.items()]
    size = F.col("p_size").cast("double")
    base = [F.concat_ws("/", "p_brand", "p_partkey").alias("prior"), F.lit(1.0).alias("weight")]
    uniform = part.select(*base, F.lit(0).alias("component"), F.lit("uniform").alias("family"), F.lit("linear").alias("scale"), size.alias("low"), (size + 10).alias("high"), *empty)
    fixed = part.select(*base, F.explode(F.array(F.lit(1), F.lit(2))).alias("component"), F.lit(D.DISCRETE).alias("family"), F.lit(None).cast("string").alias("scale"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), *[c for f, c in zip(kinds, empty) if f != "value"], F.lit("x").alias("value"))
    rows = D.enumerate_support(uniform.unionByName(fixed))
    return rows.groupBy(F.split_part("prior", F.lit("/"), F.lit(1)).alias("p_brand")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@register("kernel_quantiles", None)
def kernel_quantiles(spark, sf_dir):
    """Truncated normal and beta, their quantiles put back through their distribution functions; SQL has neither."""
    components = D.component_table(spark, {"n": {"type": "normal", "low": 0.0, "high": 10.0, "mean": 4.0, "std": 3.0}, "b": {"type": "beta", "low": 0.0, "high": 1.0, "alpha": 2.0, "beta": 3.5}})
    rows = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 97 + 0.5) / 97).alias("u")).crossJoin(F.broadcast(components))
    x = rows.withColumn("x", D.kernel_quantile("family", "u", "low", "high", F.coalesce("mean", "alpha"), F.coalesce("std", "beta")))
    return D.with_cdf(x, "x").select("p_partkey", "prior", "u", F.round("x", 9).alias("x"), (F.abs(F.col("cdf") - F.col("u")) < 1e-9).alias("returns"))


@register("sampled_lines", f"""
SELECT l_orderkey, l_linenumber, l_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY {NOISE.format(seed='s1', key="l_orderkey || '|' || l_linenumber || '|' || l_partkey")}, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) WHERE k <= 50
""")  # fmt: skip
def sampled_lines(spark, sf_dir):
    """Seeded rows of each group."""
    rows = table(spark, sf_dir, "lineitem")
    return K.sample_per_group(rows, ["l_returnflag", "l_linestatus"], 50, "s1", "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@register("held_out_orders", f"""
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE k <= 500) AS held FROM (SELECT *, row_number() OVER (ORDER BY {NOISE.format(seed='h', key='o_orderkey')}, o_orderkey) AS k FROM orders) GROUP BY 1
""")  # fmt: skip
def held_out_orders(spark, sf_dir):
    """An exact hold-out."""
    rows = K.hold_out(table(spark, sf_dir, "orders"), 500, "h", "o_orderkey")
    return rows.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if("held_out").alias("held"))


@register("weighted_picks", f"""
SELECT p_brand, p_partkey, draw FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY -ln({NOISE.format(seed='w', key='p_partkey')} + power(2.0::DOUBLE, -53)) / p_size, p_partkey)::INT AS draw FROM part WHERE p_size > 0) WHERE draw <= 3
""")  # fmt: skip
def weighted_picks(spark, sf_dir):
    """weighted sampling without replacement."""
    return K.weighted_sample(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 3, "w", "p_partkey").select("p_brand", "p_partkey", "draw")


@register("event_day_islands", """
WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM events),
g AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d),
i AS (SELECT user_id, min(day) AS first, max(day) AS last FROM g GROUP BY user_id, g)
SELECT user_id, list(CASE WHEN first = last THEN first::VARCHAR ELSE first || '-' || last END ORDER BY first) AS ranges FROM i GROUP BY 1
""")  # fmt: skip
def event_day_islands(spark, sf_dir):
    """consecutive days as ranges."""
    days = table(spark, sf_dir, "events").select("user_id", F.unix_date(F.to_date("ts")).alias("day"))
    return K.ranges_text(K.islands(days, ["user_id"], "day"), ["user_id"])


@register("event_type_runs", """
WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c)
SELECT user_id, max(run)::BIGINT AS runs, max(n) AS longest FROM (SELECT user_id, run, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1
""")  # fmt: skip
def event_type_runs(spark, sf_dir):
    """runs of equal neighbours."""
    rows = K.runs_of_equal(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")
    return rows.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("run").alias("runs"), F.max("n").alias("longest"))


@register("first_orders", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def first_orders(spark, sf_dir):
    """the first row of each key."""
    return K.first_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@register("order_variants", """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INT AS variant FROM orders
""")  # fmt: skip
def order_variants(spark, sf_dir):
    """numbers within a recipe."""
    return K.numbered(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "variant")


@register("capped_orders", f"""
WITH n AS (SELECT *, {NOISE.format(seed='c', key='o_orderkey')} AS z, o_orderstatus = 'P' AS r FROM orders),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY z, o_orderkey) AS c FROM n) WHERE c <= 3),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY z, o_orderkey) AS i FROM k)
SELECT r AS random, count(*) AS n FROM o WHERE i <= CASE WHEN r THEN 150 ELSE 850 END GROUP BY 1
""")  # fmt: skip
def capped_orders(spark, sf_dir):
    """caps per key and a limited share of random rows, under a seeded policy."""
    rows = table(spark, sf_dir, "orders").withColumn("random", F.col("o_orderstatus") == "P")
    return K.capped(rows, ["o_custkey"], 3, 1000, "random", 0.15, "c", "o_orderkey").groupBy("random").agg(F.count(F.lit(1)).alias("n"))


@register("repaired_chains", """
SELECT l_orderkey, list(l_returnflag ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 9 END, l_returnflag) AS chain FROM lineitem GROUP BY 1
""")  # fmt: skip
def repaired_chains(spark, sf_dir):
    """steps in the order of their ranks."""
    chains = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_returnflag")).alias("c"))
    return chains.select("l_orderkey", K.repair_order(F.col("c"), {"R": 1, "A": 2}).alias("chain"))


@register("ordered_targets", """
SELECT p_brand, p_type || '/' || p_partkey AS target, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_type, p_partkey) AS rank FROM part
""")  # fmt: skip
def ordered_targets(spark, sf_dir):
    """G1: candidates by priority."""
    found = K.ranked_targets(table(spark, sf_dir, "part"), ["p_brand"], ["p_size", "p_type"], "p_partkey", [F.desc("p_size"), F.col("p_type")])
    return found.select("p_brand", F.concat_ws("/", "p_type", "p_partkey").alias("target"), "rank")


@register("listed_targets", """
SELECT o_orderkey, list(l_returnflag || '/' || l_linenumber || '/' || l_partkey ORDER BY -l_quantity, l_returnflag, l_linenumber || '/' || l_partkey) AS targets FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")  # fmt: skip
def listed_targets(spark, sf_dir):
    """G1: the candidates of each order as an array, by priority; an order has few lines."""
    item = F.struct(F.col("l_quantity").alias("priority"), F.col("l_returnflag").alias("stem"), F.concat_ws("/", "l_linenumber", "l_partkey").alias("tag"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(item).alias("t"))
    rows = rows.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    return rows.select("o_orderkey", F.transform(K.ordered_targets(F.col("t")), lambda x: F.concat_ws("/", x["stem"], x["tag"])).alias("targets"))


@register("largest_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def largest_orders(spark, sf_dir):
    """A top-k report."""
    return K.first_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), "o_orderkey")


@register("batched_paths", "SELECT l_suppkey, count(*) AS n, 1::BIGINT AS partitions FROM lineitem GROUP BY 1")
def batched_paths(spark, sf_dir):
    """Rows of one input in one partition, next to each other."""
    rows = K.batches_by(table(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey", "b").withColumn("p", F.spark_partition_id())
    return rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p").alias("partitions"))


@register("flag_shares", """
SELECT l_returnflag, l_linestatus, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_returnflag) AS share FROM lineitem GROUP BY 1, 2
""")  # fmt: skip
def flag_shares(spark, sf_dir):
    """shares within a group."""
    return K.share_within(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_returnflag"])


@register("goodness_of_fit", """
WITH v AS (SELECT o_orderpriority, o_totalprice AS x, (o_totalprice - 1000) / 399000.0::DOUBLE AS f, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, n, count(DISTINCT x) AS distinct_values, count(*) FILTER (WHERE x NOT BETWEEN 1000 AND 400000) AS out_of_support,
  round(max(greatest(i::DOUBLE / n - least(greatest(f, 0), 1), least(greatest(f, 0), 1) - (i - 1)::DOUBLE / n)), 9) AS cdf_distance, count(DISTINCT CASE WHEN x BETWEEN 1000 AND 400000 THEN least(floor(f * 10), 9) END) AS occupied_bins FROM v GROUP BY 1, 2
""")  # fmt: skip
def goodness_of_fit(spark, sf_dir):
    """Distance of the observed values from a prior, by group."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").alias("x"))
    counts = K.counts_below(rows, "x", ["o_orderpriority"])
    model = D.component_table(spark, {"total": PRIORS["total"]})
    f = D.closed_cdf(F.col("x"))
    i, n = F.col("below"), F.col("total")
    high = F.greatest((i + F.col("n")) / n - f, f - i / n)
    inside = F.col("x").between(F.col("low"), F.col("high"))
    found = counts.crossJoin(F.broadcast(model.select("family", "scale", "low", "high", "exponent", "edges", "bin_weights")))
    return found.groupBy("o_orderpriority").agg(
        F.max("total").alias("n"), F.count(F.lit(1)).alias("distinct_values"), F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("out_of_support"),
        F.round(F.max(high), 9).alias("cdf_distance"), F.countDistinct(F.when(inside, F.least(F.floor(f * 10), F.lit(9)))).alias("occupied_bins"),
    )


@register("total_variation", """
WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_returnflag) AS t FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, round(sum(CASE WHEN l_linenumber <= 4 THEN abs(n::DOUBLE / t - 0.25) ELSE n::DOUBLE / t END) / 2, 9) AS total_variation FROM c GROUP BY 1
""")  # fmt: skip
def total_variation(spark, sf_dir):
    """Total variation from a discrete prior, what is outside included."""
    shares = K.share_within(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], ["l_returnflag"])
    expected = D.component_table(spark, {"p": {"type": "int_uniform", "low": 1, "high": 4}}).select(F.col("value").cast("double").cast("int").alias("l_linenumber"), F.col("weight").alias("p"))
    flags = shares.select("l_returnflag").distinct().crossJoin(F.broadcast(expected))
    both = shares.join(flags, ["l_returnflag", "l_linenumber"], "full_outer")
    return both.groupBy("l_returnflag").agg(F.round(F.sum(F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("p", F.lit(0.0)))) / 2, 9).alias("total_variation"))


@register("weighted_ecdf", """
SELECT l_returnflag, l_quantity, sum(sum(l_tax * 100)) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(sum(l_tax * 100)) OVER (PARTITION BY l_returnflag) > 0.5 AS upper, width.b AS bin
FROM (SELECT *, least(floor((l_quantity - 1) / 49.0 * 8), 7)::INT AS b FROM lineitem) width GROUP BY l_returnflag, l_quantity, width.b
""")  # fmt: skip
def weighted_ecdf(spark, sf_dir):
    """Weighted distribution on distinct values, and bins."""
    from ..operators import stats as S

    found = S.weighted_ecdf(table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_tax") * 100), ["l_returnflag"], "l_quantity", "w")
    return found.select("l_returnflag", "l_quantity", (F.col("ecdf") > 0.5).alias("upper"), S.bin_of(F.col("l_quantity"), 1.0, 50.0, 8).alias("bin"))


@register("weighted_choices", f"""
SELECT choice, count(*) AS n FROM (SELECT CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS choice FROM (SELECT {NOISE.format(seed='i1', key='o_orderkey')} AS u FROM orders)) GROUP BY 1
""")  # fmt: skip
def weighted_choices(spark, sf_dir):
    """Weighted choices from seeded numbers."""
    u = stable_noise(F.lit("i1"), F.col("o_orderkey"))
    from ..operators.sampling import weighted_choice

    return table(spark, sf_dir, "orders").select(weighted_choice(u, {"a": 5.0, "b": 3.0, "c": 2.0}).alias("choice")).groupBy("choice").agg(F.count(F.lit(1)).alias("n"))
