"""Seeded draws: every number comes from a hash of stable keys, so equal keys draw equal values on any cluster."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions.text import stable_noise
from .rank import counts_below


def weighted_choice(u: Column, weights: Mapping[str, float]) -> Column:
    """The name whose part of the cumulated weights holds u in [0, 1); names without weight are never drawn."""
    total = sum(weights.values())
    names = [n for n, w in weights.items() if w > 0]
    found, upto = F.lit(names[-1]), 1.0
    bounds, done = [], 0.0
    for n in names:
        done += weights[n] / total
        bounds.append((n, done))
    for n, upto in reversed(bounds[:-1]):
        found = F.when(u < upto, F.lit(n)).otherwise(found)
    return found


def drawn(rows: DataFrame, components: DataFrame, keys: Sequence[str], seed: str, prior: str = "prior") -> DataFrame:
    """rows with component, value_text, value: a component of the row's prior by weight, then a value of it, from two seeded
    numbers of the row's keys and prior."""
    w = Window.partitionBy("prior").orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("weight").over(Window.partitionBy("prior"))
    ranged = components.withColumn("_to", F.sum("weight").over(w) / total).withColumn("_last", F.row_number().over(Window.partitionBy("prior").orderBy(F.desc("component"))) == 1)
    ranged = ranged.withColumn("_from", F.col("_to") - F.col("weight") / total)
    ranged = ranged.select(F.col("prior").alias("_prior"), F.struct(*ranged.columns).alias("_k"))
    name, c = F.col(prior), lambda field: F.col(f"_k.{field}")
    keyed = rows.withColumn("_u", stable_noise(F.lit(seed), F.lit("component"), *map(F.col, keys), name)).withColumn("_p", stable_noise(F.lit(seed), F.lit("value"), *map(F.col, keys), name))
    joined = keyed.join(F.broadcast(ranged), name == F.col("_prior")).where((F.col("_u") >= c("_from")) & ((F.col("_u") < c("_to")) | c("_last")))
    _, a, b = D._space(c, c("low"))
    kernel = D.kernel_quantile(c("family"), F.col("_p"), a, b, F.coalesce(c("mean"), c("alpha")), F.coalesce(c("std"), c("beta")))
    x = F.when(c("family").isin(*D.KERNELS), F.when(c("scale") == "log", F.exp(kernel)).otherwise(kernel)).otherwise(D.closed_quantile(F.col("_p"), c))
    text = F.when(c("family") == D.DISCRETE, c("value")).otherwise(x.cast("string"))
    value = F.when(c("family") == D.DISCRETE, c("value").try_cast("double")).otherwise(x)
    return joined.select(*[F.col(n) for n in rows.columns], c("component").alias("component"), text.alias("value_text"), value.alias("value"))


def sampled_plans(rows: DataFrame, recipes: DataFrame, parameters: DataFrame, components: DataFrame, keys: Sequence[str], count: int, seed: str, when: Column | None = None) -> DataFrame:
    """keys, recipe, sample, parameter, prior, component, value_text, value: count plans of each row and recipe (a small table) that
    ``when`` allows, each with one draw for every parameter (recipe, parameter, prior) of its recipe."""
    wide = rows.crossJoin(F.broadcast(recipes))
    wide = (wide if when is None else wide.where(when)).select(*keys, "recipe", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("sample"))
    due = wide.join(F.broadcast(parameters.select("recipe", "parameter", "prior")), "recipe").select(*keys, "recipe", "sample", "parameter", "prior")
    return drawn(due, components, [*keys, "recipe", "sample", "parameter"], seed)


def setting_table(spark: SparkSession, priors: Mapping[str, Mapping]) -> tuple[DataFrame, DataFrame]:
    """(options, components): options (prior, option, from, to, parameters: array of parameter and leaf) of all priors, whose leaves,
    called prior#option.parameter, are the priors of components. As large as the configuration."""
    options, leaves = [], {}
    for prior, spec in priors.items():
        done = 0.0
        for k, (weight, setting) in enumerate(D.settings(spec, priors)):
            names = {p: f"{prior}#{k}.{p}" for p in setting}
            leaves |= {names[p]: leaf for p, leaf in setting.items()}
            options.append((prior, k, done, done + weight, list(names.items())))
            done += weight
        options[-1] = (*options[-1][:3], 1.0, options[-1][4])
    schema = "prior string, option int, from double, to double, parameters array<struct<parameter: string, leaf: string>>"
    return spark.createDataFrame(options, schema), D.component_table(spark, leaves)


def drawn_settings(rows: DataFrame, options: DataFrame, components: DataFrame, keys: Sequence[str], seed: str, prior: str = "prior") -> DataFrame:
    """keys, prior, option, parameter, value_text, value: one option of each row's prior by weight, then each of its parameters. All
    parameters of a row come from one option; within it they are drawn apart. rows are unique in keys and prior."""
    named = options.select(F.col("prior").alias("_prior"), "option", "from", "to", "parameters")
    u = stable_noise(F.lit(seed), F.lit("option"), *map(F.col, keys), F.col(prior))
    chosen = rows.select(*keys, F.col(prior).alias("prior"), u.alias("_u")).join(F.broadcast(named), (F.col("prior") == F.col("_prior")) & (F.col("_u") >= F.col("from")) & (F.col("_u") < F.col("to")))
    spread = chosen.select(*keys, "prior", "option", F.inline("parameters"))
    return drawn(spread, components, [*keys, "parameter"], seed, "leaf").select(*keys, "prior", "option", "parameter", "value_text", "value")


def sampler_check(draws: DataFrame, components: DataFrame, limit: float = 0.025) -> DataFrame:
    """prior, n, outside, distance, fits of draws (prior, value_text, value): the Kolmogorov-Smirnov distance of a continuous prior,
    the total variation of a discrete one, and whether that is under the limit with nothing outside the support.

    Distances come from counts by distinct value, ranked in ordered ranges, never in one task.
    """
    families = components.groupBy("prior").agg(F.max(F.col("family") == D.DISCRETE).alias("discrete"))
    total = draws.groupBy("prior").agg(F.count(F.lit(1)).alias("n"))
    texts = draws.join(families.where("discrete"), "prior").groupBy("prior", F.col("value_text").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    both = texts.join(components.where(F.col("family") == D.DISCRETE).select("prior", "value", "weight"), ["prior", "value"], "full_outer").join(total, "prior")
    discrete = both.groupBy("prior").agg(F.first("n").alias("n"), F.coalesce(F.sum(F.when(F.col("weight").isNull(), F.col("c"))), F.lit(0)).alias("outside"), (F.sum(F.abs(F.coalesce("c", F.lit(0)) / F.col("n") - F.coalesce("weight", F.lit(0.0)))) / 2).alias("distance"))
    values = draws.join(families.where("not discrete"), "prior").select("prior", "value")
    below = counts_below(values, "value", ["prior"]).select("prior", F.col("value").alias("at"), "below", F.col("n").alias("same"), F.col("total").alias("n"))
    inside = D.mixture_cdf(below, components, ["at", "below", "same", "n"], value="at")
    ranged = components.where(F.col("family") != D.DISCRETE).groupBy("prior").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    gap = F.greatest(F.abs(F.col("below") / F.col("n") - F.col("cdf")), F.abs((F.col("below") + F.col("same")) / F.col("n") - F.col("cdf")))
    continuous = inside.join(ranged, "prior").groupBy("prior").agg(F.first("n").alias("n"), F.coalesce(F.sum(F.when(~F.col("value").between(F.col("low"), F.col("high")), F.col("same"))), F.lit(0)).alias("outside"), F.max(gap).alias("distance"))
    return discrete.unionByName(continuous).withColumn("fits", (F.col("outside") == 0) & (F.col("distance") < limit))


def first_valid(rows: DataFrame, keys: Sequence[str], n: int, valid, attempts: int = 20) -> DataFrame:
    """The first n of attempts * n numbered attempts of each row for which ``valid`` (a function of the frame with attempt, giving
    the frame with a column ok) holds."""
    tried = rows.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(attempts * n))))
    good = valid(tried).where("ok").drop("ok")
    return good.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("attempt"))).where(F.col("_k") <= n).withColumnRenamed("_k", "variant")


def synthetic_manifest(rows: DataFrame, key: str, joint: Mapping[str, float], tags: Mapping[str, Sequence[str]], rates: Mapping[str, float], seed: str) -> DataFrame:
    """key, combination, stems, tags and a flag for each rate, for every row: a combination (names joined by +) by weight, one tag
    of each of its stems, and independent flags."""
    u = lambda *parts: stable_noise(F.lit(seed), *parts, F.col(key))
    stems = F.filter(F.split(weighted_choice(u(F.lit("combination")), joint), r"\+"), lambda s: s != "")
    named = F.create_map(*[x for s, t in tags.items() for x in (F.lit(s), F.array(*map(F.lit, t)))])
    out = rows.select(key, stems.alias("stems"))
    pick = lambda s: F.get(named[s], F.floor(stable_noise(F.lit(seed), F.lit("tag"), s, F.col(key)) * F.size(named[s])).cast("int"))
    return out.select(key, F.array_join("stems", "+").alias("combination"), "stems", F.transform("stems", pick).alias("tags"), *[(u(F.lit(f"rate {n}")) < r).alias(n) for n, r in rates.items()])


def sampled_against_expected(counts: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, rate, expected, z of counts (key, n, hits) against rates (key, expected)."""
    rate = F.col("hits") / F.col("n")
    q = F.col("expected")
    return counts.join(expected, key).select(key, rate.alias("rate"), q.alias("expected"), F.try_divide(rate - q, F.sqrt(q * (1 - q) / F.col("n"))).alias("z"))
