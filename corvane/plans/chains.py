"""Random chains under constraints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_noise
from ..operators.sampling import drawn, weighted_choice
from .values import with_parameters


def chosen_chains(rows: DataFrame, key: str, families: Mapping[str, float] | str, pool: DataFrame, lengths: tuple[int, int], order: Mapping[str, int], most: Mapping[str, int], seed: str, attempts: int = 20) -> DataFrame:
    """key, family, position, operator and the pool's further columns: the steps of one chain for each row.

    An attempt draws a family by weight (or takes it from a column of rows), a length, and so many operators of the family's pool (family, operator, weight, tag)
    without replacement; the first attempt that is long enough and holds no tag more often than ``most`` is kept. Operators are put in
    the order of their tags. Rows of which no attempt is valid have no chain.
    """
    given, span = isinstance(families, str), lengths[1] - lengths[0] + 1
    further = [c for c in pool.columns if c not in ("family", "operator", "weight", "tag")]
    pools = pool.where(F.col("weight") > 0).groupBy("family").agg(F.collect_list(F.struct("operator", "weight", "tag", *further)).alias("ops"))
    pools = pools.where("family is not null").agg(F.map_from_entries(F.collect_list(F.struct("family", "ops"))).alias("_pools"))
    own = rows.select(key, *([F.col(families).alias("_given")] if given else [])).crossJoin(F.broadcast(pools))

    def family(attempt: Column) -> Column:
        return F.col("_given") if given else weighted_choice(stable_noise(F.lit(seed), F.lit("family"), F.col(key), attempt), families)

    def steps(attempt: Column) -> Column:
        """at (of the pool), tag and draw of an attempt's steps: those of the least -ln(u) / weight, as weighted_sample draws them."""
        length = (lengths[0] + F.floor(stable_noise(F.lit(seed), F.lit("length"), F.col(key), attempt) * span)).cast("int")
        e = lambda o: -F.ln(stable_noise(F.lit(seed), F.col(key), attempt, o["operator"]) + F.lit(2.0**-53)) / o["weight"]
        scored = F.transform(F.try_element_at("_pools", family(attempt)), lambda o, i: F.struct(e(o).alias("e"), o["operator"].alias("operator"), i.alias("at"), o["tag"].alias("tag")))
        return F.transform(F.slice(F.sort_array(scored), F.lit(1), length), lambda s, k: F.struct(s["at"].alias("at"), s["tag"].alias("tag"), k.alias("draw")))

    def valid(found: Column) -> Column:
        holds = F.size(found) >= max(1, lengths[0])
        for tag, n in most.items():
            holds = holds & (F.size(F.filter(F.transform(found, lambda s: s["tag"]), F.lit(tag).__eq__)) <= n)
        return holds

    def is_valid(attempt: Column) -> Column:  # the steps are bound once
        return F.get(F.transform(F.array(steps(attempt)), valid), F.lit(0))

    # An attempt is made only where all before it failed; a row is tried in its own task.
    first = F.aggregate(F.sequence(F.lit(1), F.lit(attempts)), F.lit(None).cast("int"), lambda done, a: F.coalesce(done, F.when(is_valid(a), a)))
    kept = own.withColumn("_attempt", first).where("_attempt is not null").withColumn("_family", family(F.col("_attempt"))).withColumn("_ops", F.try_element_at("_pools", F.col("_family")))
    ranks = F.create_map(*[x for t, r in order.items() for x in (F.lit(t), F.lit(r))])
    ranked = F.sort_array(F.transform(steps(F.col("_attempt")), lambda s: F.struct(F.coalesce(ranks[s["tag"]], F.lit(1 << 30)).alias("rank"), s["draw"].alias("draw"), s["at"].alias("at"))))
    placed = kept.select(key, F.col("_family").alias("family"), "_ops", F.posexplode(ranked).alias("_p", "_s"))
    chosen = placed.select(key, "family", (F.col("_p") + 1).alias("position"), F.get("_ops", F.col("_s.at")).alias("_o"))
    return chosen.select(key, "family", "position", "_o.operator", *[F.col("_o").getField(c).alias(c) for c in further])


def random_chains(rows: DataFrame, key: str, families: Mapping[str, float] | str, pool: DataFrame, lengths: tuple[int, int], order: Mapping[str, int], most: Mapping[str, int], components: DataFrame, seed: str, attempts: int = 20) -> DataFrame:
    """key, family, position, operator, prior, component, value_text, value: chosen_chains of a pool that has a prior for each
    operator, from which each draws its parameter."""
    kept = chosen_chains(rows, key, families, pool, lengths, order, most, seed, attempts)
    return drawn(kept.select(key, "family", "position", "operator", "prior"), components, [key, "operator"], seed)


#: Blocks of a graph in each topology.
BLOCKS = {"serial": ("serial",), "send_return": ("send",), "serial_plus_send": ("serial", "send")}


def random_graphs(
    rows: DataFrame, key: str, families: Mapping[str, float] | str, topologies: Mapping[str, float], serial: Mapping, send: Mapping, levels: DataFrame, components: DataFrame, seed: str, forbidden: Sequence[str] = (),
    definitions: Mapping[str, Mapping[str, Any]] = {}, priors: Mapping[str, Mapping] = {}, context: Sequence[str] = (),
) -> DataFrame:
    """key, topology, family, block, position, operator, parameter, prior, value_text, value: a graph of one or two blocks for each row.

    A row draws a topology of BLOCKS and a family (or takes it from a column). serial and send hold pool, lengths, order and most of
    chosen_chains; in front of a send the serial block takes no operator of the forbidden tags. levels (topology, parameter, prior) are
    drawn for the bus, at position 0 of its block. Each value tells its prior. Rows of which a block finds no valid chain have no graph.

    Without definitions an operator has one parameter, named like the prior of its pool. With them (operator: parameter: spec) its
    parameters are those, as ``values`` compiles them over ``priors`` and the context: columns of rows (tempo and the like), and family
    if it is named. The result also has drawn and these columns.
    """
    u = lambda part: stable_noise(F.lit(seed), F.lit(part), F.col(key))
    family = F.col(families) if isinstance(families, str) else weighted_choice(u("family"), families)
    clip = [c for c in context if c != "family"]
    drawn_rows = rows.select(key, weighted_choice(u("topology"), topologies).alias("topology"), family.alias("family"), *clip)
    columns = [key, "block", "position", "operator", "parameter", "prior", "value_text", "value", *(["drawn"] if definitions else [])]

    def chains(wanted: Sequence[str], block: str, spec: Mapping, without: Sequence[str] = ()) -> DataFrame:
        pool = spec["pool"].where(~F.col("tag").isin(*without)) if without else spec["pool"]
        mine, limits = drawn_rows.where(F.col("topology").isin(*wanted)), (spec["lengths"], spec["order"], spec["most"])
        if definitions:
            return chosen_chains(mine, key, "family", pool, *limits, f"{seed}|{block}").select(key, "family", "position", "operator").withColumn("block", F.lit(block))
        made = random_chains(mine, key, "family", pool, *limits, components, f"{seed}|{block}")
        return made.withColumns({"parameter": F.col("prior"), "block": F.lit(block)}).select(*columns)

    both = chains(["serial"], "serial", serial).unionByName(chains(["serial_plus_send"], "serial", serial, forbidden)).unionByName(chains(["send_return", "serial_plus_send"], "send", send))
    if definitions:
        steps = both.join(drawn_rows.select(key, *clip), key) if clip else both
        both = with_parameters(steps, [key, "block"], definitions, priors, context, seed).select(*columns)
    bus = drawn(drawn_rows.join(F.broadcast(levels), "topology").select(key, "parameter", "prior"), components, [key, "parameter"], f"{seed}|bus")
    bus = bus.withColumns({"block": F.lit("send"), "position": F.lit(0), "operator": F.lit("send_bus"), "drawn": F.col("value_text")}).select(*columns)
    needed = F.create_map(*[x for t, b in BLOCKS.items() for x in (F.lit(t), F.lit(len(b)))])[F.col("topology")]
    chained = F.size(F.collect_set(F.when(F.col("operator") != "send_bus", F.col("block"))).over(Window.partitionBy(key)))  # a graph's rows are few
    facts = drawn_rows.select(key, "topology", "family", *clip)
    return facts.join(both.unionByName(bus), key).withColumn("_n", chained).where(F.col("_n") == needed).drop("_n")
