"""Keyed, ordered, overlapping and expanding joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranges import BEFORE, RANGE, across, carried, dealt, with_carried, within


def duplicated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n of keys that several rows have."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def join_accepted(texts: DataFrame, report: DataFrame, keys: Sequence[str], keep: Sequence[str], disposition: str = "disposition", payload: str | None = None) -> DataFrame:
    """texts with report's other columns as a struct ``verdict``, for reports whose disposition is kept; payload: a column of both
    that must agree. Stops if a kept key is reported twice or a payload differs. The report is cut to what is kept before the join."""
    kept = report.where(F.col(disposition).isin(*keep))
    if not duplicated(kept, keys).isEmpty():
        raise ValueError("a key is reported twice")
    rest = [c for c in kept.columns if c not in keys]
    joined = texts.join(kept.select(*keys, F.struct(*rest).alias("verdict")), list(keys))
    if payload:
        same = F.col(payload).eqNullSafe(F.col(f"verdict.{payload}"))
        joined = joined.withColumn(payload, F.when(same, F.col(payload)).otherwise(F.raise_error(F.lit(f"{payload} differs between texts and report"))))
    return joined


#: Columns of a pair in each mode. Fixed values.
PAIR_MODES = ("default", "poisoning", "training")


def agent_pairs(texts: DataFrame, manifest: DataFrame | None, keys: Sequence[str], order: Sequence[str], mode: str = "default") -> DataFrame:
    """texts with input_audio and ground_truth_edit_audio. default: the last render of each key that didn't fail is the truth;
    poisoning: its baseline is the input as well, and the text's own input goes to original_clean_audio; training: no render at all."""
    if mode not in PAIR_MODES or (manifest is None) != (mode == "training"):
        raise ValueError("the mode is unknown, or training comes with a manifest, or another mode without")
    if mode == "training":
        return texts.withColumn("ground_truth_edit_audio", F.lit(""))
    done = manifest.where(~F.col("status").eqNullSafe("error"))
    found = texts.join(last_per_key(done.select(*keys, *order, F.struct("output_path", "baseline_path").alias("_r")), keys, order).select(*keys, "_r"), list(keys))
    out = found.withColumn("ground_truth_edit_audio", F.col("_r.output_path"))
    if mode == "poisoning":
        out = out.withColumn("original_clean_audio", F.col("input_audio")).withColumn("input_audio", F.col("_r.baseline_path"))
    return out.drop("_r")


def last_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the order given."""
    rest = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return kept.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def pair_with_render(texts: DataFrame, manifest: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """texts joined with each key's last row of the manifest."""
    return texts.join(last_per_key(manifest, keys, order), list(keys))


def assembled_text(*parts: Column) -> Column:
    """Distinct parts (strings or arrays of strings) in order, joined by spaces, lower-cased; nulls are left out."""
    return F.lower(F.array_join(F.array_distinct(F.array_compact(F.concat(*parts))), " "))


def pending(inputs: DataFrame, outputs: DataFrame, keys: Sequence[str], done: Column | None = None) -> DataFrame:
    """Inputs without an output that is done; those that failed count as not done."""
    finished = outputs if done is None else outputs.where(F.coalesce(done, F.lit(False)))
    return inputs.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], compare: str) -> DataFrame:
    """One row: matched, mismatched (of the matched), only_left, only_right; both sides unique in keys."""
    a = left.select(*keys, F.col(compare).alias("_a"), F.lit(1).alias("_l"))
    b = right.select(*keys, F.col(compare).alias("_b"), F.lit(1).alias("_r"))
    both = a.join(b, list(keys), "full_outer")
    hit = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.agg(F.count_if(hit).alias("matched"), F.count_if(hit & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("mismatched"), F.count_if(F.col("_r").isNull()).alias("only_left"), F.count_if(F.col("_l").isNull()).alias("only_right"))


def upgrade_reference(rows: DataFrame, baselines: DataFrame, keys: Sequence[str], poisoned: str) -> DataFrame:
    """rows whose reference is replaced by a baseline's where there is one, but for poisoned rows."""
    known = baselines.select(*keys, F.col("reference").alias("_b"))
    upgraded = F.when(F.col("_b").isNotNull() & ~F.coalesce(F.col(poisoned), F.lit(False)), F.col("_b")).otherwise(F.col("reference"))
    return rows.join(known, list(keys), "left").withColumn("reference", upgraded).drop("_b")


def from_provenance(rows: DataFrame, used: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows that a provenance table names."""
    return rows.join(used.select(*keys).distinct(), list(keys), "left_semi")


def next_after(events: DataFrame, targets: DataFrame, keys: Sequence[str], at: str, target: str, until: Column | None = None, ranges: int | None = None) -> DataFrame:
    """events with the first target after each of them in its group, up to ``until`` (a column of events) if given; null without one.

    Both go into one table, dealt to ranges of group and place. The next target is carried back over a range, and over the borders of
    ranges by a table of each range's first target, so a group may have any size and no pairs are made. Targets at the same place
    don't count as after.
    """
    limit = F.lit(None) if until is None else until
    e = events.select("*", limit.alias("_until"), F.lit(0).alias("_kind"), F.lit(None).alias("_t"))
    t = targets.select(*keys, F.col(at), F.struct(F.col(at).alias("at"), F.col(target).alias("value")).alias("_t"), F.lit(1).alias("_kind"))
    both = dealt(e.withColumn("_t", F.lit(None).cast(t.schema["_t"].dataType)).unionByName(t, allowMissingColumns=True), keys, [at], ranges)
    later = within(keys).orderBy(F.col(at).desc(), F.col("_kind").asc()).rowsBetween(Window.unboundedPreceding, 0)
    parts = both.groupBy(*keys, RANGE).agg(F.min_by("_t", F.when(F.col("_t").isNotNull(), F.col(at))).alias("_first"))
    carry = carried(parts, keys, _after=F.last("_first", ignorenulls=True).over(across(keys, forward=False).rowsBetween(*BEFORE)))
    found = both.withColumn("_own", F.last("_t", ignorenulls=True).over(later)).where("_kind = 0")
    out = with_carried(found, carry, keys).withColumn("_n", F.coalesce("_own", "_after"))
    hit = F.col("_n").isNotNull() & (F.col("_until").isNull() | (F.col("_n.at") < F.col("_until")))
    return out.select(*events.columns, F.when(hit, F.col("_n.at")).alias("next_at"), F.when(hit, F.col("_n.value")).alias("next_target"))


def with_only_target(found: DataFrame, targets: DataFrame, keys: Sequence[str], target: str, out: str = "next_target") -> DataFrame:
    """found with ``out`` filled, where it is null, by the target of its group if all targets of the group are the same one."""
    only = targets.groupBy(*keys).agg(F.min(target).alias("_only"), F.max(target).alias("_other")).where("_only = _other").drop("_other")
    return found.join(only, list(keys), "left").withColumn(out, F.coalesce(out, "_only")).drop("_only")


def _slots(lo: Column, hi: Column, width: float, levels: int) -> Column:
    """The fewest slots of widths width * 2^level that together are the unit slots from lo to hi: at most two of each level."""
    first, end = F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long") + 1
    parts = []
    for k in range(levels + 1):
        a, b = -F.shiftright(-first, k), F.shiftright(end, k)
        node = lambda x, k=k: F.struct(F.lit(k).alias("level"), x.alias("slot"))
        parts += [F.when((a < b) & (F.pmod(a, F.lit(2)) == 1), node(a)), F.when((a < b) & (F.pmod(b, F.lit(2)) == 1), node(b - 1))]
        if k == levels:  # what is left in the widest level is all of it
            parts = parts[:-2] + [F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: node(x)))]
    return F.concat(F.array_compact(F.array(*parts[:-1])), F.coalesce(parts[-1], F.array())) if levels else F.coalesce(parts[-1], F.array())


def _above(point: Column, width: float, levels: int) -> Column:
    """The slots of all levels that a point lies in."""
    unit = F.floor(point / width).cast("long")
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(unit, k).alias("slot")) for k in range(levels + 1)])


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Pairs of intervals (keys, lo, hi) that share more than a point, right's columns with the prefix r_.

    The later start of such a pair lies in the other interval. So starts meet intervals: an interval is cut into slots whose widths are
    width times powers of two, at most two of each, a start goes into one slot of each width, and equal slots meet. A pair meets in one
    slot only. An interval over the whole range makes a few dozen rows, whatever the width.
    """
    r = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    sizes = [d.select(F.lit(side).alias("side"), (F.floor(F.col(hi) / width) - F.floor(F.col(lo) / width) + 1).alias("n")) for side, d, lo, hi in ((0, left, "lo", "hi"), (1, r, "r_lo", "r_hi"))]
    longest = {x.side: x.n for x in sizes[0].unionByName(sizes[1]).groupBy("side").agg(F.max("n").alias("n")).collect()}
    levels = [max(int(longest.get(side) or 1) - 1, 0).bit_length() for side in (0, 1)]
    shared = (F.col("lo") < F.col("r_hi")) & (F.col("r_lo") < F.col("hi"))
    slots = lambda d, lo, hi, k: d.withColumn("_s", F.explode(_slots(F.col(lo), F.col(hi), width, k)))
    starts = lambda d, lo, k: d.withColumn("_s", F.explode(_above(F.col(lo), width, k)))
    columns = [*left.columns, *[c for c in r.columns if c not in keys]]
    one = slots(left, "lo", "hi", levels[0]).join(starts(r, "r_lo", levels[0]), [*keys, "_s"]).where(shared & (F.col("r_lo") >= F.col("lo")))
    other = starts(left, "lo", levels[1]).join(slots(r, "r_lo", "r_hi", levels[1]), [*keys, "_s"]).where(shared & (F.col("lo") > F.col("r_lo")))
    return one.select(*columns).unionByName(other.select(*columns))


def region_status(regions: DataFrame, supports: DataFrame, keys: Sequence[str]) -> DataFrame:
    """regions (keys, rule, lo, hi) with status against observed supports (keys, s_lo, s_hi): live, vacuous (the whole support lies
    inside), dormant (none does) or unreachable (nothing was observed)."""
    joined = regions.join(supports, list(keys), "left")
    status = F.when(F.col("s_lo").isNull(), "unreachable").when((F.col("lo") <= F.col("s_lo")) & (F.col("s_hi") <= F.col("hi")), "vacuous").when((F.col("lo") <= F.col("s_hi")) & (F.col("s_lo") <= F.col("hi")), "live").otherwise("dormant")
    return joined.withColumn("status", status).drop("s_lo", "s_hi")


#: What keeps a rule from firing, the first of them that any of its leaves shows. Fixed values.
BLOCKING = ("unreachable_operator", "dormant_no_param", "dormant_distribution")


def rule_status(leaves: DataFrame, supports: DataFrame, placeable: DataFrame) -> DataFrame:
    """rule, status of rules by their leaves (rule, operator, parameter, lo, hi), supports (operator, parameter, s_lo, s_hi) and the
    operators that can be placed.

    A leaf without an operator reads something else than parameters; one with an operator alone asks only whether it is there. A rule
    is unreachable_operator, dormant_no_param (no support) or dormant_distribution (the support lies outside) if any leaf is, in this
    order; vacuous if every parameter's support lies wholly inside; data_dependent if no leaf reads a parameter; else live.
    """
    known = placeable.select("operator").distinct().withColumn("_placed", F.lit(True))
    joined = leaves.join(known, "operator", "left").join(supports.select("operator", "parameter", "s_lo", "s_hi"), ["operator", "parameter"], "left")
    status = F.when(F.col("operator").isNotNull() & F.col("_placed").isNull(), "unreachable_operator").when(F.col("operator").isNull() | F.col("parameter").isNull(), "data_dependent")
    status = status.when(F.col("s_lo").isNull(), "dormant_no_param").when((F.col("lo") > F.col("s_hi")) | (F.col("s_lo") > F.col("hi")), "dormant_distribution")
    status = status.when((F.col("lo") <= F.col("s_lo")) & (F.col("s_hi") <= F.col("hi")), "vacuous").otherwise("live")
    seen = joined.select("rule", status.alias("_s")).groupBy("rule").agg(*[F.bool_or(F.col("_s") == s).alias(s) for s in (*BLOCKING, "vacuous", "live")])
    out = F.when(F.col(BLOCKING[0]), BLOCKING[0]).when(F.col(BLOCKING[1]), BLOCKING[1]).when(F.col(BLOCKING[2]), BLOCKING[2])
    return seen.select("rule", out.when(F.col("live"), "live").when(F.col("vacuous"), "vacuous").otherwise("data_dependent").alias("status"))


def band_coverage(values: DataFrame, keys: Sequence[str], value: str, uppers: Sequence[float]) -> DataFrame:
    """keys, band, n: observed values by band, zero for bands that nothing reaches, -1 for values above the top."""
    band = F.lit(-1)
    for k in reversed(range(len(uppers))):
        band = F.when(F.col(value) < uppers[k], F.lit(k)).otherwise(band)
    counts = values.groupBy(*keys, band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    bands = F.explode(F.array(*[F.lit(k) for k in range(len(uppers))])).alias("band")
    every = counts.select(*keys).distinct().select("*", bands) if keys else values.sparkSession.range(1).select(bands)
    missing = every.join(counts, [*keys, "band"], "left_anti").withColumn("n", F.lit(0).cast("long"))
    return counts.unionByName(missing)


def common_grid(spark: SparkSession, low: float, high: float, n: int, scale: str = "linear") -> DataFrame:
    """bin, b_lo, b_hi: n bins of equal width, or of equal ratio on a log scale."""
    edge = lambda k: F.lit(low) * F.pow(F.lit(high / low), k / n) if scale == "log" else F.lit(low) + k * ((high - low) / n)
    return spark.range(n).select(F.col("id").alias("bin"), edge(F.col("id")).alias("b_lo"), edge(F.col("id") + 1).alias("b_hi"))


def redistribute(intervals: DataFrame, bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, bin, mass: the mass of intervals (keys, lo, hi, mass) by their overlap with bins (bin, b_lo, b_hi), a fixed grid. An
    interval without width gives all to the bin that holds it."""
    point = F.col("lo") == F.col("hi")
    joined = intervals.join(F.broadcast(bins), (F.col("lo") < F.col("b_hi")) & (F.col("b_lo") < F.col("hi")) | point & (F.col("b_lo") <= F.col("lo")) & (F.col("lo") < F.col("b_hi")))
    share = F.when(point, F.lit(1.0)).otherwise((F.least("hi", "b_hi") - F.greatest("lo", "b_lo")) / (F.col("hi") - F.col("lo")))
    return joined.groupBy(*keys, "bin").agg(F.sum(F.col("mass") * share).alias("mass"))


def expansion_size(rows: DataFrame, factors: Sequence[int]) -> int:
    """Rows that an expansion would make at most."""
    size = rows.count()
    for f in factors:
        size *= max(f, 1)
    return size


def expand(rows: DataFrame, recipes: DataFrame, grids: Mapping[str, Sequence], when: Column | None = None, targets: str | None = None, cap: int | None = 32, keys: Sequence[str] = (), seed: str = "expand", most: int | None = None, poisons: DataFrame | None = None, poison_when: Column | None = None, recipe: str = "recipe") -> DataFrame:
    """rows x recipes (a small table) x targets (an array column) x grids of parameter values, filtered by ``when``.

    The condition on rows and recipes is applied before targets and grids are spread. cap: variants kept for each of keys, by seeded
    order; most: an error before anything runs if the product could be larger. poisons: a small table (recipe and what a poison
    brings): each plan comes once with every poison of its recipe for which ``poison_when`` holds, with nulls if its recipe has none,
    and not at all if it has some and none holds.
    """
    from ..functions.text import stable_noise

    if most is not None and (n := expansion_size(rows, [recipes.count(), *map(len, grids.values()), *([] if poisons is None else [poisons.count()])])) > most:
        raise ValueError(f"the expansion could make {n} rows")
    wide = rows.crossJoin(F.broadcast(recipes))
    wide = wide if when is None else wide.where(when)
    if targets:
        wide = wide.withColumn("target", F.explode(targets))
    if poisons is not None:
        wide = wide.join(F.broadcast(poisons.withColumn("_poison", F.lit(True))), recipe, "left")
        holds = F.lit(True) if poison_when is None else F.coalesce(poison_when, F.lit(False))
        wide = wide.where(F.col("_poison").isNull() | holds).drop("_poison")
    for name, values in grids.items():
        wide = wide.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    if cap and keys:
        identity = [*keys, *(["target"] if targets else []), *([c for c in poisons.columns if c != recipe] if poisons is not None else []), *grids]
        noise = stable_noise(F.lit(seed), *[F.col(c) for c in identity])
        w = Window.partitionBy(*keys).orderBy("_noise", *identity)
        wide = wide.withColumn("_noise", noise).withColumn("variant", F.row_number().over(w)).where(F.col("variant") <= cap).drop("_noise")
    return wide


def matched_rules(rows: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the one rule (keys, rule, subtypes, equals) that they match: subtype among its subtypes (none: any) and all of equals
    in their parameters. Two matches of a row, found by its column ``id``, stop the job."""
    r = rules.select(*keys, "rule", F.col("subtypes").alias("_s"), F.col("equals").alias("_e"))
    ok = (F.size("_s") == 0) | F.array_contains("_s", F.col("subtype"))
    same = F.forall(F.map_entries("_e"), lambda e: F.coalesce(F.element_at("parameters", e["key"]) == e["value"], F.lit(False)))
    hits = rows.join(F.broadcast(r), list(keys)).where(ok & same).select("id", "rule").groupBy("id").agg(F.min("rule").alias("rule"), F.count(F.lit(1)).alias("_n"))
    checked = hits.withColumn("rule", F.when(F.col("_n") > 1, F.raise_error(F.lit("a row matches two rules"))).otherwise(F.col("rule"))).drop("_n")
    return rows.join(checked, "id", "left")


def mapped_targets(rows: DataFrame, tags: str, mapping: DataFrame, key: str) -> DataFrame:
    """key, targets: array of struct(priority, stem, tag), distinct by (stem, family) at the first tag, unmapped tags and the stem
    ``other`` dropped, by priority, stem and tag. mapping: tag, stem, family, priority."""
    spread = rows.select(key, F.posexplode(tags).alias("_at", "tag")).join(mapping, "tag").where("stem <> 'other'")
    first = spread.groupBy(key, "stem", "family").agg(F.min_by(F.struct("priority", "tag"), "_at").alias("f"))
    item = F.struct((-F.col("f.priority")).alias("p"), "stem", F.col("f.tag").alias("tag"))
    found = first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct((-x["p"]).alias("priority"), x["stem"].alias("stem"), x["tag"].alias("tag"))).alias("targets"))
    return rows.select(key).distinct().join(found, key, "left").withColumn("targets", F.coalesce("targets", F.array().cast(found.schema["targets"].dataType)))


def resolved_dependencies(references: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """references with path and issue: the one file of its keys, or missing or ambiguous."""
    counted = files.groupBy(*keys).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("_n"))
    joined = references.join(counted, list(keys), "left")
    issue = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous")
    return joined.withColumn("issue", issue).withColumn("path", F.when(F.col("_n") == 1, F.col("path"))).drop("_n")


def assembled(parts: Mapping[str, DataFrame], key: str, items: Sequence[str]) -> DataFrame:
    """key and one array column per part with its rows' items as structs, sorted; keys of any part appear."""
    typed = [d.select(key, F.lit(n).alias("_part"), F.struct(*items).alias("_item")) for n, d in parts.items()]
    rows = typed[0]
    for d in typed[1:]:
        rows = rows.unionByName(d)
    return rows.groupBy(key).agg(*[F.sort_array(F.collect_list(F.when(F.col("_part") == n, F.col("_item")))).alias(n) for n in parts])


def missing_artifacts(manifest: DataFrame, listing: DataFrame, path: str = "output_path") -> DataFrame:
    """manifest with reason: no_path, missing_file, empty_file, or null for one that is there."""
    known = listing.select(F.col("path").alias("_p"), F.col("length").alias("_l"))
    joined = manifest.join(known, F.col(path) == F.col("_p"), "left")
    return joined.withColumn("reason", F.when(F.col(path).isNull(), "no_path").when(F.col("_p").isNull(), "missing_file").when(F.col("_l") == 0, "empty_file")).drop("_p", "_l")


def present_only(rows: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """rows whose file is listed; those without a path stay."""
    known = listing.select(F.col("path").alias("_p")).distinct()
    return rows.join(known, F.col(path) == F.col("_p"), "left").where(F.col(path).isNull() | F.col("_p").isNotNull()).drop("_p")


def cache_status(requests: DataFrame, cache: DataFrame, key: str, version: str) -> DataFrame:
    """status, n: requests that the cache answers (hit), has under another version (stale), or lacks (miss). Of several entries of a
    key one of the right version counts."""
    known = cache.groupBy(F.col(key).alias("_key"), F.col(version).alias("_version")).agg(F.lit(1).alias("_has"))
    keys = known.groupBy(F.col("_key").alias("_any")).agg(F.lit(1).alias("_old"))
    joined = requests.join(known, (F.col(key) == F.col("_key")) & (F.col(version) == F.col("_version")), "left").join(keys, F.col(key) == F.col("_any"), "left")
    status = F.when(F.col("_has").isNotNull(), "hit").when(F.col("_old").isNotNull(), "stale").otherwise("miss")
    return joined.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def overlay(rows: DataFrame, over: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """rows whose columns are replaced by those of ``over`` where these aren't null."""
    top = over.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in columns])
    return rows.join(top, list(keys), "left").select(*[F.coalesce(f"_o_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def parameter_provenance(occurrences: DataFrame, definitions: DataFrame, row_level: DataFrame, location: Sequence[str], row_key: str) -> DataFrame:
    """occurrences with prior, factor, offset, resolved_value, status: a definition of the row wins over the configured one; two of a
    location are ambiguous; none is authored; a factor of zero is fixed."""
    one = definitions.groupBy(*location).agg(F.min(F.struct("prior", "factor", "offset")).alias("_d"), F.count(F.lit(1)).alias("_n"))
    own = row_level.select(row_key, *location, F.struct("prior", "factor", "offset").alias("_r"))
    joined = occurrences.join(one, list(location), "left").join(own, [row_key, *location], "left")
    d = F.coalesce("_r", "_d")
    status = F.when(F.col("_r").isNull() & (F.col("_n") > 1), "ambiguous").when(d.isNull(), "authored").when(d["factor"] == 0, "fixed").otherwise("prior")
    return joined.select(*occurrences.columns, status.alias("status"), F.when(status == "prior", d["prior"]).alias("prior"), F.when(status == "prior", F.try_divide(F.col("value") - d["offset"], d["factor"])).alias("resolved_value"))


def resolved_parameters(occurrences: DataFrame, definitions: DataFrame, row_keys: Sequence[str], location: Sequence[str], context: str) -> DataFrame:
    """occurrences with status, reference and resolved_value, by definitions (location, kind, reference, factor, offset); context is a
    map column of numbers that the row knows (its tempo, say) by name.

    kind: sample (of the prior ``reference``), values, literal, ref (a context name), tempo (beats of a prior, at the tempo that
    ``context`` has under ``bpm``), anything else has no scalar prior. A value is led back through ``factor`` and ``offset`` (1 and 0
    if null); a factor of zero is fixed. status is prior, fixed, authored, context or the reason why nothing is known.
    """
    known = definitions.select(*location, F.struct("kind", "reference", F.coalesce("factor", F.lit(1.0)).alias("factor"), F.coalesce("offset", F.lit(0.0)).alias("offset")).alias("_d"))
    times = occurrences.groupBy(*row_keys, *location).agg(F.count(F.lit(1)).alias("_n"))
    joined = occurrences.join(times, [*row_keys, *location]).join(known, list(location), "left")
    d = F.col("_d")
    read, bpm = F.try_element_at(context, d["reference"]), F.try_element_at(context, F.lit("bpm"))
    status = F.when(F.col("_n") > 1, "ambiguous location").when(d.isNull(), "no definition").when((d["kind"] == "literal") | (d["factor"] == 0), "fixed")
    status = status.when(d["kind"] == "sample", "prior").when(d["kind"] == "values", "authored")
    status = status.when(d["kind"] == "ref", F.when(read.isNotNull(), F.lit("context")).otherwise(F.concat(F.lit("missing context: "), d["reference"])))
    status = status.when(d["kind"] == "tempo", F.when(bpm.isNotNull(), "prior").otherwise("missing tempo")).otherwise("no scalar prior")
    back = (F.col("value") - d["offset"]) / F.when(d["factor"] != 0, d["factor"])
    led = F.col("status").isin("prior", "authored", "context")
    found = joined.withColumn("status", status)
    return found.select(*occurrences.columns, "status", F.when(F.col("status") == "prior", d["reference"]).alias("reference"), F.when(led & (d["kind"] == "tempo"), back * bpm / 60.0).when(led, back).otherwise(F.col("value")).alias("resolved_value"))


def missing_parameters(definitions: DataFrame, occurrences: DataFrame, row_keys: Sequence[str], scope: Sequence[str], location: Sequence[str]) -> DataFrame:
    """row_keys, location: configured locations of a row's scope (its recipe, say) that the row lacks."""
    due = occurrences.select(*row_keys, *scope).distinct().join(definitions.select(*scope, *location).distinct(), list(scope))
    return due.join(occurrences.select(*row_keys, *location).distinct(), [*row_keys, *location], "left_anti").select(*row_keys, *location)
