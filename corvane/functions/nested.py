"""Nested records: graphs of blocks and steps as one table of parameters, and the columns that read such records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.writers import scratch
from .text import strings, to_number

GRAPH = """array<struct<kind:string,name:string,operator:string,source:string,output:string,dry_level:double,send_level:double,return_level:double,
params:map<string,string>,steps:array<struct<name:string,operator:string,params:map<string,string>>>>>"""
BUS_LEVELS = ("dry_level", "send_level", "return_level")


def flatten_graph(plans: DataFrame, graph: str = "graph_spec", keep: Sequence[str] = ("clip_id", "plan_id")) -> DataFrame:
    """One row for each parameter of a plan's graph: keep, node (block index), block_kind, block_name, label, step (index), operator,
    parameter, value_text, value.

    Parameters come from the steps of a block, from a block that is a step itself, and from the levels of a send bus. A graph that is
    null or empty gives no rows; null parameters are left out. The one walker that everything else reads.
    """
    keys = [F.col(k) for k in keep]
    blocks = plans.select(*keys, F.posexplode(graph).alias("node", "b"))
    own = F.array(F.struct(F.coalesce("b.name", "b.operator").alias("name"), F.col("b.operator").alias("operator"), F.col("b.params").alias("params")))
    bus = F.array(F.struct(F.col("b.name").alias("name"), F.lit("send_bus").alias("operator"), F.map_from_arrays(F.array(*map(F.lit, BUS_LEVELS)), F.array(*[F.col(f"b.{c}").cast("string") for c in BUS_LEVELS])).alias("params")))
    none = F.array().cast("array<struct<name:string,operator:string,params:map<string,string>>>")
    steps = F.concat(F.coalesce("b.steps", none), F.when(F.col("b.kind") == "step", own).otherwise(none), F.when(F.col("b.kind") == "send_return", bus).otherwise(none))
    rows = blocks.select(*keys, "node", F.col("b.kind").alias("block_kind"), F.col("b.name").alias("block_name"), F.posexplode(steps).alias("step", "s"))
    rows = rows.select(*keys, "node", "block_kind", "block_name", F.col("s.name").alias("label"), "step", F.col("s.operator").alias("operator"), F.explode("s.params").alias("parameter", "value_text"))
    return rows.where("value_text is not null").withColumn("value", to_number(F.col("value_text")))


def flatten_json(rows: DataFrame, column: str, keep: Sequence[str], depth: int | None = None) -> DataFrame:
    """keep, path, value_text, value of every leaf of a JSON column, as a/b/0; with a depth, levels below it stay JSON text.

    Text that isn't JSON gives no rows, an empty container none either, a null leaf a null value. The text is parsed once; each level
    is written with what its containers hold, and the next one reads only those, until none is left.
    """
    spark = rows.sparkSession
    keys = [F.col(k) for k in keep]
    kind = F.schema_of_variant("v")
    container = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    level = rows.select(*keys, F.lit("").alias("path"), F.try_parse_json(column).alias("v")).where("v is not null")
    parts, at = [], 0
    while True:
        last = at == depth
        path = scratch(spark)
        level.withColumn("_open", F.lit(False) if last else container).write.partitionBy("_open").parquet(path)
        held = spark.read.schema(level.withColumn("_open", F.lit(True)).schema).parquet(path)
        parts.append(held.where("not _open").drop("_open"))
        opened = held.where("_open").drop("_open")
        if last or opened.isEmpty():
            break
        level, at = _opened(opened, keys), at + 1
    text = F.when(~F.is_variant_null("v"), F.coalesce(F.try_variant_get("v", "$", "string"), F.to_json("v")))
    leaves = reduce(DataFrame.unionByName, parts)
    return leaves.select(*keys, F.ltrim(F.col("path"), F.lit("/")).alias("path"), text.alias("value_text")).withColumn("value", to_number(F.col("value_text")))


def _opened(rows: DataFrame, keys: list[Column]) -> DataFrame:
    items, fields = F.try_variant_get("v", "$", "array<variant>"), F.try_variant_get("v", "$", "map<string,variant>")
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    numbered = F.transform(items, lambda x, i: F.struct(i.cast("string").alias("n"), x.alias("x")))
    named = F.transform(F.map_keys(fields), lambda k: F.struct(k.alias("n"), fields[k].alias("x")))
    spread = rows.select(*keys, "path", F.explode(F.when(is_list, numbered).otherwise(named)).alias("p"))
    return spread.select(*keys, F.concat_ws("/", "path", "p.n").alias("path"), F.col("p.x").alias("v")).where("v is not null")


def has_path(columns: DataFrame, path: str) -> bool:
    """Does a dotted path name a field of the schema?"""
    kind = columns.schema
    for part in path.split("."):
        kind = getattr(kind, "elementType", kind)
        if not hasattr(kind, "fieldNames") or part not in kind.fieldNames():
            return False
        kind = kind[part].dataType
    return True


def variant_fields(record: Column, paths: Sequence[str]) -> dict[str, tuple[Column, Column]]:
    """path: (value as text, is it there?) of dotted paths of a variant. A field that is null in the record is there; one that the
    record lacks isn't, nor is one below a field that is no object."""
    found = {p: F.try_variant_get(record, "$." + p, "variant") for p in paths}
    return {p: (F.try_variant_get(record, "$." + p, "string"), v.isNotNull()) for p, v in found.items()}


def convert_control(parameters: Column, paths: Sequence[str], transform: str = "identity", factor: float = 1.0, low: float | None = None, high: float | None = None, above: float | None = None) -> Column:
    """struct(value, issue) of a control read from a map under any of its paths.

    Paths that are present must agree; an amplitude becomes decibels, a scaled one is multiplied; what is outside the domain is an
    issue. No path: both null.
    """
    texts = F.array_compact(F.array(*[F.get(F.array(parameters[p]), F.lit(0)) for p in paths]))
    return F.get(F.transform(F.array(F.transform(texts, to_number)), lambda numbers: _converted(numbers, transform, factor, low, high, above)), F.lit(0))


def _converted(numbers: Column, transform: str, factor: float, low: float | None, high: float | None, above: float | None) -> Column:
    """convert_control of numbers, which its caller has bound to a name: each text is read once."""
    clash = F.exists(numbers, lambda x: x.isNull()) | (F.size(F.array_distinct(numbers)) > 1)
    raw = F.get(numbers, F.lit(0))
    if transform == "amplitude_to_db":
        value = F.when(raw > 0, 20 * F.log10(raw))
    elif transform == "scale":
        value = raw * factor
    elif transform == "identity":
        value = raw
    else:
        raise ValueError(f"unknown transform {transform}")
    outside = F.lit(False)
    for bound, test in ((low, lambda v, b: v < b), (high, lambda v, b: v > b), (above, lambda v, b: v <= b)):
        if bound is not None:
            outside = outside | test(value, F.lit(float(bound)))
    issue = F.when(F.size(numbers) == 0, F.lit(None)).when(clash, "conflicting or nonnumeric").when((raw <= 0) if transform == "amplitude_to_db" else F.lit(False), "nonpositive amplitude").when(outside, "outside the domain")
    return F.struct(F.when(issue.isNull(), value).alias("value"), issue.alias("issue"))


def expand_bands(parameters: Column, bands: int) -> Column:
    """array of struct(plugin, subtype, gain) of an equaliser in a map: input gain, each band that isn't Off, output gain, in this
    order; a muted band, and every band if one is soloed, is left out."""

    def flag(k: int, name: str) -> Column:
        return F.coalesce(F.lower(parameters[f"band{k}/{name}"]) == "true", F.lit(False))

    solo = F.lit(False)
    for k in range(bands):
        solo = solo | flag(k, "solo")
    unit = lambda plugin, subtype, gain: F.struct(F.lit(plugin).alias("plugin"), subtype.alias("subtype"), to_number(gain).alias("gain"))
    units = [F.when(parameters["input-gain"].isNotNull(), unit("eq_gain", F.lit(""), parameters["input-gain"]))]
    for k in range(bands):
        kind = parameters[f"band{k}/type"]
        units.append(F.when(kind.isNotNull() & (kind != "Off") & ~flag(k, "mute") & ~solo, unit("eq_band", kind, parameters[f"band{k}/gain"])))
    units.append(F.when(parameters["output-gain"].isNotNull(), unit("eq_gain", F.lit(""), parameters["output-gain"])))
    return F.array_compact(F.array(*units))


def scaled(value: Column, factor: float, offset: float = 0.0) -> Column:
    return value * factor + offset


def unscaled(value: Column, factor: float, offset: float = 0.0) -> Column:
    """The inverse of scaled; null for a factor of zero."""
    return F.try_divide(value - offset, F.lit(float(factor)))


def beat_seconds(bpm: Column, beats: Column, default: float = 120.0) -> Column:
    """Seconds of so many beats; a tempo that is null or zero is the default."""
    return 60.0 / F.coalesce(F.nullif(bpm.cast("double"), F.lit(0.0)), F.lit(default)) * beats


def seconds_beats(bpm: Column, seconds: Column, default: float = 120.0) -> Column:
    """Beats of so many seconds, to four places."""
    return F.bround(seconds * F.coalesce(F.nullif(bpm.cast("double"), F.lit(0.0)), F.lit(default)) / 60.0, 4)


def describe_steps(steps: Column) -> Column:
    """``operator(a=1, b=2) -> operator()`` of an array of steps, parameters by name."""
    shown = lambda s: F.concat(s["operator"], F.lit("("), F.array_join(F.transform(F.sort_array(F.map_entries(s["params"])), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "), F.lit(")"))
    return F.array_join(F.transform(steps, shown), " -> ")


def describe_graph(graph: Column) -> Column:
    """A line for each block: its kind, its name, and its steps."""
    return F.array_join(F.transform(graph, lambda b: F.concat(b["kind"], F.lit(" "), F.coalesce(b["name"], F.lit("")), F.lit(": "), describe_steps(F.coalesce(b["steps"], F.array().cast("array<struct<name:string,operator:string,params:map<string,string>>>"))))), "\n")


def unwrap(rows: DataFrame, fields: Sequence[str], inner: str = "metadata") -> DataFrame:
    """Rows that hold ``fields`` directly or under ``inner``, in one shape; wrapped tells which."""
    has = has_path(rows, inner)
    picked = [F.coalesce(*([F.col(f"{inner}.{f}")] if has and has_path(rows, f"{inner}.{f}") else []), *([F.col(f)] if f in rows.columns else []), F.lit(None)).alias(f) for f in fields]
    return rows.select(*picked, (F.col(inner).isNotNull() if has else F.lit(False)).alias("wrapped"))


def row_audio(wrapped: Column, edited: Column, given: Column, poisoned: Column, *clean: Column) -> Column:
    """struct(reference_path, edited_path, reference, poison_repair) of a wrapped row: its given input, or, where that was poisoned,
    the first clean original; a poisoned row without one is marked poisoned_input. Null for bare rows, and where a path is missing or
    empty."""
    filled = lambda c: F.nullif(c, F.lit(""))
    repair, original = F.coalesce(poisoned, F.lit(False)), F.coalesce(*map(filled, clean)) if clean else F.lit(None).cast("string")
    path = F.when(repair & original.isNotNull(), original).otherwise(filled(given))
    kind = F.when(repair & original.isNull(), "poisoned_input").otherwise("source")
    found = F.struct(path.alias("reference_path"), filled(edited).alias("edited_path"), kind.alias("reference"), repair.alias("poison_repair"))
    return F.when(F.coalesce(wrapped, F.lit(False)) & path.isNotNull() & filled(edited).isNotNull(), found)


def resolve_reference(baseline: Column, source: Column, poisoned: Column) -> Column:
    """struct(path, reason): the baseline where there is one, else the source; poisoned rows only take the source."""
    plain = F.coalesce(poisoned, F.lit(False))
    path = F.when(plain, source).otherwise(F.coalesce(baseline, source))
    reason = F.when(path.isNull(), "missing").when(plain, "poisoned_source").when(baseline.isNotNull(), "baseline").otherwise("source")
    return F.struct(path.alias("path"), reason.alias("reason"))


def observations(records: DataFrame, keep: Sequence[str] = ("id", "source", "split")) -> DataFrame:
    """keep, instance_id, plugin, effect, routing, parameter, value_text, value: one row per control of every enabled instance."""
    rows = records.select(*keep, F.explode("instances").alias("i")).where(F.coalesce("i.enabled", F.lit(True)))
    rows = rows.select(*keep, "i.instance_id", "i.plugin", "i.effect", "i.routing", F.explode("i.parameters").alias("parameter", "value_text"))
    return rows.withColumn("value", to_number(F.col("value_text")))


def _in_bands(parameters: DataFrame, bands: DataFrame) -> DataFrame:
    """parameters with _name (label.parameter), _at (their place in the graph) and _term, the last two null without a number or bands."""
    spec = F.struct("uppers", "direction", "terms")
    any_ = bands.where("label is null").select("operator", "parameter", spec.alias("_any"))
    own = bands.where("label is not null").select("operator", "parameter", "label", spec.alias("_own"))
    joined = parameters.join(F.broadcast(any_), ["operator", "parameter"], "left").join(F.broadcast(own), ["operator", "parameter", "label"], "left")
    joined = joined.withColumn("_spec", F.coalesce("_own", "_any"))
    measured = F.when(F.col("_spec.direction") == "absolute", F.abs("value")).otherwise(F.col("value"))
    band = F.least(F.size(F.filter("_spec.uppers", lambda u: u <= measured)), F.size("_spec.uppers") - 1)
    usable = F.col("value").isNotNull() & ~F.isnan("value") & F.col("_spec").isNotNull()
    name = F.concat_ws(".", "label", "parameter")
    return joined.withColumns({"_name": name, "_at": F.when(usable, F.struct("node", "step")), "_term": F.when(usable, F.get(F.col("_spec.terms"), band))})


def band_terms(parameters: DataFrame, bands: DataFrame, keep: Sequence[str] = ("clip_id", "plan_id")) -> DataFrame:
    """keep, terms: a map from label.parameter to the first term of the band that the value lies in.

    bands: operator, parameter, label (null: any), uppers, direction, terms (one a band). A row of the label itself wins over one for
    any label; the last band takes what lies above; of parameters with one name the last in the graph counts. What has no bands or
    isn't a number is left out. Bands are configuration and go to all tasks, so parameters stay where they are.
    """
    joined = _in_bands(parameters, bands).where("_at is not null")
    named = joined.groupBy(*keep, "_name").agg(F.max_by("_term", "_at").alias("_term"))
    return named.groupBy(*keep).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_name", "_term")))).alias("terms"))


def overlay_terms(tags: Column, always: Sequence[str], overlays: Sequence[tuple[Sequence[str], Sequence[str]]]) -> Column:
    """Distinct terms in order: those of every chain, then those of each overlay (tags, terms) of which the chain has a tag."""
    added = [F.when(F.arrays_overlap(tags, strings(wanted)), strings(terms)).otherwise(strings([])) for wanted, terms in overlays]
    return F.array_distinct(F.concat(strings(always), *added))


def profile_with_terms(parameters: DataFrame, registry: DataFrame, bands: DataFrame, keep: Sequence[str] = ("clip_id", "plan_id"), structural: Sequence[str] = ()) -> DataFrame:
    """keep, operators, tags, terms: what ``profile`` and ``band_terms`` joined to it give, from one pass over the parameters. Terms are
    null without any; what only has structural operators gives no row."""
    plain = ~F.col("operator").isin(*structural) if structural else F.lit(True)
    known = _in_bands(parameters, bands).join(F.broadcast(registry.select("operator", "tags")), "operator", "left")
    place, named = F.when(plain, F.struct("node", "step")), F.struct("_name", "_at", "_term")
    found = known.groupBy(*keep).agg(
        F.collect_list(F.when(plain, F.struct(place.alias("at"), "operator"))).alias("_used"), F.collect_list(F.when(plain, F.coalesce("tags", F.array().cast("array<string>")))).alias("_tags"),
        F.sort_array(F.collect_list(F.when(F.col("_at").isNotNull(), named))).alias("_named"),
    )
    following = lambda i: F.get("_named", i + 1)["_name"]
    last = F.filter("_named", lambda x, i: ~x["_name"].eqNullSafe(following(i)))
    terms = F.map_from_entries(F.transform(last, lambda x: F.struct(x["_name"], x["_term"])))
    operators = F.array_distinct(F.transform(F.sort_array("_used"), lambda x: x["operator"]))
    return found.where(F.size("_used") > 0).select(*keep, operators.alias("operators"), F.sort_array(F.array_distinct(F.flatten("_tags"))).alias("tags"), F.when(F.size("_named") > 0, terms).alias("terms"))


def profile(parameters: DataFrame, registry: DataFrame, keep: Sequence[str] = ("clip_id", "plan_id"), structural: Sequence[str] = ()) -> DataFrame:
    """keep, operators, tags: distinct operators in order and the sorted tags that a registry (operator, tags) gives them. A registry is
    configuration and goes to all tasks."""
    used = parameters.where(~F.col("operator").isin(*structural) if structural else F.lit(True)).groupBy(*keep, "operator").agg(F.min(F.struct("node", "step")).alias("at"))
    joined = used.join(F.broadcast(registry.select("operator", "tags")), "operator", "left")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("at", "operator"))), lambda x: x["operator"])
    return joined.groupBy(*keep).agg(ordered.alias("operators"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"))
