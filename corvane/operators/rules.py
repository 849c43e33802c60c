"""Rules: conditions as columns, weights, gates, chain checks and guards."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nested import has_path


@dataclass(frozen=True)
class Read:
    """What a condition reads: the value of its path, whether it is there, and the value as a list (a single one as a list of one)."""

    value: Column
    there: Column
    listed: Callable[[], Column]


#: Two-valued columns by the key of a condition on a path, and (allowed, weight) by the action of a rule that applies where hit holds.
CONDITIONS: dict[str, Callable[[Mapping, Read], Column]] = {}
ACTIONS: dict[str, Callable[[Mapping, Column, Column, Column], tuple[Column, Column]]] = {}
#: Conditions made of others.
NESTED = ("all", "any", "not")


def register_condition(key: str, compiled: Callable[[Mapping, Read], Column]) -> None:
    """Adds a condition: compiled(spec, read) gives its column, in which null counts as false. A key that there is is an error."""
    if key in CONDITIONS or key in NESTED:
        raise ValueError(f"two conditions are named {key}")
    CONDITIONS[key] = compiled


def register_action(name: str, compiled: Callable[[Mapping, Column, Column, Column], tuple[Column, Column]]) -> None:
    """Adds a rule action: compiled(rule, hit, allowed, weight) gives allowed and weight after it. A name that there is is an error."""
    if name in ACTIONS:
        raise ValueError(f"two actions are named {name}")
    ACTIONS[name] = compiled


def _is_list(frame: DataFrame, path: str) -> bool:
    return isinstance(frame.select(F.col(path)).schema[0].dataType, T.ArrayType)


def _same(wanted, x: Column) -> Column:
    return x.eqNullSafe(F.lit(wanted))


def paths(condition: Mapping | None) -> list[str]:
    """All paths that a condition reads."""
    found: list[str] = []
    for key, inner in (condition or {}).items():
        if key in NESTED:
            for item in inner if isinstance(inner, list) else [inner]:
                found += paths(item)
        else:
            found.append(inner["path"])
    return found


def condition_column(frame: DataFrame, condition: Mapping | None, strict: bool = True, fields: Mapping[str, tuple[Column, Column]] = {}) -> Column:
    """A two-valued column for a nested condition: eq neq gt gte lt lte, all any not, exists in contains_any contains_all, and what
    register_condition has added.

    No condition is true. What is absent is false, before any not. With strict a path that the frame lacks stops, as a rule on it
    could never fire; else it counts as absent. A null leaf is absent, except for the paths of ``fields``, which give their values
    and whether they are there: one that is there may be null, equals null, differs from all else and exists.
    """
    if not condition:
        return F.lit(True)
    (key, spec), *more = condition.items()
    if more:
        raise ValueError("a condition has one key")
    if key in ("all", "any"):
        parts = [condition_column(frame, c, strict, fields) for c in spec]
        return reduce((lambda a, b: a & b) if key == "all" else (lambda a, b: a | b), parts, F.lit(key == "all"))
    if key == "not":
        return ~condition_column(frame, spec, strict, fields)
    path = spec["path"]
    if path in fields:
        value, there = fields[path]
    elif has_path(frame, path):
        value, there = F.col(path), F.col(path).isNotNull()
    elif strict:
        raise ValueError(f"no such path: {path}")
    else:
        return F.lit(False)
    if key not in CONDITIONS:
        raise ValueError(f"unknown condition: {key}")
    listed = lambda: value if path not in fields and _is_list(frame, path) else F.array(value)
    return F.coalesce(CONDITIONS[key](spec, Read(value, there, listed)), F.lit(False))


def _contains(spec: Mapping, read: Read, every: bool) -> Column:
    held = read.listed()
    wanted = [F.exists(held, partial(_same, v)) for v in spec["values"]]
    return F.coalesce(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), wanted, F.lit(every)), F.lit(False)) & read.there


def _ordering(compare: Callable[[Column, Column], Column]) -> Callable[[Mapping, Read], Column]:
    return lambda spec, read: compare(read.value, F.lit(spec["value"]))


CONDITIONS |= {
    "exists": lambda spec, read: read.there,
    "contains_any": lambda spec, read: _contains(spec, read, False),
    "contains_all": lambda spec, read: _contains(spec, read, True),
    "in": lambda spec, read: reduce(lambda a, b: a | b, [read.value.eqNullSafe(F.lit(v)) for v in spec["values"]], F.lit(False)) & read.there,
    "eq": lambda spec, read: read.value.eqNullSafe(F.lit(spec["value"])) & read.there,
    "neq": lambda spec, read: ~read.value.eqNullSafe(F.lit(spec["value"])) & read.there,
    "gt": _ordering(lambda a, b: a > b), "gte": _ordering(lambda a, b: a >= b), "lt": _ordering(lambda a, b: a < b), "lte": _ordering(lambda a, b: a <= b),
}
ACTIONS |= {
    "multiply": lambda rule, hit, allowed, weight: (allowed, F.when(hit, weight * float(rule.get("multiplier", 1.0))).otherwise(weight)),
    "add": lambda rule, hit, allowed, weight: (allowed, F.when(hit, weight + float(rule.get("delta", 0.0))).otherwise(weight)),
    "reject": lambda rule, hit, allowed, weight: (allowed & ~hit, weight),
}


def fired_rules(frame: DataFrame, rules: Mapping[str, Mapping]) -> Column:
    """The names of the rules whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(condition_column(frame, c), F.lit(n)) for n, c in rules.items()])).cast("array<string>")


def resolve_weight(frame: DataFrame, base: Column, rules: Sequence[Mapping]) -> Column:
    """struct(allowed, weight, applied): rules (name, when, action: multiply, add, reject or a registered one) in order; what the first
    reject lets through stops the rest."""
    allowed, weight, applied = F.lit(True), base.cast("double"), []
    for rule in rules:
        hit = condition_column(frame, rule.get("when")) & allowed
        action = rule.get("action", "multiply")
        applied.append(F.when(hit, F.lit(rule.get("name", "rule"))))
        if action not in ACTIONS:
            raise ValueError(f"unknown action: {action}")
        allowed, weight = ACTIONS[action](rule, hit, allowed, weight)
    return F.struct(allowed.alias("allowed"), weight.alias("weight"), F.array_compact(F.array(*applied)).cast("array<string>").alias("applied"))


def trigger_gate(frame: DataFrame, rules: Mapping[str, Mapping], caption: str | None = None) -> Column:
    """struct(fired, verdict): the default verdict where nothing fires, unclear where the caption that it needs is missing, else
    null, as a judge must look."""
    fired = fired_rules(frame, rules)
    missing = F.coalesce(F.trim(F.col(caption)), F.lit("")) == "" if caption else F.lit(False)
    return F.struct(fired.alias("fired"), F.when(F.size(fired) == 0, "plausible").when(missing, "unclear").alias("verdict"))


def eligible(tags: Column, least: int, targets: Column, wanted: Sequence[str]) -> Column:
    """At least so many tags, and some candidate target among the wanted ones."""
    return (F.size(F.coalesce(tags, F.array().cast("array<string>"))) >= least) & F.coalesce(F.arrays_overlap(targets, F.array(*map(F.lit, wanted))), F.lit(False))


def include_exclude(rows: DataFrame, column: str, include: Sequence[str] | None = None, exclude: Sequence[str] = (), must_have: bool = False) -> DataFrame:
    """Rows whose value is included and not excluded; must_have: an error if none is left."""
    kept = rows.where(F.col(column).isin(*include)) if include else rows
    kept = kept.where(~F.col(column).isin(*exclude)) if exclude else kept
    if must_have and kept.isEmpty():
        raise ValueError(f"no row is left by the lists on {column}")
    return kept


def reject_whole(rows: DataFrame, bad: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows without those of an instance of which bad holds any row."""
    return rows.join(bad.select(*keys).distinct(), list(keys), "left_anti")


def operator_registry(spark: SparkSession, specs: Mapping[str, Mapping]) -> DataFrame:
    """operator (a name or alias), name, tags, params of operators {name: {aliases, tags, params}}, one row for each way to call
    one. A name or alias that two have is an error, and so is a registry without any. Only as large as the configuration."""
    rows, seen = [], {}
    for name, spec in specs.items():
        for alias in dict.fromkeys((name, *spec.get("aliases", ()))):
            if seen.setdefault(alias, name) != name:
                raise ValueError(f"{seen[alias]} and {name} are both called {alias}")
            rows.append((alias, name, list(spec.get("tags", ())), list(spec.get("params", ()))))
    if not rows:
        raise ValueError("the registry has no operator")
    return spark.createDataFrame(rows, "operator string, name string, tags array<string>, params array<string>")


def chain_violations(steps: DataFrame, registry: DataFrame, order: Sequence[str], keys: Sequence[str] = ("plan_id",), parameters: str | None = None) -> DataFrame:
    """keys, step, problem of steps (keys, step, operator): operators that the registry (operator, tags, params) lacks, parameters (an
    array column, if named) that the operator doesn't have, and steps whose least tag rank in ``order`` is under that of an earlier
    step. Steps without a ranked tag are passed over; step is a number, and steps of one number are not earlier than each other.
    The registry is configuration and goes to all tasks; of a step only its rank and its own problem are sorted by keys."""
    ranks = F.array(*map(F.lit, order))
    known = steps.join(F.broadcast(registry), "operator", "left")
    rank = F.array_min(F.filter(F.transform("tags", lambda t: F.array_position(ranks, t)), lambda r: r > 0))
    before = F.max("rank").over(Window.partitionBy(*keys).orderBy("step").rangeBetween(Window.unboundedPreceding, -1))
    problem = F.when(F.col("tags").isNull(), "unknown operator")
    if parameters:
        unknown = F.array_except(F.coalesce(parameters, F.array().cast("array<string>")), "params")
        problem = problem.when(F.size(unknown) > 0, F.concat(F.lit("unknown parameter: "), F.array_join(F.sort_array(unknown), ", ")))
    known = known.select(*keys, "step", rank.alias("rank"), problem.alias("_own"))
    problem = F.coalesce("_own", F.when(F.col("rank") < before, "out of order"))
    return known.withColumn("problem", problem).where("problem is not null").select(*keys, "step", "problem")


def chain_budget(steps: DataFrame, keys: Sequence[str] = ("plan_id",), length: tuple[int, int] = (3, 10), most: Mapping[str, int] = {}, gain: float = 10.0, pass_ratio: float = 8.0) -> DataFrame:
    """keys, problems of chains in rows (keys, step, tag, operator, parameter, value), one row for each parameter: length, number of
    steps by tag, summed gain (shelves and peaks count half), and the width of the pass band."""
    cutoff = (F.col("parameter") == "cutoff_frequency_hz")
    gains = F.when(F.col("parameter") == "gain_db", F.when(F.col("operator") == "apply_gain", F.col("value")).when(F.col("tag").isin("shelf", "peak"), 0.5 * F.col("value")).otherwise(0.0)).otherwise(0.0)
    totals = steps.groupBy(*keys).agg(
        F.countDistinct("step").alias("n"), F.sum(gains).alias("gain"),
        F.max(F.when(cutoff & (F.col("operator") == "apply_highpass_filter"), F.col("value"))).alias("hp"),
        F.min(F.when(cutoff & (F.col("operator") == "apply_lowpass_filter"), F.col("value"))).alias("lp"),
        *[F.countDistinct(F.when(F.col("tag") == t, F.col("step"))).alias(f"n_{t}") for t in most],
    )
    problems = [
        F.when(~F.col("n").between(*length), "length"), F.when(F.abs("gain") > gain, "gain"), F.when(F.col("lp") / F.greatest("hp", F.lit(1.0)) < pass_ratio, "pass band"),
        *[F.when(F.col(f"n_{t}") > k, f"too many: {t}") for t, k in most.items()],
    ]
    return totals.select(*keys, F.array_compact(F.array(*problems)).alias("problems"))


def range_warnings(parameters: DataFrame, priors: DataFrame, fully_wet: Mapping[str, float] = {}) -> DataFrame:
    """parameters with severity: out_of_range or off_grid against priors (operator, parameter, low, high, grid), send_bus_blend for a
    bus step that isn't wholly wet. Rows without a warning are left out."""
    rows = parameters.join(priors.select("operator", "parameter", "low", "high", "grid"), ["operator", "parameter"], "left")
    blend = reduce(lambda a, b: a | b, [(F.col("parameter") == p) & (F.col("value") != v) for p, v in fully_wet.items()], F.lit(False)) & (F.col("block_kind") == "send_return") & (F.col("operator") != "send_bus")
    off = F.col("grid").isNotNull() & ~F.exists("grid", lambda g: F.abs(g - F.col("value")) <= 1e-8)
    severity = F.when(blend, "send_bus_blend").when(~F.col("value").between(F.col("low"), F.col("high")), "out_of_range").when(off, "off_grid")
    return rows.withColumn("severity", severity).where("severity is not null").drop("low", "high", "grid")


def guard(frame: DataFrame, required: Sequence[str] = (), version: str | None = None, expected=None) -> DataFrame:
    """frame, after one aggregate over it: stops if a required column is missing or null anywhere, or a version is neither expected
    nor null."""
    missing = [c for c in required if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in required]
    if version is not None:
        counts.append(F.count_if(F.col(version) != F.lit(expected)).alias("_version"))
    if counts:
        bad = {k: v for k, v in frame.agg(*counts).first().asDict().items() if v}
        if bad:
            raise ValueError(f"rows that break the guard: {bad}")
    return frame


def intent_filter(rows: DataFrame, policy: DataFrame, signs: Mapping[str, int] = {}, context: str | None = None, families: Mapping[str, str] = {}, family: str | None = None) -> DataFrame:
    """Observations (source, record, instance, parameter, value, routing) that a policy (parameter, low, high, blocked) lets through:
    not on a send, not blocked for their source, inside the domain, of the sign asked for; one that fails drops its instance.
    family: only what comes from a context (a column) that ``families``, by lower-cased name, puts into it; other rows are no failures.
    rows are read once: an instance's observations meet in one task, and one without a whole key is an instance of its own. The policy
    is configuration and goes to all tasks."""
    if family is not None:
        rows = rows.where(F.lower(context).isin(*[c for c, f in families.items() if f == family]))
    keys = ["source", "record", "instance"]
    known = rows.join(F.broadcast(policy), "parameter")
    sign = reduce(lambda a, b: a | b, [(F.col("parameter") == p) & (F.signum("value") != s) for p, s in signs.items()], F.lit(False))
    bad = (F.col("routing") == "send") | F.array_contains("blocked", F.col("source")) | ~F.col("value").between(F.col("low"), F.col("high")) | sign
    alone = F.when(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]), F.monotonically_increasing_id())
    marked = known.withColumn("_bad", F.coalesce(bad, F.lit(False))).withColumn("_alone", alone)
    failed = F.max("_bad").over(Window.partitionBy(*keys, "_alone"))
    return marked.withColumn("_failed", failed).where("not _failed").select(*keys, *[c for c in known.columns if c not in (*keys, "low", "high", "blocked")])
