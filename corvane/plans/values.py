"""Values that a plan's parameters are written as, compiled to columns.

A parameter's spec is a constant, a text with ``${path}`` in it, or one special value: what the clip says (``ref``), the first of several
that can be resolved (``coalesce``), a draw (``sample``, ``sample_choice``, ``values``), another value scaled (``scale``) or in beats of a
tempo (``tempo_sync``), or one of two by a condition and a chance (``either``). Specs nest. Each compiles to a ``Value``: columns that
tell the result, what was drawn for it from which prior, and whether it could be resolved at all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions.text import stable_noise
from ..operators.rules import condition_column, paths

PLACEHOLDER = re.compile(r"\$\{([^}]+)\}")


class Value(NamedTuple):
    """value (a number, or null), text, prior (null if nothing is drawn), drawn (the number or category drawn, as text), there."""

    value: Column
    text: Column
    prior: Column
    drawn: Column
    there: Column


def number(value: Column, of: Value | None = None, there: Column | None = None) -> Value:
    """A computed number, with the draw and the resolvability of the value that it is computed from."""
    none = F.lit(None).cast("string")
    known = of.there if of else F.lit(True)
    return Value(value, value.cast("string"), of.prior if of else none, of.drawn if of else none, known if there is None else known & there)


def pick(hit: Column, one: Value, other: Value) -> Value:
    """one where hit holds, else other."""
    return Value(*[F.when(hit, a).otherwise(b) for a, b in zip(one, other)])


@dataclass(frozen=True)
class Compiler:
    """What specs may read. ``keys`` identify a row for its draws; ``context`` has the columns of paths; ``name`` is the parameter's,
    under which inline values are priors; ``active`` tells the rows that the result is used of."""

    priors: Mapping[str, Mapping]
    context: Mapping[str, Column]
    keys: Sequence[Column]
    seed: str
    name: str = ""
    active: Column | None = None

    def noise(self, *part: str) -> Column:
        return stable_noise(F.lit(self.seed), F.lit(part[0]), *self.keys, *[F.lit(p) for p in part[1:]])

    def read(self, path: str) -> Column:
        if path not in self.context:
            raise ValueError(f"no such path: {path}")
        return self.context[path]

    def expand(self, spec: Any) -> Value:
        if isinstance(spec, Mapping):
            (key, inner), *more = spec.items()
            if more or key not in SPECIAL:
                raise ValueError(f"no special value: {', '.join(spec)}")
            return SPECIAL[key](inner, self)
        none = F.lit(None).cast("string")
        if spec is None:
            return Value(F.lit(None).cast("double"), none, none, none, F.lit(False))
        if isinstance(spec, str) and PLACEHOLDER.search(spec):
            return self._interpolated(spec)
        text = D._text(spec)
        value = F.lit(text).try_cast("double") if isinstance(spec, str) else F.lit(float(spec))
        return Value(value, F.lit(text), F.lit(self.name), F.lit(text), F.lit(True))

    def _interpolated(self, spec: str) -> Value:
        if whole := PLACEHOLDER.fullmatch(spec):
            return SPECIAL["ref"](whole[1], self)
        parts, at, there = [], 0, F.lit(True)
        for m in PLACEHOLDER.finditer(spec):
            parts += [F.lit(spec[at : m.start()]), self.read(m[1]).cast("string")]
            there, at = there & self.read(m[1]).isNotNull(), m.end()
        text = F.concat(*parts, F.lit(spec[at:]))
        return Value(text.try_cast("double"), text, F.lit(None).cast("string"), F.lit(None).cast("string"), there)

    def draw(self, name: str, leaves: Sequence[Mapping]) -> Value:
        """A component by its weight, then a value of it, from two seeded numbers of the keys and the prior: as ``sampling.drawn``."""
        u, p = self.noise("component", name), self.noise("value", name)
        total, done, bounds = sum(leaf["weight"] for leaf in leaves), 0.0, []
        for leaf in leaves:
            done += leaf["weight"]
            bounds.append(done / total)
        chosen = F.lit(len(leaves) - 1)
        for k in reversed(range(len(leaves) - 1)):
            chosen = F.when(u < bounds[k], F.lit(k)).otherwise(chosen)
        if all(leaf["family"] == D.DISCRETE for leaf in leaves):
            text = _by_number(chosen, [F.lit(leaf["value"]) for leaf in leaves], "string")
            return Value(text.try_cast("double"), text, F.lit(name), text, F.lit(True))
        kernel = F.lit(None).cast("double")
        if any(leaf["family"] in D.KERNELS for leaf in leaves):
            kernel = self._kernel(p, chosen, leaves)
        parts = [F.lit(leaf["value"]).try_cast("double") if leaf["family"] == D.DISCRETE else kernel if leaf["family"] in D.KERNELS else D.leaf_quantile(leaf, p) for leaf in leaves]
        value = _by_number(chosen, parts, "double")
        text = value.cast("string")
        if any(leaf["family"] == D.DISCRETE for leaf in leaves):
            text = F.coalesce(_by_number(chosen, [F.lit(leaf.get("value")) for leaf in leaves], "string"), text)
        return Value(value, text, F.lit(name), text, F.lit(True))

    def _kernel(self, p: Column, chosen: Column, leaves: Sequence[Mapping]) -> Column:
        """The quantile of the chosen leaf if an Arrow function computes its family: one call for all leaves."""

        def field(of: Callable[[Mapping], Any], kind: str) -> Column:
            known = [of(leaf) if leaf["family"] in D.KERNELS else None for leaf in leaves]
            return F.lit(known[0]).cast(kind) if len(set(known)) == 1 else _by_number(chosen, [F.lit(x) for x in known], kind)

        log = lambda leaf: leaf.get("scale") == "log"
        bound = lambda name: field(lambda leaf: math.log(leaf[name]) if log(leaf) else leaf[name], "double")
        family = field(lambda leaf: leaf["family"], "string")
        family = family if self.active is None else F.when(self.active, family)  # an Arrow function sees all rows
        parameter = lambda *names: field(lambda leaf: next(leaf[n] for n in names if leaf.get(n) is not None), "double")
        found = D.kernel_quantile(family, p, bound("low"), bound("high"), parameter("mean", "alpha"), parameter("std", "beta"))
        return F.when(field(log, "boolean"), F.exp(found)).otherwise(found) if any(map(log, leaves)) else found


def _by_number(k: Column, parts: Sequence[Column], kind: str) -> Column:
    out = parts[-1].cast(kind)
    for i in reversed(range(len(parts) - 1)):
        out = F.when(k == i, parts[i]).otherwise(out)
    return out


#: What compiles each special value: handler(inner spec, compiler) -> Value.
SPECIAL: dict[str, Callable[[Any, Compiler], Value]] = {}


def register_special(key: str, handler: Callable[[Any, Compiler], Value]) -> None:
    """Adds a special value; one of that name is an error."""
    if key in SPECIAL:
        raise ValueError(f"two special values are named {key}")
    SPECIAL[key] = handler


def _ref(path: str, at: Compiler) -> Value:
    found = at.read(path)
    none = F.lit(None).cast("string")
    return Value(found.try_cast("double"), found.cast("string"), none, none, found.isNotNull())


def _coalesce(specs: Sequence, at: Compiler) -> Value:
    parts = [at.expand(s) for s in specs]
    found = parts[-1]
    for part in reversed(parts[:-1]):
        found = pick(part.there, part, found)
    return found


def _sample(name: str, at: Compiler) -> Value:
    found = D.prior_leaves(at.priors, [name])
    if list(found) != [name]:
        raise ValueError(f"{name} draws several parameters")
    return at.draw(name, found[name])


def _sample_choice(names: Sequence[str], at: Compiler) -> Value:
    """Each of several priors alike."""
    u = at.noise("choice", at.name)
    found = _sample(names[-1], at)
    for k in reversed(range(len(names) - 1)):
        found = pick(u < (k + 1) / len(names), _sample(names[k], at), found)
    return found


def _values(values: Sequence, at: Compiler) -> Value:
    return at.draw(at.name, list(D.leaves({"type": "choice", "values": values})))


def _scale(spec: Mapping, at: Compiler) -> Value:
    inner = at.expand(spec["value"])
    return number(inner.value * float(spec.get("factor", 1.0)) + float(spec.get("offset", 0.0)), inner)


def _tempo_sync(spec: Mapping, at: Compiler) -> Value:
    bpm, beats = at.expand(spec["bpm"]), at.expand(spec["beats"])
    return number(F.try_divide(F.lit(60.0), bpm.value) * beats.value, beats, bpm.there & (bpm.value != 0))


def _either(spec: Mapping, at: Compiler) -> Value:
    """then, where its condition on the context (when) holds and a draw is below its chance, else otherwise."""
    for path in paths(spec.get("when")):
        at.read(path)
    fields = {p: (c, c.isNotNull()) for p, c in at.context.items()}
    hit = condition_column(None, spec.get("when"), fields=fields)
    if "chance" in spec:
        hit = hit & (at.noise("either", at.name) < float(spec["chance"]))
    return pick(hit, replace(at, active=hit if at.active is None else at.active & hit).expand(spec["then"]), at.expand(spec["otherwise"]))


SPECIAL |= {"ref": _ref, "coalesce": _coalesce, "sample": _sample, "sample_choice": _sample_choice, "values": _values, "scale": _scale, "tempo_sync": _tempo_sync, "either": _either}


def inline_priors(definitions: Mapping[str, Mapping[str, Any]], namespace: str = "random") -> dict[str, dict]:
    """namespace.operator.parameter: choice, of all inline values and constants in definitions (operator: parameter: spec)."""
    found: dict[str, dict] = {}

    def walk(name: str, spec: Any) -> None:
        if isinstance(spec, Mapping):
            (key, inner), *_ = spec.items()
            if key == "values":
                found[name] = {"type": "choice", "values": list(inner)}
            elif key in ("coalesce", "scale", "either"):
                for part in inner if key == "coalesce" else [v for k, v in inner.items() if k in ("value", "then", "otherwise")]:
                    walk(name, part)
            elif key == "tempo_sync":
                walk(name, inner["beats"])
        elif spec is not None and not (isinstance(spec, str) and PLACEHOLDER.search(spec)):
            found.setdefault(name, {"type": "choice", "values": []})["values"].append(spec)

    for operator, parameters in definitions.items():
        for parameter, spec in parameters.items():
            walk(f"{namespace}.{operator}.{parameter}", spec)
    return found


def with_parameters(steps: DataFrame, keys: Sequence[str], definitions: Mapping[str, Mapping[str, Any]], priors: Mapping[str, Mapping], context: Sequence[str], seed: str, namespace: str = "random", operator: str = "operator") -> DataFrame:
    """steps with parameter, prior, value_text, value, drawn: a row for each parameter that its operator defines, drawn by the keys,
    the operator and the parameter. Paths of context are columns of steps.

    A value that can't be resolved is null and has no prior; steps whose operator isn't defined have no rows. Everything is one
    expression over a step: no join and no shuffle.
    """
    at = {p: F.col(p) for p in context}
    item = "array<struct<parameter:string,prior:string,value_text:string,value:double,drawn:string>>"
    spread = F.lit(None).cast(item)
    for name, parameters in definitions.items():
        own, parts = F.col(operator) == name, []
        for parameter, spec in parameters.items():
            compiler = Compiler(priors, at, [*map(F.col, keys), F.lit(name), F.lit(parameter)], seed, f"{namespace}.{name}.{parameter}", own)
            v = compiler.expand(spec)
            told = lambda c, there=v.there: F.when(there, c)
            parts.append(F.struct(F.lit(parameter).alias("parameter"), told(v.prior).alias("prior"), told(v.text).alias("value_text"), told(v.value).alias("value"), told(v.drawn).alias("drawn")))
        spread = F.when(own, F.array(*parts)).otherwise(spread)
    return steps.withColumn("_s", spread).select(*steps.columns, F.explode("_s").alias("_p")).select(*steps.columns, "_p.*")
