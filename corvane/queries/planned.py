"""Queries over special values of parameters, registered handlers, and graphs whose parameters tell where they come from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions import nested as N
from ..operators import rules as R
from ..plans import values as V
from ..plans.chains import random_graphs
from ..registry import register
from .nested import spread, table
from .ranked import NOISE

PRIORS = {
    "beats": {"type": "choice", "values": [{"value": 0.25, "weight": 1}, {"value": 0.5, "weight": 2}, {"value": 1.0, "weight": 1}]},
    "seconds": {"type": "uniform", "low": 0.05, "high": 0.8},
    "up_db": {"type": "uniform", "low": 1.0, "high": 6.0},
    "down_db": {"type": "uniform", "low": -9.0, "high": -1.0},
    "ratio": {"type": "gaussian_mixture", "low": 1.0, "high": 8.0, "components": [{"mean": 2.0, "std": 0.5, "weight": 3}, {"mean": 5.0, "std": 1.0, "weight": 1}]},
    "parallel_ratio": {"type": "uniform", "low": 4.0, "high": 12.0},
    "shelf_hz": {"type": "log_uniform", "low": 1000.0, "high": 9000.0},
    "mix": {"type": "beta", "low": 0.1, "high": 0.9, "alpha": 2.0, "beta": 3.0},
    "send": {"type": "choice", "values": [0.2, 0.35]},
    "return": {"type": "choice", "values": [0.4, 0.65]},
}
TEMPO = {"coalesce": [{"ref": "tempo_bpm"}, 120.0]}
SPECS = {
    "echo": {
        "delay": {"either": {"when": {"exists": {"path": "tempo_bpm"}}, "chance": 0.7, "then": {"tempo_sync": {"bpm": {"ref": "tempo_bpm"}, "beats": {"sample": "beats"}}}, "otherwise": {"sample": "seconds"}}},
        "pre": {"tempo_sync": {"bpm": TEMPO, "beats": {"values": [0.25, 0.5]}}},
        "strict": {"tempo_sync": {"bpm": {"ref": "tempo_bpm"}, "beats": 2}},
        "gain": {"sample_choice": ["up_db", "down_db"]},
        "cut": {"scale": {"value": {"sample": "seconds"}, "factor": -100.0, "offset": 3.0}},
        "label": "${segment} at ${tempo_bpm}",
    }
}


def clips(spark, sf_dir):
    """Customers as clips, a third of them without a tempo."""
    tempo = F.when(F.col("c_custkey") % 3 > 0, (60 + F.col("c_custkey") % 120).cast("double"))
    return spread(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), tempo.alias("tempo_bpm")), "c_custkey")


def _noise(part: str, parameter: str, last: str) -> str:
    return NOISE.format(seed=f"sv|{part}", key=f"c_custkey || '|echo|{parameter}|{last}'")


@register("special_values", f"""
WITH c AS (SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_custkey % 3 > 0 THEN (60 + c_custkey % 120)::DOUBLE END AS bpm FROM customer),
u AS (
  SELECT *, {_noise('either', 'delay', 'random.echo.delay')} AS e, {_noise('component', 'delay', 'beats')} AS b, 0.05 + {_noise('value', 'delay', 'seconds')} * 0.75::DOUBLE AS s, {_noise('component', 'pre', 'random.echo.pre')} AS p,
    {_noise('choice', 'gain', 'random.echo.gain')} AS g, 1.0 + {_noise('value', 'gain', 'up_db')} * 5.0::DOUBLE AS up, -9.0 + {_noise('value', 'gain', 'down_db')} * 8.0::DOUBLE AS down, 0.05 + {_noise('value', 'cut', 'seconds')} * 0.75::DOUBLE AS k
  FROM c),
v AS (
  SELECT c_custkey, 'delay' AS parameter, CASE WHEN bpm IS NOT NULL AND e < 0.7 THEN 'beats' ELSE 'seconds' END AS prior, CASE WHEN bpm IS NOT NULL AND e < 0.7 THEN 60 / bpm * CASE WHEN b < 0.25 THEN 0.25 WHEN b < 0.75 THEN 0.5 ELSE 1.0 END ELSE s END AS value, NULL AS label FROM u
  UNION ALL SELECT c_custkey, 'pre', 'random.echo.pre', 60 / coalesce(bpm, 120) * CASE WHEN p < 0.5 THEN 0.25 ELSE 0.5 END, NULL FROM u
  UNION ALL SELECT c_custkey, 'strict', CASE WHEN bpm IS NOT NULL THEN 'random.echo.strict' END, 120 / bpm, NULL FROM u
  UNION ALL SELECT c_custkey, 'gain', CASE WHEN g < 0.5 THEN 'up_db' ELSE 'down_db' END, CASE WHEN g < 0.5 THEN up ELSE down END, NULL FROM u
  UNION ALL SELECT c_custkey, 'cut', 'seconds', k * -100 + 3, NULL FROM u
  UNION ALL SELECT c_custkey, 'label', NULL, NULL, segment || ' at ' || bpm::VARCHAR FROM u)
SELECT c_custkey, parameter, prior, round(value, 6) AS value, label FROM v
""")  # fmt: skip
def special_values(spark, sf_dir):
    """Nested specs (ref, coalesce, sample, sample_choice, values, scale, tempo_sync, either, texts) as columns, with and without a tempo."""
    steps = clips(spark, sf_dir).withColumn("operator", F.lit("echo"))
    found = V.with_parameters(steps, ["c_custkey"], SPECS, PRIORS, ["tempo_bpm", "segment"], "sv")
    return found.select("c_custkey", "parameter", "prior", F.round("value", 6).alias("value"), F.when(F.col("parameter") == "label", F.col("value_text")).alias("label"))


def _triangle_cdf(x, c):
    a, m, b = c("low"), c("mean"), c("high")
    return F.when(x < m, (x - a) * (x - a) / ((b - a) * (m - a))).otherwise(1 - (b - x) * (b - x) / ((b - a) * (b - m)))


def _triangle_quantile(p, c):
    a, m, b = c("low"), c("mean"), c("high")
    return F.when(p < (m - a) / (b - a), a + F.sqrt(p * (b - a) * (m - a))).otherwise(b - F.sqrt((1 - p) * (b - a) * (b - m)))


def _rounded(spec, at):
    inner = at.expand(spec["value"])
    return V.number(F.floor(inner.value / float(spec["step"]) + 0.5) * float(spec["step"]), inner)


def registered() -> None:
    """One handler of each kind, added once."""
    if "between" not in R.CONDITIONS:
        R.register_condition("between", lambda spec, read: read.value.between(spec["low"], spec["high"]) & read.there)
        R.register_action("cap", lambda rule, hit, allowed, weight: (allowed, F.when(hit, F.least(weight, F.lit(float(rule["at"])))).otherwise(weight)))
        D.register_family("triangle", D.Family(_triangle_cdf, _triangle_quantile))
        D.register_distribution("even_steps", lambda spec, weight: D.leaves({"type": "choice", "values": [spec["low"] + (spec["high"] - spec["low"]) * k / (spec["n"] - 1) for k in range(spec["n"])]}, weight))
        V.register_special("rounded", _rounded)


@register("registered_handlers", f"""
WITH u AS (SELECT *, {NOISE.format(seed='rh|value', key="c_custkey || '|fx|tilt|tri'")} AS p, {NOISE.format(seed='rh|component', key="c_custkey || '|fx|level|steps'")} AS s FROM customer),
x AS (SELECT *, CASE WHEN p < 0.3 THEN sqrt(p * 10 * 3) ELSE 10 - sqrt((1 - p) * 10 * 7) END AS tilt FROM u)
SELECT c_custkey, c_acctbal BETWEEN 0 AND 5000 AS between_holds,
  CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 0 AND 5000 THEN 2.5 WHEN c_mktsegment = 'BUILDING' THEN 4.0 WHEN c_acctbal BETWEEN 0 AND 5000 THEN least(2.0, 2.5) ELSE 2.0 END::DOUBLE AS weight,
  round(tilt, 6) AS tilt, round(CASE WHEN tilt < 3 THEN tilt * tilt / 30 ELSE 1 - (10 - tilt) * (10 - tilt) / 70 END, 6) AS tilt_cdf,
  floor((least(floor(s * 5), 4) * 2.5) / 4 + 0.5) * 4 AS level
FROM x
""")  # fmt: skip
def registered_handlers(spark, sf_dir):
    """K2: a condition, a rule action, a family, a kind of distribution and a special value that the caller adds."""
    registered()
    priors = {"tri": {"type": "triangle", "low": 0.0, "mean": 3.0, "high": 10.0}, "steps": {"type": "even_steps", "low": 0.0, "high": 10.0, "n": 5}}
    rows = table(spark, sf_dir, "customer").withColumn("operator", F.lit("fx"))
    between = {"between": {"path": "c_acctbal", "low": 0, "high": 5000}}
    rules = [{"name": "double", "when": {"eq": {"path": "c_mktsegment", "value": "BUILDING"}}, "action": "multiply", "multiplier": 2.0}, {"name": "cap", "when": between, "action": "cap", "at": 2.5}]
    weighed = rows.select("c_custkey", R.condition_column(rows, between).alias("between_holds"), R.resolve_weight(rows, F.lit(2.0), rules)["weight"].alias("weight"))
    values = V.with_parameters(rows.select("c_custkey", "operator"), ["c_custkey"], {"fx": {"tilt": {"sample": "tri"}, "level": {"rounded": {"value": {"sample": "steps"}, "step": 4.0}}}}, priors, [], "rh")
    wide = values.groupBy("c_custkey").agg(*[F.max(F.when(F.col("parameter") == p, F.col("value"))).alias(p) for p in ("tilt", "level")])
    cdf = D.closed_cdf(F.col("tilt"), D.leaf_fields(next(iter(D.leaves(priors["tri"])))))
    return weighed.join(wide, "c_custkey").select("c_custkey", "between_holds", "weight", F.round("tilt", 6).alias("tilt"), F.round(cdf, 6).alias("tilt_cdf"), "level")


FAMILIES = ["vocals", "drums", "bass", "guitar"]
DEFINITIONS = {
    "delay": {"seconds": SPECS["echo"]["delay"], "mix": {"sample": "mix"}},
    "gain": {"gain_db": SPECS["echo"]["gain"]},
    "compressor": {"ratio": {"either": {"when": {"eq": {"path": "family", "value": "drums"}}, "then": {"sample": "parallel_ratio"}, "otherwise": {"sample": "ratio"}}}},
    "peak": {"hz": {"values": [350.0, 800.0, 1800.0]}, "q": {"values": [0.8, 1.5, 3.0]}},
    "shelf": {"hz": {"sample": "shelf_hz"}, "gain_db": {"sample": "down_db"}},
    "reverb": {"mix": {"sample": "mix"}, "freeze": 0.0},
}


@register("graph_parameters", None)
def graph_parameters(spark, sf_dir):
    """Graphs of four families with and without a tempo; for each parameter and prior, values that there are and values that lie
    in the prior's support once scales and tempos are taken back."""
    pool = lambda *ops: spark.createDataFrame([(f, o, w, t) for f in FAMILIES for o, w, t in ops], "family string, operator string, weight double, tag string")
    order = {"eq": 0, "dynamics": 1, "gain": 2, "time": 3}
    serial = pool(("peak", 2.0, "eq"), ("shelf", 1.0, "eq"), ("compressor", 2.0, "dynamics"), ("gain", 2.0, "gain"), ("delay", 1.0, "time"))
    send = pool(("delay", 3.0, "time"), ("reverb", 3.0, "time"), ("peak", 1.0, "eq"))
    levels = spark.createDataFrame([(t, p, p) for t in ("send_return", "serial_plus_send") for p in ("send", "return")], "topology string, parameter string, prior string")
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("c_custkey") % 4 + 1).cast("int"))
    priors = PRIORS | V.inline_priors(DEFINITIONS)
    components = D.component_table(spark, priors)
    made = random_graphs(
        clips(spark, sf_dir).withColumn("kind", family), "c_custkey", "kind", {"serial": 3.0, "send_return": 1.0, "serial_plus_send": 1.0}, {"pool": serial, "lengths": (2, 3), "order": order, "most": {"dynamics": 1}},
        {"pool": send, "lengths": (1, 2), "order": order, "most": {}}, levels, components, "gp", ["time"], DEFINITIONS, PRIORS, ["tempo_bpm", "family"],
    )
    synced = (F.col("operator") == "delay") & (F.col("prior") == "beats")
    before = F.when(synced, N.seconds_beats(F.col("tempo_bpm"), F.col("value"))).otherwise(F.col("value"))
    keys = ["c_custkey", "block", "position", "operator", "parameter", "stem", "has_tempo", "there"]
    facts = made.withColumns({"before": before, "has_tempo": F.col("tempo_bpm").isNotNull(), "there": F.col("value").isNotNull(), "stem": F.col("family")}).withColumn("before_text", F.col("before").cast("string"))
    found = D.placed(facts, components, 10, keys, "prior", "before_text", "before")
    return found.groupBy(F.col("stem").alias("family"), "has_tempo", "operator", "parameter", "prior").agg(F.count_if("there").alias("values"), F.count_if("in_support").alias("in_support"))
