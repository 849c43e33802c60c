"""Queries over nested records and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested as N
from ..operators import rules as R
from ..operators import stats as S
from ..registry import register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows, key, most=10_000):
    """rows dealt to as many tasks as hold about ``most`` of them, by a hash of key: for rows that are made into many or cost much each.
    A file of few bytes is one task otherwise, however many rows it has. They are counted first, which reads the footers of a file."""
    return rows.repartition(max(1, -(-rows.count() // most)), key)


def plans(spark, sf_dir):
    """A plan for each order: its lines as steps of a chain, a send bus of the order's own levels, and a step block. Plans lie in tasks
    of about 50,000 lines, dealt by plan_id, so what groups or joins by it needs no other shuffle."""
    line = F.struct("l_linenumber", "l_extendedprice", "l_returnflag", F.col("l_quantity").cast("int").cast("string").alias("quantity"), F.col("l_discount").cast("string").alias("discount"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_quantity", "l_discount")
    chains = spread(lines, "l_orderkey", 50_000).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(chains, F.col("o_orderkey") == F.col("l_orderkey"))
    params = lambda x: F.create_map(F.lit("quantity"), x["quantity"], F.lit("discount"), x["discount"])
    steps = F.transform("lines", lambda x: F.struct(x["l_linenumber"].cast("string").alias("name"), x["l_returnflag"].alias("operator"), params(x).alias("params")))
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    fields = ("kind", "name", "operator", "source", "output", "dry_level", "send_level", "return_level", "params", "steps")
    no_params, no_steps = F.lit(None).cast("map<string,string>"), F.array().cast("array<struct<name:string,operator:string,params:map<string,string>>>")

    def block(*values):
        return F.struct(*[v.alias(n) for v, n in zip(values, fields)])

    chain = block(F.lit("chain"), F.lit("main"), text, text, text, number, number, number, no_params, steps)
    bus = block(F.lit("send_return"), F.lit("bus"), text, text, text, F.lit(1.0), F.col("o_totalprice"), F.lit(0.5), no_params, no_steps)
    step = block(F.lit("step"), F.lit("gain"), F.lit("apply_gain"), text, text, number, number, number, F.create_map(F.lit("gain_db"), F.col("o_custkey").cast("string")), no_steps)
    return orders.select(F.col("o_custkey").alias("clip_id"), F.col("o_orderkey").alias("plan_id"), F.col("o_orderpriority").alias("recipe_id"), F.array(chain, bus, step).alias("graph_spec"))


PARAMETERS = """
parameters AS (
  SELECT o_custkey AS clip_id, o_orderkey AS plan_id, o_orderpriority AS recipe_id, 'chain' AS block_kind, l_returnflag AS operator, 'quantity' AS parameter, l_quantity::INT::DOUBLE AS value, l_linenumber::VARCHAR AS label
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority, 'chain', l_returnflag, 'discount', l_discount, l_linenumber::VARCHAR FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority, 'send_return', 'send_bus', p, CASE p WHEN 'dry_level' THEN 1.0 WHEN 'send_level' THEN o_totalprice ELSE 0.5 END, 'bus'
    FROM orders, (SELECT unnest(['dry_level', 'send_level', 'return_level']) AS p) WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
  UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority, 'step', 'apply_gain', 'gain_db', o_custkey::DOUBLE, 'gain' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
"""


@register("coverage_by_operator", f"""
WITH {PARAMETERS}
SELECT block_kind, operator, parameter, count(*) AS n, count(DISTINCT plan_id) AS plans, count(DISTINCT clip_id) AS clips, min(value) AS low, max(value) AS high
FROM parameters GROUP BY 1, 2, 3
""")  # fmt: skip
def coverage_by_operator(spark, sf_dir):
    """The graphs' parameters as one table, and what it covers."""
    return S.coverage(N.flatten_graph(plans(spark, sf_dir)), ["block_kind", "operator", "parameter"])


@register("flattened_properties", """
SELECT event_id, 'a/k' AS path, json_extract_string(props, '$.k') AS value_text, json_extract_string(props, '$.k')::DOUBLE AS value FROM events
UNION ALL SELECT event_id, 'b/0', event_type, NULL FROM events UNION ALL SELECT event_id, 'b/1', '2.5', 2.5 FROM events
""")  # fmt: skip
def flattened_properties(spark, sf_dir):
    """Leaves of nested JSON as rows."""
    text = F.concat(F.lit('{"a": '), "props", F.lit(', "b": ["'), "event_type", F.lit('", 2.5], "c": {}}'))
    return N.flatten_json(table(spark, sf_dir, "events").select("event_id", text.alias("j")), "j", ["event_id"])


@register("converted_controls", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber = 1 THEN 20 * log10(l_quantity) END AS level, CASE WHEN l_linenumber <> 1 THEN 'conflicting or nonnumeric' END AS level_issue,
  CASE WHEN l_discount * 100.0 <= 5 THEN l_discount * 100.0 END AS share, CASE WHEN l_discount * 100.0 > 5 THEN 'outside the domain' END AS share_issue
FROM lineitem
""")  # fmt: skip
def converted_controls(spark, sf_dir):
    """Native controls under several names, converted and checked."""
    quantity = F.col("l_quantity").cast("string")
    native = F.create_map(F.lit("a"), quantity, F.lit("b"), F.when(F.col("l_linenumber") == 1, quantity).otherwise(F.lit("7.25")), F.lit("share"), F.col("l_discount").cast("string"))
    level, share = N.convert_control(native, ["a", "b", "none"], "amplitude_to_db"), N.convert_control(native, ["share"], "scale", 100.0, high=5.0)
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", level["value"].alias("level"), level["issue"].alias("level_issue"), share["value"].alias("share"), share["issue"].alias("share_issue"))


@register("equaliser_units", """
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'eq_gain' WHEN p_size % 4 = 1 THEN 'eq_gain,Bell,Shelf,eq_gain' WHEN p_size % 4 = 2 THEN 'eq_gain,Shelf,eq_gain' ELSE 'eq_gain,eq_gain' END AS units FROM part
""")  # fmt: skip
def equaliser_units(spark, sf_dir):
    """Bands of an equaliser as ordered units, mute, solo and Off respected."""
    kind = F.col("p_size") % 4
    made = F.map_filter(
        F.create_map(
            F.lit("input-gain"), F.lit("0"), F.lit("output-gain"), F.when(kind > 0, F.lit("-3")), F.lit("band0/type"), F.when(kind == 0, "Off").otherwise("Bell"), F.lit("band0/gain"), F.col("p_size").cast("string"),
            F.lit("band0/mute"), F.when(kind == 2, "true"), F.lit("band1/type"), F.when(kind > 0, "Shelf"), F.lit("band1/gain"), F.lit("1"), F.lit("band1/solo"), F.when(kind == 3, "true"),
        ), lambda _, v: v.isNotNull(),
    )
    units = N.expand_bands(made, 2)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(units, lambda u: F.when(u["plugin"] == "eq_gain", u["plugin"]).otherwise(u["subtype"])), ",").alias("units"))


@register("tempo_synced", """
SELECT o_orderkey, 60.0 / (CASE WHEN o_orderkey % 5 = 0 THEN 120.0 ELSE 60 + o_custkey % 100 END) * 0.5 AS seconds, 0.5::DOUBLE AS beats, round((o_totalprice * 2.0 + 1.0 - 1.0) / 2.0, 2) AS price FROM orders
""")  # fmt: skip
def tempo_synced(spark, sf_dir):
    """Scaling and tempo, and their inverses."""
    bpm = F.when(F.col("o_orderkey") % 5 > 0, 60 + F.col("o_custkey") % 100)
    seconds = N.beat_seconds(bpm, F.lit(0.5))
    return table(spark, sf_dir, "orders").select("o_orderkey", seconds.alias("seconds"), N.seconds_beats(bpm, seconds).alias("beats"), F.round(N.unscaled(N.scaled(F.col("o_totalprice"), 2.0, 1.0), 2.0, 1.0), 2).alias("price"))


@register("described_plans", """
SELECT o_orderkey AS plan_id, string_agg(l_returnflag || '(discount=' || l_discount::VARCHAR || ', quantity=' || l_quantity::INT::VARCHAR || ')', ' -> ' ORDER BY l_linenumber, l_extendedprice) AS described
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")  # fmt: skip
def described_plans(spark, sf_dir):
    """Graphs as text."""
    lines = F.split(N.describe_graph(F.col("graph_spec")), "\n")
    return plans(spark, sf_dir).select("plan_id", F.regexp_replace(F.get(lines, F.lit(0)), "^chain main: ", "").alias("described"))


@register("operator_profiles", """
SELECT o_orderkey AS plan_id, list_sort(list(DISTINCT l_returnflag)) AS operators,
  list_sort(list_distinct(flatten(list(CASE l_returnflag WHEN 'A' THEN ['eq', 'pass'] WHEN 'R' THEN ['dynamics', 'eq'] ELSE [] END)))) AS tags
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
""")  # fmt: skip
def operator_profiles(spark, sf_dir):
    """Operators and tags of each plan."""
    registry = spark.createDataFrame([("A", ["eq", "pass"]), ("R", ["dynamics", "eq"])], "operator string, tags array<string>")
    found = N.profile(N.flatten_graph(plans(spark, sf_dir)), registry, ["plan_id"], ["send_bus", "apply_gain"])
    return found.select("plan_id", F.sort_array("operators").alias("operators"), "tags")


@register("profile_terms", """
WITH l AS (SELECT o_orderkey AS plan_id, l_linenumber::VARCHAR AS label, l_returnflag AS op, l_quantity::INT AS q, l_discount AS d, l_extendedprice AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
t AS (
  SELECT plan_id, label || '.quantity' AS name, e, op, CASE WHEN label = '1' THEN CASE WHEN q < 25 THEN 'few' ELSE 'many' END WHEN q < 10 THEN 'low' WHEN q < 30 THEN 'mid' ELSE 'high' END AS term FROM l WHERE op = 'A'
  UNION ALL SELECT plan_id, label || '.discount', e, op, 'some' FROM l WHERE op = 'R'),
n AS (SELECT plan_id, name, arg_max(term, (e, op)) AS term FROM t GROUP BY 1, 2)
SELECT plan_id, coalesce(any_value(named), '') AS terms, CASE WHEN bool_or(op = 'A') THEN 'chain,bright' ELSE 'chain' END || CASE WHEN bool_or(op = 'R') THEN ',tight' ELSE '' END AS overlay
FROM l LEFT JOIN (SELECT plan_id, string_agg(name || '=' || term, ' ' ORDER BY name) AS named FROM n GROUP BY 1) USING (plan_id) GROUP BY 1
""")  # fmt: skip
def profile_terms(spark, sf_dir):
    """The first term of each parameter's band, labels with bands of their own, and terms by tags."""
    rows = N.flatten_graph(plans(spark, sf_dir))
    registry = spark.createDataFrame([("A", ["eq", "pass"]), ("R", ["dynamics", "eq"])], "operator string, tags array<string>")
    bands = spark.createDataFrame(
        [("A", "quantity", None, [10.0, 30.0, 51.0], "ascending", ["low", "mid", "high"]), ("A", "quantity", "1", [25.0, 51.0], "ascending", ["few", "many"]), ("R", "discount", None, [0.05], "absolute", ["some"])],
        "operator string, parameter string, label string, uppers array<double>, direction string, terms array<string>",
    )
    used = N.profile_with_terms(rows, registry, bands, ["plan_id"], ["send_bus", "apply_gain"])
    shown = F.array_join(F.transform(F.map_entries("terms"), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    overlay = N.overlay_terms(F.col("tags"), ["chain"], [(["pass"], ["bright", "chain"]), (["dynamics"], ["tight"])])
    return used.select("plan_id", F.coalesce(shown, F.lit("")).alias("terms"), F.array_join(overlay, ",").alias("overlay"))


@register("unwrapped_texts", """
SELECT doc_id, lang, doc_id % 2 = 0 AS wrapped FROM documents
""")  # fmt: skip
def unwrapped_texts(spark, sf_dir):
    """Rows in either of two shapes, in one."""
    docs = table(spark, sf_dir, "documents")
    even = F.col("doc_id") % 2 == 0
    rows = docs.select(F.when(even, F.struct("doc_id", "lang")).alias("metadata"), F.when(~even, F.col("doc_id")).alias("doc_id"), F.when(~even, F.col("lang")).alias("lang"))
    return N.unwrap(rows, ["doc_id", "lang"])


@register("resolved_references", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR o_custkey % 3 > 0 THEN 'source/' || o_custkey ELSE 'base/' || o_custkey END AS path,
  CASE WHEN o_orderstatus = 'F' THEN 'poisoned_source' WHEN o_custkey % 3 = 0 THEN 'baseline' ELSE 'source' END AS reason FROM orders
""")  # fmt: skip
def resolved_references(spark, sf_dir):
    """The path that a row is compared with, and why."""
    found = N.resolve_reference(F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("base/"), "o_custkey")), F.concat(F.lit("source/"), "o_custkey"), F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").select("o_orderkey", found["path"].alias("path"), found["reason"].alias("reason"))


@register("rule_conditions", """
SELECT event_id, (event_type = 'purchase' AND value >= 50) AS big, NOT (event_type IN ('view', 'click') OR value < 10) AS other,
  list_filter(['big', 'tagged', 'rest'], lambda n: CASE n WHEN 'big' THEN event_type = 'purchase' AND value >= 50 WHEN 'tagged' THEN event_type IN ('error', 'view') ELSE value IS NOT NULL AND value <> 1 END) AS fired
FROM events
""")  # fmt: skip
def rule_conditions(spark, sf_dir):
    """Nested conditions as columns."""
    events = table(spark, sf_dir, "events").withColumn("e", F.struct("value", F.array("event_type").alias("tags")))
    big = {"all": [{"eq": {"path": "event_type", "value": "purchase"}}, {"gte": {"path": "e.value", "value": 50}}]}
    other = {"not": {"any": [{"in": {"path": "event_type", "values": ["view", "click"]}}, {"lt": {"path": "e.value", "value": 10}}]}}
    rules = {"big": big, "tagged": {"contains_any": {"path": "e.tags", "values": ["error", "view"]}}, "rest": {"all": [{"exists": {"path": "value"}}, {"neq": {"path": "value", "value": 1.0}}]}}
    return events.select("event_id", R.condition_column(events, big).alias("big"), R.condition_column(events, other).alias("other"), R.fired_rules(events, rules).alias("fired"))


@register("rule_weights", """
SELECT o_orderkey, NOT (c_mktsegment = 'MACHINERY' AND o_totalprice > 200000) AS allowed,
  ((CASE WHEN c_mktsegment = 'BUILDING' THEN 2.0 ELSE 1.0 END) + (CASE WHEN o_orderpriority = '1-URGENT' THEN 0.5 ELSE 0 END))::DOUBLE AS weight,
  list_filter(['double', 'urgent', 'machines'], lambda n: CASE n WHEN 'double' THEN c_mktsegment = 'BUILDING' WHEN 'urgent' THEN o_orderpriority = '1-URGENT' ELSE c_mktsegment = 'MACHINERY' AND o_totalprice > 200000 END) AS applied
FROM orders JOIN customer ON o_custkey = c_custkey
""")  # fmt: skip
def rule_weights(spark, sf_dir):
    """Weights by rules in order, a reject stops them."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rules = [
        {"name": "double", "when": {"eq": {"path": "c_mktsegment", "value": "BUILDING"}}, "multiplier": 2.0},
        {"name": "urgent", "when": {"eq": {"path": "o_orderpriority", "value": "1-URGENT"}}, "action": "add", "delta": 0.5},
        {"name": "machines", "when": {"all": [{"eq": {"path": "c_mktsegment", "value": "MACHINERY"}}, {"gt": {"path": "o_totalprice", "value": 200000}}]}, "action": "reject"},
    ]
    found = R.resolve_weight(rows, F.lit(1.0), rules)
    return rows.select("o_orderkey", found["allowed"].alias("allowed"), found["weight"].alias("weight"), found["applied"].alias("applied"))


@register("eligible_customers", """
SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'
GROUP BY c_custkey HAVING count(DISTINCT o_orderpriority) >= 3 AND bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH'))
""")  # fmt: skip
def eligible_customers(spark, sf_dir):
    """Enough tags, a wanted target, rows gated before."""
    rows = R.include_exclude(table(spark, sf_dir, "orders"), "o_orderstatus", exclude=["P"], must_have=True)
    per = rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("tags"), F.count(F.lit(1)).alias("n"))
    return per.where(R.eligible(F.col("tags"), 3, F.col("tags"), ["1-URGENT", "2-HIGH"])).select("c_custkey", "n")


@register("whole_order_rejection", """
SELECT l_orderkey, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = l.l_orderkey AND b.l_discount > 0.08) GROUP BY 1
""")  # fmt: skip
def whole_order_rejection(spark, sf_dir):
    """One bad row drops all of its instance."""
    lines = table(spark, sf_dir, "lineitem")
    return R.reject_whole(lines, lines.where("l_discount > 0.08"), ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@register("chain_order", """
WITH r AS (SELECT l_orderkey AS plan_id, l_linenumber * 1000000 + l_partkey AS step, l_returnflag AS operator, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS rank FROM lineitem),
w AS (SELECT *, max(rank) OVER (PARTITION BY plan_id ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT * FROM r))
SELECT problem, count(*) AS n FROM (SELECT CASE WHEN operator = 'N' THEN 'unknown operator' WHEN rank < before THEN 'out of order' END AS problem FROM w) WHERE problem IS NOT NULL GROUP BY 1
""")  # fmt: skip
def chain_order(spark, sf_dir):
    """Chains against the registry and the order of tags."""
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("step"), F.col("l_returnflag").alias("operator")).distinct()
    registry = spark.createDataFrame([("A", ["eq", "odd"]), ("R", ["level", "dynamics"])], "operator string, tags array<string>")
    return R.chain_violations(steps, registry, ["eq", "dynamics"]).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@register("operator_registry", """
WITH s AS (
  SELECT l_orderkey AS plan_id, l_linenumber AS step, CASE l_returnflag WHEN 'A' THEN 'trim' WHEN 'R' THEN 'press' END AS name, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS rank,
    CASE WHEN l_tax > 0.06 THEN 'speed' END AS extra FROM lineitem),
w AS (SELECT *, max(rank) OVER (PARTITION BY plan_id ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT plan_id, step, CASE WHEN name IS NULL THEN 'unknown operator' WHEN name = 'press' AND extra = 'speed' THEN 'unknown parameter: speed' WHEN rank < before THEN 'out of order' END AS problem
FROM w WHERE name IS NULL OR (name = 'press' AND extra = 'speed') OR rank < before
""")  # fmt: skip
def operator_registry(spark, sf_dir):
    """Steps under aliases, with parameters that not every operator has."""
    registry = R.operator_registry(spark, {"trim": {"aliases": ["A"], "tags": ["eq", "odd"], "params": ["amount", "speed"]}, "press": {"aliases": ["R"], "tags": ["level", "dynamics"], "params": ["amount"]}})
    given = F.array_compact(F.array(F.lit("amount"), F.when(F.col("l_tax") > 0.06, "speed")))
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_tax"), "l_orderkey", 100_000)
    steps = lines.select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("operator"), given.alias("given"))
    return R.chain_violations(steps, registry, ["eq", "dynamics"], parameters="given")


@register("null_conditions", """
WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN o_orderpriority END AS b, o_orderkey % 3 <> 1 AS there FROM orders)
SELECT o_orderkey, list_filter([CASE WHEN there THEN 'exists' END, CASE WHEN there AND b IS NULL THEN 'is null' END, CASE WHEN there AND b IS DISTINCT FROM '1-URGENT' THEN 'not urgent' END,
  CASE WHEN there AND (b IS NULL OR b = '2-HIGH') THEN 'null or high' END, CASE WHEN NOT (there AND b IS NULL) THEN 'anything else' END, CASE WHEN there AND b IS NULL THEN 'holds null' END,
  CASE WHEN there AND b > '3' THEN 'late' END], lambda x: x IS NOT NULL) AS fired FROM o
""")  # fmt: skip
def null_conditions(spark, sf_dir):
    """A field that is null, and one that isn't there."""
    kind = F.col("o_orderkey") % 3
    text = F.when(kind == 0, F.lit('{"a": {"b": null}}')).when(kind == 1, F.lit('{"a": {}}')).otherwise(F.concat(F.lit('{"a": {"b": "'), "o_orderpriority", F.lit('"}}')))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.parse_json(text).alias("record"))
    b, fields = "a.b", N.variant_fields(F.col("record"), ["a.b"])
    null = {"eq": {"path": b, "value": None}}
    rules = {
        "exists": {"exists": {"path": b}}, "is null": null, "not urgent": {"neq": {"path": b, "value": "1-URGENT"}}, "null or high": {"in": {"path": b, "values": [None, "2-HIGH"]}},
        "anything else": {"not": null}, "holds null": {"contains_any": {"path": b, "values": [None]}}, "late": {"gt": {"path": b, "value": "3"}},
    }
    fired = F.array_compact(F.array(*[F.when(R.condition_column(rows, c, fields=fields), F.lit(n)) for n, c in rules.items()]))
    return rows.select("o_orderkey", fired.alias("fired"))


@register("trigger_gates", """
SELECT c_custkey, fired, CASE WHEN len(fired) = 0 THEN 'plausible' WHEN c_custkey % 3 = 0 THEN 'unclear' END AS verdict FROM (
  SELECT c_custkey, list_filter([CASE WHEN c_acctbal > 5000 THEN 'rich' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'machines' END], lambda x: x IS NOT NULL) AS fired FROM customer)
""")  # fmt: skip
def trigger_gates(spark, sf_dir):
    """What fires, and the verdict where no judge is needed."""
    rows = table(spark, sf_dir, "customer").withColumn("caption", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")))
    gate = R.trigger_gate(rows, {"rich": {"gt": {"path": "c_acctbal", "value": 5000}}, "machines": {"eq": {"path": "c_mktsegment", "value": "MACHINERY"}}}, "caption")
    return rows.select("c_custkey", gate["fired"].alias("fired"), gate["verdict"].alias("verdict"))


@register("parameter_histogram", f"""
WITH {PARAMETERS}
SELECT operator, parameter, value, count(*) AS n FROM parameters WHERE parameter = 'quantity' OR parameter = 'discount' GROUP BY 1, 2, 3
""")  # fmt: skip
def parameter_histogram(spark, sf_dir):
    """How often each value of a parameter is set."""
    rows = N.flatten_graph(plans(spark, sf_dir)).where(F.col("parameter").isin("quantity", "discount"))
    return S.parameter_histogram(rows)


@register("chain_budget", """
WITH t AS (
  SELECT l_orderkey AS plan_id, count(DISTINCT l_linenumber) AS n, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity - 25 ELSE 0 END) AS gain, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS r,
    max(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN l_quantity * 10 END) AS hp, min(CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN l_quantity * 100 END) AS lp
  FROM lineitem GROUP BY 1)
SELECT plan_id, list_filter([CASE WHEN n NOT BETWEEN 3 AND 10 THEN 'length' END, CASE WHEN abs(gain) > 10 THEN 'gain' END, CASE WHEN lp / greatest(hp, 1.0) < 8 THEN 'pass band' END, CASE WHEN r > 1 THEN 'too many: R' END], lambda x: x IS NOT NULL) AS problems FROM t
""")  # fmt: skip
def chain_budget(spark, sf_dir):
    """Limits on chains."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("step"), flag.alias("tag"),
        F.when(flag == "A", "apply_gain").when((flag == "N") & (status == "F"), "apply_highpass_filter").when(flag == "N", "apply_lowpass_filter").otherwise("other").alias("operator"),
        F.when(flag == "A", "gain_db").when(flag == "N", "cutoff_frequency_hz").otherwise("x").alias("parameter"),
        F.when(flag == "A", F.col("l_quantity") - 25).when(status == "F", F.col("l_quantity") * 10).otherwise(F.col("l_quantity") * 100).alias("value"),
    )
    return R.chain_budget(rows, most={"R": 1})


@register("range_warnings", f"""
WITH {PARAMETERS}
SELECT severity, operator, parameter, count(*) AS n FROM (
  SELECT *, CASE WHEN parameter = 'quantity' AND operator = 'A' AND NOT value BETWEEN 5 AND 40 THEN 'out_of_range' WHEN parameter = 'quantity' AND operator = 'R' AND value NOT IN (10, 20, 30) THEN CASE WHEN value BETWEEN 0 AND 100 THEN 'off_grid' ELSE 'out_of_range' END END AS severity FROM parameters)
WHERE severity IS NOT NULL GROUP BY 1, 2, 3
""")  # fmt: skip
def range_warnings(spark, sf_dir):
    """Values outside what is sampled."""
    priors = spark.createDataFrame([("A", "quantity", 5.0, 40.0, None), ("R", "quantity", 0.0, 100.0, [10.0, 20.0, 30.0])], "operator string, parameter string, low double, high double, grid array<double>")
    found = R.range_warnings(N.flatten_graph(plans(spark, sf_dir)), priors, {"mix": 1.0})
    return found.groupBy("severity", "operator", "parameter").agg(F.count(F.lit(1)).alias("n"))


@register("guarded_orders", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def guarded_orders(spark, sf_dir):
    """C11: a run stops on missing keys before anything is written."""
    return R.guard(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"]).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@register("intent_filter", """
WITH x AS (SELECT l_returnflag AS source, l_orderkey AS record, l_linenumber || '-' || l_partkey AS instance, 'quantity' AS parameter, l_quantity AS value, l_linestatus AS routing FROM lineitem
  UNION ALL SELECT l_returnflag, l_orderkey, l_linenumber || '-' || l_partkey, 'tax', l_tax, l_linestatus FROM lineitem),
b AS (SELECT *, routing = 'O' OR (parameter = 'tax' AND source = 'N') OR (parameter = 'quantity' AND NOT value BETWEEN 10 AND 30) OR (parameter = 'tax' AND NOT value BETWEEN 0 AND 0.06) AS bad FROM x)
SELECT source, parameter, count(*) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM b c WHERE c.bad AND c.source = b.source AND c.record = b.record AND c.instance = b.instance) GROUP BY 1, 2
""")  # fmt: skip
def intent_filter(spark, sf_dir):
    """Observations that a policy lets through, by whole instances."""
    pairs = F.explode(F.create_map(F.lit("quantity"), "l_quantity", F.lit("tax"), "l_tax")).alias("parameter", "value")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("record"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("instance"), F.when(F.col("l_linestatus") == "O", "send").otherwise("insert").alias("routing"), pairs)
    policy = spark.createDataFrame([("quantity", 10.0, 30.0, []), ("tax", 0.0, 0.06, ["N"])], "parameter string, low double, high double, blocked array<string>")
    return R.intent_filter(rows, policy).groupBy("source", "parameter").agg(F.count(F.lit(1)).alias("n"))


@register("family_intents", """
WITH x AS (SELECT l_returnflag AS source, l_returnflag || '/' || l_orderkey || '/' || l_linenumber || '-' || l_partkey AS instance, l_quantity AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
SELECT source, count(*) AS n FROM x WHERE instance NOT IN (SELECT instance FROM x WHERE NOT value BETWEEN 10 AND 30) GROUP BY 1
""")  # fmt: skip
def family_intents(spark, sf_dir):
    """Observations of one family, which a context tells."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(F.col("l_returnflag").alias("source"), F.col("l_orderkey").alias("record"), F.concat_ws("-", "l_linenumber", "l_partkey").alias("instance"), F.lit("insert").alias("routing"), F.lit("quantity").alias("parameter"), F.col("l_quantity").alias("value"), "o_orderpriority")
    policy = spark.createDataFrame([("quantity", 10.0, 30.0, [])], "parameter string, low double, high double, blocked array<string>")
    return R.intent_filter(rows, policy, context="o_orderpriority", families={"1-urgent": "first", "2-high": "first", "5-low": "last"}, family="first").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("observed_controls", """
SELECT l_returnflag AS effect, 'quantity' AS parameter, count(*) AS n, sum(l_quantity) AS total FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1
""")  # fmt: skip
def observed_controls(spark, sf_dir):
    """One row per control of every enabled instance."""
    item = F.struct(F.col("l_linenumber").cast("string").alias("instance_id"), F.lit("p").alias("plugin"), F.col("l_returnflag").alias("effect"), (F.col("l_linestatus") == "F").alias("enabled"), F.lit("insert").alias("routing"), F.create_map(F.lit("quantity"), F.col("l_quantity").cast("string")).alias("parameters"))
    records = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(item).alias("instances")).withColumns({"source": F.lit("s"), "split": F.lit("train")})
    return N.observations(records).groupBy("effect", "parameter").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
