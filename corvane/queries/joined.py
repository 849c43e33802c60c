"""Queries over joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import sets as S
from ..registry import register
from .nested import spread, table


@register("accepted_documents", """
SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id) WHERE l.toxic = 0
""")  # fmt: skip
def accepted_documents(spark, sf_dir):
    """Texts with the verdicts that keep them."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    report = labels.withColumn("disposition", F.when(F.col("toxic") == 0, "accept").otherwise("reject"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return J.join_accepted(docs, report, ["doc_id"], ["accept"]).select("doc_id", "lang", "verdict.quality")


@register("last_shipments", """
SELECT o_orderkey, o_orderpriority, arg_max(l_linenumber, (l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
""")  # fmt: skip
def last_shipments(spark, sf_dir):
    """The last manifest row of each key wins."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.pair_with_render(table(spark, sf_dir, "orders"), lines, ["o_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("o_orderkey", "o_orderpriority", "l_linenumber")


@register("assembled_captions", """
SELECT p_partkey, lower(array_to_string(list_distinct_ordered, ' ')) AS caption FROM (
  SELECT p_partkey, list_filter([p_type, p_brand, CASE WHEN p_name <> p_type AND p_name <> p_brand THEN p_name END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM part)
""")  # fmt: skip
def assembled_captions(spark, sf_dir):
    """D3: distinct parts of a text in order."""
    caption = J.assembled_text(F.array("p_type"), F.array("p_brand", "p_type"), F.array(F.col("p_name"), F.lit(None)))
    return table(spark, sf_dir, "part").select("p_partkey", caption.alias("caption"))


@register("pending_orders", """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')
""")  # fmt: skip
def pending_orders(spark, sf_dir):
    """What is still to do; failures count as not done."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return J.pending(table(spark, sf_dir, "orders").select("o_orderkey"), lines, ["o_orderkey"], F.col("l_linestatus") == "F")


@register("reconciled_counts", """
WITH a AS (SELECT o_orderkey AS k, o_orderkey % 7 + 1 AS n FROM orders WHERE o_orderkey % 11 > 0), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS matched, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL AND a.n <> b.n) AS mismatched,
  count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right FROM a FULL JOIN b ON a.k = b.k
""")  # fmt: skip
def reconciled_counts(spark, sf_dir):
    """What two sides share and lack."""
    a = table(spark, sf_dir, "orders").where("o_orderkey % 11 > 0").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 7 + 1).alias("n"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return J.reconcile(a, b, ["k"], "n")


@register("upgraded_references", """
SELECT c_custkey, CASE WHEN o.k IS NOT NULL AND c_mktsegment <> 'MACHINERY' THEN 'order ' || o.k ELSE c_name END AS reference FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY 1) o ON c_custkey = o_custkey
""")  # fmt: skip
def upgraded_references(spark, sf_dir):
    """References replaced by baselines, poisoned rows left alone."""
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat(F.lit("order "), F.min("o_orderkey")).alias("reference"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("reference"), (F.col("c_mktsegment") == "MACHINERY").alias("p"))
    return J.upgrade_reference(rows, first, ["c_custkey"], "p").drop("p")


@register("parts_in_use", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def parts_in_use(spark, sf_dir):
    """Rows that a provenance names."""
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return J.from_provenance(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), used, ["p_partkey"])


@register("next_purchases", """
SELECT e.event_id, min(p.ts) AS next_at FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts > e.ts AND p.ts < date_trunc('day', e.ts) + INTERVAL 1 DAY
WHERE e.event_type = 'error' GROUP BY 1
""")  # fmt: skip
def next_purchases(spark, sf_dir):
    """Each event takes the next target of its group within its day."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    until = F.date_trunc("day", "ts") + F.expr("interval 1 day")
    found = J.next_after(e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'purchase'"), ["user_id"], "ts", "event_id", until)
    return found.select("event_id", "next_at")


@register("overlapping_prices", """
WITH i AS (SELECT p_brand, p_type, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1, 2)
SELECT a.p_brand, a.p_type, b.p_type AS r_p_type, round(least(a.hi, b.hi) - greatest(a.lo, b.lo), 6) AS shared FROM i a JOIN i b ON a.p_brand = b.p_brand AND a.lo < b.hi AND b.lo < a.hi
""")  # fmt: skip
def overlapping_prices(spark, sf_dir):
    """Intervals that overlap, by slots."""
    i = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    found = J.overlaps(i, i, ["p_brand"], 25.0)
    return found.select("p_brand", "p_type", "r_p_type", F.round(F.least("hi", "r_hi") - F.greatest("lo", "r_lo"), 6).alias("shared"))


@register("rule_regions", """
WITH s AS (SELECT p_brand, min(p_retailprice) AS a, max(p_retailprice) AS b FROM part WHERE p_type = 'SMALL' GROUP BY 1), brands AS (SELECT DISTINCT p_brand FROM part),
r AS (SELECT p_brand, rule, lo, hi FROM brands, (VALUES ('low', 0.0::DOUBLE, 905.0::DOUBLE), ('all', 0.0, 100000.0), ('mid', 950.0, 960.0), ('none', 5000.0, 6000.0)) v(rule, lo, hi))
SELECT p_brand, rule, CASE WHEN a IS NULL THEN 'unreachable' WHEN lo <= a AND b <= hi THEN 'vacuous' WHEN lo <= b AND a <= hi THEN 'live' ELSE 'dormant' END AS status FROM r LEFT JOIN s USING (p_brand)
""")  # fmt: skip
def rule_regions(spark, sf_dir):
    """Rules against what was observed."""
    part = table(spark, sf_dir, "part")
    supports = part.where("p_type = 'SMALL'").groupBy("p_brand").agg(F.min("p_retailprice").alias("s_lo"), F.max("p_retailprice").alias("s_hi"))
    rules = spark.createDataFrame([("low", 0.0, 905.0), ("all", 0.0, 100000.0), ("mid", 950.0, 960.0), ("none", 5000.0, 6000.0)], "rule string, lo double, hi double")
    return J.region_status(part.select("p_brand").distinct().crossJoin(F.broadcast(rules)), supports, ["p_brand"]).select("p_brand", "rule", "status")


@register("band_coverage", """
WITH b AS (SELECT p_brand, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 40 THEN 1 WHEN p_size < 41 THEN 2 ELSE -1 END AS band FROM part)
SELECT k.p_brand, k.band, count(b.band) AS n FROM (SELECT p_brand, unnest([0, 1, 2]) AS band FROM (SELECT DISTINCT p_brand FROM part) UNION SELECT p_brand, band FROM b) k LEFT JOIN b USING (p_brand, band) GROUP BY 1, 2
""")  # fmt: skip
def band_coverage(spark, sf_dir):
    """Bands that nothing reaches, values above the top."""
    return J.band_coverage(table(spark, sf_dir, "part"), ["p_brand"], "p_size", [10, 40, 41])


@register("redistributed_mass", """
WITH i AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(*)::DOUBLE AS mass FROM part GROUP BY 1), b AS (SELECT k AS bin, 900.0::DOUBLE + 50 * k AS b_lo, 950.0::DOUBLE + 50 * k AS b_hi FROM range(0, 30) t(k))
SELECT p_brand, bin, round(sum(mass * (least(hi, b_hi) - greatest(lo, b_lo)) / (hi - lo)), 6) AS mass FROM i JOIN b ON lo < b_hi AND b_lo < hi GROUP BY 1, 2
""")  # fmt: skip
def redistributed_mass(spark, sf_dir):
    """Masses of intervals on a common grid."""
    i = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"), F.count(F.lit(1)).cast("double").alias("mass"))
    grid = spark.range(30).select(F.col("id").alias("bin"), (900.0 + 50 * F.col("id")).alias("b_lo"), (950.0 + 50 * F.col("id")).alias("b_hi"))
    return J.redistribute(i, grid, ["p_brand"]).select("p_brand", "bin", F.round("mass", 6).alias("mass"))


@register("expanded_plans", """
SELECT c_custkey, recipe, count(*) AS n, sum(gain * 10 + mix) AS total FROM (
  SELECT c_custkey, recipe, unnest(list_distinct([c_mktsegment, 'ALL'])) AS target, gain, mix FROM customer, (VALUES ('a', 0), ('b', 5000)) r(recipe, least), (SELECT unnest([1, 2, 3]) AS gain), (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE]) AS mix) WHERE c_acctbal >= least)
GROUP BY 1, 2
""")  # fmt: skip
def expanded_plans(spark, sf_dir):
    """Rows by recipes, targets and grids, filtered before they are spread."""
    recipes = spark.createDataFrame([("a", 0), ("b", 5000)], "recipe string, least int")
    rows = spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_acctbal", F.array_distinct(F.array("c_mktsegment", F.lit("ALL"))).alias("targets"))
    wide = J.expand(rows, recipes, {"gain": [1, 2, 3], "mix": [0.5, 1.0]}, F.col("c_acctbal") >= F.col("least"), "targets", 32, ["c_custkey", "recipe"], most=10**9)
    return wide.groupBy("c_custkey", "recipe").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gain") * 10 + F.col("mix")).alias("total"))


@register("poisoned_plans", """
WITH r AS (SELECT c_custkey, recipe, c_acctbal FROM customer, (VALUES ('a', 0), ('b', 5000), ('c', 0)) r(recipe, least) WHERE c_acctbal >= least),
p AS (SELECT * FROM (VALUES ('a', 'hum', -10000), ('a', 'clip', 3000), ('b', 'hiss', 7000)) p(recipe, poison, floor))
SELECT c_custkey, r.recipe, poison, gain FROM r LEFT JOIN p ON p.recipe = r.recipe, (SELECT unnest([1, 2]) AS gain) WHERE poison IS NULL OR c_acctbal >= floor
""")  # fmt: skip
def poisoned_plans(spark, sf_dir):
    """Plans with each poison that a row allows; a recipe whose poisons all fail has no plan."""
    recipes = spark.createDataFrame([("a", 0), ("b", 5000), ("c", 0)], "recipe string, least int")
    poisons = spark.createDataFrame([("a", "hum", -10000), ("a", "clip", 3000), ("b", "hiss", 7000)], "recipe string, poison string, floor int")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return J.expand(rows, recipes, {"gain": [1, 2]}, F.col("c_acctbal") >= F.col("least"), cap=None, poisons=poisons, poison_when=F.col("c_acctbal") >= F.col("floor")).select("c_custkey", "recipe", "poison", "gain")


@register("matched_rules", """
SELECT p_partkey, CASE WHEN p_type = 'SMALL' AND p_size = 7 THEN 'seven' WHEN p_type = 'LARGE' THEN 'large' END AS rule FROM part
""")  # fmt: skip
def matched_rules(spark, sf_dir):
    """At most one mapping rule for a row."""
    rules = spark.createDataFrame([("k", "seven", ["SMALL"], {"size": "7"}), ("k", "large", ["LARGE"], {})], "adapter string, rule string, subtypes array<string>, equals map<string,string>")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("k").alias("adapter"), F.col("p_type").alias("subtype"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("parameters"))
    return J.matched_rules(rows, rules, ["adapter"]).select(F.col("id").alias("p_partkey"), "rule")


@register("mapped_targets", """
WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tag, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part),
m AS (SELECT p_partkey, i, t.tag, stem, family, priority FROM t JOIN (VALUES ('ring', 'metal', 'round', 2), ('bolt', 'metal', 'long', 5), ('small', 'size', 'little', 9), ('red', 'other', 'x', 1)) v(tag, stem, family, priority) ON v.tag = t.tag WHERE stem <> 'other'),
f AS (SELECT p_partkey, stem, family, arg_min(priority, i) AS priority, arg_min(tag, i) AS tag FROM m GROUP BY 1, 2, 3)
SELECT p.p_partkey, list_filter(list(stem || '/' || f.tag ORDER BY -priority, stem, f.tag), lambda x: x IS NOT NULL) AS targets FROM part p LEFT JOIN f USING (p_partkey) GROUP BY 1
""")  # fmt: skip
def mapped_targets(spark, sf_dir):
    """Tags to targets, distinct and by priority."""
    mapping = spark.createDataFrame([("ring", "metal", "round", 2), ("bolt", "metal", "long", 5), ("small", "size", "little", 9), ("red", "other", "x", 1)], "tag string, stem string, family string, priority int")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("tags"))
    return J.mapped_targets(rows, "tags", mapping, "p_partkey").select("p_partkey", F.transform("targets", lambda x: F.concat_ws("/", x["stem"], x["tag"])).alias("targets"))


@register("resolved_dependencies", """
SELECT c_custkey, CASE WHEN n = 1 THEN k END AS path, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' END AS issue FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey)::VARCHAR AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON c_custkey = o_custkey
""")  # fmt: skip
def resolved_dependencies(spark, sf_dir):
    """None, one or many candidates."""
    files = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("k"))
    found = J.resolved_dependencies(table(spark, sf_dir, "customer").select("c_custkey"), files.withColumnRenamed("k", "path"), ["c_custkey"])
    return found.select("c_custkey", F.col("path").cast("string").alias("path"), "issue")


@register("assembled_manifests", """
SELECT c_custkey, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'O'), []) AS open, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F'), []) AS done
FROM (SELECT o_custkey AS c_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F')) GROUP BY 1
""")  # fmt: skip
def assembled_manifests(spark, sf_dir):
    """Several manifests by key."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    found = J.assembled({"open": o.where("o_orderstatus = 'O'"), "done": o.where("o_orderstatus = 'F'")}, "c_custkey", ["o_orderkey"])
    return found.select("c_custkey", *[F.transform(c, lambda x: x["o_orderkey"]).alias(c) for c in ("open", "done")])


@register("missing_artifacts", """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN d.lang = 'de' THEN 'no_path' WHEN l.doc_id IS NULL THEN 'missing_file' WHEN quality = 0 THEN 'empty_file' END AS reason FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)) GROUP BY 1
""")  # fmt: skip
def missing_artifacts(spark, sf_dir):
    """Outputs that are missing, by reason."""
    manifest = table(spark, sf_dir, "documents").select(F.when(F.col("lang") != "de", F.concat(F.lit("f"), "doc_id")).alias("output_path"))
    listing = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("length")).select(F.concat(F.lit("f"), "doc_id").alias("path"), "length")
    return J.missing_artifacts(manifest, listing).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("overlaid_customers", """
SELECT c_custkey, coalesce(o.s, c_mktsegment) AS c_mktsegment, c_nationkey FROM customer LEFT JOIN (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS s FROM orders GROUP BY 1) o ON c_custkey = o_custkey
""")  # fmt: skip
def overlaid_customers(spark, sf_dir):
    """One side's columns win where they aren't null."""
    over = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("c_mktsegment"))
    return J.overlay(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), over, ["c_custkey"], ["c_mktsegment"])


@register("parameter_provenance", """
WITH s AS (SELECT l_orderkey, l_quantity AS value, CASE WHEN l_orderkey % 50 = 0 AND l_returnflag = 'A' THEN 'own' WHEN l_returnflag = 'A' THEN 'conf' WHEN l_returnflag = 'R' THEN 'two' END AS d FROM lineitem)
SELECT CASE d WHEN 'own' THEN 'prior' WHEN 'conf' THEN 'prior' WHEN 'two' THEN 'ambiguous' ELSE 'authored' END AS status, CASE d WHEN 'own' THEN 'q2' WHEN 'conf' THEN 'q' END AS prior, count(*) AS n,
  sum(CASE d WHEN 'own' THEN value / 4 WHEN 'conf' THEN (value - 1) / 2 END) AS total FROM s GROUP BY 1, 2
""")  # fmt: skip
def parameter_provenance(spark, sf_dir):
    """Parameters back to their priors."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_returnflag").alias("operator"), F.col("l_quantity").alias("value"))
    definitions = spark.createDataFrame([("A", "q", 2.0, 1.0), ("R", "x", 1.0, 0.0), ("R", "y", 1.0, 0.0)], "operator string, prior string, factor double, offset double")
    own = rows.where("plan_id % 50 = 0 and operator = 'A'").select("plan_id", "operator").distinct().withColumns({"prior": F.lit("q2"), "factor": F.lit(4.0), "offset": F.lit(0.0)})
    found = J.parameter_provenance(rows, definitions, own, ["operator"], "plan_id")
    return found.groupBy("status", "prior").agg(F.count(F.lit(1)).alias("n"), F.sum("resolved_value").alias("total"))


@register("dead_parts", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_discount < 0.02)")
def dead_parts(spark, sf_dir):
    """H1, H5: configured, never used."""
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_discount < 0.02").select(F.col("l_partkey").alias("p_partkey"))
    return S.dead(table(spark, sf_dir, "part"), used, ["p_partkey"])


@register("united_documents", """
SELECT doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)
""")  # fmt: skip
def united_documents(spark, sf_dir):
    """Unions of unlike parts, the first row of a key kept."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return S.union_first([labels, table(spark, sf_dir, "documents").select("doc_id")], ["doc_id"], ["doc_id"]).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@register("touched_customers", """
SELECT o_custkey, bool_or(o_orderpriority IN ('1-URGENT', '5-LOW')) AS touches, count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority END) = 2 AS covers FROM orders GROUP BY 1
""")  # fmt: skip
def touched_customers(spark, sf_dir):
    """H3: intersections and containment."""
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return sets.select("o_custkey", S.touches(F.col("p"), ["1-URGENT", "5-LOW"]).alias("touches"), S.covers(F.col("p"), ["1-URGENT", "2-HIGH"]).alias("covers"))


@register("drifted_statuses", "SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus <> 'O'")
def drifted_statuses(spark, sf_dir):
    """H4: versions other than the expected one."""
    return S.drift(table(spark, sf_dir, "orders"), "o_orderstatus", "O")
