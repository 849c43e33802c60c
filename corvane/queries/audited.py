"""Queries that hold rows against rules, definitions and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dist as D
from ..functions import nested as N
from ..functions import text as T
from ..functions import vectors as V
from ..operators import audit as A
from ..operators import joins as J
from ..operators import stats as S
from ..registry import register
from .nested import table


@register("next_or_only_purchases", """
WITH p AS (SELECT user_id, ts::DATE AS day, ts, floor(value / 10)::INT AS t FROM events WHERE event_type = 'purchase' AND value IS NOT NULL),
lone AS (SELECT user_id, day, min(t) AS t FROM p GROUP BY 1, 2 HAVING min(t) = max(t)),
n AS (SELECT e.event_id, e.user_id, e.ts::DATE AS day, min(p.ts) AS at FROM events e LEFT JOIN p ON p.user_id = e.user_id AND p.day = e.ts::DATE AND p.ts > e.ts WHERE e.event_type = 'error' GROUP BY 1, 2, 3)
SELECT n.event_id, coalesce((SELECT max(p.t) FROM p WHERE p.user_id = n.user_id AND p.ts = n.at), lone.t) AS target FROM n LEFT JOIN lone USING (user_id, day)
""")  # fmt: skip
def next_or_only_purchases(spark, sf_dir):
    """Each event takes the next target of its day, or the only one that the day has."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    targets = e.where("event_type = 'purchase' and value is not null").groupBy("user_id", "day", "ts").agg(F.max(F.floor(F.col("value") / 10).cast("int")).alias("target"))
    found = J.next_after(e.where("event_type = 'error'").select("event_id", "user_id", "day", "ts"), targets, ["user_id", "day"], "ts", "target")
    return J.with_only_target(found, targets, ["user_id", "day"], "target").select("event_id", F.col("next_target").alias("target"))


@register("rule_statuses", """
WITH s AS (SELECT p_brand, p_type, min(p_retailprice) AS a, max(p_retailprice) AS b FROM part GROUP BY 1, 2), brands AS (SELECT DISTINCT p_brand FROM part),
r AS (SELECT p_brand, rule, CASE kind WHEN 'own' THEN p_brand WHEN 'ghost' THEN p_brand || '-ghost' END AS operator, type AS p_type, lo, hi FROM brands, (VALUES
  ('low', 'own', 'SMALL', 0.0::DOUBLE, 905.0::DOUBLE), ('all', 'own', 'SMALL', 0.0, 100000.0), ('both', 'own', 'SMALL', 0.0, 100000.0), ('both', 'own', 'LARGE', 5000.0, 6000.0), ('none', 'own', 'NOTHING', 0.0, 1.0), ('none', 'own', 'LARGE', 5000.0, 6000.0),
  ('ghost', 'ghost', 'SMALL', 0.0, 1.0), ('ghost', 'own', 'NOTHING', 0.0, 1.0), ('text', NULL, NULL, NULL, NULL), ('there', 'own', NULL, NULL, NULL)) v(rule, kind, type, lo, hi)),
l AS (SELECT r.p_brand, rule, CASE WHEN operator LIKE '%-ghost' THEN 5 WHEN operator IS NULL OR r.p_type IS NULL THEN 0 WHEN a IS NULL THEN 4 WHEN lo > b OR a > hi THEN 3 WHEN lo <= a AND b <= hi THEN 1 ELSE 2 END AS level
  FROM r LEFT JOIN s ON s.p_brand = r.operator AND s.p_type = r.p_type)
SELECT p_brand || '/' || rule AS rule, CASE max(level) WHEN 5 THEN 'unreachable_operator' WHEN 4 THEN 'dormant_no_param' WHEN 3 THEN 'dormant_distribution' WHEN 2 THEN 'live' WHEN 1 THEN 'vacuous' ELSE 'data_dependent' END AS status FROM l GROUP BY p_brand, rule
""")  # fmt: skip
def rule_statuses(spark, sf_dir):
    """Which rules can fire at all, and what keeps the others from it."""
    part = table(spark, sf_dir, "part")
    supports = part.groupBy(F.col("p_brand").alias("operator"), F.col("p_type").alias("parameter")).agg(F.min("p_retailprice").alias("s_lo"), F.max("p_retailprice").alias("s_hi"))
    brands = part.select(F.col("p_brand").alias("brand")).distinct()
    rules = [
        ("low", "own", "SMALL", 0.0, 905.0), ("all", "own", "SMALL", 0.0, 100000.0), ("both", "own", "SMALL", 0.0, 100000.0), ("both", "own", "LARGE", 5000.0, 6000.0), ("none", "own", "NOTHING", 0.0, 1.0),
        ("none", "own", "LARGE", 5000.0, 6000.0), ("ghost", "ghost", "SMALL", 0.0, 1.0), ("ghost", "own", "NOTHING", 0.0, 1.0), ("text", None, None, None, None), ("there", "own", None, None, None),
    ]
    config = spark.createDataFrame(rules, "name string, kind string, parameter string, lo double, hi double")
    operator = F.when(F.col("kind") == "own", F.col("brand")).when(F.col("kind") == "ghost", F.concat("brand", F.lit("-ghost")))
    leaves = brands.crossJoin(F.broadcast(config)).select(F.concat_ws("/", "brand", "name").alias("rule"), operator.alias("operator"), "parameter", "lo", "hi")
    return J.rule_status(leaves, supports, brands.select(F.col("brand").alias("operator")))


@register("provenance_statuses", """
WITH x AS (SELECT l_orderkey AS o, l_linenumber AS line, l_returnflag || l_linestatus AS op, l_quantity AS v, CASE WHEN l_suppkey % 3 > 0 THEN 60.0::DOUBLE + l_suppkey % 7 END AS bpm, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag, l_linestatus) AS n FROM lineitem)
SELECT CASE WHEN n > 1 THEN 'ambiguous location' WHEN op = 'AF' THEN 'prior' WHEN op = 'RF' THEN CASE WHEN bpm IS NULL THEN 'missing tempo' ELSE 'prior' END WHEN op = 'NO' THEN CASE WHEN bpm IS NULL THEN 'missing context: bpm' ELSE 'context' END
    WHEN op = 'NF' THEN 'fixed' WHEN op = 'AO' THEN 'authored' WHEN op = 'RO' THEN 'no scalar prior' ELSE 'no definition' END AS status,
  CASE WHEN n > 1 THEN NULL WHEN op = 'AF' THEN 'q' WHEN op = 'RF' AND bpm IS NOT NULL THEN 'beats' END AS reference, count(*) AS n,
  round(sum(CASE WHEN n > 1 THEN v WHEN op = 'AF' THEN (v - 1) / 2 WHEN op = 'RF' AND bpm IS NOT NULL THEN v * bpm / 60 ELSE v END), 4) AS total FROM x GROUP BY 1, 2
""")  # fmt: skip
def provenance_statuses(spark, sf_dir):
    """Parameters back to priors, fixed values, choices and contexts, or the reason why not."""
    bpm = F.when(F.col("l_suppkey") % 3 > 0, F.create_map(F.lit("bpm"), (60 + F.col("l_suppkey") % 7).cast("double"))).otherwise(F.create_map().cast("map<string,double>"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("step"), F.concat("l_returnflag", "l_linestatus").alias("operator"), F.col("l_quantity").alias("value"), bpm.alias("context"))
    kinds = [("AF", "sample", "q", 2.0, 1.0), ("RF", "tempo", "beats", None, None), ("NO", "ref", "bpm", None, None), ("NF", "sample", "q", 0.0, 3.0), ("AO", "values", None, None, None), ("RO", "each", None, None, None)]
    definitions = spark.createDataFrame(kinds, "operator string, kind string, reference string, factor double, offset double")
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("step")).distinct()
    found = J.resolved_parameters(rows, steps.crossJoin(F.broadcast(definitions)), ["l_orderkey"], ["step", "operator"], "context")
    return found.groupBy("status", "reference").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("resolved_value"), 4).alias("total"))


@register("absent_parameters", """
WITH x AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem), d AS (SELECT l_orderkey, unnest(['A', 'N', 'R']) AS l_returnflag FROM (SELECT DISTINCT l_orderkey FROM lineitem))
SELECT l_orderkey, l_returnflag FROM d WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.l_orderkey = d.l_orderkey AND x.l_returnflag = d.l_returnflag)
""")  # fmt: skip
def absent_parameters(spark, sf_dir):
    """Configured places that a row lacks."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.lit("r").alias("recipe"), "l_returnflag")
    definitions = spark.createDataFrame([("r", f) for f in "ANR"], "recipe string, l_returnflag string")
    return J.missing_parameters(definitions, rows, ["l_orderkey"], ["recipe"], ["l_returnflag"])


@register("source_levels", """
WITH s AS (SELECT label, i, sum(embedding[i]::DOUBLE) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2), m AS (SELECT label, sqrt(avg(x * x)) AS mixture FROM s GROUP BY 1),
r AS (SELECT vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) AS rms FROM embeddings)
SELECT vec_id, round(rms / greatest(mixture, 0.001::DOUBLE), 6) AS rms_ratio, rms >= 0.001::DOUBLE AND rms / greatest(mixture, 0.001::DOUBLE) >= 0.02 AS active FROM r JOIN m ON r.label IS NOT DISTINCT FROM m.label
""")  # fmt: skip
def source_levels(spark, sf_dir):
    """Each frame against the sum of its group, and whether it is active in it."""
    found = V.source_levels(table(spark, sf_dir, "embeddings"), ["label"], "embedding", 0.001, 0.02)
    return found.select("vec_id", F.round("rms_ratio", 6).alias("rms_ratio"), "active")


@register("send_presence", """
WITH t AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)
SELECT l_returnflag AS item, count(DISTINCT l_orderkey) AS n, count(DISTINCT l_orderkey)::DOUBLE / (SELECT n FROM t) AS share FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1
""")  # fmt: skip
def send_presence(spark, sf_dir):
    """Records that use an effect on a send."""
    item = F.struct(F.col("l_returnflag").alias("effect"), F.when(F.col("l_linestatus") == "O", "send").otherwise("insert").alias("routing"))
    return S.send_presence(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items")), "items")


@register("leaks_by_part", """
WITH x AS (SELECT p_brand, p_type, p_size, list_filter([p_type, CASE WHEN p_size % 2 = 0 THEN 'even' END], lambda v: v IS NOT NULL) AS t FROM part)
SELECT p_brand, max(CASE WHEN p_size > 25 THEN 'fail' ELSE 'pass' END) AS size, max(CASE WHEN p_size > 25 THEN p_type END) AS size_why, CAST(NULL AS VARCHAR) AS size_reason, list_sort(list_distinct(flatten(list(t)))) AS leaks FROM x GROUP BY 1
""")  # fmt: skip
def leaks_by_part(spark, sf_dir):
    """A report with the distinct tokens that leaked."""
    tokens = F.array_compact(F.array("p_type", F.when(F.col("p_size") % 2 == 0, "even")))
    flags = table(spark, sf_dir, "part").select("p_brand", F.lit("size").alias("flag"), F.when(F.col("p_size") > 25, "fail").otherwise("pass").alias("verdict"), F.col("p_type").alias("rationale"), tokens.alias("tokens"))
    return S.flat_report(flags, ["p_brand"], ["size"], ["fail"], "tokens")


@register("priority_fits", """
WITH r AS (SELECT o_orderpriority, o_custkey, CASE WHEN o_custkey % 17 > 0 THEN o_totalprice END AS x FROM orders),
v AS (SELECT o_orderpriority, x, (x - 1000) / 399000.0::DOUBLE AS f, row_number() OVER (PARTITION BY o_orderpriority ORDER BY x) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM r WHERE x IS NOT NULL),
g AS (SELECT o_orderpriority, count(DISTINCT x) AS distinct_values, count(*) FILTER (WHERE x NOT BETWEEN 1000 AND 400000) AS out_of_support, max(greatest(i::DOUBLE / n - least(greatest(f, 0), 1), least(greatest(f, 0), 1) - (i - 1)::DOUBLE / n)) AS cdf_distance,
  count(DISTINCT CASE WHEN x BETWEEN 1000 AND 400000 THEN least(floor(f * 10), 9) END) AS occupied_bins FROM v GROUP BY 1),
t AS (SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS unresolved, count(DISTINCT o_custkey) AS unique_clips FROM r GROUP BY 1)
SELECT o_orderpriority, n, distinct_values, out_of_support, unresolved, unique_clips, round(cdf_distance, 9) AS cdf_distance, occupied_bins, 10::BIGINT AS total_bins, occupied_bins / 10.0::DOUBLE AS coverage FROM t JOIN g USING (o_orderpriority)
""")  # fmt: skip
def priority_fits(spark, sf_dir):
    """Observed values by group against a continuous prior, with clips and unresolved values."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", F.when(F.col("o_custkey") % 17 > 0, F.col("o_totalprice")).alias("x"))
    model = D.component_table(spark, {"total": {"type": "uniform", "low": 1000.0, "high": 400000.0}})
    found = A.goodness_of_fit(rows, ["o_orderpriority"], "x", model, "o_custkey")
    return found.withColumn("cdf_distance", F.round("cdf_distance", 9))


@register("line_variation", """
WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_returnflag) AS t FROM lineitem GROUP BY 1, 2),
k AS (SELECT l_returnflag, unnest([1, 2, 3, 4, 9]) AS l_linenumber FROM (SELECT DISTINCT l_returnflag FROM lineitem))
SELECT l_returnflag, round(sum(abs(coalesce(n::DOUBLE / t, 0) - CASE WHEN k.l_linenumber IS NULL THEN 0 ELSE 0.2::DOUBLE END)) / 2, 9) AS total_variation FROM c FULL JOIN k USING (l_returnflag, l_linenumber) GROUP BY 1
""")  # fmt: skip
def line_variation(spark, sf_dir):
    """Shares by group against a discrete prior, what either side lacks included."""
    expected = spark.createDataFrame([(k, 0.2) for k in (1, 2, 3, 4, 9)], "l_linenumber int, p double")
    found = A.total_variation(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linenumber"), ["l_returnflag"], "l_linenumber", expected)
    return found.select("l_returnflag", F.round("total_variation", 9).alias("total_variation"))


@register("derived_identifiers", """
SELECT event_type, list_sort(list_distinct(list_concat(['apply_gain', 'room_size'], list(DISTINCT event_type || '_' || hour(ts)) FILTER (WHERE event_type IS NOT NULL)))) AS identifiers FROM events GROUP BY 1
""")  # fmt: skip
def derived_identifiers(spark, sf_dir):
    """Names with an underscore, of a registry and of each group's own fields."""
    registry = spark.createDataFrame([("apply_gain", ["db"]), ("reverb", ["room_size", "wet"])], "operator string, params array<string>")
    rows = table(spark, sf_dir, "events").select("event_type", F.concat_ws("_", "event_type", F.hour("ts")).alias("step"))
    return T.derive_identifiers(registry, rows, ["event_type"], ["event_type", "step"])


@register("derived_paths", """
SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'c' || o_custkey WHEN 1 THEN 'c' || o_custkey END AS clip, o_orderstatus || '-x' AS split, 'raw-' || CASE o_custkey % 3 WHEN 0 THEN 'renders' WHEN 1 THEN 'audio' ELSE 'other' END || '.tar' AS shard,
  CASE WHEN o_orderstatus = 'F' THEN 'initial__p_' || o_orderkey || '.wav' WHEN o_custkey % 3 = 0 THEN 'original.wav' ELSE 'original__' || trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '_', 'g'), '_') || '.wav' END AS baseline FROM orders
""")  # fmt: skip
def derived_paths(spark, sf_dir):
    """Clip, split and shard of paths, and the name of what an edit starts from."""
    kind = F.col("o_custkey") % 3
    clip = F.concat(F.lit("c"), "o_custkey")
    path = F.when(kind == 0, F.concat(F.lit("renders/"), clip, F.lit("/a.wav"))).when(kind == 1, F.concat(F.lit("audio/"), clip, F.lit(".mp3"))).otherwise(F.concat(F.lit("other/"), clip))
    names = F.concat(F.lit("data/"), "o_orderstatus", F.lit("-x-00003-of-00009.parquet"))
    baseline = T.baseline_name(F.col("o_orderstatus") == "F", F.concat(F.lit("p-"), "o_orderkey"), F.when(kind != 0, F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.clip_of_path(path).alias("clip"), T.split_of_path(names).alias("split"), T.shard_of_path(path, "raw-").alias("shard"), baseline.alias("baseline"))


@register("role_mentions", r"""
WITH t AS (SELECT conv_id, turn, role, lower(text) AS t FROM conversations), f AS (SELECT conv_id, turn, role, t, unnest([{'f': 'french', 'w': ['de', 'la']}, {'f': 'german', 'w': ['und', 'der']}], recursive := true) FROM t)
SELECT conv_id, turn, role, f AS family, len(list_filter(string_split_regex(t, '[^a-z0-9]+'), lambda x: list_contains(w, x))) AS n,
  length(string_split_regex(' ' || t || ' ', CASE f WHEN 'french' THEN '[^a-z0-9](de|la)[^a-z0-9]' ELSE '[^a-z0-9](und|der)[^a-z0-9]' END)[1])::INT AS first FROM f
WHERE len(list_filter(string_split_regex(t, '[^a-z0-9]+'), lambda x: list_contains(w, x))) > 0
""")  # fmt: skip
def role_mentions(spark, sf_dir):
    """Spans of terms by role, with their first offset."""
    found = T.role_mentions(table(spark, sf_dir, "conversations").withColumn("said", F.col("text")).withColumnRenamed("role", "speaker"), ["conv_id", "turn", "speaker"], {"text": "said"}, {"french": ["de", "la"], "german": ["und", "der"]})
    return found.groupBy("conv_id", "turn", F.col("speaker").alias("role"), "family").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"))


@register("poisoned_pairs", """
WITH r AS (SELECT l_orderkey AS k, arg_max('out/' || l_linenumber || '-' || l_partkey, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS o, arg_max('base/' || l_suppkey, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS b FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT o_orderkey, r.o AS ground_truth_edit_audio, 'in/' || o_orderkey AS original_clean_audio, r.b AS input_audio FROM orders JOIN r ON r.k = o_orderkey
""")  # fmt: skip
def poisoned_pairs(spark, sf_dir):
    """Texts paired with poisoned renders; failed renders don't count."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") == "R", "error").alias("status"),
        F.concat(F.lit("out/"), "l_linenumber", F.lit("-"), "l_partkey").alias("output_path"), F.concat(F.lit("base/"), "l_suppkey").alias("baseline_path"),
    )
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("in/"), "o_orderkey").alias("input_audio"))
    found = J.agent_pairs(texts, lines, ["o_orderkey"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"], "poisoning")
    return found.select("o_orderkey", "ground_truth_edit_audio", "original_clean_audio", "input_audio")


@register("row_references", """
WITH x AS (SELECT o_orderkey, o_custkey % 5 > 0 AS wrapped, CASE WHEN o_orderkey % 7 > 0 THEN 'e' || o_orderkey END AS edited, CASE WHEN o_orderkey % 11 > 0 THEN 'i' || o_orderkey ELSE '' END AS given, o_orderstatus = 'F' AS poisoned, CASE WHEN o_custkey % 3 = 0 THEN 'c' || o_orderkey END AS clean FROM orders),
y AS (SELECT *, CASE WHEN poisoned AND clean IS NOT NULL THEN clean ELSE nullif(given, '') END AS path FROM x)
SELECT o_orderkey, CASE WHEN wrapped AND edited IS NOT NULL THEN path END AS reference_path, CASE WHEN wrapped AND edited IS NOT NULL AND path IS NOT NULL THEN CASE WHEN poisoned AND clean IS NULL THEN 'poisoned_input' ELSE 'source' END END AS reference FROM y
""")  # fmt: skip
def row_references(spark, sf_dir):
    """What an edit is compared with, and of which kind that is."""
    key = F.col("o_orderkey")
    edited, given = F.when(key % 7 > 0, F.concat(F.lit("e"), key)), F.when(key % 11 > 0, F.concat(F.lit("i"), key)).otherwise("")
    clean = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("c"), key))
    audio = N.row_audio(F.col("o_custkey") % 5 > 0, edited, given, F.col("o_orderstatus") == "F", F.lit(""), clean)
    return table(spark, sf_dir, "orders").select("o_orderkey", audio["reference_path"].alias("reference_path"), audio["reference"].alias("reference"))
