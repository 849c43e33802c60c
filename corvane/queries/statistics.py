"""Queries over corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators.sampling import sampled_against_expected
from ..registry import register
from .nested import table


def user_chains(spark, sf_dir):
    """The ordered event types of each user and day."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.struct("event_id", "event_type").alias("x"))
    return e.groupBy("user_id", "day").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["event_type"]).alias("items"))


CHAINS = "c AS (SELECT user_id, ts::DATE AS day, list(event_type ORDER BY event_id) AS items FROM events GROUP BY 1, 2)"


@register("plan_coverage", """
WITH p AS (SELECT l_orderkey, any_value(l_suppkey % 10) AS clip_id, count(*) AS n FROM (SELECT *, min(l_suppkey) OVER (PARTITION BY l_orderkey) AS s FROM lineitem) WHERE l_suppkey = s GROUP BY 1)
SELECT count(*) AS plans, count(DISTINCT o_custkey) AS clips, avg(n) AS mean_steps, median(n) AS median_steps, count(*)::DOUBLE / count(DISTINCT o_custkey) AS plans_per_clip, count(DISTINCT o_orderpriority) AS n_o_orderpriority
FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
""")  # fmt: skip
def plan_coverage(spark, sf_dir):
    """Totals of a set of plans."""
    steps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_steps"))
    return S.coverage_report(table(spark, sf_dir, "orders").join(steps, "o_orderkey").withColumnRenamed("o_custkey", "clip_id"), ["o_orderpriority"])


@register("value_counts", "SELECT w AS value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def value_counts(spark, sf_dir):
    """The most common values of a list column."""
    return S.value_counts(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("w")), "w", 8, many=True)


@register("parameter_summary", """
SELECT l_suppkey, l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(l_quantity) AS numeric_n,
  quantile_cont(l_quantity, [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]) AS quantiles, count(DISTINCT l_quantity) AS support
FROM lineitem GROUP BY 1, 2
""")  # fmt: skip
def parameter_summary(spark, sf_dir):
    """Counts, quantiles and supports by group."""
    return S.parameter_summary(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity", {"orders": "l_orderkey", "parts": "l_partkey"})


@register("parameter_support", """
SELECT l_returnflag, l_quantity AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag)::DOUBLE, 9) AS share FROM lineitem GROUP BY 1, 2
""")  # fmt: skip
def parameter_support(spark, sf_dir):
    """The distinct values of each group, a row for each."""
    return S.parameter_support(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").withColumn("share", F.round("share", 9))


@register("ordered_quantiles", """
WITH v AS (SELECT 'all' AS part, o_totalprice::DOUBLE AS v FROM orders UNION ALL SELECT o_orderstatus, o_totalprice::DOUBLE FROM orders),
r AS (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY part) - 1 AS last FROM v WHERE v IS NOT NULL),
a AS (SELECT part, v, k, p, p * last AS place FROM r, (SELECT unnest([0.01::DOUBLE, 0.5::DOUBLE, 0.999::DOUBLE]) AS p) WHERE k IN (floor(p * last), ceil(p * last))),
n AS (SELECT part, p, max(place - floor(place)) AS share, max(v) FILTER (WHERE k = floor(place)) AS low, max(v) FILTER (WHERE k = ceil(place)) AS high FROM a GROUP BY 1, 2),
q AS (SELECT part, list(low + (high - low) * share ORDER BY p) AS quantiles FROM n GROUP BY 1)
SELECT g.part, quantiles FROM (SELECT DISTINCT part FROM v) g LEFT JOIN q ON g.part IS NOT DISTINCT FROM q.part
""")  # fmt: skip
def ordered_quantiles(spark, sf_dir):
    """Exact quantiles of one group with all rows, and of a few groups, over many distinct values: low + (high - low) * share, as doubles."""
    from ..operators.ranges import prefix_sums, quantiles

    rows = table(spark, sf_dir, "orders").select(F.explode(F.array(F.lit("all"), "o_orderstatus")).alias("part"), "o_totalprice")
    found = quantiles(prefix_sums(rows, ["part"], "o_totalprice", {"n": F.lit(1)}), ["part"], "o_totalprice", [0.01, 0.5, 0.999])
    parts = rows.select("part").distinct()  # one without a price has no quantiles
    return parts.join(found.withColumnRenamed("part", "_part"), F.col("part").eqNullSafe(F.col("_part")), "left").select("part", "quantiles")


@register("conditioned_summary", """
SELECT l_returnflag, 'all' AS condition, 'all' AS condition_value, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_linestatus', l_linestatus, count(*), round(avg(l_quantity), 6) FROM lineitem GROUP BY 1, 3
UNION ALL SELECT l_returnflag, 'small', CASE WHEN l_linenumber < 3 THEN l_linenumber::VARCHAR END AS s, count(*), round(avg(l_quantity), 6) FROM lineitem WHERE l_linenumber < 3 GROUP BY 1, 3
""")  # fmt: skip
def conditioned_summary(spark, sf_dir):
    """E5: grouping sets, each with its own denominator."""
    rows = table(spark, sf_dir, "lineitem").withColumn("small", F.when(F.col("l_linenumber") < 3, F.col("l_linenumber")))
    return S.summary_by_condition(rows, "l_returnflag", ["l_linestatus", "small"], "l_quantity").withColumn("mean", F.round("mean", 6))


@register("event_presence", f"WITH {CHAINS} SELECT item, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM c) AS share FROM (SELECT unnest(list_distinct(items)) AS item FROM c) GROUP BY 1")
def event_presence(spark, sf_dir):
    """Records that hold an item."""
    return S.presence(user_chains(spark, sf_dir), "items")


@register("event_pairs", f"WITH {CHAINS}, d AS (SELECT user_id, day, unnest(list_distinct(items)) AS i FROM c) SELECT a.i AS a, b.i AS b, count(*) AS n FROM d a JOIN d b USING (user_id, day) WHERE a.i < b.i GROUP BY 1, 2")
def event_pairs(spark, sf_dir):
    """Items that occur together."""
    return S.pairs(user_chains(spark, sf_dir), "items")


@register("event_chains", f"WITH {CHAINS} SELECT items AS chain, len(items)::INT AS length, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS probability FROM c GROUP BY 1")
def event_chains(spark, sf_dir):
    """Whole chains and their probabilities."""
    return S.chains(user_chains(spark, sf_dir), "items")


@register("event_transitions", f"WITH {CHAINS}, t AS (SELECT items[i] AS before, items[i + 1] AS after FROM (SELECT items, unnest(range(1, len(items))) AS i FROM c)) SELECT before, after, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY before) AS next_probability FROM t GROUP BY 1, 2")
def event_transitions(spark, sf_dir):
    """What follows what."""
    return S.transitions(user_chains(spark, sf_dir), "items")


@register("event_positions", f"WITH {CHAINS}, p AS (SELECT i::INT AS position, items[i + 1] AS item FROM (SELECT items, unnest(range(0, len(items))) AS i FROM c)) SELECT position, item, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY position) AS probability FROM p GROUP BY 1, 2")
def event_positions(spark, sf_dir):
    """Items by place."""
    return S.positions(user_chains(spark, sf_dir), "items")


@register("descriptor_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def descriptor_counts(spark, sf_dir):
    """Counts by source and split."""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@register("known_phrases", """
WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS phrase FROM part), v AS (SELECT phrase, CASE phrase WHEN 'ring' THEN 10 WHEN 'bolt' THEN 20 ELSE 30 END AS volume FROM (VALUES ('ring'), ('bolt'), ('gear')) t(phrase))
SELECT w.phrase, volume, count(*) AS n FROM w LEFT JOIN v USING (phrase) GROUP BY 1, 2
""")  # fmt: skip
def known_phrases(spark, sf_dir):
    """Phrases with their volumes, and the unknown ones."""
    vocabulary = spark.createDataFrame([("ring", 10), ("bolt", 20), ("gear", 30)], "phrase string, volume int")
    known, unknown = S.vocabulary_table(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("w")), "w", vocabulary)
    return known.unionByName(unknown, allowMissingColumns=True)


@register("scoped_extremes", """
SELECT o_orderpriority, l_returnflag AS operator, max(l_quantity) AS max_all, min(l_quantity) AS min_all, max(l_quantity) FILTER (WHERE l_linestatus = 'O') AS max_send, min(l_quantity) FILTER (WHERE l_linestatus = 'O') AS min_send,
  max(l_quantity) FILTER (WHERE l_linestatus = 'F') AS max_chain, min(l_quantity) FILTER (WHERE l_linestatus = 'F') AS min_chain FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2
""")  # fmt: skip
def scoped_extremes(spark, sf_dir):
    """Extremes by scope."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select("o_orderpriority", F.col("l_returnflag").alias("operator"), F.lit("q").alias("parameter"), F.col("l_quantity").alias("value"), F.when(F.col("l_linestatus") == "O", "send_return").otherwise("chain").alias("block_kind"))
    return S.scoped_extremes(rows, ["o_orderpriority"]).drop("parameter")


@register("order_magnitudes", """
SELECT l_orderkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 9) AS intensity, CASE WHEN round(sum(l_quantity * l_discount) / sum(l_quantity), 9) < 0.03 THEN 0 WHEN round(sum(l_quantity * l_discount) / sum(l_quantity), 9) < 0.06 THEN 1 ELSE 2 END AS band FROM lineitem GROUP BY 1
""")  # fmt: skip
def order_magnitudes(spark, sf_dir):
    """Weighted intensity and its band."""
    found = S.magnitude(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "l_discount", [0.03, 0.06, 1.0]).withColumn("intensity", F.round("intensity", 9))
    return found.withColumn("band", F.when(F.col("intensity") < 0.03, 0).when(F.col("intensity") < 0.06, 1).otherwise(2))


def verdicts(spark, sf_dir):
    """A verdict for each turn of a conversation."""
    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    return c.select(
        "conv_id", F.col("turn").alias("level"), F.when(n % 7 == 0, "fail").when(n % 11 > 0, "pass").alias("verdict"),
        F.when(n % 7 == 0, F.array(F.when(n % 2 == 0, "omission").otherwise("hallucination"))).alias("failures"), F.when(n % 7 == 0, F.concat(F.lit("t"), "turn")).alias("rationale"), (n % 97 == 0).alias("judge_error"),
    )


VERDICTS = """
v AS (SELECT conv_id, turn, CASE WHEN len(text) % 7 = 0 THEN 'fail' WHEN len(text) % 11 > 0 THEN 'pass' END AS verdict, CASE WHEN len(text) % 7 = 0 THEN CASE WHEN len(text) % 2 = 0 THEN 'omission' ELSE 'hallucination' END END AS f, len(text) % 97 = 0 AS e FROM conversations)
"""


@register("verdict_rollup", f"""
WITH {VERDICTS}
SELECT conv_id, CASE WHEN bool_or(coalesce(verdict = 'fail', false)) THEN 'fail' WHEN bool_and(coalesce(verdict = 'pass', false)) THEN 'pass' END AS verdict, coalesce(list_sort(list(DISTINCT f) FILTER (WHERE f IS NOT NULL)), []) AS failures,
  coalesce(string_agg('t' || turn, '; ' ORDER BY turn) FILTER (WHERE f IS NOT NULL), '') AS rationale, bool_or(e) AS judge_error FROM v GROUP BY 1
""")  # fmt: skip
def verdict_rollup(spark, sf_dir):
    """Verdicts of levels in one."""
    return S.rollup(verdicts(spark, sf_dir), ["conv_id"])


@register("dispositions", f"""
WITH {VERDICTS},
a AS (SELECT conv_id, 'consistency' AS flag, CASE WHEN e THEN 'review' WHEN f IS NOT NULL THEN CASE WHEN f = 'hallucination' THEN 'reject' ELSE 'keep' END WHEN verdict = 'fail' THEN 'reject' WHEN verdict IS NULL THEN 'review' ELSE 'keep' END AS action FROM v
  UNION ALL SELECT conv_id, 'length', CASE WHEN len(text) > 1500 THEN 'reject' ELSE 'keep' END FROM conversations)
SELECT conv_id, CASE WHEN bool_or(action = 'reject') THEN 'reject' WHEN bool_or(action = 'review') THEN 'review' ELSE 'accept' END AS disposition,
  coalesce(list_sort(list(DISTINCT flag) FILTER (WHERE action = 'reject')), []) AS reject_reasons, coalesce(list_sort(list(DISTINCT flag) FILTER (WHERE action = 'review')), []) AS review_reasons FROM a GROUP BY 1
""")  # fmt: skip
def dispositions(spark, sf_dir):
    """Flags and a policy to one decision."""
    consistency = verdicts(spark, sf_dir).select("conv_id", F.lit("consistency").alias("flag"), "verdict", "failures", "judge_error")
    length = table(spark, sf_dir, "conversations").select("conv_id", F.lit("length").alias("flag"), F.when(F.length("text") > 1500, "fail").otherwise("pass").alias("verdict"), F.lit(None).cast("array<string>").alias("failures"), F.lit(False).alias("judge_error"))
    policy = spark.createDataFrame([("consistency", "verdict", "fail", "reject"), ("consistency", "failure", "hallucination", "reject"), ("consistency", "unclear", None, "review"), ("length", "verdict", "fail", "reject")], "flag string, kind string, match string, action string")
    return S.disposition(consistency.unionByName(length), policy, ["conv_id"])


@register("flat_report", f"""
WITH {VERDICTS}, d AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY 1)
SELECT doc_id, CASE WHEN q = 1 THEN 'pass' ELSE 'fail' END AS quality, CASE WHEN q = 0 THEN 'low' END AS quality_why, CAST(NULL AS VARCHAR) AS quality_reason, CASE WHEN t = 0 THEN 'pass' END AS toxic, CAST(NULL AS VARCHAR) AS toxic_why, CASE WHEN t = 1 THEN 'open' END AS toxic_reason FROM d
""")  # fmt: skip
def flat_report(spark, sf_dir):
    """One column per flag."""
    d = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    quality = d.select("doc_id", F.lit("quality").alias("flag"), F.when(F.col("q") == 1, "pass").otherwise("fail").alias("verdict"), F.when(F.col("q") == 0, "low").alias("rationale"))
    toxic = d.select("doc_id", F.lit("toxic").alias("flag"), F.when(F.col("t") == 0, "pass").alias("verdict"), F.when(F.col("t") == 1, "open").alias("rationale"))
    return S.flat_report(quality.unionByName(toxic), ["doc_id"], ["quality", "toxic"], ["fail"])


@register("turns_with_parents", """
SELECT c.conv_id, c.turn AS level, c.turn >= 1 AS judged, len(c.text)::INT AS chars, len(p.text)::INT AS parent_chars FROM (SELECT conv_id, turn, any_value(text) AS text, count(*) AS k FROM conversations GROUP BY 1, 2) c LEFT JOIN (SELECT conv_id, turn, any_value(text) AS text FROM conversations GROUP BY 1, 2) p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
""")  # fmt: skip
def turns_with_parents(spark, sf_dir):
    """Levels joined with the level that they derive from."""
    item = F.struct(F.col("turn").alias("level"), F.col("turn").cast("string").alias("name"), "text", (F.col("turn") - 1).cast("string").alias("derived_from"))
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(item).alias("levels"))
    return S.levels_with_parents(texts, ["conv_id"], "levels").select("conv_id", "level", "judged", F.length("text").alias("chars"), F.length("parent_text").alias("parent_chars"))


@register("clustered_weights", """
WITH c AS (SELECT l_returnflag, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT l_returnflag, count(*) AS c FROM c GROUP BY 1)
SELECT l_returnflag, round(sum(w), 9) AS weight, round(sum(w) * sum(w) / sum(w * w), 3) AS effective FROM (SELECT l_returnflag, 1.0::DOUBLE / (s.c * (SELECT count(*) FROM s)) AS w FROM c JOIN s USING (l_returnflag)) GROUP BY 1
""")  # fmt: skip
def clustered_weights(spark, sf_dir):
    """Weights by cluster, and the effective number of clusters."""
    w = S.observation_weights(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey")
    masses = w.groupBy("l_returnflag", "l_orderkey").agg(F.sum("weight").alias("m"))
    total = masses.groupBy("l_returnflag").agg(F.round(F.sum("m"), 9).alias("weight"))
    return total.join(S.effective_n(masses, ["l_returnflag"], "m"), "l_returnflag").withColumn("effective", F.round("effective", 3))


@register("supported_groups", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_partkey) >= 15 AND count(DISTINCT p_size) >= 12")
def supported_groups(spark, sf_dir):
    """Groups with enough support."""
    return S.supported(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_partkey", "p_size", 15, 12).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))


@register("complete_settings", """
SELECT l_orderkey, arg_max(l_quantity, (l_linenumber * 1000000 + l_partkey)) FILTER (WHERE l_returnflag = 'A') AS "A", arg_max(l_quantity, (l_linenumber * 1000000 + l_partkey)) FILTER (WHERE l_returnflag = 'R') AS "R"
FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'A') > 0 AND count(*) FILTER (WHERE l_returnflag = 'R') > 0
""")  # fmt: skip
def complete_settings(spark, sf_dir):
    """Instances with all controls, as columns. Of lines with one number and part, the first in the table counts."""
    rows = table(spark, sf_dir, "lineitem").select("*", "_metadata.file_path", "_metadata.row_index").withColumn("o", F.col("l_linenumber") * 1000000 + F.col("l_partkey"))
    return S.complete_settings(rows, ["l_orderkey"], "l_returnflag", "l_quantity", ["A", "R"], "o", ["file_path", "row_index"])


@register("weighted_correlations", """
WITH w AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, l_linenumber::DOUBLE AS w FROM lineitem),
m AS (SELECT l_returnflag, sum(w) AS w, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM w GROUP BY 1)
SELECT l_returnflag, round(sum(w.w * (x - mx) * (y - my)) / any_value(m.w), 3) AS covariance, round(sum(w.w * (x - mx) * (y - my)) / sqrt(sum(w.w * (x - mx) * (x - mx)) * sum(w.w * (y - my) * (y - my))), 6) AS pearson FROM w JOIN m USING (l_returnflag) GROUP BY 1
""")  # fmt: skip
def weighted_correlations(spark, sf_dir):
    """Weighted covariance and correlation."""
    found = S.weighted_moments(table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_linenumber").cast("double")), ["l_returnflag"], "l_quantity", "l_extendedprice", "w")
    return found.select("l_returnflag", F.round("covariance", 3).alias("covariance"), F.round("pearson", 6).alias("pearson"))


@register("rank_correlations", """
WITH r AS (SELECT p_brand, (rank() OVER a + count(*) OVER (PARTITION BY p_brand, p_size) / 2.0::DOUBLE - 1) AS rx, (rank() OVER b + count(*) OVER (PARTITION BY p_brand, p_retailprice) / 2.0::DOUBLE - 1) AS ry FROM part WINDOW a AS (PARTITION BY p_brand ORDER BY p_size), b AS (PARTITION BY p_brand ORDER BY p_retailprice))
SELECT p_brand, round(corr(rx, ry), 6) AS spearman, abs(round(corr(rx, ry), 6)) >= 0.8 AS extreme FROM r GROUP BY 1
""")  # fmt: skip
def rank_correlations(spark, sf_dir):
    """Correlation of mid-ranks by group, extremes marked."""
    rows = table(spark, sf_dir, "part").withColumn("w", F.lit(1.0))
    rows = S.weighted_mid_ranks(S.weighted_mid_ranks(rows, ["p_brand"], "p_size", "w", "rx"), ["p_brand"], "p_retailprice", "w", "ry")
    found = S.weighted_moments(rows, ["p_brand"], "rx", "ry", "w").select("p_brand", F.round("pearson", 6).alias("spearman"))
    return found.withColumn("extreme", F.abs("spearman") >= 0.8)


@register("cooccurrence_evidence", f"""
WITH {CHAINS}
SELECT pattern, count(*) AS n FROM (SELECT unnest(list_filter(['both', 'preceded', 'adjacent'], lambda p: CASE p WHEN 'both' THEN list_contains(items, 'click') AND list_contains(items, 'purchase')
  WHEN 'preceded' THEN list_position(items, 'view') > 0 AND list_position(list_reverse(items), 'error') > 0 AND list_position(items, 'view') < len(items) + 1 - list_position(list_reverse(items), 'error') ELSE contains(',' || array_to_string(items, ',') || ',', ',view,click,') END)) AS pattern FROM c) GROUP BY 1 HAVING count(*) >= 3
""")  # fmt: skip
def cooccurrence_evidence(spark, sf_dir):
    """What occurs together, before and next to what."""
    items = F.col("items")
    first, last = F.array_position(items, "view"), F.size(items) + 1 - F.array_position(F.reverse(items), "error")
    tests = {
        "both": F.array_contains(items, "click") & F.array_contains(items, "purchase"),
        "preceded": (first > 0) & F.array_contains(items, "error") & (first < last),
        "adjacent": F.contains(F.concat(F.lit(","), F.array_join(items, ","), F.lit(",")), F.lit(",view,click,")),
    }
    return S.evidence(user_chains(spark, sf_dir), "items", tests, [], 3)


@register("row_provenance", "SELECT p_brand, list_sort(list(DISTINCT p_size)) AS rows FROM part GROUP BY 1")
def row_provenance(spark, sf_dir):
    """Distinct row numbers of each asset."""
    return S.row_provenance(table(spark, sf_dir, "part"), "p_brand", "p_size")


@register("translation_report", """
WITH i AS (SELECT l_orderkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS op, CASE WHEN l_returnflag = 'A' AND l_discount < 0.05 THEN 'discount' END AS lack, l_discount FROM lineitem)
SELECT l_orderkey, count(op) AS mapped, count(*) FILTER (WHERE op IS NULL) AS unmapped, CASE WHEN count(lack) > 0 THEN ['discount'] ELSE [] END AS missing,
  list_filter([CASE WHEN bool_or(op = 'R' AND l_discount >= 0.05) THEN 'discount' END, CASE WHEN bool_or(op = 'R') THEN 'quantity' END], lambda x: x IS NOT NULL) AS omitted, bool_and(op IS NOT NULL AND lack IS NULL) AS projectable FROM i GROUP BY 1
""")  # fmt: skip
def translation_report(spark, sf_dir):
    """Which chains can be carried over whole."""
    flag = F.col("l_returnflag")
    present = F.array_compact(F.array(F.lit("quantity"), F.when(F.col("l_discount") >= 0.05, "discount")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(flag != "N", flag).alias("op"), present.alias("present"))
    return S.translation_report(rows, "l_orderkey", {"A": ["quantity", "discount"], "R": []}, "op", "present")


NAMES = ("view", "click", "purchase", "error")
MASKS = "m AS (SELECT user_id, ts::DATE AS day, bit_or(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 WHEN 'error' THEN 8 ELSE 0 END) AS mask FROM events GROUP BY 1, 2)"


def day_masks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("k", F.concat_ws("/", "user_id", F.to_date("ts")))
    return S.set_masks(rows, "k", "event_type", NAMES)


@register("set_combinations", f"WITH {MASKS} SELECT mask, bit_count(mask)::INT AS size, count(*) AS n FROM m GROUP BY 1")
def set_combinations(spark, sf_dir):
    """Combinations as masks."""
    return S.mask_counts(day_masks(spark, sf_dir))


@register("rate_spread", """
WITH g AS (SELECT c_nationkey, count(*) AS n, avg((c_mktsegment = 'BUILDING')::INT) AS r FROM customer GROUP BY 1), w AS (SELECT sum(n * r) / sum(n) AS m FROM g WHERE n >= 10)
SELECT round((SELECT avg((c_mktsegment = 'BUILDING')::INT) FROM customer), 9) AS rate, round(sqrt(sum(n * (r - m) * (r - m)) / sum(n)), 9) AS spread FROM g, w WHERE n >= 10
""")  # fmt: skip
def rate_spread(spark, sf_dir):
    """How much a rate differs between groups."""
    found = S.spread_of_rates(table(spark, sf_dir, "customer").withColumn("hit", F.col("c_mktsegment") == "BUILDING"), "c_nationkey", "hit")
    return found.select(F.round("rate", 9).alias("rate"), F.round("spread", 9).alias("spread"))


@register("blended_rates", """
WITH g AS (SELECT p_type, count(*) AS n, avg((p_size > 25)::INT) AS r, stddev_pop(p_size) / 100 AS s FROM part GROUP BY 1)
SELECT p_type, round(CASE WHEN p_type = 'SMALL' THEN r WHEN s > 0.144 THEN 0.4 ELSE (n * r + 500 * 0.4) / (n + 500) END, 9) AS value, CASE WHEN p_type = 'SMALL' THEN 'corpus' WHEN s > 0.144 THEN 'anchor' ELSE 'blend' END AS source FROM g
""")  # fmt: skip
def blended_rates(spark, sf_dir):
    """Rates blended with an anchor by size."""
    g = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("p_size") > 25).cast("double")).alias("r"), (F.stddev_pop("p_size") / 100).alias("s"))
    found = S.blended_rate(F.col("r"), F.col("n"), F.when(F.col("p_type") != "SMALL", 0.4), 500.0, F.col("s"), 0.144)
    return g.select("p_type", F.round(found["value"], 9).alias("value"), found["source"].alias("source"))


@register("set_joints", f"""
WITH {MASKS}, r AS (SELECT k, avg((mask >> k) & 1) AS rate FROM m, range(4) t(k) GROUP BY 1), n AS (SELECT mask, count(*) AS n FROM m GROUP BY 1)
SELECT x.mask::INT AS mask, round((SELECT product(CASE WHEN (x.mask >> k) & 1 = 1 THEN rate ELSE 1 - rate END) FROM r), 9) AS independent, round((coalesce(n.n, 0) + 1.0::DOUBLE) / ((SELECT count(*) FROM m) + 16), 9) AS smoothed, 0.0625::DOUBLE AS uniform FROM range(16) x(mask) LEFT JOIN n ON n.mask = x.mask
""")  # fmt: skip
def set_joints(spark, sf_dir):
    """Independent, smoothed and uniform joints over sets."""
    masks = day_masks(spark, sf_dir)
    bits = masks.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"shiftright(mask, {k}) & 1").alias("b")) for k in range(4)])).alias("x"))
    rates = bits.groupBy("x.k").agg(F.avg("x.b").alias("rate"))
    joint = S.independent_joint(rates, 4).withColumnRenamed("p", "independent")
    both = joint.join(S.smoothed_joint(S.mask_counts(masks), 4).withColumnRenamed("p", "smoothed"), "mask")
    both = both.join(S.uniform_joint(spark, 4).withColumnRenamed("p", "uniform"), "mask")
    return both.select("mask", F.round("independent", 9).alias("independent"), F.round("smoothed", 9).alias("smoothed"), "uniform")


@register("set_sensitivities", f"""
WITH {MASKS}, n AS (SELECT mask, count(*) AS n FROM m GROUP BY 1), f AS (SELECT k::INT AS k, coalesce((SELECT n FROM n WHERE mask = 15), 0) AS a, coalesce((SELECT n FROM n WHERE mask = 15 - (1 << k)), 0) AS b FROM range(4) t(k))
SELECT k, CASE WHEN a + b = 0 THEN 1.0 ELSE least(1.0, a::DOUBLE / (a + b) / 0.9) END AS sensitivity FROM f
""")  # fmt: skip
def set_sensitivities(spark, sf_dir):
    """How often a name is seen where it is."""
    truths = spark.range(4).select(F.col("id").cast("int").alias("k"), F.lit(0.9).alias("truth"))
    return S.sensitivity(S.mask_counts(day_masks(spark, sf_dir)), truths, 4)


@register("rounded_shares", """
WITH r AS (SELECT l_returnflag, l_linenumber, round_even(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_returnflag) * 100000, 0)::BIGINT AS r FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linenumber, (r + CASE WHEN row_number() OVER (PARTITION BY l_returnflag ORDER BY r DESC, l_linenumber) = 1 THEN 100000 - sum(r) OVER (PARTITION BY l_returnflag) ELSE 0 END) / 100000.0::DOUBLE AS share FROM r
""")  # fmt: skip
def rounded_shares(spark, sf_dir):
    """Rounded shares that sum to one."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return S.rounded_shares(counts, ["l_returnflag"], "n", "l_linenumber").drop("n")


@register("rates_against_expected", """
SELECT o_orderpriority, round(r, 9) AS rate, 0.5::DOUBLE AS expected, round((r - 0.5) / sqrt(0.25 / n), 6) AS z FROM (SELECT o_orderpriority, count(*) AS n, avg((o_orderstatus = 'O')::INT) AS r FROM orders GROUP BY 1)
""")  # fmt: skip
def rates_against_expected(spark, sf_dir):
    """Sampled rates against what was asked for."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("hits"))
    found = sampled_against_expected(counts, counts.select("o_orderpriority", F.lit(0.5).alias("expected")), "o_orderpriority")
    return found.select("o_orderpriority", F.round("rate", 9).alias("rate"), "expected", F.round("z", 6).alias("z"))
