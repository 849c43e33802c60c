"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import joins as J
from ..registry import register
from .nested import spread


def docs(spark, sf_dir, *columns):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


@register("token_counts", r"""
SELECT lang, token, count(*) AS n FROM (
  SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents)
GROUP BY lang, token
""")  # fmt: skip
def token_counts(spark, sf_dir):
    """Counts of tokens by language."""
    tokens = docs(spark, sf_dir, "lang", "text").select("lang", F.explode(T.tokenize(F.col("text"))).alias("token"))
    return tokens.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))


@register("prefixed_tags", """
SELECT doc_id, list_sort(list_distinct([lang, source])) AS tags FROM documents
""")  # fmt: skip
def prefixed_tags(spark, sf_dir):
    """B1: tags of one domain out of a mixed list."""
    tags = F.array(F.concat(F.lit("genre---"), "source"), F.lit("mood---calm"), F.concat(F.lit("genre---"), "lang"), F.concat(F.lit("genre---"), "lang"))
    return docs(spark, sf_dir, "doc_id", "lang", "source").select("doc_id", T.tags_with_prefix(tags, "genre").alias("tags"))


@register("resolved_tags", r"""
WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS w FROM part),
c AS (
  SELECT p_partkey, list_concat([array_to_string(w, '')], list_reverse(w)) AS c FROM t
  WHERE len(w) > 0 AND w[1] NOT IN ('no', 'not', 'without', 'lacks', 'lacking', 'absent', 'none', 'sans', 'minus')),
k AS (SELECT list(x) AS k FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS x FROM part UNION SELECT 'widgets' UNION SELECT 'gadget')),
v AS (
  SELECT p_partkey, list_filter(flatten(list_transform(c, lambda x: [x, CASE WHEN ends_with(x, 's') THEN x[:-2] ELSE x || 's' END])), lambda x: list_contains(k, x)) AS f FROM c, k)
SELECT part.p_partkey, f[1] AS resolved FROM part LEFT JOIN v USING (p_partkey)
""")  # fmt: skip
def resolved_tags(spark, sf_dir):
    """Names resolved against a vocabulary table, plurals allowed, the head word last."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    vocabulary = part.select(F.explode(T.tokenize(F.col("p_type"))).alias("tag")).union(spark.createDataFrame([("widgets",), ("gadget",)], "tag string"))
    return T.resolve_tags(part.select("p_partkey", "p_name"), "p_name", vocabulary).select("p_partkey", "resolved")


MINED = ("the of", "und der", "la", "de los", "que", "and", "nicht")


@register("unclaimed_tags", """
SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda w: w NOT IN ('ring', 'rings', 'small')) AS left_over FROM part WHERE p_size % 3 > 0 OR p_brand IN (SELECT p_brand FROM part WHERE p_type = 'SMALL' GROUP BY 1)
""")  # fmt: skip
def unclaimed_tags(spark, sf_dir):
    """Phrases that name no target and hold no stop word, of rows whose file is there or isn't asked for."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("file", F.when(F.col("p_size") % 3 == 0, F.col("p_brand")))
    listing = part.where("p_type = 'SMALL'").select(F.col("p_brand").alias("path"))
    return J.present_only(part, listing, "file").select("p_partkey", T.unclaimed(F.split("p_name", " "), ["ring"], ["small"]).alias("left_over"))


@register("mined_vocabulary", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
SELECT doc_id, list_filter(['the of', 'und der', 'la', 'de los', 'que', 'and', 'nicht'], lambda v: list_has_all(w, string_split(v, ' '))) AS found FROM t
""")  # fmt: skip
def mined_vocabulary(spark, sf_dir):
    """Vocabulary entries whose tokens a text holds."""
    return docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.mine_vocabulary(F.col("text"), MINED).alias("found"))


CUES = {"article": ["the", "der", "la"], "phrase": ["of the", "de la"], "licence": ["MIT License", "all rights reserved"]}


@register("cue_flags", r"""
WITH t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS p FROM documents)
SELECT doc_id, contains(p, ' the ') OR contains(p, ' der ') OR contains(p, ' la ') AS article,
       contains(p, ' of the ') OR contains(p, ' de la ') AS phrase,
       contains(p, ' mit license ') OR contains(p, ' all rights reserved ') AS licence FROM t
""")  # fmt: skip
def cue_flags(spark, sf_dir):
    """Whole-word cue groups."""
    flags = docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.cue_flags(F.col("text"), CUES).alias("f"))
    return flags.select("doc_id", *[F.col("f")[c].alias(c) for c in CUES])


@register("operator_mentions", r"""
SELECT p_partkey,
  list_filter(['steel_bolt', 'large_widget', 'apply_brass_filter', 'ring'], lambda o:
    CASE o WHEN 'steel_bolt' THEN regexp_matches(lower(p_name || ' ' || p_type), '(^|[^a-z0-9])(steelbolt|s[^a-z0-9]*t[^a-z0-9]*e[^a-z0-9]*e[^a-z0-9]*l[^a-z0-9]*b[^a-z0-9]*o[^a-z0-9]*l[^a-z0-9]*t|b[^a-z0-9]*o[^a-z0-9]*l[^a-z0-9]*t)')
      WHEN 'large_widget' THEN regexp_matches(lower(p_name || ' ' || p_type), '(^|[^a-z0-9])(l[^a-z0-9]*a[^a-z0-9]*r[^a-z0-9]*g[^a-z0-9]*e[^a-z0-9]*w[^a-z0-9]*i[^a-z0-9]*d[^a-z0-9]*g[^a-z0-9]*e[^a-z0-9]*t|w[^a-z0-9]*i[^a-z0-9]*d[^a-z0-9]*g[^a-z0-9]*e[^a-z0-9]*t)')
      WHEN 'apply_brass_filter' THEN regexp_matches(lower(p_name || ' ' || p_type), '(^|[^a-z0-9])b[^a-z0-9]*r[^a-z0-9]*a[^a-z0-9]*s[^a-z0-9]*s')
      ELSE regexp_matches(lower(p_name || ' ' || p_type), '(^|[^a-z0-9])r[^a-z0-9]*i[^a-z0-9]*n[^a-z0-9]*g') END = false) AS missing
FROM part
""")  # fmt: skip
def operator_mentions(spark, sf_dir):
    """Operators that a text doesn't name in any spelling."""
    text = F.concat_ws(" ", "p_name", "p_type")
    names = ("steel_bolt", "large_widget", "apply_brass_filter", "ring")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.missing_mentions(text, {n: T.operator_tokens(n) for n in names}).alias("missing"))


_SPELLED = lambda w: "[^a-z0-9]*".join(w)


@register("omitted_facts", rf"""
WITH t AS (
  SELECT p_partkey, p_size, p_partkey / 4.0::DOUBLE AS depth, p_name || ' size ' || CASE WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR ELSE '' END || ' depth ' || CASE WHEN p_partkey % 3 = 1 THEN (p_partkey / 4.0::DOUBLE)::VARCHAR WHEN p_partkey % 3 = 2 THEN printf('%.1f', p_partkey / 4.0::DOUBLE) ELSE '' END AS text FROM part),
f AS (SELECT *, lower(text) AS low, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS flat FROM t),
m AS (
  SELECT p_partkey,
    list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'steel_bolt' END, 'large_widget', CASE WHEN p_partkey % 2 = 1 THEN 'apply_ring_filter' END], lambda o: CASE o
      WHEN 'steel_bolt' THEN NOT regexp_matches(low, '(^|[^a-z0-9])({_SPELLED("steelbolt")}|{_SPELLED("bolt")}|{_SPELLED("screw")})') WHEN 'large_widget' THEN NOT regexp_matches(low, '(^|[^a-z0-9])({_SPELLED("largewidget")}|{_SPELLED("widget")})')
      WHEN 'apply_ring_filter' THEN NOT regexp_matches(low, '(^|[^a-z0-9])({_SPELLED("ring")})') ELSE false END) AS operators,
    list_filter(['red', 'round'], lambda s: CASE s WHEN 'red' THEN NOT regexp_matches(low, '(^|[^a-z0-9])({_SPELLED("red")}|{_SPELLED("scarlet")})') ELSE p_partkey % 5 > 0 AND NOT regexp_matches(low, '(^|[^a-z0-9]){_SPELLED("rod")}') END) AS stems,
    list_filter([{{'n': 'depth', 'v': depth}}, {{'n': 'size', 'v': p_size::DOUBLE}}], lambda e: len(list_filter(list_concat(
      [e.v::VARCHAR], list_transform([1, 2, 3, 4], lambda p: rtrim(rtrim(printf('%.' || p || 'f', e.v), '0'), '.')), CASE WHEN e.v >= 1000 THEN [rtrim(rtrim(printf('%.4f', e.v / 1000), '0'), '.') || 'k'] ELSE [] END,
      CASE WHEN e.v = floor(e.v) THEN [e.v::BIGINT::VARCHAR] ELSE [] END), lambda r: contains(flat, regexp_replace(r, '[^a-z0-9]+', '', 'g')))) = 0) AS vals
  FROM f)
SELECT p_partkey, list_filter([
  CASE WHEN len(operators) > 0 THEN 'did not name operator(s) ' || array_to_string(operators, ', ') END, CASE WHEN len(stems) > 0 THEN 'did not name stem(s) ' || array_to_string(stems, ', ') END,
  CASE WHEN len(vals) > 0 THEN 'omitted value(s) ' || array_to_string(list_transform(vals, lambda e: e.n || '=' || e.v::VARCHAR), ', ') END], lambda x: x IS NOT NULL) AS omitted
FROM m
""")  # fmt: skip
def omitted_facts(spark, sf_dir):
    """Operators, stems and values of a row's own profile that its text leaves out."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    depth = key / 4.0
    told = F.when(key % 3 == 1, depth.cast("string")).when(key % 3 == 2, F.format_string("%.1f", F.bround(depth, 1))).otherwise("")
    text = F.concat("p_name", F.lit(" size "), F.when(key % 3 == 0, F.col("p_size").cast("string")).otherwise(""), F.lit(" depth "), told)
    used = F.array_compact(F.array(F.when(key % 2 == 0, F.lit("steel_bolt")), F.lit("large_widget"), F.when(key % 2 == 1, F.lit("apply_ring_filter"))))
    stems = F.create_map(F.lit("red"), T.strings(["red", "scarlet"]), F.lit("round"), F.when(key % 5 > 0, T.strings(["rod"])).otherwise(T.strings([])))
    values = F.create_map(F.lit("depth"), depth, F.lit("size"), F.col("p_size").cast("double"))
    rows = spread(part, "p_partkey").select("p_partkey", text.alias("text"), used.alias("used"), stems.alias("stems"), values.alias("values"))
    accepted = {"steel_bolt": ["screw"], "large_widget": [], "apply_ring_filter": []}
    found = T.omissions(F.col("text"), T.missing_operators(F.col("text"), F.col("used"), accepted), T.missing_stems(F.col("text"), F.col("stems")), T.missing_values(F.col("text"), F.col("values"), 1))
    return rows.select("p_partkey", found.alias("omitted"))


@register("leaks_and_checks", r"""
SELECT doc_id,
  list_sort(list_distinct(list_concat(regexp_extract_all(text, '->'), regexp_extract_all(text, '\w+\([A-Za-z_]+\s*=')))) AS leaks,
  CASE WHEN len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) > 300 THEN ['used ' || len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) || ' words, limit is 300'] ELSE [] END AS over,
  regexp_matches(text, '[0-9]{3}-[0-9]{4}') AS phone
FROM documents
""")  # fmt: skip
def leaks_and_checks(spark, sf_dir):
    """Leaked identifiers and syntax; limits on the text."""
    text = F.col("text")
    return docs(spark, sf_dir, "doc_id", "text").select(
        "doc_id", T.leak_tokens(text, ["apply_gain", "room_size", "drums"]).alias("leaks"), T.text_checks(text, max_words=300).alias("over"),
        (F.size(T.text_checks(text, ["[0-9]{3}-[0-9]{4}"])) > 0).alias("phone"),
    )


@register("parsed_cells", r"""
WITH c AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus,
    '[''' || l_returnflag || ' minor'', "' || l_linestatus || '"]' AS items, CAST(l_quantity AS INT)::VARCHAR || ' BPM, ' || l_shipdate::DATE::VARCHAR AS tempo,
    CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_quantity AS INT)::VARCHAR || ' : 1' WHEN l_linenumber % 3 = 1 THEN CAST(l_quantity AS INT)::VARCHAR || 'e-1' ELSE 'n/a' END AS number
  FROM lineitem)
SELECT l_orderkey, l_linenumber, [l_returnflag || ' minor', l_linestatus] AS items, l_returnflag AS key, 'minor' AS mode,
  CAST(l_quantity AS INT)::DOUBLE AS tempo,
  CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_quantity AS INT)::DOUBLE WHEN l_linenumber % 3 = 1 THEN (CAST(l_quantity AS INT)::VARCHAR || 'e-1')::DOUBLE END AS number,
  l_linenumber % 3 = 0 AS flag, regexp_replace(tempo, '[^0-9]', '', 'g')::BIGINT AS digits
FROM c
""")  # fmt: skip
def parsed_cells(spark, sf_dir):
    """List literals, key and mode, tempo, numbers, flags and digits out of text cells."""
    n = F.col("l_quantity").cast("int").cast("string")
    kind = F.col("l_linenumber") % 3
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("['"), "l_returnflag", F.lit(" minor', \""), "l_linestatus", F.lit('"]')).alias("list"),
        F.concat(n, F.lit(" BPM, "), F.to_date("l_shipdate").cast("string")).alias("text"),
        F.when(kind == 0, F.concat(n, F.lit(" : 1"))).when(kind == 1, F.concat(n, F.lit("e-1"))).otherwise("n/a").alias("cell"),
        F.when(kind == 0, "Yes").otherwise("no").alias("bool"),
    )
    rows = rows.withColumn("items", T.parse_list(F.col("list")))
    key = T.key_mode(F.col("items"))
    return rows.select(
        "l_orderkey", "l_linenumber", "items", key["key"].alias("key"), key["mode"].alias("mode"), T.parse_tempo(F.col("text")).alias("tempo"),
        T.to_number(F.col("cell")).alias("number"), T.parse_bool(F.col("bool")).alias("flag"), T.clean_int(F.col("text")).alias("digits"),
    )


@register("labels_and_paths", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '[^\p{L}\p{N}]', '_', 'g'), '^_+|_+$', '', 'g')) AS slug,
  regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, nullif(regexp_extract(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', ''), '(\d+)[^\d]*$', 1), '') AS shard,
  regexp_extract(url, '://([^/]+)', 1) || ' -> ' || page_id AS line
FROM pages
""")  # fmt: skip
def labels_and_paths(spark, sf_dir):
    """Slugs, parts of paths and filled templates."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    parts = T.path_parts(F.col("url"))
    line = T.interpolate("${page.host} -> ${page.id}", {"page.host": F.regexp_extract("url", "://([^/]+)", 1), "page.id": F.col("page_id")})
    return pages.select("page_id", T.slugify(F.col("url")).alias("slug"), parts["folder"].alias("folder"), parts["shard"].alias("shard"), line.alias("line"))


@register("readable_labels", """
SELECT event_type, replace(event_type, '_', ' ') AS label, count(*) AS n FROM events GROUP BY event_type
""")  # fmt: skip
def readable_labels(spark, sf_dir):
    """Operator names as words."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type")
    named = events.withColumn("label", T.readable_label(F.concat(F.lit("apply_"), "event_type", F.lit("_filter"))))
    return named.groupBy("event_type", "label").agg(F.count(F.lit(1)).alias("n"))


@register("value_spellings", """
SELECT p_partkey, rtrim(rtrim(printf('%.1f', round_even(p_retailprice, 1)), '0'), '.') || ' Hz' AS shown,
  list_contains(list_transform([printf('%.0f', round_even(p_retailprice, 0))], lambda x: x), regexp_replace(p_size::VARCHAR, '[^0-9]', '', 'g')) AS odd
FROM part
""")  # fmt: skip
def value_spellings(spark, sf_dir):
    """Numbers as people write them."""
    price = F.col("p_retailprice")
    spelled = F.array_contains(F.array(T.format_value(price, 0)), F.col("p_size").cast("string"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", T.format_value(price, 1, "hz", {"hz": "Hz"}).alias("shown"), spelled.alias("odd"))


@register("extracted_verdicts", """
SELECT event_id, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_type END AS verdict,
       CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 0 ELSE 1 END AS problems
FROM events
""")  # fmt: skip
def extracted_verdicts(spark, sf_dir):
    """Verdicts out of prose, refused outside the vocabulary."""
    text = F.concat(F.lit("Sure, here it is:\n{\"verdict\": \""), "event_type", F.lit("\", \"value\": "), F.col("props"), F.lit("} done"))
    verdict = T.extract_verdict(text, ["view", "click", "purchase"])
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", verdict["verdict"].alias("verdict"), F.size(verdict["problems"]).alias("problems"))


@register("term_spans", r"""
WITH m AS (
  SELECT doc_id, lower(text) AS t, regexp_extract_all(lower(text), '(^|[^a-z0-9])(the|of|und|der|que)([^a-z0-9]|$)') AS x FROM documents)
SELECT doc_id, len(list_filter(string_split_regex(t, '[^a-z0-9]+'), lambda w: w IN ('the', 'of')))::INT AS english,
       len(list_filter(string_split_regex(t, '[^a-z0-9]+'), lambda w: w IN ('und', 'der')))::INT AS german
FROM m
""")  # fmt: skip
def term_spans(spark, sf_dir):
    """Spans of lexicon terms by family."""
    spans = T.term_spans(F.col("text"), {"english": ["the", "of"], "german": ["und", "der"]})
    rows = docs(spark, sf_dir, "doc_id", "text").select("doc_id", spans["family"].alias("families"))
    return rows.select("doc_id", *[(F.size("families") - F.size(F.array_remove("families", f))).alias(f) for f in ("english", "german")])


@register("stable_keys", """
SELECT o_orderkey, substr(sha256('["' || o_orderkey || '","' || o_orderpriority || '"]'), 1, 24) AS id,
  ('0x' || substr(sha256('seed|' || o_orderkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS noise,
  sha256('{"path":"' || o_orderpriority || '","size":' || o_orderkey || ',"modified":' || o_custkey || ',"model":"m1"}') AS content
FROM orders
""")  # fmt: skip
def stable_keys(spark, sf_dir):
    """Ids, noise and cache keys that only depend on content."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        "o_orderkey", T.stable_id(F.col("o_orderkey"), F.col("o_orderpriority")).alias("id"), T.stable_noise(F.lit("seed"), F.col("o_orderkey")).alias("noise"),
        T.content_key(F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_custkey"), "m1").alias("content"),
    )


@register("normalized_labels", r"""
WITH t AS (SELECT p_partkey, regexp_extract_all(lower(p_type), '[a-z0-9]+') AS w FROM part)
SELECT p_partkey,
  CASE WHEN list_has_all(w, ['steel']) THEN 'iron' WHEN list_has_all(w, ['small', 'brass']) THEN 'tiny brass' WHEN list_has_all(w, ['copper']) THEN 'copper' END AS canonical
FROM t
""")  # fmt: skip
def normalized_labels(spark, sf_dir):
    """Names by alias tables, exact first, then by tokens."""
    found = T.normalize_label(F.col("p_type"), {"iron": ["steel"], "tiny brass": ["small brass"], "copper": []})
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", found["canonical"].alias("canonical"))


@register("identifiers_by_priority", """
SELECT event_type, list_sort(list(DISTINCT k)) AS identifiers FROM (
  SELECT event_type, event_type || '_' || unnest(json_keys(props)) AS k FROM events)
GROUP BY event_type
""")  # fmt: skip
def identifiers_by_priority(spark, sf_dir):
    """Identifiers with an underscore, derived from the parameters that occur."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.explode(F.json_object_keys("props")).alias("k"))
    names = events.select("event_type", F.concat_ws("_", "event_type", "k").alias("k")).distinct().where(F.contains(F.col("k"), F.lit("_")))
    return names.groupBy("event_type").agg(F.sort_array(F.collect_set("k")).alias("identifiers"))
