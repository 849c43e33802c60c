"""Quality rules on DataFrame functions only: cross-document line frequency, and the counts that go with it.

Lines are normalised and hashed. For every host (the documents' source), the distinct documents that hold a line are counted: those
of different ids, or, where ``copies`` is false, of different texts, so that a document does not turn common by its own copies. Lines
above the limits are taken out, and documents of which too little is left are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, boxed, shared_dir, table, text_hash, unboxed, written

#: A line is common on a host if more documents than MIN_DOCS and than this share of the host's documents hold it.
MIN_DOCS, MIN_SHARE = 20, 0.02
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.3
#: Base limits, and words in a window that repeats.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(line: Column) -> Column:
    """A-Z lower-cased, digits as 0, white space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER + "123456789", LOWER + "0" * 9), f"[{SPACE}]+", " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normalised(line))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, the base counts, and the hash and words of each line that has a word; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text.alias("text"))
    rows = rows.withColumns({
        "words": F.transform(F.filter(F.split("text", f"[{SPACE}]+", -1), lambda w: w != ""), lambda w: F.xxhash64(w)),
        "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")),
    })
    # Windows are hashed. If all hashes differ, none repeats; else equal ones become neighbours by sorting, and the union of the
    # words that they cover is measured over their places in order.
    rows = rows.withColumn("windows", F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("placed", lambda x, i: F.get(F.col("placed"), i - 1)["h"].eqNullSafe(x["h"]) | F.get(F.col("placed"), i + 1)["h"].eqNullSafe(x["h"]))
    rows = rows.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("starts", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    return rows.select(
        "doc_id", "source", text_hash(F.col("text")).alias("text_hash"), F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("lines", line_hash).alias("line_hashes"),
        F.transform("lines", lambda x: F.size(F.split(normalised(x), " ", -1))).alias("line_words"),
    )


def common_lines(rows: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, copies: bool = True) -> DataFrame:
    """source, line_hash of the lines that too many distinct documents of a source hold; a null source is one of its own.

    Rows of one id are one document, and a row without an id is known by its text; with ``copies`` false, all rows are. A line or
    source of any size is pre-aggregated before each shuffle.
    """
    document = F.coalesce("doc_id", F.xxhash64("text_hash")) if copies else F.col("text_hash")
    rows = rows.select("source", document.alias("document"), "line_hashes")
    lines = rows.select("source", "document", F.explode(F.array_distinct("line_hashes")).alias("line_hash"))
    counts = lines.groupBy("source", "line_hash").agg(F.countDistinct("document").alias("n")).where(F.col("n") > min_docs)
    hosts = rows.groupBy("source").agg(F.countDistinct("document").alias("of")).withColumnRenamed("source", "host")
    return counts.join(hosts, F.col("source").eqNullSafe(F.col("host"))).where(F.col("n") > F.col("of") * min_share).select("source", "line_hash")


def common_in_texts(rows: DataFrame, common: DataFrame) -> DataFrame:
    """source, text_hash, common of each text that has common lines: an array of their places among its lines with a word, in order,
    each with its number of words. A text's lines meet the common ones in a join, so a text of any number of lines costs no more."""
    lines = rows.select("source", "text_hash", F.posexplode(F.arrays_zip("line_hashes", "line_words")).alias("at", "line"))
    lines = lines.select("source", "text_hash", F.struct("at", F.col("line.line_words").alias("words")).alias("place"), F.col("line.line_hashes").alias("line_hash"))
    known = common.select(F.col("source").alias("_s"), F.col("line_hash").alias("_h"))
    return lines.join(known, (F.col("line_hash") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_s")), "left_semi").groupBy("source", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("common"))


def judged(rows: DataFrame, common: DataFrame, left_share: float = LEFT_SHARE) -> DataFrame:
    """rows with common, words_left, base_failed, kept; repeated rows are judged alike."""
    found = common_in_texts(rows, common).withColumnsRenamed({"source": "_s", "text_hash": "_t"})
    rows = rows.join(found, (F.col("text_hash") == F.col("_t")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "_t")
    removed = F.aggregate("common", F.lit(0), lambda a, x: a + x["words"])
    left = F.col("n_words") - F.coalesce(removed, F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumns({"words_left": left, "base_failed": failed})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= F.col("n_words") * left_share))


def without_lines(text: Column, places: Column) -> Column:
    """text without its lines at some places (an ordered array; 0 is the first line with a word): what lies between is joined again."""
    lines = F.split(text, "\n", -1)
    worded = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(f"[^{SPACE}]"), i)), lambda i: i.isNotNull())
    cuts = F.transform(places, lambda p: F.get(worded, p))
    edges = F.concat(F.array(F.lit(-1)), cuts, F.array(F.size(lines)))
    runs = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.when(b - a > 1, F.array_join(F.slice(lines, a + 2, b - a - 1), "\n")))
    return F.array_join(F.filter(runs, lambda r: r.isNotNull()), "\n")


def line_frequency_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words_left of each row of docs.

    Null and empty texts have no words and fail; repeated rows are judged alike, long texts whole; other columns have no say.
    """
    rows = written(measured(docs), shared_dir(docs.sparkSession))
    out = judged(rows, common_lines(rows))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("words_left").cast("long"))


def clean(docs: DataFrame, copies: bool = False) -> DataFrame:
    """The rows of docs that the rules keep, common lines taken out of their texts and n_chars set anew; columns as they were,
    whatever their names.

    Repeated rows stay repeated. A text from which nothing is taken stays byte by byte; a null text is always rejected. Copies of a
    text don't make its lines common unless ``copies`` says so: removing them is left to a later stage, which keeps one.
    """
    rows = written(measured(docs), shared_dir(docs.sparkSession))
    verdicts = judged(rows, common_lines(rows, copies=copies)).where("kept").select(F.col("source").alias("host"), F.col("text_hash").alias("hash"), "common").dropDuplicates(["host", "hash"])
    text = F.col("text").cast("string")
    boxes = boxed(docs, text=text, source=F.col("source").cast("string"), text_hash=text_hash(text))
    kept = boxes.join(verdicts, (F.col("text_hash") == F.col("hash")) & F.col("source").eqNullSafe(F.col("host")))
    kept = kept.withColumn("left", F.when(F.col("common").isNull(), F.col("text")).otherwise(without_lines(F.col("text"), F.transform("common", lambda x: x["at"]))))
    changed = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("left").cast(docs.schema["n_chars"].dataType)
    return unboxed(kept, docs.columns, **changed)


def op3_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, one row each; see line_frequency_rules for nulls, empty and long texts, repeats and other columns."""
    return line_frequency_rules(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT r, i, array_to_string(list_slice(words, i, i + 7), ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
starts AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM starts) GROUP BY r),
lines AS (
  SELECT r, source, document, line,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT r, source, coalesce(doc_id::VARCHAR, md5(text)) AS document, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
hosts AS (SELECT source, count(DISTINCT coalesce(doc_id::VARCHAR, md5(text))) AS of FROM d GROUP BY source),
counts AS (SELECT source, norm, count(DISTINCT document) AS n FROM lines GROUP BY source, norm),
common AS (SELECT c.source, norm FROM counts c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source WHERE n > 20 AND n > of * 0.02::DOUBLE),
taken AS (
  SELECT r, sum(len(string_split(l.norm, ' '))) AS n FROM lines l JOIN common c ON l.norm = c.norm AND l.source IS NOT DISTINCT FROM c.source GROUP BY r),
all_of AS (
  SELECT d.doc_id, len(d.words)::BIGINT AS n_words, len(array_to_string(d.words, ''))::BIGINT AS word_chars,
         (len(d.text) - len(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
         (len(d.words) - coalesce(taken.n, 0))::BIGINT AS words_left
  FROM d LEFT JOIN repeated USING (r) LEFT JOIN dups USING (r) LEFT JOIN taken USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND words_left >= n_words * 0.3::DOUBLE AS kept, words_left
FROM all_of
"""
