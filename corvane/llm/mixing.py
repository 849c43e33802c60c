"""Mixing sources to target weights by systematic sampling.

A source's target is its share, by weight, of all words; no target passes ``most`` times its source's words, and what is over is
shared anew by weight. Every document of a source then expects target / source words copies. Documents are laid end to end by these
expected copies, a random offset is added, and a document is emitted once for each integer boundary that it crosses. Sorted by
size, this takes words close to the target. The prefix sums come from small ordered buckets, so a source of any size is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, boxed, shared_dir, table, unboxed, written

WEIGHTS = (5.0, 2.0, 1.0)
SEED = "mix-1"


def word_count(text) -> F.Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"[^{SPACE}]++")), F.lit(0)).cast("long")


def uniform(*parts) -> F.Column:
    """A number in [0, 1) that only depends on the parts: the first 52 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size, n_docs, target of each source of sizes (source, size); a null source is one of its own, in last place.

    Weights repeat over the sources in code point order. The windows over all sources see one aggregated row of each.
    """
    w = Window.orderBy(F.col("source").isNull(), "source")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int")))
    # Filled from the source that reaches its limit first: k sources are at their limits, the others share the rest by weight.
    sources = sources.withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("reach", F.col("limit") / F.col("weight"))
    every, upto = Window.partitionBy(), Window.orderBy("reach", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("at_limit", F.coalesce(F.sum("limit").over(upto), F.lit(0.0))).withColumn("spent", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    sources = sources.withColumn("level", (F.sum("source_size").over(every) - F.col("at_limit")) / (F.sum("weight").over(every) - F.col("spent")))
    # The level of the first source that stays below its limit holds for all of them.
    level = F.min(F.when(F.col("level") < F.col("reach"), F.struct("reach", "level"))).over(every)["level"]
    return sources.withColumn("level", level).select("source", "source_size", "n_docs", F.coalesce(F.least("limit", F.col("weight") * F.col("level")), F.col("limit")).alias("target"))


def systematic_copies(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: str = SEED) -> DataFrame:
    """row (a struct of the columns of docs), size, source_size, target and copies; size is the number of words unless given.

    Order within a source: by size in classes of a quarter of an octave, within these by 256 hashed buckets, then size and hash of
    doc_id. The buckets' totals are prefix-summed per source (at most some 40,000 of them whatever the input), and rows are
    counted within a bucket, so one source may hold any part of the rows. Equal rows are sampled one by one, null ids as well, and
    an empty document counts as one of size 0. A source of no words has the target 0 and yields nothing. Reruns agree. Columns of
    docs may have any names, and only doc_id, source and text (without a given size) have a say.
    """
    source = F.col("source").cast("string")
    sized = boxed(docs, doc_id=F.col("doc_id"), source=F.coalesce(source, F.lit("")), none=source.isNull(), size=word_count(F.col("text")) if size is None else size.cast("long"), hash=F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    octave = F.floor(4 * F.log2(F.col("size") + F.lit(1.0))).cast("int")
    sized = sized.withColumn("bucket", octave * 256 + F.conv(F.substring("hash", 1, 2), 16, 10).cast("int"))
    buckets = sized.groupBy("source", "none", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source", "none").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    targets = source_targets(buckets.select(F.when(~F.col("none"), F.col("source")).alias("source"), F.col("words").alias("size")), weights, most)
    targets = targets.select(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("none"), "source_size", "target")
    known = starts.join(targets, ["source", "none"]).select("source", "none", "bucket", "before", "source_size", "target")
    # Ranks and their join have the same keys, so rows travel once.
    place = Window.partitionBy("source", "none", "bucket").orderBy("size", "hash", "doc_id")
    ranked = sized.withColumn("rank", F.row_number().over(place)).join(known, ["source", "none", "bucket"])
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    end, offset = F.col("before") + F.col("rank"), uniform(F.lit(seed), F.col("source"), F.col("none").cast("string"))
    return ranked.select("row", "size", "source_size", "target", (F.floor(end * rate + offset) - F.floor((end - 1) * rate + offset)).alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: str = SEED) -> DataFrame:
    """docs, each row as often as it was drawn; columns as they were."""
    drawn = systematic_copies(docs, None, weights, most, seed).where("copies > 0")
    return unboxed(drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents: a null text has size 0, a null source is one of its own, rows of one id and repeated rows are drawn one by
    one, a long text counts whole, other columns are left out, and no rows give no rows."""
    # Words are counted once; only sizes travel.
    docs = written(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), shared_dir(spark))
    drawn = systematic_copies(docs, F.col("size"))
    return drawn.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k
  FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM sources),
reached AS (SELECT *, source_size * 3.0::DOUBLE AS lim, source_size * 3.0::DOUBLE / weight AS reach FROM weighed),
filled AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(lim) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM reached WINDOW w AS (ORDER BY reach, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         coalesce(least(lim, weight * (SELECT arg_min(level, reach) FROM filled WHERE level < reach)), lim) AS target
  FROM filled),
ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.source,
         row_number() OVER (PARTITION BY s.source ORDER BY floor(4 * log2(s.size + 1.0::DOUBLE)), substr(s.h, 1, 2), s.size, s.h, s.doc_id) AS pos,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
         ('0x' || substr(sha256('mix-1|' || coalesce(t.source, '') || '|' || (CASE WHEN t.source IS NULL THEN 'true' ELSE 'false' END)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shift
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(pos * rate + shift) - floor((pos - 1) * rate + shift)) * size)::BIGINT AS taken
FROM ranked
"""
