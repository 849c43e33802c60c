"""Shards by extendible hashing.

The directory is indexed by the leading bits of a hash of doc_id. All documents start in one bucket; only a bucket over its byte
limit splits on its next bit, until every shard fits. A bucket's size is a sum over fine prefixes, so the directory comes from small
aggregated tables; the documents only look their shard up.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, quoted, shared_dir, table, written

#: Bits that one round looks ahead; a round's directory has at most 2 ** STEP entries for each bucket that is still too large.
STEP = 12
HASH_BITS = 60


def hash_bits(key) -> F.Column:
    """The leading 60 bits of an MD5, as a long."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def rounds(sizes: DataFrame, max_bytes: int) -> list[tuple[int, DataFrame, DataFrame]]:
    """(bits, shards, hashes) of each round; shards: depth, prefix, shard_bytes, shard_docs, depth over those of the round before and up
    to bits; hashes: h of all that were still to be placed. sizes: h (a hash of HASH_BITS bits), bytes.

    The bytes of each hash are summed once and written, and so is what a round sums, so a round reads no document. Every round sums bytes by the next STEP bits of the buckets that are still over the limit, and takes, for each fine prefix, the
    shallowest bucket that fits. What no split can part (rows of one hash) stays one shard, whatever its size.
    """
    spark = sizes.sparkSession
    found, depth = [], 0
    left = written(sizes.groupBy("h").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")), shared_dir(spark))
    while depth < HASH_BITS:
        step = min(STEP, HASH_BITS - depth)
        fine = left.groupBy(F.shiftrightunsigned("h", HASH_BITS - depth - step).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("keys"))
        levels = fine.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(step)))).groupBy((F.lit(depth + step) - F.col("up")).alias("depth"), F.expr("shiftright(fine, up)").alias("prefix"))
        levels = written(levels.agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.sum("keys").alias("keys")), shared_dir(spark))
        fits = levels.where((F.col("shard_bytes") <= max_bytes) | (F.col("keys") == 1))
        if depth:
            fits = fits.where(F.col("depth") > depth)
        parents = levels.where((F.col("shard_bytes") > max_bytes) & (F.col("keys") > 1)).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        depth += step
        found.append((depth, fits.where("depth = 0").unionByName(fits.join(parents, ["depth", "prefix"], "left_semi")).drop("keys"), left))
        over = levels.where((F.col("depth") == depth) & (F.col("shard_bytes") > max_bytes) & (F.col("keys") > 1)).select(F.col("prefix").alias("over"))
        if depth >= HASH_BITS or over.isEmpty():
            break
        left = left.join(over, F.shiftrightunsigned("h", HASH_BITS - depth) == F.col("over"), "left_semi")
    return found


def directory(sizes: DataFrame, max_bytes: int) -> DataFrame:
    """depth, prefix, shard_bytes, shard_docs of every shard, from sizes (h, bytes)."""
    return functools.reduce(DataFrame.unionByName, [shards for _, shards, _ in rounds(sizes, max_bytes)])


def leaves(shards: DataFrame, bits: int) -> DataFrame:
    """slot, leaf (shard, shard_bytes, shard_docs): what the shards of a round are for hashes that begin with these bits. A shard
    covers at most 2 ** STEP slots, and a slot is covered once."""
    wide = F.lit(bits) - F.col("depth")
    leaf = F.struct(F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')")).alias("shard"), "shard_bytes", "shard_docs")
    first = shards.select(leaf.alias("leaf"), F.call_function("shiftleft", "prefix", wide).alias("first"), F.call_function("shiftleft", F.lit(1).cast("long"), wide).alias("n"))
    return first.select(F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"), "leaf")


def assign_shards(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8 bytes of the text, 0 for null), shard (its bits; empty: the only shard), shard_bytes, shard_docs.

    Rows of one key, null included, share a shard. A shard is over max_bytes only if all its rows have one key. Columns of docs with
    these names are replaced; others may have any name. No rows give no rows. Hashes look their shards up by equal bits, each in the
    round that places it; rows meet their hash's shard in one join, which is all that moves them.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "shard", "shard_bytes", "shard_docs")]
    size = F.coalesce(F.octet_length(F.col(quoted(text))), F.lit(0)).cast("long")
    rows = boxed(docs, n_bytes=size, h=hash_bits(F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))))
    found = rounds(rows.select("h", F.col("n_bytes").alias("bytes")), max_bytes)
    placed = [hashes.join(leaves(shards, bits), F.shiftrightunsigned("h", HASH_BITS - bits) == F.col("slot")).select(F.col("h").alias("own"), "leaf") for bits, shards, hashes in found]
    rows = rows.join(functools.reduce(DataFrame.unionByName, placed), F.col("h") == F.col("own"), "left")
    return rows.select(*[F.col(f"row.{quoted(c)}") for c in kept], "n_bytes", "leaf.shard", "leaf.shard_bytes", "leaf.shard_docs")


def write_shards(docs: DataFrame, path: str, max_bytes: int) -> None:
    """One folder shard=<bits> for each shard; its rows come from one task."""
    assign_shards(docs, max_bytes).repartition("shard").write.partitionBy("shard").parquet(path)


#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def op10_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, one row each; see assign_shards for nulls, empty and long texts, repeats and ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs, SHARD_BYTES).select("doc_id", "n_bytes", "shard", "shard_bytes", "shard_docs")


OP10_SQL = """
WITH rows AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
levels AS (
  SELECT d.depth, r.h >> (60 - d.depth) AS prefix, sum(r.n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs,
         count(DISTINCT r.h) AS keys
  FROM rows r, (SELECT unnest(range(0, 61)) AS depth) d GROUP BY 1, 2),
mine AS (
  SELECT r.doc_id, r.n_bytes, r.h, l.depth, l.prefix, l.shard_bytes, l.shard_docs,
         row_number() OVER (PARTITION BY r.doc_id, r.h ORDER BY l.depth) AS k
  FROM (SELECT doc_id, n_bytes, h FROM rows) r, (SELECT unnest(range(0, 61)) AS depth) d, levels l
  WHERE l.depth = d.depth AND l.prefix = r.h >> (60 - d.depth) AND (l.shard_bytes <= 1048576 OR l.keys = 1))
SELECT doc_id, n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), 60, '0'), depth) END AS shard, shard_bytes, shard_docs
FROM mine WHERE k = 1
"""
