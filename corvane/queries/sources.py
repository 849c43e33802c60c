"""Queries over readers, writers and streams: the given tables are written in each format and read back."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

from pyspark.sql import functions as F

from ..registry import register
from ..sources import clips as C
from ..sources import readers as R
from ..sources import writers as W
from ..streaming import resume as S
from .nested import spread, table


@register("jsonl_round_trip", "SELECT doc_id, text, lang FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """Lines of JSON, written and read strictly."""
    path = W.scratch(spark)
    W.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return R.scan_jsonl(spark, path, "doc_id bigint, text string, lang string", strict=True)


@register("document_files", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def document_files(spark, sf_dir):
    """A2: files that hold lists of objects."""
    path = W.scratch(spark)
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    counts.groupBy("lang").agg(F.to_json(F.collect_list(F.struct("lang", "source", "n"))).alias("value")).select("value").repartition(4, "value").write.option("maxRecordsPerFile", 1).text(path)
    return R.scan_documents(spark, path, "lang string, source string, n bigint")


@register("yaml_documents", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def yaml_documents(spark, sf_dir):
    """A2: files that hold lists of objects, in YAML."""
    path = W.scratch(spark)
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    quoted = lambda c: F.coalesce(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("null"))
    item = F.format_string("- lang: %s\n  source: %s\n  n: %d", quoted(F.col("lang")), quoted(F.col("source")), "n")
    counts.groupBy("lang").agg(F.array_join(F.collect_list(item), "\n").alias("value")).select("value").repartition(4, "value").write.option("maxRecordsPerFile", 1).text(path)
    return R.scan_documents(spark, path, "lang string, source string, n bigint", "yaml")


@register("tolerant_lines", """
SELECT event_type, count(*) FILTER (WHERE event_id % 10 > 0) AS rows, count(*) FILTER (WHERE event_id % 10 = 0) AS quarantined FROM events GROUP BY 1
""")  # fmt: skip
def tolerant_lines(spark, sf_dir):
    """A3: good rows kept, broken lines set aside, text behind an object passed over."""
    path = W.scratch(spark)
    whole = F.to_json(F.struct("event_id", "event_type"))
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken "), "event_type")).when(F.col("event_id") % 10 == 1, F.concat(whole, F.lit(" and more"))).otherwise(whole)
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    rows, bad = R.scan_jsonl_tolerant(spark, path, "event_id bigint, event_type string")
    good = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))
    return good.join(bad.groupBy(F.split_part("value", F.lit(" "), F.lit(2)).alias("event_type")).agg(F.count(F.lit(1)).alias("quarantined")), "event_type")


@register("ragged_lines", "SELECT p_partkey::VARCHAR AS id, p_brand AS brand, string_split(p_name, ' ') AS tags FROM part")
def ragged_lines(spark, sf_dir):
    """A4: fixed columns and any number of further cells."""
    path = W.scratch(spark)
    table(spark, sf_dir, "part").select(F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_brand", F.array_join(F.split("p_name", " "), "\t")).alias("value")).write.text(path)
    return R.scan_ragged_tsv(spark, path, ["id", "brand"])


#: What cells of a CSV or items of a list literal can't hold, and the letter that stands for it behind a character 1.
MARKS = {1: "A", 0: "B", 39: "C"}


def marked(name):
    """A text column as a cell or item that reads back as it was: NUL, a single quote, an empty text and null have marks."""
    text = F.col(name)
    cell = reduce(lambda x, c: F.replace(x, F.lit(chr(c)), F.lit(f"\x01{MARKS[c]}")), MARKS, text)
    return F.when(text.isNull(), "\x01N").when(text == "", "\x01E").otherwise(cell)


def unmarked(name):
    """SQL for the text that marked made a cell of."""
    return reduce(lambda x, c: f"replace({x}, char(1) || '{MARKS[c]}', char({c}))", reversed(MARKS), f"replace(nullif({name}, char(1) || 'N'), char(1) || 'E', '')")


@register("csv_metadata", "SELECT doc_id, text, [lang, source] AS tags FROM documents")
def csv_metadata(spark, sf_dir):
    """Quoted cells over several lines, list cells, and an adapter."""
    path = W.scratch(spark)
    tags = F.concat(F.lit("['"), marked("lang"), F.lit("', '"), marked("source"), F.lit("']"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ytid"), marked("text").alias("caption"), tags.alias("aspects"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    if "captions" not in R.ADAPTERS:
        R.register_adapter("captions", {"doc_id": "cast(ytid AS bigint)", "text": unmarked("caption"), "tags": f"transform(aspects, x -> {unmarked('x')})"})
    return R.scan_csv_metadata(spark, path, "captions", ["aspects"])


@register("ragged_clips", """
SELECT p_partkey::VARCHAR AS clip_id, '/audio/' || p_brand || '/' || p_partkey || '.mp3' AS audio_path, list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda w: length(w) % 2 = 0))) AS genres,
  list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda w: length(w) % 2 = 1))) AS mood_themes, [p_brand] AS instrument_tags, p_size::DOUBLE AS duration_s, p_brand AS artist FROM part
""")  # fmt: skip
def ragged_clips(spark, sf_dir):
    """A5: clips of the ragged table of tracks with prefixed tags."""
    path = W.scratch(spark)
    word = lambda w: F.concat(F.when(F.length(w) % 2 == 0, "genre---").otherwise("mood/theme---"), w)
    tags = F.concat(F.transform(F.split("p_name", " "), word), F.array(F.concat(F.lit("instrument---"), "p_brand"), F.lit("other---x")))
    relative = F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".mp3"))
    cells = F.concat_ws("\t", F.col("p_partkey").cast("string"), "p_brand", F.lit("album"), relative, F.col("p_size").cast("string"), F.array_join(tags, "\t"))
    table(spark, sf_dir, "part").select(cells.alias("value")).write.text(path)
    clips = C.jamendo_clips(spark, path, "/audio/")
    return clips.select("clip_id", "audio_path", "genres", "mood_themes", "instrument_tags", F.col("dataset")["duration_s"].cast("double").alias("duration_s"), F.col("dataset")["artist_name"].alias("artist"))


@register("multitrack_clips", """
SELECT CASE WHEN p_partkey % 4 = 0 THEN p_partkey::VARCHAR ELSE p_brand || '_' || p_partkey END AS clip_id, '/audio/mix/' || p_partkey || '.wav' AS audio_path, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS artist,
  list_sort(list_distinct(string_split(p_name, ' '))) AS genres, list_sort(list_distinct([p_type, p_brand])) AS instrument_tags, CASE WHEN p_partkey % 3 > 0 THEN (p_size + 60)::DOUBLE END AS tempo_bpm, CASE p_partkey % 3 WHEN 0 THEN NULL ELSE 'A' END AS key,
  CASE p_partkey % 3 WHEN 1 THEN 'minor' END AS mode FROM part WHERE p_partkey % 5 > 0
""")  # fmt: skip
def multitrack_clips(spark, sf_dir):
    """A5: clips of the CSV of multitracks: list cells, keys, tempos, artists in ids, only some types."""
    path = W.scratch(spark)
    k, listed = F.col("p_partkey"), lambda c: F.concat(F.lit("['"), c, F.lit("']"))
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 4 > 0, F.concat("p_brand", F.lit("_"), k.cast("string"))).alias("medleydb_id"), F.concat(k.cast("string"), F.lit(".wav")).alias("audio_path"), listed(F.replace("p_name", F.lit(" "), F.lit("', '"))).alias("genre"),
        F.concat(F.lit("some '"), "p_type", F.lit("' and '"), "p_brand", F.lit("'")).alias("instrument"), F.when(k % 3 == 1, listed(F.lit("A Minor"))).when(k % 3 == 2, listed(F.lit("A"))).alias("key"),
        F.when(k % 3 > 0, F.concat(F.lit("about "), (F.col("p_size") + 60).cast("string"), F.lit(" BPM, or 200 bpm"))).alias("tempo"), F.lit("cc").alias("license"), F.when(k % 5 > 0, "full").otherwise("stem").alias("type"),
    )
    W.write_report(rows, path)
    clips = C.medleydb_clips(spark, path, "/audio", "mix", ["full"])
    return clips.select("clip_id", "audio_path", F.col("dataset")["artist_name"].alias("artist"), "genres", "instrument_tags", "tempo_bpm", "key", "mode")


@register("captioned_clips", """
WITH t AS (SELECT p_partkey, p_name || chr(39) || 's' AS caption, string_split(p_name, ' ') AS w, p_size FROM part)
SELECT p_partkey::VARCHAR AS clip_id, caption, list_sort(list_distinct(list_filter(w, lambda x: x IN ('steel', 'brass')))) AS instrument_tags, list_sort(list_distinct(list_filter(w, lambda x: x IN ('small', 'large')))) AS genres,
  list_sort(list_distinct(list_filter(list_concat(w, CASE WHEN p_partkey % 2 = 0 THEN ['calm'] ELSE [] END), lambda x: x IN ('calm', 'red')))) AS mood_themes, CASE WHEN p_partkey % 2 = 0 THEN ['noise'] ELSE [] END AS issues, round(p_size / 8.0::DOUBLE, 3) AS duration_s,
  p_partkey % 2 = 0 AS balanced FROM t
""")  # fmt: skip
def captioned_clips(spark, sf_dir):
    """A5: clips of the CSV of captions: aspects as instruments, genres, moods and issues; durations and flags."""
    path = W.scratch(spark)
    k = F.col("p_partkey")
    aspects = F.concat(F.lit('["'), F.replace("p_name", F.lit(" "), F.lit('", "')), F.lit('"'), F.when(k % 2 == 0, ', "large noisy room", "calm"').otherwise(""), F.lit("]"))
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select(
        k.alias("ytid"), F.lit("10").alias("start_s"), (10 + F.col("p_size") / 8.0).cast("string").alias("end_s"), F.lit("/m/1,,/m/2").alias("audioset_positive_labels"), aspects.alias("aspect_list"), F.concat("p_name", F.lit("'s")).alias("caption"),
        F.when(k % 2 == 0, "True").otherwise("False").alias("is_balanced_subset"), F.lit("").alias("is_audioset_eval"),
    )
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    clips = C.musiccaps_clips(spark, path, ["steel", "brass"], ["small", "large"], ["calm", "red"], {"noise": ["noisy"], "clipped": ["distorted"]}, ["room"])
    of = F.col("dataset")
    return clips.select("clip_id", "caption", "instrument_tags", "genres", "mood_themes", "issues", of["duration_s"].cast("double").alias("duration_s"), (of["is_balanced_subset"] == "true").alias("balanced"))


@register("parquet_columns", "SELECT vec_id, label FROM embeddings")
def parquet_columns(spark, sf_dir):
    """Two columns of a wide table."""
    return R.scan_parquet(spark, f"{sf_dir}/embeddings.parquet", ["vec_id", "label"])


@register("xml_presets", "SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part")
def xml_presets(spark, sf_dir):
    """One row for each element."""
    path = W.scratch(spark)
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")).write.format("xml").option("rowTag", "preset").save(path)
    return R.scan_xml(spark, path, "preset", "_id bigint, name string, size int").withColumnRenamed("_id", "id")


@register("ordered_pipelines", """
SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'missing order' WHEN o_orderstatus = 'P' THEN 'no settings: gain' ELSE 'gain' END AS what, count(*) AS n FROM (SELECT o_orderpriority, o_orderstatus FROM orders GROUP BY 1, 2) GROUP BY 1
""")  # fmt: skip
def ordered_pipelines(spark, sf_dir):
    """Ordered steps with their settings, and what is amiss."""
    path = W.scratch(spark)
    kinds = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus").distinct()
    order = F.when(F.col("o_orderpriority") != "1-URGENT", F.array(F.lit("gain")))
    settings = F.map_filter(F.create_map(F.lit("gain"), F.create_map(F.lit("db"), "o_orderstatus")), lambda _, v: v["db"] != "P")
    kinds.select(F.to_json(F.struct(order.alias("order"), settings.alias("plugins"))).alias("value")).repartition(15).write.option("maxRecordsPerFile", 1).text(path)
    steps, issues = R.scan_ordered_pipeline(spark, path)
    return steps.select(F.col("plugin").alias("what")).unionByName(issues.select(F.col("issue").alias("what"))).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


#: Rows that an archive holds at most on average.
ARCHIVE_ROWS = 20_000


@register("zip_members", "SELECT source, count(*) AS n, sum(len(lang))::BIGINT AS chars FROM documents GROUP BY 1")
def zip_members(spark, sf_dir):
    """Tables inside archives. Each source has as many archives as its rows ask for, and tasks write them into the shared folder."""
    import pyarrow as pa

    path = W.scratch(spark)

    def packed(batches):
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(path)
        files.create_dir(folder)
        for batch in batches:
            for source, bucket, langs in zip(*(c.to_pylist() for c in batch.columns)):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(f"{source}.csv", "\n".join(langs))
                    z.writestr("readme.txt", "x")
                with files.open_output_stream(f"{folder}/{source}-{bucket}.zip") as out:  # a task that runs again writes the same file
                    out.write(held.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    docs = table(spark, sf_dir, "documents")
    sizes = docs.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / ARCHIVE_ROWS).alias("archives"))
    parts = docs.select("doc_id", "source", "lang").join(sizes, "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("archives")))
    parts.groupBy("source", "bucket").agg(F.collect_list("lang").alias("langs")).mapInArrow(packed, "n long").agg(F.sum("n")).first()
    lines = R.scan_zip_members(spark, path, ".csv").select(F.regexp_extract("member", r"(\w+)\.csv", 1).alias("source"), F.explode(F.split("text", "\n")).alias("lang"))
    return lines.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("lang")).alias("chars"))


@register("lookup_table", "SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 5 > 0")
def lookup_table(spark, sf_dir):
    """A10: a key and a value column, empty ones skipped."""
    path = W.scratch(spark)
    W.write_report(table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("value"), "c_nationkey"), path)
    return R.scan_lookup(spark, path, "key", "value")


@register("inventory_status", f"""
WITH f AS (SELECT source, ceil(count(*) / {ARCHIVE_ROWS}.0)::BIGINT AS files FROM documents GROUP BY 1), b AS (SELECT DISTINCT source, doc_id % files AS part FROM documents JOIN f USING (source))
SELECT source, count(*) FILTER (WHERE part > 0) AS ok, count(*) FILTER (WHERE part = 0) AS differs, 1::BIGINT AS missing FROM b GROUP BY 1
""")  # fmt: skip
def inventory_status(spark, sf_dir):
    """Files listed and held against their hashes; of each source, part 0 has another hash and one more file is expected.
    Files hold about ARCHIVE_ROWS rows, so what a hash is taken of is bounded."""
    path = W.scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    sizes = docs.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / ARCHIVE_ROWS).alias("files"))
    by = docs.join(sizes, "source").select("source", F.pmod("doc_id", "files").alias("part"), F.concat_ws(",", "doc_id", "lang").alias("value"))
    by.repartition("source", "part").sortWithinPartitions("source", "part", "value").write.option("maxRecordsPerFile", 0).partitionBy("source", "part").text(path)
    content = by.groupBy("source", "part").agg(F.concat(F.array_join(F.sort_array(F.collect_list("value")), "\n"), F.lit("\n")).alias("c"))
    place = F.split("path", "/")
    listed = R.list_files(spark, path, "*.txt").select(F.array_join(F.slice(place, -3, 3), "/").alias("name"), F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), F.regexp_extract("path", "part=([^/]+)/", 1).cast("long").alias("part"))
    known = listed.join(content, ["source", "part"]).select("name", F.when(F.col("part") > 0, F.sha2("c", 256)).otherwise("y").alias("sha256"))
    lost = sizes.select(F.concat(F.lit("source="), "source", F.lit("/part=none/none.txt")).alias("name"), F.lit("x").alias("sha256"))
    found = R.verify_inventory(spark, path, known.unionByName(lost), 3).withColumn("source", F.regexp_extract("name", "source=([^/]+)/", 1))
    return found.groupBy("source").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "differs", "missing")])


@register("many_files", "SELECT lang || '.json' AS kind, count(*) AS n FROM documents GROUP BY 1")
def many_files(spark, sf_dir):
    """Several files and where each row came from."""
    path = W.scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("lang").alias("kind"))
    docs.write.partitionBy("kind").json(path)
    rows = R.scan_many(spark, [f"{path}/*"], "doc_id bigint, lang string")
    return rows.where("file is not null").groupBy(F.concat("lang", F.lit(".json")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("fanned_out", """
SELECT 'accept' AS sink, count(*) FILTER (WHERE quality = 1) AS n FROM labels UNION ALL SELECT 'review', count(*) FILTER (WHERE quality = 0) FROM labels UNION ALL SELECT 'full', count(*) FROM labels
""")  # fmt: skip
def fanned_out(spark, sf_dir):
    """One evaluation, several outputs."""
    path = W.scratch(spark)
    W.fan_out(table(spark, sf_dir, "labels"), {"accept": ("json", F.col("quality") == 1, ["doc_id"]), "review": ("parquet", F.col("quality") == 0, None), "full": ("csv", None, ["doc_id", "toxic"])}, path)
    read = {"accept": spark.read.schema("doc_id bigint").json(f"{path}/accept"), "review": spark.read.parquet(f"{path}/review"), "full": spark.read.option("header", True).csv(f"{path}/full")}
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("sink"), "n") for k, d in read.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("published_versions", """
SELECT 'current' AS which, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'begun before', NULL, count(*) FROM orders UNION ALL SELECT 'kept', 'versions', 2
""")  # fmt: skip
def published_versions(spark, sf_dir):
    """Versions behind a pointer that changes in one step; a reader that began before keeps its version."""
    path, orders = W.scratch(spark), table(spark, sf_dir, "orders")
    W.publish(orders.where("o_orderkey < 0").select("o_orderkey"), path)
    W.publish(orders.select("o_orderkey"), path)
    begun = W.read_current(spark, path)
    W.publish(orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), path)
    now = W.read_current(spark, path).select(F.lit("current").alias("which"), F.col("o_orderstatus").alias("status"), "n")
    before = begun.agg(F.count(F.lit(1)).alias("n")).select(F.lit("begun before").alias("which"), F.lit(None).cast("string").alias("status"), "n")
    kept = spark.range(1).select(F.lit("kept").alias("which"), F.lit("versions").alias("status"), F.lit(len(W.versions(spark, path))).cast("long").alias("n"))
    return now.unionByName(before).unionByName(kept)


@register("replaced_output", """
SELECT 'current' AS which, o_orderstatus, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'kept', NULL, count(*) FROM orders
""")  # fmt: skip
def replaced_output(spark, sf_dir):
    """An output replaced as a whole, its former content kept beside it."""
    path = W.scratch(spark)
    W.replace_atomically(table(spark, sf_dir, "orders").select("o_orderkey"), path)
    kept = W.replace_atomically(table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), path, backup=True)
    now = spark.read.parquet(path).select(F.lit("current").alias("which"), "o_orderstatus", "n")
    return now.unionByName(spark.read.parquet(kept).agg(F.count("o_orderkey").alias("n")).select(F.lit("kept").alias("which"), F.lit(None).cast("string").alias("o_orderstatus"), "n"))


@register("streamed_checks", r"""
SELECT CASE WHEN len(regexp_extract_all(text, '->')) + len(regexp_extract_all(text, '\w+\([A-Za-z_]+\s*=')) > 0 THEN 'reject' WHEN len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) > 300 THEN 'review' ELSE 'accept' END AS disposition, count(*) AS n FROM documents GROUP BY 1
""")  # fmt: skip
def streamed_checks(spark, sf_dir):
    """2.10, D4: append and resume as a stream; the second call finds nothing new."""
    source, out, checkpoint = W.scratch(spark), W.scratch(spark), W.scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs.write.parquet(source)
    for _ in range(2):
        S.resume(spark, source, docs.schema, out, checkpoint, identifiers=["apply_gain"], forbidden=[], max_words=300)
    return spark.read.parquet(out).groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


@register("streamed_json_checks", r"""
SELECT CASE WHEN len(regexp_extract_all(text, '->')) + len(regexp_extract_all(text, '\w+\([A-Za-z_]+\s*=')) > 0 THEN 'reject' WHEN len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) > 300 THEN 'review' ELSE 'accept' END AS disposition, source, count(*) AS n FROM documents GROUP BY 1, 2
""")  # fmt: skip
def streamed_json_checks(spark, sf_dir):
    """2.10: lines of JSON as a stream, one source after the other; each call decides what came since the last."""
    source, out, checkpoint = W.scratch(spark), W.scratch(spark), W.scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    half = F.pmod(F.xxhash64("source"), F.lit(2)) == 0
    for part in (docs.where(half), docs.where(~half | half.isNull())):
        W.write_jsonl(part, source, mode="append")
        S.resume(spark, source, docs.schema, out, checkpoint, kind="json", identifiers=["apply_gain"], forbidden=[], max_words=300)
    return spark.read.parquet(out).groupBy("disposition", "source").agg(F.count(F.lit(1)).alias("n"))


@register("hourly_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark, sf_dir):
    """Windowed counts of a table."""
    return S.counts_by_window(table(spark, sf_dir, "events").select("ts", "event_type"), "ts", "event_type")


#: Days of each wave of files, days that a late event comes after its own wave's, and the hours that a window waits for it.
WAVE_DAYS, WAIT_HOURS = 8, 30
WAVE = f"least(3, (day(ts) - 1) // {WAVE_DAYS})"


@register("streamed_windows", f"""
WITH e AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN least(3, {WAVE} + 1) ELSE {WAVE} END AS wave, time_bucket(INTERVAL 6 HOURS, ts) AS start FROM events),
w AS (SELECT wave, max(max(ts)) OVER (ORDER BY wave) - INTERVAL {WAIT_HOURS} HOURS AS mark FROM e GROUP BY wave),
kept AS (SELECT e.* FROM e LEFT JOIN w ON w.wave = e.wave - 1 WHERE w.mark IS NULL OR start + INTERVAL 6 HOURS > w.mark)
SELECT start, event_type, count(*) AS n FROM kept WHERE start + INTERVAL 6 HOURS <= (SELECT max(mark) FROM w) GROUP BY 1, 2
""")  # fmt: skip
def streamed_windows(spark, sf_dir):
    """2.10: windowed counts of a stream of JSON files in four waves, a tenth of the events a wave late. Each wave is a run of its own
    that resumes from the checkpoint, and one more run finds nothing new."""
    source, out, checkpoint = W.scratch(spark), W.scratch(spark), W.scratch(spark)
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    own = F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / WAVE_DAYS))
    wave = F.when(F.col("event_id") % 10 == 0, F.least(F.lit(3), own + 1)).otherwise(own)
    for k in (0, 1, 2, 3, None):
        if k is not None:
            W.write_jsonl(events.where(wave == k), source, mode="append")
        S.resume_counts(spark, source, events.schema, out, checkpoint, "ts", "event_type", f"{WAIT_HOURS} hours", "6 hours", "json")
    return S.seen_windows(spark, out, "event_type")
