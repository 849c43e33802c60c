"""Metadata tables of three public music datasets, each projected to one schema of clips.

A clip: clip_id, audio_path, dataset (map of what only its source tells), genres, mood_themes, instrument_tags, issues (sorted distinct
arrays), tempo_bpm, key, mode, caption.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .readers import scan_csv_metadata, scan_ragged_tsv


def _text() -> Column:
    return F.lit(None).cast("string")


def _path(relative: Column, root: str | None) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), relative) if root else _text()


def _sorted(values: Column) -> Column:
    return F.sort_array(F.array_distinct(values))


def _clip(
    rows: DataFrame, clip_id: Column, relative: Column, root: str | None, dataset: Mapping[str, Column], genres: Column, moods: Column, tags: Column, issues: Column | None = None, tempo: Column | None = None,
    key: Column | None = None, mode: Column | None = None, caption: Column | None = None,
) -> DataFrame:
    known = F.create_map(*[x for name, c in (dataset | {"relative_path": relative}).items() for x in (F.lit(name), c.cast("string"))])
    return rows.select(
        clip_id.cast("string").alias("clip_id"), _path(relative, root).alias("audio_path"), F.map_filter(known, lambda _, v: v.isNotNull()).alias("dataset"), _sorted(genres).alias("genres"), _sorted(moods).alias("mood_themes"),
        _sorted(tags).alias("instrument_tags"), (T.strings([]) if issues is None else _sorted(issues)).alias("issues"), (F.lit(None).cast("double") if tempo is None else tempo).alias("tempo_bpm"),
        (_text() if key is None else key).alias("key"), (_text() if mode is None else mode).alias("mode"), (_text() if caption is None else caption).alias("caption"),
    )


def jamendo_clips(spark: SparkSession, path: str, root: str | None = None, name: str = "mtg_jamendo") -> DataFrame:
    """Clips of a ragged table TRACK_ID, ARTIST_ID, ALBUM_ID, PATH, DURATION and tags ``domain---tag`` in any number of cells."""
    rows = scan_ragged_tsv(spark, path, ["TRACK_ID", "ARTIST_ID", "ALBUM_ID", "PATH", "DURATION"], "tags")
    c = F.col
    dataset = {"name": F.lit(name), "track_id": c("TRACK_ID"), "artist_id": c("ARTIST_ID"), "album_id": c("ALBUM_ID"), "track_name": c("TRACK_ID"), "artist_name": c("ARTIST_ID"), "album_name": c("ALBUM_ID"), "duration_s": T.to_number(c("DURATION"))}
    domain = lambda d: T.tags_with_prefix(c("tags"), d)
    return _clip(rows, c("TRACK_ID"), c("PATH"), root, dataset, domain("genre"), domain("mood/theme"), domain("instrument"))


def medleydb_clips(spark: SparkSession, path: str, root: str | None = None, subfolder: str = "", types: Sequence[str] = (), name: str = "medleydb") -> DataFrame:
    """Clips of a CSV table id, medleydb_id, audio_path, genre, instrument, key, tempo, license, type; types: only rows of these. The
    artist is what stands before the first _ of medleydb_id."""
    rows = scan_csv_metadata(spark, path)
    rows = rows.where(F.col("type").isin(*types)) if types else rows
    c, own = F.col, F.nullif(F.col("medleydb_id"), F.lit(""))
    relative = F.concat(F.lit(subfolder.rstrip("/") + "/"), c("audio_path")) if subfolder else c("audio_path")
    artist = F.when(own.contains("_"), F.split_part(own, F.lit("_"), F.lit(1)))
    dataset = {"name": F.lit(name), "track_id": c("id"), "medleydb_id": c("medleydb_id"), "track_name": c("medleydb_id"), "artist_name": artist, "license": c("license"), "type": c("type")}
    key_mode = T.parse_key_mode(c("key"))
    return _clip(rows, F.coalesce(own, "id"), relative, root, dataset, T.parse_list(c("genre")), T.strings([]), T.parse_list(c("instrument"), quoted_only=True), tempo=T.parse_tempo(c("tempo")), key=key_mode["key"], mode=key_mode["mode"])


def musiccaps_clips(
    spark: SparkSession, path: str, vocabulary: Sequence[str], genres: Sequence[str], moods: Sequence[str], issues: Mapping[str, Sequence[str]] = {}, stop: Sequence[str] = (), root: str | None = None, suffix: str = ".wav", present: DataFrame | None = None,
    name: str = "musiccaps",
) -> DataFrame:
    """Clips of a CSV table ytid, start_s, end_s, audioset_positive_labels, aspect_list, caption, is_balanced_subset, is_audioset_eval.

    Aspects that resolve to an entry of the vocabulary are instruments. Of the others, those without a stop word are looked through for
    genres; moods and issues (name: phrases) are looked for in all. present (path): only clips whose audio is there.
    """
    rows = scan_csv_metadata(spark, path).withColumn("aspects", T.parse_list(F.col("aspect_list")))
    c = F.col
    relative = F.concat(c("ytid"), F.lit(suffix))
    if present is not None:
        rows = rows.join(present.select(F.col("path").alias("_p")).distinct(), _path(relative, root) == F.col("_p"), "left_semi")
    instruments = F.array_compact(F.transform(c("aspects"), lambda a: T.resolve_tag(a, vocabulary)))
    told = F.array_compact(F.array(*[F.when(F.size(T.mine_phrases(c("aspects"), phrases)) > 0, F.lit(n)) for n, phrases in issues.items()])).cast("array<string>") if issues else T.strings([])
    labels = F.array_join(F.filter(F.split(F.coalesce("audioset_positive_labels", F.lit("")), ","), lambda x: x != ""), ",")
    dataset = {
        "name": F.lit(name), "track_id": c("ytid"), "track_name": c("ytid"), "url": F.concat(F.lit("https://www.youtube.com/watch?v="), "ytid"), "duration_s": T.duration(c("start_s"), c("end_s")), "start_s": T.to_number(c("start_s")),
        "end_s": T.to_number(c("end_s")), "aspect_list": F.to_json("aspects"), "audioset_positive_labels": labels, "is_balanced_subset": T.parse_bool(c("is_balanced_subset")), "is_audioset_eval": T.parse_bool(c("is_audioset_eval")),
    }
    return _clip(rows, c("ytid"), relative, root, dataset, T.mine_phrases(T.unclaimed(c("aspects"), vocabulary, stop), genres), T.mine_phrases(c("aspects"), moods), instruments, issues=told, caption=c("caption"))
