"""Published versions, clips of three sources, YAML, deep JSON, and what a text leaves out."""

import json
import threading

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corvane.functions import nested as N
from corvane.functions import text as T
from corvane.sources import clips as C
from corvane.sources import readers as R
from corvane.sources import writers as W

SF = "/root/testdata/sf0.001"


def test_a_reader_never_misses_a_published_output(spark, tmp_path):
    path, stop, seen, failed = f"file://{tmp_path}/out", threading.Event(), [], []
    W.publish(spark.range(10).withColumn("v", F.lit(0)), path)

    def read():
        while not stop.is_set():
            try:
                rows = W.read_current(spark, path).collect()
                seen.append((len(rows), {r.v for r in rows}))
            except Exception as e:  # any failure at all counts
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 9):
        W.publish(spark.range(10 + k).withColumn("v", F.lit(k)), path, keep=4)
    stop.set()
    reader.join()
    assert not failed and len(seen) > 3
    assert all(len(vs) == 1 and n == 10 + next(iter(vs)) for n, vs in seen)
    assert len(W.versions(spark, path)) == 4 and W.current_version(spark, path) == W.versions(spark, path)[-1]


def test_a_writer_that_fails_leaves_the_current_version(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    W.publish(spark.range(3), path)
    with pytest.raises(Exception):
        W.publish(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), path)
    assert W.read_current(spark, path).count() == 3


def test_clips_of_three_sources_have_one_schema(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("TRACK_ID\tARTIST_ID\tALBUM_ID\tPATH\tDURATION\tTAGS\nt1\ta1\tb1\t01/1.mp3\t12.5\tgenre---rock\tmood/theme---calm\tgenre---pop\tgenre---rock\nt2\ta2\tb2\t02/2.mp3\tx\n")
    one = C.jamendo_clips(spark, f"{tmp_path}/a.tsv", "/audio")
    rows = {r.clip_id: r for r in one.collect()}
    assert rows["t1"].genres == ["pop", "rock"] and rows["t1"].mood_themes == ["calm"] and rows["t1"].audio_path == "/audio/01/1.mp3" and rows["t1"].dataset["duration_s"] == "12.5"
    assert rows["t2"].genres == [] and "duration_s" not in rows["t2"].dataset and rows["t2"].tempo_bpm is None
    (tmp_path / "b.csv").write_text('id,medleydb_id,audio_path,genre,instrument,key,tempo,license,type\n1,Art_Song,x.wav,"[\'Rock\']","[\'piano\' \'bass\']","[\'C Major\']","fast, 96.5 bpm",cc,full\n2,,y.wav,bad[,,,,cc,stem\n')
    two = C.medleydb_clips(spark, f"{tmp_path}/b.csv")
    rows = {r.clip_id: r for r in two.collect()}
    assert (rows["Art_Song"].dataset["artist_name"], rows["Art_Song"].key, rows["Art_Song"].mode, rows["Art_Song"].tempo_bpm, rows["Art_Song"].instrument_tags) == ("Art", "C", "major", 96.5, ["bass", "piano"])
    assert (rows["2"].genres, rows["2"].key, rows["2"].tempo_bpm, rows["2"].audio_path) == ([], None, None, None) and "artist_name" not in rows["2"].dataset
    assert [r.clip_id for r in C.medleydb_clips(spark, f"{tmp_path}/b.csv", types=["stem"]).collect()] == ["2"]
    (tmp_path / "c.csv").write_text('ytid,start_s,end_s,audioset_positive_labels,aspect_list,caption,is_balanced_subset,is_audioset_eval\ny1,30,40.125,"/m/1,/m/2","[\'acoustic guitars\', \'no drums\', \'jazz\', \'noisy rock recording\']","A ""live"" take,\nslow",True,\ny2,,5,,,,False,1\n')
    options = {"vocabulary": ["guitar", "drums"], "genres": ["jazz", "rock"], "moods": ["calm"], "issues": {"noise": ["noisy"], "hum": ["hum"]}, "stop": ["recording"], "root": "/yt"}
    three = C.musiccaps_clips(spark, f"{tmp_path}/c.csv", **options)
    rows = {r.clip_id: r for r in three.collect()}
    assert (rows["y1"].instrument_tags, rows["y1"].genres, rows["y1"].issues, rows["y1"].caption) == (["guitar"], ["jazz"], ["noise"], 'A "live" take,\nslow')
    assert (rows["y1"].dataset["duration_s"], rows["y1"].dataset["is_balanced_subset"]) == ("10.125", "true") and "is_audioset_eval" not in rows["y1"].dataset
    assert (rows["y2"].genres, rows["y2"].caption, rows["y2"].dataset["is_audioset_eval"]) == ([], None, "true") and "duration_s" not in rows["y2"].dataset
    there = spark.createDataFrame([("/yt/y2.wav",)], "path string")
    assert [r.clip_id for r in C.musiccaps_clips(spark, f"{tmp_path}/c.csv", present=there, **options).collect()] == ["y2"]
    assert one.dtypes == two.dtypes == three.dtypes


def test_texts_and_tags_of_any_kind_pass_through_csv(spark, tmp_path):
    texts = [None, "", " ", "\n", "\0", "\1", "\1N", "\1E", "  lead", "trail \t", "line\n", "a\r\nb", "a\rb", 'q"', '"q', '""', "\\", '\\"x', 'a\0"b', "\1A\0\1B", "o'c", "', '", "# no", "\ufeffx", "x\x85", "NULL"]
    rows = [(k, t, texts[-k], texts[(5 * k) % len(texts)]) for k, t in enumerate(texts)] + [(None, "no id", "en", "web")]
    for name, of in (("some", rows), ("none", [])):
        spark.createDataFrame(of, "doc_id long, text string, lang string, source string").coalesce(2).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = entry.queries()["csv_metadata"](spark, f"file://{tmp_path}/{name}").collect()
        assert sorted(((r.doc_id, r.text, r.tags) for r in got), key=repr) == sorted(((i, t, [a, b]) for i, t, a, b in of), key=repr)


def test_yaml_files(spark, tmp_path):
    pytest.importorskip("yaml")
    for name, text in {"a": "- x: 1\n  y: [a, b]\n- x: 2\n", "b": "x: 3\ny: []\n", "c": "", "d": "# nothing\n"}.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    rows = R.scan_documents(spark, f"{tmp_path}/*.yaml", "x int, y array<string>", "yaml").collect()
    assert sorted((r.x, r.y) for r in rows) == [(1, ["a", "b"]), (2, None), (3, [])]
    with pytest.raises(ValueError):
        R.scan_documents(spark, f"{tmp_path}/*.yaml", None, "yaml")


def test_deep_json_is_opened_to_its_leaves(spark):
    deep = json.loads("[" * 12 + "7" + "]" * 12)
    texts = [json.dumps({"a": deep, "b": {}, "c": None, "d": [[], 1, {"e": "x"}]}), "not json", None, "5", "[]"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    found = sorted((r.id, r.path, r.value_text, r.value) for r in N.flatten_json(rows, "j", ["id"]).collect())
    assert found == [(0, "a/" + "/".join(["0"] * 12), "7", 7.0), (0, "c", None, None), (0, "d/1", "1", 1.0), (0, "d/2/e", "x", None), (3, "", "5", 5.0)]
    cut = {r.path: r.value_text for r in N.flatten_json(rows.where("id = 0"), "j", ["id"], depth=1).collect()}
    assert set(cut) == {"a", "b", "c", "d"} and json.loads(cut["a"]) == deep
    assert N.flatten_json(rows.where("id = 9"), "j", ["id"]).collect() == []


def test_properties_are_parsed_once(spark):
    plan = entry.queries()["flattened_properties"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan and "parse_json" not in plan


def test_omitted_operators_stems_and_values(spark):
    rows = spark.createDataFrame(
        [("Cut the bass, then a Low-Shelf at 250 Hz.", ["apply_lowshelf_filter", "apply_gain", "separate"], {"bass": ["bass"], "vocals": ["voice", "vocals"], "mix": []}, {"hz": 250.4, "gain": -3.25}), (None, ["apply_gain"], {"bass": ["bass"]}, {"hz": 1.0}), ("", None, None, None)],
        "text string, used array<string>, stems map<string,array<string>>, params map<string,double>",
    )
    accepted = {"apply_lowshelf_filter": ["shelf"], "apply_gain": [], "separate": []}
    operators = T.missing_operators(F.col("text"), F.col("used"), accepted, exempt=["separate"])
    got = rows.select(T.omissions(F.col("text"), operators, T.missing_stems(F.col("text"), F.col("stems")), T.missing_values(F.col("text"), F.col("params"), 0)).alias("o")).collect()
    assert got[0].o == ["did not name operator(s) apply_gain", "did not name stem(s) vocals", "omitted value(s) gain=-3.25"]
    assert got[1].o == ["did not name operator(s) apply_gain", "did not name stem(s) bass", "omitted value(s) hz=1.0"] and got[2].o == []
    assert rows.select(T.omissions(F.col("text")).alias("o")).first().o == []
