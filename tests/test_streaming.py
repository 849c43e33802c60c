"""Windowed counts of a stream: watermark, late files, state that is dropped, and runs that resume."""

import json
from collections import Counter
from datetime import datetime, timedelta

import pytest

from corvane.streaming import resume as S

SCHEMA = "ts timestamp, kind string"
START = datetime(2024, 5, 1)


def at(minutes, kind="a"):
    return {"ts": (START + timedelta(minutes=minutes)).isoformat(), "kind": kind}


@pytest.fixture
def stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    paths = [f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint")]

    def arrive(name, rows, late="30 minutes", **options):
        if name:
            (tmp_path / "in" / f"{name}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        return S.resume_counts(spark, paths[0], SCHEMA, paths[1], paths[2], "ts", "kind", late, "1 hour", "json", **options)

    def closed():
        return {(int((r.start - START).total_seconds() // 3600), r.kind): r.n for r in S.seen_windows(spark, paths[1], "kind").collect()}

    return arrive, closed


def test_windows_close_once_and_late_events_are_dropped(stream):
    arrive, closed = stream
    arrive("one", [at(5), at(50), at(65), at(80, "b")])
    assert closed() == {}  # the watermark stands at 0:50
    arrive("two", [at(20), at(100)])  # out of order, but its window is still open
    assert closed() == {(0, "a"): 3}
    reports = arrive("three", [at(10), at(59), at(70, "b"), at(200)])
    assert sum(r["dropped"] for r in reports) >= 1  # rows of 0:10 and 0:59, pre-summed before they meet the state
    assert closed() == {(0, "a"): 3, (1, "a"): 2, (1, "b"): 2}
    assert reports[-1]["rows"] == 1  # only the window of 3:20 is still held


def test_a_run_without_new_input_changes_nothing(stream, spark):
    arrive, closed = stream
    arrive("one", [at(5), at(300)])
    before = closed()
    for _ in range(2):
        arrive(None, [])
    assert closed() == before == {(0, "a"): 1}


def test_batches_of_files_give_what_one_batch_does(stream, tmp_path):
    arrive, closed = stream
    rows = [[at(60 * h + m) for m in (1, 30, 59)] for h in range(6)]
    for k, part in enumerate(rows):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in part))
    arrive(None, [], files=1)
    assert closed() == {(h, "a"): 3 for h in range(5)}


def test_a_failed_call_may_be_made_again(stream, tmp_path):
    arrive, closed = stream
    arrive("one", [at(5)])
    (tmp_path / "in" / "bad.json").write_text('{"ts": "2024-05-01T00:10:00", "kind": "a"}\n')
    (tmp_path / "out" / "_spark_metadata").rename(tmp_path / "hidden")
    (tmp_path / "out" / "_spark_metadata").write_text("not a folder")
    with pytest.raises(Exception):
        arrive("two", [at(400)])
    (tmp_path / "out" / "_spark_metadata").unlink()
    (tmp_path / "hidden").rename(tmp_path / "out" / "_spark_metadata")
    arrive(None, [])
    assert closed() == {(0, "a"): 2}


def test_stream_and_table_count_alike(spark, tmp_path):
    rows = [(START + timedelta(minutes=7 * i), "ab"[i % 2]) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.repartition(3).write.parquet(f"{tmp_path}/in")
    S.resume_counts(spark, f"{tmp_path}/in", frame.schema, f"{tmp_path}/out", f"{tmp_path}/c", "ts", "kind", "0 seconds", "1 hour")
    want = {tuple(r) for r in S.counts_by_window(frame, "ts", "kind").collect()}
    last = max(t for t, _ in rows)
    found = {tuple(r) for r in S.seen_windows(spark, f"{tmp_path}/out", "kind").collect()}
    assert found == {w for w in want if w[0] + timedelta(hours=1) <= last}
    assert sum(Counter(w[1] for w in want).values()) == len(want)
