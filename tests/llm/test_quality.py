import re
from collections import Counter

from pyspark.sql import functions as F

from corvane.llm import quality

SPACE = r"[\x20\x09-\x0D]"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def normal(line):
    line = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return re.sub(SPACE + "+", " ", re.sub("[1-9]", "0", line)).strip(" ")


def slow(rows, min_docs, min_share, left_share, copies=True):
    lines = {i: [x for x in (t or "").split("\n") if words(x)] for i, t, *_ in rows}
    texts = {}
    for i, t, _, source, *_ in rows:
        texts.setdefault(source, {})[i if copies else t or ""] = t or ""
    counts = Counter((source, n) for source, of in texts.items() for t in of.values() for n in {normal(x) for x in t.split("\n") if words(x)})
    out = {}
    for i, t, _, source, *_ in rows:
        w = words(t)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        many = Counter(windows)
        repeated = len({p for k, x in enumerate(windows) if many[x] > 1 for p in range(k, k + 8)})
        left = sum(len(words(x)) for x in lines[i] if not (counts[source, normal(x)] > min_docs and counts[source, normal(x)] > min_share * len(texts[source])))
        failed = len(w) < 20 or 100 * repeated > 30 * len(w)
        out[i] = (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines[i]) - len(set(lines[i])), repeated, failed, not failed and left >= left_share * len(w), left)
    return out


def documents():
    import random

    rng = random.Random(1)
    head, foot = "Cookie notice 123: accept all of our many cookies now please", "All   rights reserved\t2024"
    rows = []
    for i in range(90):
        own = "\n".join(" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(3, 15))) for _ in range(rng.randint(1, 5)))
        text = {0: f"{head}\n{own}\n{foot}", 1: own, 2: f"{head.replace('123', '789')}\n{foot.upper()}\nshort tail of text"}[i % 3]
        rows.append((i, text, "en", "h1" if i % 2 else None, 1, "x"))
    rows += [(90, rows[4][1], "en", "h1", 1, "x"), (91, None, "en", "h1", 1, "x"), (92, "", None, None, 0, "x"), (93, "a b c d e f g h " * 20 + "# * <x>", "en", "h1", 1, "x"), (94, "line one here\nline one here\n \nline", "en", "h1", 1, "x")]
    rows.append((95, " ".join(f"z{k % 700}" for k in range(5000)), "en", "h1", 1, "x"))
    return rows


def test_rules_against_slow_counts(spark, monkeypatch, corpus):
    monkeypatch.setattr(quality, "MIN_DOCS", 5)
    for rows in (documents(), corpus):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").repartition(3)
        measured = quality.measured(docs)
        got = quality.judged(measured, quality.common_lines(measured, 5, 0.02)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")
        want = slow(rows, 5, 0.02, quality.LEFT_SHARE)
        assert sorted(map(tuple, got.collect())) == sorted(want.values())


def test_clean_documents_stay(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string")
    kept = quality.clean(docs)
    assert kept.columns == docs.columns
    want = {i: r for i, r in slow(rows, quality.MIN_DOCS, quality.MIN_SHARE, quality.LEFT_SHARE, copies=False).items() if r[7]}
    got = {r.doc_id: r for r in kept.collect()}
    assert sorted(got) == sorted(want)
    for i, r in got.items():
        assert len(words(r.text)) == want[i][8] and r.n_chars == len(r.text)
        assert want[i][8] < want[i][1] or r.text == rows[i][1]


def test_nothing_and_repeated_rows(spark, no_docs):
    assert quality.line_frequency_rules(no_docs).collect() == []
    assert quality.clean(no_docs).collect() == []
    text = " ".join(f"w{i}" for i in range(40))
    twice = spark.createDataFrame([(None, text, None)] * 2, "doc_id long, text string, source string")
    assert [r.kept for r in quality.line_frequency_rules(twice).collect()] == [True, True]
    assert quality.clean(twice).count() == 2


def test_copies_of_one_text(spark):
    text = "\n".join(" ".join(f"w{i}x{k}" for i in range(9)) for k in range(4))
    rows = [(i, text, "h") for i in range(40)] + [(100 + i, text.replace("w", "v" + chr(97 + i % 26) + chr(97 + i // 26)), "h") for i in range(60)] + [(0, text, "h")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.line_frequency_rules(docs).collect()}
    assert all(kept[i] == (i >= 100) for i in kept)
    assert quality.clean(docs).count() == len(rows) and quality.clean(docs, copies=True).count() == 60
    repeated = docs.where("doc_id in (0) or doc_id >= 100")  # one document, many rows
    assert all(r.kept for r in quality.line_frequency_rules(repeated).collect())


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "source", "host", "hash", "common", "_s", "_t", "_common", "row", "left", "text_hash", "a.b"]
    rows = [(i, " ".join(f"w{i}n{k}" for k in range(30)), "h", *range(10)) for i in range(4)]
    kept = quality.clean(spark.createDataFrame(rows, names))
    assert kept.columns == names and sorted(map(tuple, kept.collect())) == rows


def test_no_python_on_the_main_path(spark, docs):
    rows = quality.measured(docs)
    plan = quality.judged(rows, quality.common_lines(rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lines_are_cut_where_they_are(spark):
    cases = [("a\n\nb\n \nc", [0], "\n\nb\n \nc"), ("a\n\nb\n \nc", [1], "a\n\n \nc"), ("a\nb\nc", [0, 1, 2], ""), ("a\nb\nc", [2], "a\nb"), ("\n\na\n", [0], "\n\n"), ("a\nb", [], "a\nb"), ("a", [0], "")]
    frame = spark.createDataFrame([(t, p) for t, p, _ in cases], "t string, p array<int>")
    got = [r.x for r in frame.select(quality.without_lines(F.col("t"), F.col("p")).alias("x")).collect()]

    def slow(text, places):
        worded = [i for i, x in enumerate(text.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in {worded[p] for p in places})

    assert got == [slow(t, p) for t, p, _ in cases] and got[1:4] == [c[2] for c in cases[1:4]]


def test_texts_of_many_common_lines_take_linear_time(spark, tmp_path):
    import time

    def took(n):
        lines = [f"line number {chr(97 + i % 26)} {'x' * (i // 26 % 40)} {'y' * (i // 1040)} is here" for i in range(n)]
        rows = [(i, "\n".join([*lines, f"own words of document {'z' * i} and nothing else"]), "s") for i in range(24)]
        path = f"{tmp_path}/{n}-{time.monotonic_ns()}"
        spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(path)
        docs = spark.read.parquet(path)
        began = time.perf_counter()
        found = quality.line_frequency_rules(docs).collect()
        assert len(found) == 24 and all(r.words_left in (7, 8) and not r.kept for r in found)
        return time.perf_counter() - began

    took(1000)
    assert took(16_000) < 3 * took(8_000) + 2
