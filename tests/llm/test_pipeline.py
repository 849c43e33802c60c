import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_every_stage_takes_effect(spark, tmp_path):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bcdfghk" for b in "aeiou" for c in "lmnrst"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(n))
    passage = prose(60)
    rows = [(i, prose(80), "en", f"src{i % 3}", 1) for i in range(30)]
    rows += [(100, rows[3][1], "en", "src0", 1), (101, rows[4][1].replace(" ", " ", 1) + " end", "en", "src1", 1), (102, "too short", "en", "src1", 1), (103, None, "en", "src1", 1)]
    rows += [(200 + i, prose(60) + " " + passage + " " + prose(60), "en", "src2", 1) for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == before
    ids = lambda name: sorted(r.doc_id for r in seen[name])
    assert ids("quality_rules") == sorted({r[0] for r in rows} - {102, 103})
    assert ids("near_duplicates") == sorted({r[0] for r in rows} - {100, 101, 102, 103})
    cleaned = {r.doc_id: r.text for r in seen["repeated_passages"]}
    assert sorted(cleaned) == ids("near_duplicates")
    assert all(passage[5:-5] not in t for t in cleaned.values()) and all(cleaned[i] == t for i, t, *_ in rows[:30])
    assert all(len(cleaned[200 + i].split()) >= 118 for i in range(4))
    copies = Counter(ids("source_mixture"))
    assert max(copies.values()) <= 3 and sum(copies.values()) == len(seen["token_ids"])
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(r.ids == theirs.encode(cleaned[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in seen["token_ids"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.select("doc_id", "n_tokens").collect())) == sorted((r.doc_id, r.n_tokens) for r in seen["token_ids"])


def through(spark, rows, schema, path):
    """Rows after each stage; every stage is written and read again."""
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen.append(docs)
    return seen


def test_an_empty_table_goes_through(spark, tmp_path):
    seen = through(spark, [], "doc_id long, text string, lang string, source string, n_chars long", str(tmp_path))
    assert [d.count() for d in seen] == [0] * 5


def test_odd_rows_and_names_go_through(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghiklmnopr") for _ in range(rng.randint(3, 9))) for _ in range(n))
    long, copied, passage = prose(200_000), prose(60), prose(60)
    texts = [(None, prose(50)), (1, long), (2, copied), (2, copied), (3, copied), (4, None), (5, ""), (6, prose(45)), (None, prose(55)), (7, f"{prose(40)} {passage} {prose(40)}"), (8, f"{passage} {prose(90)}")]
    rows = [(i, t, "en", None if k % 3 == 0 else "s", None, "x", k) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, IDS string, `a``b` int"
    seen = through(spark, rows, schema, str(tmp_path))
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars", "IDS", "a`b"] for d in seen[:-1])
    kept = [r.doc_id for r in seen[1].collect()]
    assert Counter(i if i not in (2, 3) else "copy" for i in kept) == Counter({None: 2, 1: 1, "copy": 1, 6: 1, 7: 1, 8: 1})
    cut = {r.doc_id: r for r in seen[2].where("doc_id is not null").collect()}
    assert cut[1].text == long and cut[1].n_chars in (None, len(long)) and passage[5:-5] not in cut[7].text + cut[8].text
    last = seen[-1].collect()
    assert {r.doc_id for r in last} <= {None, 1, 2, 3, 6, 7, 8} and all(r.n_tokens == len(r.ids) > 0 for r in last)


def test_a_document_of_repeats_only_goes(spark, tmp_path):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghiklmnopr") for _ in range(rng.randint(3, 9))) for _ in range(n))
    one, other = prose(80), prose(80)
    rows = [(1, f"{one} {other}", "en", "s", 1), (2, f"{prose(60)} {one}", "en", "s", 1), (3, f"{other} {prose(60)}", "en", "s", 1), (4, prose(80), "en", "s", 1)]
    seen = through(spark, rows, "doc_id long, text string, lang string, source string, n_chars long", str(tmp_path))
    assert sorted(r.doc_id for r in seen[1].collect()) == [1, 2, 3, 4]
    left = {r.doc_id: r.text for r in seen[2].collect()}
    assert set(left) >= {2, 3, 4} and all(t.strip() for t in left.values())
