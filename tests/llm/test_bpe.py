import hashlib
import random
import shutil

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from corvane.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_equal_to_the_library_on_odd_texts(corpus):
    mine, theirs = bpe.ForcedBoundaryBpe(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(8)
    pieces = [*"abàé '\n\t.,!　\xa0\x85\x1c中12\r", "  ", "'s", "'re", "<|endoftext|>", " \n", "　 \n\n", "à la", "\U0001f600", "\U0001f600 x"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [r[1] or "" for r in corpus]
    for text, got in zip(texts, mine.encode_many(texts)):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, mine.dtype).tolist() == ids, text
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False) == text


def test_small_caches_change_nothing(corpus):
    texts = [r[1] for r in corpus] * 2
    whole, small = bpe.ForcedBoundaryBpe(PATH), bpe.ForcedBoundaryBpe(PATH, cache_entries=20, cache_key_chars=4)
    assert list(whole.encode_many(texts)) == list(small.encode_many(texts))


def test_a_fragment_is_looked_up_once_for_all_texts_that_repeat_it():
    class Counted(dict):
        n = 0

        def __getitem__(self, key):
            Counted.n += 1
            return super().__getitem__(key)

    mine = bpe.ForcedBoundaryBpe(PATH)
    mine.known = Counted()
    texts = ["the cat, the dog. " * 500, "", None, "the cat", ".", "dog"]
    assert [np.frombuffer(x, mine.dtype).tolist() for x in mine.encode_many(texts)] == [library(t) for t in texts]
    assert Counted.n < 20


def test_no_fragment_goes_beyond_its_text():
    mine = bpe.ForcedBoundaryBpe(PATH)
    for texts in (["ab", "cd."], [" ", "x.", "", "y"], ["", None], ["é", " ", ".", "\u3000", " a"], ["a\xd7b.", "<|endof", "text|>"], ["don", "'t."], []):
        assert [np.frombuffer(x, mine.dtype).tolist() for x in mine.encode_many(texts)] == [library(t) for t in texts], texts


def test_pairs_that_no_token_holds():
    never = bpe.ForcedBoundaryBpe.pairs_never_inside([b"ab", b"bcd", b"x"])
    assert not never[ord("a"), ord("b")] and not never[ord("c"), ord("d")] and never[ord("a"), ord("c")] and never.sum() == 65536 - 3
    assert bpe.ForcedBoundaryBpe(PATH).never[ord("a"), ord(" ")]


def test_round_trip_of_documents(spark, docs, corpus, no_docs):
    want = []
    for i, text, *_ in corpus:
        ids = library(text)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs, PATH).collect())) == want
    assert bpe.round_trip(no_docs, PATH).collect() == []


def test_columns_of_ids(spark, docs, corpus, no_docs):
    coded = bpe.encode_documents(docs.withColumnRenamed("extra", "ids"), PATH)
    assert coded.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"]
    back = {r.doc_id: r for r in bpe.decode_documents(coded.drop("text"), PATH).collect()}
    assert all(back[r[0]].text == (r[1] or "") and back[r[0]].ids == library(r[1]) for r in corpus)
    assert bpe.encode_documents(no_docs, PATH).collect() == []


def test_clashing_and_odd_names(spark):
    frame = spark.createDataFrame([("a b", 1, 2, 3), (None, 4, 5, 6)], "text string, IDS int, `a``b` int, `x.y` int")
    coded = bpe.encode_documents(frame, PATH)
    assert coded.columns == ["text", "a`b", "x.y", "ids"]
    assert sorted((r["a`b"], r["x.y"], r.ids) for r in coded.collect()) == [(2, 3, library("a b")), (5, 6, [])]
    back = bpe.decode_documents(coded.withColumnRenamed("text", "TEXT"), PATH)
    assert back.columns == ["a`b", "x.y", "ids", "text"] and sorted(r.text for r in back.collect()) == ["", "a b"]


def test_a_worker_holds_no_fragments_after_its_task(spark, monkeypatch, tmp_path):
    path = str(shutil.copy(PATH, tmp_path))  # an encoder that no other test has filled

    def held(batches):
        from corvane.llm.bpe import loaded

        for batch in batches:
            bpe = loaded(path)
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.known) + len(bpe.older)] * batch.num_rows, pa.int64())], names=["held"])

    texts = [None, "", *(f"word{i} other{i}" for i in range(400))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.ids for r in bpe.encode_documents(frame, path).collect()}
    assert [row.held for row in spark.range(64, numPartitions=16).mapInArrow(held, "held long").collect()] == [0] * 64
    encoder = bpe.ForcedBoundaryBpe(PATH)
    assert [got[i] for i in range(len(texts))] == [encoder.encode(t).tolist() for t in texts]
    monkeypatch.setattr(bpe, "LIST_PORTION", 100)
    arrays = list(encoder.encode_lists(pa.array(texts, pa.string())))
    assert len(arrays) > 1 and [x for a in arrays for x in a.to_pylist()] == [got[i] for i in range(len(texts))]
    assert [a.to_pylist() for a in encoder.encode_lists(pa.array([], pa.string()))] == [[]]
