import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corvane.llm import suffix


def brute_force(texts, length):
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_block_repeats_equal_counts():
    rng = random.Random(2)
    for trial in range(60):
        length = rng.choice([3, 8, 20])
        alphabet = bytes(rng.sample(range(256), rng.choice([1, 2, 4, 30])))
        base = bytes(rng.choice(alphabet) for _ in range(200))
        stretches = list({bytes(base[(a := rng.randrange(150)) : a + rng.randint(length, length + 40)]) for _ in range(rng.randint(1, 12))})
        stretches = [s for s in stretches if len(s) >= length] or [base]
        count = Counter(s[i : i + length] for s in stretches for i in range(len(s) - length + 1))
        owner, place, class_, members = suffix.block_repeats(stretches, length)
        seen = {}
        assert len(owner) == sum(len(s) - length + 1 for s in stretches)
        for o, p, c, m in zip(owner, place, class_, members):
            string = stretches[o][p : p + length]
            assert m == count[string] and seen.setdefault(c, string) == string


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(4)
    passage = bytes(rng.randrange(256) for _ in range(90))
    for length, gram in ((30, 8), (30, 30)):
        finder = suffix.Anchors(length, gram)
        found = []
        for _ in range(4):
            before = bytes(rng.randrange(256) for _ in range(rng.randint(0, 50)))
            text = np.frombuffer(before + passage + b"end", np.uint8)
            doc, lo, hi, anchor, hashes = finder.of(text, np.array([0]), np.array([len(text)]))
            of = {p: (a - p, h) for s, e, a, h in zip(lo, hi, anchor, hashes) for p in range(s, e + 1)}
            assert sorted(of) == list(range(len(text) - length + 1))
            found.append([of[len(before) + k] for k in range(len(passage) - length + 1)])
        assert all(f == found[0] for f in found)


def test_anchors_of_long_texts_in_portions(monkeypatch):
    rng = random.Random(6)
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in (5, 60, 700, 29, 30, 31)]
    finder = suffix.Anchors(30, 8)

    def anchors():
        out = {}
        for held, offsets, parts in suffix.portions(texts, 30):
            ends = np.cumsum([len(p) for p in parts])
            starts = ends - [len(p) for p in parts]
            for d, s, e, a, h in zip(*finder.of(np.frombuffer(b"".join(parts), np.uint8), starts, ends)):
                out.update({(held[d], p - starts[d] + offsets[d]): (a - starts[d] + offsets[d], h) for p in range(s, e + 1)})
        return out

    whole = anchors()
    assert len(whole) == sum(max(0, len(t) - 29) for t in texts)
    monkeypatch.setattr(suffix, "PORTION", 90)
    assert anchors() == whole


@pytest.mark.parametrize(("length", "gram", "split"), [(200, 48, 3000), (40, 12, 2), (60, 60, 3000)])
def test_removal_of_documents(spark, docs, corpus, monkeypatch, length, gram, split):
    monkeypatch.setattr(suffix, "SPLIT", split)
    got = sorted(map(tuple, suffix.removal(docs, length, gram).collect()))
    assert got == [(i, *w) for i, w in enumerate(brute_force([r[1] for r in corpus], length))]


def test_texts_without_repeats(spark, docs, corpus):
    kept = suffix.without_repeats(docs, 60, 20)
    assert kept.columns == docs.columns
    got = {r.doc_id: r for r in kept.collect()}
    for (i, text, *_), (n, removed, _, digest) in zip(corpus, brute_force([r[1] for r in corpus], 60)):
        if not removed:
            assert got[i].text == text
        elif text.isascii():
            assert hashlib.sha256(got[i].text.encode()).hexdigest() == digest
        assert text is None or got[i].n_chars == len(got[i].text)


def test_nothing(spark, no_docs):
    assert suffix.removal(no_docs).collect() == []
    assert suffix.without_repeats(no_docs).collect() == []
    same = spark.createDataFrame([(None, "é" * 150), (None, "é" * 150), (3, None)], "doc_id long, text string")
    assert sorted((r.n_removed, r.n_spans) for r in suffix.removal(same).collect()) == [(0, 0), (300, 1), (300, 1)]


@pytest.mark.parametrize("unlike", [True, False])
def test_many_stretches_around_one_gram(spark, unlike, monkeypatch):
    monkeypatch.setattr(suffix, "SPLIT", 100)
    rng = random.Random(8)
    gram, letters = "the one line that all of these texts have in common", "abcdefghijklmnopqrstuvwxyz"
    prose = lambda n: "".join(rng.choices(letters, k=n))
    ends = [prose(300) for _ in range(1500 if unlike else 3)]
    texts = [prose(rng.randrange(200)) + gram + end for end in ends] if unlike else [prose(rng.randrange(80, 200)) + gram + rng.choice(ends) for _ in range(1500)]
    texts += [prose(50) + t[30:-20] for t in texts[:40]]  # repeats that begin and end at odd places
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, suffix.removal(docs).collect()))
    assert got == [(i, *w) for i, w in enumerate(brute_force(texts, 200))]


def test_parts_of_a_key_hold_each_string_once():
    rng = random.Random(3)
    text = bytes(rng.randrange(256) for _ in range(500))
    hits = [{"anchor": 5, "place": 240, "lo": 240 - 152, "hi": 240, "left": 0, "right": 48}]
    whole = []
    for _ in range(8):
        finer = [part for h in hits for part in suffix.parted(text, h, 200)]
        assert sorted(p for h in whole + finer for p in range(h["lo"], h["hi"] + 1)) == list(range(240 - 152, 241))
        for h in finer:
            assert h["hi"] <= h["place"] - h["left"] and h["lo"] + 200 >= h["place"] + h["right"]
        assert len({h["anchor"] for h in finer}) == len(finer)
        hits = [h for h in finer if h["left"] + h["right"] < 200]
        whole += [h for h in finer if h not in hits]
    assert not hits


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "key", "hash", "copy", "left", "_key", "_hash", "_left", "_copy", "row", "a.b"]
    rows = [(i, f"{i} " * 40 + "the same words at the end of each " * 8, *range(10)) for i in range(3)] + [(7, "alone", *range(10))]
    got = sorted(map(tuple, suffix.without_repeats(spark.createDataFrame(rows, names), 60, 20).collect()))
    assert [r[2:] for r in got] == [tuple(range(10))] * 4 and got[3] == rows[3] and all(len(r[1]) < 100 for r in got[:3])
