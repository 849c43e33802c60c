import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from corvane.llm import lattice

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def all_divisions(word, scores):
    """Sum over divisions, by plain recursion on prefixes."""
    sums = [1.0]
    for end in range(1, len(word) + 1):
        sums.append(sum(sums[a] * scores[word[a:end]] for a in range(end) if word[a:end] in scores))
    return sums[-1]


def test_forward_recursion_sums_all_divisions():
    pieces = [b" a", b" ", b"a", b"b", b"ab", b"ba", b" ab", b"b", None, b"bab", b"\xc3", b"\xa9", b"\xc3\xa9"]
    probs = np.linspace(0.01, 0.1, len(pieces))
    scores = Counter()
    for p, x in zip(pieces, probs):
        if p:
            scores[p] += x
    words = [b"a", b"ab", b"abab", b"babab" * 3, "é".encode(), b"", b"x", b"aaaaaaaaaaaaaaaaaaaaaaaa" * 20, b"ab\xc3\xa9"]
    got = lattice.Lattice(pieces, np.log(probs)).word_log_probs(words)
    for w, g in zip(words, got):
        want = all_divisions(b" " + w, scores)
        if want < 1e-300:  # impossible, or beyond what plain numbers hold
            assert np.isneginf(g) == (w == b"x") and g < -600
        else:
            assert abs(g - math.log(want)) < 1e-9


def mean_counts(count, scores):
    """How often each piece occurs in the words, over all divisions, by plain sums on prefixes and suffixes."""
    out = Counter()
    for w, times in count.items():
        word = b" " + w.encode()
        before = [all_divisions(word[:k], scores) for k in range(len(word) + 1)]
        after = [all_divisions(word[k:], scores) for k in range(len(word) + 1)]
        for a in range(len(word)):
            for b in range(a + 1, len(word) + 1):
                if word[a:b] in scores:
                    out[word[a:b]] += times * before[a] * scores[word[a:b]] * after[b] / before[-1]
    return out


def test_expected_counts_are_means_over_divisions():
    pieces = [b" a", b" ", b"a", b"b", b"ab", b"ba", b" ab", b"bab", b"\xc3", b"\xa9", b"\xc3\xa9"]
    probs = np.linspace(0.01, 0.1, len(pieces))
    words = {"a": 3, "abab": 1, "babab": 7, "é": 2, "": 5}
    got = lattice.Lattice(pieces, np.log(probs)).expected_counts([w.encode() for w in [*words, "x"]], np.array([*words.values(), 9]))
    want = mean_counts(words, dict(zip(pieces, probs)))
    assert np.allclose(got, [want[p] for p in pieces])
    assert abs(sum(g * len(p) for g, p in zip(got, pieces)) - sum(n * (1 + len(w.encode())) for w, n in words.items())) < 1e-9


def brute_force(corpus, rounds):
    train = [r for r in corpus if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    count = Counter(t for r in train for t in [*tokens(r[1]), None])
    n, v = sum(count.values()), len(count)
    sp = lattice.processor(MODEL)
    pieces = lattice.piece_bytes(MODEL)
    used = Counter(pieces[i] for w, c in count.items() if w is not None for i in sp.encode(w) for _ in range(c))
    real = Counter(p for p in pieces if p is not None)
    for step in range(rounds + 1):
        total = sum(used[p] for p in real) + len(train) + sum(real.values()) + 1
        scores = {p: (used[p] + n) / total for p, n in real.items()}
        if step < rounds:
            used = mean_counts({w: c for w, c in count.items() if w is not None}, scores)
    out = []
    for doc_id, text, *_ in corpus:
        ts = [*tokens(text), None]
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts)
        score = math.log10((len(train) + 1) / total) + sum(math.log10(all_divisions(b" " + t.encode(), scores)) for t in ts[:-1] if len(t) < 60)
        out.append((doc_id, zlib.crc32(str(doc_id).encode()) % 7 == 2, len(ts), sum(count[t] > 0 for t in ts), n, base, score if all(t is None or len(t) < 60 for t in ts) else None))
    return out


def test_scores_of_documents(spark, docs, corpus):
    short = [r for r in corpus if all(len(t) < 60 for t in tokens(r[1]))]  # plain sums over a long word's prefixes take too long
    for frequent, rounds in ((lattice.FREQUENT, 0), (10, 0), (lattice.FREQUENT, lattice.ROUNDS)):
        rows, frame = (short, docs.where(F.col("doc_id").isin([r[0] for r in short]))) if rounds else (corpus, docs)
        want = {r[0]: r for r in brute_force(rows, rounds)}
        before, lattice.FREQUENT = lattice.FREQUENT, frequent
        try:
            got = lattice.lattice_scores(frame, MODEL, rounds).collect()
        finally:
            lattice.FREQUENT = before
        assert len(got) == len(rows)
        for r in got:
            w = want[r.doc_id]
            assert tuple(r)[:5] == w[:5]
            assert abs(r.base_score - w[5]) < 1e-6
            assert w[6] is None or abs(r.score - w[6]) < 1e-6, r


def test_rounds_raise_the_likelihood_of_training_text(spark, docs):
    sums = [sum(r.score for r in lattice.lattice_scores(docs, MODEL, rounds).collect() if not r.held_out) for rounds in (0, 2)]
    assert sums[1] > sums[0]


def test_longer_training_text_scores_better(spark, docs, corpus):
    held = [r for r in lattice.lattice_scores(docs, MODEL).collect() if r.held_out and r.n_tokens > 30]
    assert held and all(r.score > -20 * r.n_tokens for r in held)


def test_nothing_nulls_and_long_words(spark, no_docs):
    assert lattice.lattice_scores(no_docs, MODEL).collect() == []
    odd = spark.createDataFrame([(None, None), (None, ""), (1, "x" * 30000), (1, "x" * 30000)], "doc_id long, text string")
    got = sorted(lattice.lattice_scores(odd, MODEL).collect(), key=lambda r: r.n_tokens)
    assert [r.n_tokens for r in got] == [1, 1, 2, 2]
    assert all(math.isfinite(r.score) for r in got) and got[2].score == got[3].score


def test_long_words_are_gone_through_place_by_place(monkeypatch):
    rng = np.random.default_rng(3)
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bca", b"abcab", b" ", b"cc", b"abcabcabcabca"]
    model = lattice.Lattice(pieces, np.log(rng.dirichlet(np.ones(len(pieces)))))
    words = [bytes(rng.choice(list(b"abc"), n)) for n in (1, 2, 3, 30, 200)] + [b"", b"\xff\x00" * 20]
    times = rng.integers(1, 9, len(words))
    scores, counts = model.word_log_probs(words), model.expected_counts(words, times)
    monkeypatch.setattr(lattice, "LONG", 0)
    assert np.allclose(model.word_log_probs(words), scores, rtol=1e-12) and np.allclose(model.expected_counts(words, times), counts, rtol=1e-9, atol=1e-12)
    few = lattice.Lattice([b" a", b"b"], np.log([0.5, 0.5]))
    assert np.isneginf(few.word_log_probs([b"ax"])[0]) and not few.expected_counts([b"ax"], np.array([1])).any()


def test_a_word_of_a_megabyte_takes_seconds():
    import time

    import public_tokenizers

    names = [p for p in dict.fromkeys(lattice.piece_bytes(public_tokenizers.path("piece_bpe_32k.model"))) if p]
    model = lattice.Lattice(names, np.full(len(names), -np.log(len(names))))
    word = bytes(np.random.default_rng(4).choice(list(b"ABCDEFabcdef0123456789+/"), 1 << 20))
    began = time.thread_time()
    assert np.isfinite(model.word_log_probs([word])[0])
    assert time.thread_time() - began < 30
