import re
import time

import numpy as np
import xxhash

from corvane.llm import simhash
from corvane.llm.graph import components


def slow_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_near(text, k=5):
    """Both halves of a text's fingerprint."""
    hashes = np.array(simhash.shingle_hashes(simhash.words_of(text), k), dtype=np.uint64)
    other = [int(h) for h in simhash.other_bits(hashes)]
    return slow_print(text, k), sum(1 << b for b in range(64) if other and 2 * sum(h >> b & 1 for h in other) > len(other))


def near(x, y, radius=10):
    return any((a ^ b).bit_count() <= radius for a, b in zip(x, y))


def slow_components(prints, linked):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_components_of_documents(spark, docs, corpus):
    prints = [slow_print(r[1]) for r in corpus]
    roots = slow_components(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    want = sorted((i, f"{p:016x}", r) for i, (p, r) in enumerate(zip(prints, roots)))
    assert sorted(map(tuple, simhash.simhash_components(docs).collect())) == want


def test_links_reach_all_within_radius(spark):
    import random

    rng = random.Random(3)
    codes = [0, (1 << 64) - 1]
    for _ in range(12):
        code = rng.getrandbits(64)
        codes.append(code)
        for _ in range(25):
            code ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6)))
            codes.append(code)
    codes = sorted(set(codes))
    for radius, limit in ((4, 40_000), (10, 40_000), (4, 8)):
        before, simhash.GROUP = simhash.GROUP, limit
        try:
            frame = spark.createDataFrame([(simhash.signed(c),) for c in codes], "fingerprint long")
            edges = simhash.links(frame, radius)
            stars = dict(map(tuple, components(edges.select("a", "b")).collect()))
            assert all(((a ^ b) & ((1 << 64) - 1)).bit_count() == n <= radius for a, b, n in edges.collect())
        finally:
            simhash.GROUP = before
        mine = [stars.get(simhash.signed(c), simhash.signed(c)) for c in codes]
        slow = slow_components(codes, lambda i, j: (codes[i] ^ codes[j]).bit_count() <= radius)
        assert len(set(zip(mine, slow))) == len(set(mine)) == len(set(slow))


def test_pairs_of_large_groups_cost_little_more_than_their_count():
    rng = np.random.default_rng(5)
    sizes = np.array([3000, 1, 9, 500])
    group = np.repeat(np.arange(len(sizes)), sizes)
    codes = rng.integers(0, 1 << 64, size=len(group), dtype=np.uint64)
    codes[1::3] = codes[: len(codes[1::3])] ^ np.uint64(0b10010000001)
    codes = codes[np.lexsort((simhash.gray_rank(codes), group))]

    def plain():
        found = set()
        for i in range(len(codes)):
            bits = np.bitwise_count(codes[i + 1 :] ^ codes[i])
            near = np.flatnonzero((bits <= 10) & (group[i + 1 :] == group[i]))
            found |= {(i, int(j) + i + 1, int(bits[j])) for j in near}
        return found

    def indexed():
        return {x for a, b, d in simhash.close_pairs(codes, sizes, 10) for x in zip(a.tolist(), b.tolist(), d.tolist())}

    def least_time(f):
        times = []
        for _ in range(3):
            began = time.process_time()
            f()
            times.append(time.process_time() - began)
        return min(times)

    assert indexed() == plain() and len(plain()) > 500
    assert least_time(indexed) < 3 * least_time(plain)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    found = dict(map(tuple, components(edges).collect()))
    assert found == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_near_dedup_keeps_one_of_each_group(spark, docs, corpus):
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    sets = [set(simhash.shingle_hashes(simhash.words_of(r[1]), 5)) for r in corpus]
    prints = [slow_near(r[1]) for r in corpus]
    close = lambda i, j: not sets[i] | sets[j] or near(prints[i], prints[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert ids == sorted(set(slow_components(prints, close)))
    again = docs.unionByName(docs.where("doc_id < 9"))
    assert sorted(r.doc_id for r in simhash.near_dedup(again).collect()) == ids


def test_copies_that_only_resemble_their_base(spark, monkeypatch):
    import random

    rng = random.Random(11)
    texts = []
    for _ in range(4):
        base = [f"w{rng.randrange(9000)}" for _ in range(400)]
        for _ in range(40):
            words = list(base)
            for at in rng.sample(range(6, 394, 9), rng.choice([6, 7, 8])):
                words[at] = f"x{rng.randrange(10**9)}"
            texts.append(" ".join(words))
        texts.append(" ".join(base))
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = [set(simhash.shingle_hashes(simhash.words_of(t), 5)) for t in texts]
    prints = [slow_near(t) for t in texts]
    want = sorted(set(slow_components(prints, lambda i, j: near(prints[i], prints[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (1000, 9):
        monkeypatch.setattr(simhash, "TILE", tile, raising=False)
        assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == want


def test_texts_of_one_fingerprint_are_checked_too(spark):
    phrase = "one phrase of seven words in all "
    texts = [" ".join(phrase + " ".join(f"t{t}n{i}w{w}" for w in range(10)) for i in range(500)) for t in range(3)]
    texts.append(texts[1].upper().replace(" ", "\n"))
    assert len({slow_print(t, 5) for t in texts}) == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.near_dedup(docs).collect()) == [0, 1, 2]


def test_nothing_and_null_ids(spark, no_docs, docs):
    assert simhash.simhash_components(no_docs).collect() == []
    assert simhash.near_dedup(no_docs).collect() == []
    odd = spark.createDataFrame([(None, "one two"), (None, "one two"), (7, "one two"), (None, "three")], "doc_id long, text string")
    assert sorted(map(str, (r.component_id for r in simhash.simhash_components(odd).collect()))) == ["7", "7", "7", "None"]


def test_a_true_pair_is_not_lost_between_two_that_fail(spark):
    """A and B are 0.8 similar; C is nearer to both in bits, and similar to neither."""
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(30):
        base = [f"w{n}" for n in rng.integers(0, 10**6, 300)]
        near_one = list(base)
        for at in rng.choice(np.arange(10, 290, 12), 6, replace=False):
            near_one[at] = f"x{rng.integers(10**9)}"
        between = base * 2 + [f"y{n}" for n in rng.integers(0, 10**6, 160)]
        texts += [" ".join(w) for w in (base, near_one, between)]
    sets = [set(simhash.shingle_hashes(simhash.words_of(t), 5)) for t in texts]
    true = [(i, i + 1) for i in range(0, len(texts), 3) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) and near(slow_near(texts[i]), slow_near(texts[i + 1]))]
    prints = [slow_print(t, 5) for t in texts]
    assert len(true) > 20 and any(max((prints[i] ^ prints[i + 2]).bit_count(), (prints[j] ^ prints[i + 2]).bit_count()) <= (prints[i] ^ prints[j]).bit_count() for i, j in true)
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(i in kept and j not in kept and i + 2 in kept for i, j in true)


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "class", "first", "second", "root", "row", "id", "_d", "_t", "text_hash", "a.b"]
    rows = [(1, "one two three four five six", *range(10)), (2, "one two three four five six", *range(10)), (3, "seven", *range(10))]
    docs = spark.createDataFrame(rows, names)
    assert sorted(map(tuple, simhash.near_dedup(docs).collect())) == [rows[0], rows[2]] and simhash.near_dedup(docs).columns == names
