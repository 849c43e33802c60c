from collections import Counter

from corvane.llm import mixing


def slow_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed, free = float(sum(sizes.values())), {}, set(order)
    while True:
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return fixed | share
        for s in above:
            fixed[s] = most * sizes[s]
            free.discard(s)
        if not free:
            return fixed


def test_targets_and_copies(spark, docs, corpus):
    rows = docs.unionByName(spark.createDataFrame([(1000 + i, "w " * (i % 50), "en", None if i % 3 else "small", 1, "x") for i in range(400)], docs.schema))
    got = mixing.systematic_copies(rows).collect()
    assert len(got) == rows.count()
    sizes = Counter()
    for r in got:
        assert r.size == len((r.row.text or "").encode().split())
        sizes[r.row.source] += r.size
    targets, taken = slow_targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.row.source] and abs(r.target - targets[r.row.source]) < 1e-6 * max(1, targets[r.row.source])
        assert 0 <= r.copies <= 3
        taken[r.row.source] += r.copies * r.size
    assert all(abs(taken[s] - targets[s]) <= 0.1 * targets[s] + 3 * max(r.size for r in got if r.row.source == s) for s in sizes)
    again = {(r.row.doc_id, r.row.text): r.copies for r in mixing.systematic_copies(rows.repartition(7)).collect()}
    assert again == {(r.row.doc_id, r.row.text): r.copies for r in got}


def test_mixture_repeats_rows(spark, docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter({r.row.doc_id: r.copies for r in mixing.systematic_copies(docs).collect() if r.copies})


def test_nothing_empty_sources_and_ties(spark, no_docs):
    assert mixing.mix(no_docs).collect() == []
    odd = spark.createDataFrame([(1, "", "a"), (1, "", "a"), (None, None, None), (2, "x y", "b"), (2, "x y", "b")], "doc_id long, text string, source string")
    got = mixing.systematic_copies(odd).collect()
    assert len(got) == 5 and sum(r.copies for r in got if r.row.source != "b") == 0
    assert [r.target for r in got if r.row.source == "b"] == [4.0, 4.0]


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "source", "_size", "size", "hash", "none", "bucket", "rank", "copies", "target", "row", "a.b"]
    rows = [(i, "w " * (i + 1), "ab"[i % 2], 1000, *range(9)) for i in range(20)]
    docs = spark.createDataFrame(rows, names)
    plain = docs.select("doc_id", "text", "source")
    assert mixing.mix(docs).columns == names
    assert Counter(tuple(r[:3]) for r in mixing.mix(docs).collect()) == Counter(map(tuple, mixing.mix(plain).collect()))
    assert {r.row.doc_id: (r.size, r.target) for r in mixing.systematic_copies(docs).collect()} == {r.row.doc_id: (r.size, r.target) for r in mixing.systematic_copies(plain).collect()}
