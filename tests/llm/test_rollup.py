from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvane.llm import rollup
from corvane.llm.common import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


def changes(spark, rows):
    return spark.createDataFrame(rows, rollup.CHANGE)


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens, r.changes) for r in store.totals().collect()}


def test_batches_add_up_and_replays_change_nothing(spark):
    store = rollup.RollupStore(spark, shared_dir(spark))
    assert totals(store) == {}
    first = changes(spark, [("a", "en", "t", "insert", None, 10), ("a", "en", "t", "insert", 99, 5), (None, "en", "t", "insert", None, 3), ("b", None, "t", "insert", None, None)])
    second = changes(spark, [("a", "en", "t", "revise", 10, 7), ("a", "en", "t", "delete", 5, 1)])
    assert store.commit(1, first) and store.commit(2, second) and not store.commit(2, second) and not store.commit(1, first)
    want = {("a", "en", "t"): (1, 7, 4), (None, "en", "t"): (1, 3, 1), ("b", None, "t"): (1, 0, 1)}
    assert totals(store) == want
    store.compact()
    assert totals(store) == want and not store.commit(1, first) and store.committed() == [1, 2]
    assert store.commit(3, changes(spark, [("a", "en", "t2", "insert", None, 4)]))
    assert totals(store) == want | {("a", "en", "t2"): (1, 4, 1)}
    again = rollup.RollupStore(spark, store.path)
    assert totals(again) == totals(store)


def test_late_batches_count_once(spark):
    store = rollup.RollupStore(spark, shared_dir(spark))
    one = lambda n: changes(spark, [("a", "en", "t", "insert", None, n)])
    assert store.commit(2, one(10)) and store.commit(7, one(20))
    store.compact()
    assert store.commit(1, one(3)) and not store.commit(7, one(99)) and store.committed() == [1, 2, 7]
    assert totals(store) == {("a", "en", "t"): (3, 33, 3)}
    store.compact()
    assert not store.commit(1, one(99)) and store.commit(5, one(4)) and store.committed() == [1, 2, 5, 7]
    assert totals(store) == {("a", "en", "t"): (4, 37, 4)}
    with pytest.raises(ValueError):
        store.commit(-1, one(1))


def test_a_batch_that_broke_off_is_not_counted(spark):
    store = rollup.RollupStore(spark, shared_dir(spark))
    with pytest.raises(Exception, match="unknown op"):
        store.commit(1, changes(spark, [("a", "en", "t", "insert", None, 1), ("a", "en", "t", "odd", None, 1)]))
    assert store.committed() == [] and totals(store) == {}
    assert store.commit(1, changes(spark, [("a", "en", "t", "insert", None, 1)])) and totals(store) == {("a", "en", "t"): (1, 1, 1)}


def test_counts_of_documents(spark, docs, corpus, no_docs):
    theirs = Tokenizer.from_file(PATH)
    want = Counter()
    for _, text, _, source, *_ in corpus:
        want[source] += len(theirs.encode(text or "", add_special_tokens=False).ids)
    got = Counter()
    for r in rollup.token_counts(docs, PATH).collect():
        got[r.source] += r.n_tokens
    assert got == want
    assert rollup.token_counts(no_docs, PATH).collect() == []


def test_query_counts_each_document_once(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("source", "lang", "text").collect()
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.op9_token_rollup(spark, sf).collect()}
    theirs, want = Tokenizer.from_file(PATH), {}
    for r in rows:
        text = r.text or ""
        kept = "\n".join(dict.fromkeys(text.split("\n")))
        short = len(kept.split()) < rollup.SHORT
        for name, n in (("byte_bpe_50k", len(theirs.encode(kept, add_special_tokens=False).ids)), ("words-1", len(kept.split()))):
            d, t = want.get((r.source, r.lang, name), (0, 0))
            want[r.source, r.lang, name] = (d + (not short), t + (0 if short else n))
    assert any(len((r.text or "").split()) in range(1, rollup.SHORT) for r in rows)
    assert got == want
