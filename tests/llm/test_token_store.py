import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvane.llm import token_store
from corvane.llm.common import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 2, 7, 3000, 60000])
@pytest.mark.parametrize("base", [3, 300, 50257, 70000])
def test_any_range_of_a_block(n, base):
    rng = np.random.default_rng(n + base)
    ids = (rng.zipf(1.3, n) % base).astype(np.uint32)
    if n > 10:
        ids[n // 2 :] = ids[: n - n // 2]
    cuts = [0, *sorted(rng.integers(0, n + 1, 3).tolist()), n]
    payload = token_store.pack(ids, [None, 5, 5, -1], np.diff(cuts).tolist(), base, least=2)
    block = token_store.Block(payload)
    assert np.array_equal(block.all_ids(), ids) and block.doc_ids == [None, 5, 5, -1]
    fresh = token_store.Block(payload)
    for k in range(4):
        assert np.array_equal(fresh.document(k), ids[cuts[k] : cuts[k + 1]])
    for _ in range(20):
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert np.array_equal(token_store.Block(payload).ids(a, b), ids[a:b])


def test_rules_shorten_and_name_earlier_symbols():
    ids = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3, 7, 7, 7, 7, 7] * 50, np.uint32)
    seq, rules = token_store.grammar(ids, 10, 2)
    assert len(seq) < len(ids) / 8
    assert all(max(pair) < 10 + r for r, pair in enumerate(rules.tolist()))
    assert token_store.expansion_lengths(rules, 10).min() >= 2


def frequent_pairs(seq, least):
    pairs = np.unique(np.stack([seq[:-1], seq[1:]]), axis=1, return_counts=True)[1]
    return int((pairs >= least).sum())


@pytest.mark.parametrize("share", [1, 4096])
@pytest.mark.parametrize("base", [40, 65_000, 70_000])
def test_no_frequent_pair_is_left(base, share, monkeypatch):
    monkeypatch.setattr(token_store, "SHARE", share)
    rng = np.random.default_rng(base)
    ids = np.concatenate([rng.zipf(1.5, 9000) % 40, np.tile(rng.permutation(base)[:30], 40), np.full(500, 7), np.tile([1, 1, 2], 90)]).astype(np.uint32)
    for least in (2, 8):
        seq, rules = token_store.grammar(ids, base, least)
        lone = np.unique(np.stack([seq[:-1], seq[1:]]), axis=1, return_counts=True)
        # a run of three equal symbols holds a pair twice that can be replaced once
        assert all(n < least or a == b and n < 2 * least for (a, b), n in zip(lone[0].T.tolist(), lone[1].tolist()))
        payload = token_store.pack(ids, [1], [len(ids)], base, least)
        assert np.array_equal(token_store.Block(payload).all_ids(), ids)


def test_equal_ids_leave_a_handful_of_symbols():
    ids = np.full(1 << 16, 7, np.uint32)
    payload = token_store.pack(ids, [1], [len(ids)], 50_257)
    block = token_store.Block(payload)
    assert len(block.seq) < 40 and int(block.rule_lengths.max()) >= 1 << 12
    assert np.array_equal(block.all_ids(), ids) and np.array_equal(block.ids(777, 1500), ids[777:1500])


def test_blocks_are_packed_until_no_pair_is_frequent():
    passage = np.random.default_rng(4).permutation(50_000)[:2000].astype(np.uint32)
    payload = token_store.pack(np.tile(passage, 100), [1], [200_000], 50_000)
    block = token_store.Block(payload)
    assert frequent_pairs(block.seq, 8) == 0 and len(block.seq) < 1000
    assert np.array_equal(block.all_ids(), np.tile(passage, 100))


@pytest.mark.parametrize("base", [50_000, 70_000])
def test_pairs_in_one_slot_are_all_found(base):
    ids = np.repeat(np.random.default_rng(6).permutation(base)[:12_000].astype(np.uint32).reshape(-1, 2), 8, axis=0).reshape(-1)
    want = np.unique(np.stack([ids[:-1], ids[1:]]), axis=1, return_counts=True)
    seq, rules = token_store.grammar(ids, base, 8)
    of_ids = [tuple(p) for p in rules.tolist() if max(p) < base]
    assert set(of_ids) == {tuple(p) for p, n in zip(want[0].T.tolist(), want[1].tolist()) if n >= 8} and len(of_ids) == len(set(of_ids))
    kind = np.uint32 if base <= 1 << 16 else np.uint64
    pairs = np.random.default_rng(7).permutation(np.arange(1 << 20, dtype=kind) * kind(977))[:70_000]
    keys = np.concatenate([pairs[::3], pairs[::3] + kind(1)])
    assert np.array_equal(token_store.places_of(keys, pairs, 16 if base <= 1 << 16 else 32), np.concatenate([np.arange(0, 70_000, 3), np.full(len(pairs[::3]), -1)]))


@pytest.mark.parametrize("block_ids", [1 << 20, 50])
def test_documents_written_and_read(spark, docs, corpus, block_ids):
    path = shared_dir(spark)
    token_store.write_ids(docs, path, PATH, block_ids=block_ids)
    theirs, want, start = Tokenizer.from_file(PATH), [], 0
    for i, text, *_ in corpus:
        ids = [*theirs.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_store.read_ids(spark, path).collect())) == want


def test_nothing_null_ids_and_repeats(spark, no_docs):
    path = shared_dir(spark)
    token_store.write_ids(no_docs, path, PATH)
    assert token_store.read_ids(spark, path).collect() == []
    path = shared_dir(spark)
    token_store.write_ids(spark.createDataFrame([(2, "b"), (None, "a"), (2, "b"), (1, None)], "doc_id long, text string"), path, PATH)
    got = token_store.read_ids(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (1, 2, 1), (2, 3, 2), (2, 5, 2)]


def test_documents_of_a_range(spark, docs, corpus):
    path = shared_dir(spark)
    token_store.write_ids(docs, path, PATH, block_ids=50)
    theirs = Tokenizer.from_file(PATH)
    found = token_store.read_documents(spark, path, 12, 15)
    assert sorted((r.doc_id, r.ids) for r in found.collect()) == [(i, [*theirs.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in corpus if 12 <= i <= 15]
    blocks = spark.read.parquet(path)
    assert blocks.where("last_doc >= 12 and first_doc <= 15").count() < blocks.count() / 4
    assert "PushedFilters: [IsNotNull(last_doc), IsNotNull(first_doc), GreaterThanOrEqual(last_doc,12)" in found._jdf.queryExecution().toString()


def test_a_text_of_megabytes(spark):
    rng = np.random.default_rng(3)
    text = " ".join(f"w{n}" for n in rng.zipf(1.2, 600_000) % 90_000)
    docs = spark.createDataFrame([(1, "a"), (2, text), (3, "x" * 200_000)], "doc_id long, text string")
    path = shared_dir(spark)
    token_store.write_ids(docs, path, PATH)
    theirs = Tokenizer.from_file(PATH)
    want = [(i, zlib.crc32(np.array([*theirs.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, t in ((1, "a"), (2, text), (3, "x" * 200_000))]
    assert sorted((r.doc_id, r.ids_crc32) for r in token_store.read_ids(spark, path).collect()) == want
