import hashlib
from collections import Counter

import pytest

from corvane.llm import sharding


def slow(rows, limit):
    bits = {i: bin(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16))[2:].zfill(60) for i, *_ in rows}
    size = Counter()
    keys = {}
    for i, t, *_ in rows:
        for d in range(61):
            size[bits[i][:d]] += len((t or "").encode())
            keys.setdefault(bits[i][:d], set()).add(bits[i])
    return sorted((str(i), next(bits[i][:d] for d in range(61) if size[bits[i][:d]] <= limit or len(keys[bits[i][:d]]) == 1)) for i, *_ in rows)


@pytest.mark.parametrize("limit", [10**9, 20000, 700, 1])
@pytest.mark.parametrize("step", [12, 2])
def test_shards_split_until_they_fit(spark, docs, corpus, monkeypatch, limit, step):
    monkeypatch.setattr(sharding, "STEP", step)
    got = sharding.assign_shards(docs, limit).collect()
    assert sorted((str(r.doc_id), r.shard) for r in got) == slow(corpus, limit)
    total, n = Counter(), Counter()
    for r in got:
        total[r.shard] += r.n_bytes
        n[r.shard] += 1
    assert all(r.shard_bytes == total[r.shard] and r.shard_docs == n[r.shard] for r in got)
    assert all(total[s] <= limit or n[s] == 1 for s in total)


def test_nothing_repeats_and_clashing_names(spark, no_docs):
    assert sharding.assign_shards(no_docs, 10).collect() == []
    odd = spark.createDataFrame([(None, "abc", "old"), (None, "abc", "old"), (7, None, "old")], "doc_id long, text string, shard string")
    got = sharding.assign_shards(odd, 3).collect()
    assert sorted((r.n_bytes, r.shard_bytes, r.shard_docs) for r in got) == [(0, 0, 1), (3, 6, 2), (3, 6, 2)] and "old" not in {r.shard for r in got}


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 20000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() > 1


def test_rows_of_deep_directories_stay_single(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 3)
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('x', cast(id % 40 AS int)) AS text", "1 AS h", "2 AS row", "3 AS slot0", "4 AS `a.b`")
    found = sharding.assign_shards(docs, 300)
    rows = found.collect()
    assert len(rows) == 3000 and found.columns == [*docs.columns, "n_bytes", "shard", "shard_bytes", "shard_docs"]
    sums = {}
    for r in rows:
        n, size = sums.get(r.shard, (0, 0))
        sums[r.shard] = (n + 1, size + r.n_bytes)
    assert len(sums) > 200 and all(sums[r.shard] == (r.shard_docs, r.shard_bytes) and r.shard_bytes <= 300 for r in rows)
