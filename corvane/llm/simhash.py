"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are grouped by the bits of some of their blocks, so that any two within the radius meet in a group. Within a
group they are sorted by Gray rank, where neighbours share many bits. Runs of them form nodes that hold the bits which all their
members share; nodes form nodes above them. Pairs of nodes are compared from the top, differences add up over the bits that become
common on the way down, and a pair of nodes is dropped with all below it once they pass the radius. The members of two lowest nodes
are compared with each other directly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, shared_dir, table, text_hash, unboxed, written
from .graph import components

#: Children of an index node, pairs of nodes looked at together (the lowest: PACE at a time), and close pairs handed on at once.
FAN, SLICE, PACE, HELD = 8, 1 << 19, 1 << 11, 1 << 16
#: Fingerprints of one group in one task; larger groups are dealt to pairs of tiles.
GROUP = 40_000
#: Classes of texts, and their shingles, of one tile when similarities are checked, and pairs looked at between two looks at what is connected.
TILE, TILE_SHINGLES, PORTION = 1000, 1 << 21, 1 << 12


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text, parted by ASCII white space."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], k: int) -> list[int]:
    """XXH64, seed 42, of every run of k words, joined by spaces; of the whole sequence if it is shorter; none without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(b" ".join(words), 42)] if words else []
    text = b" ".join(words)
    lengths = [len(w) + 1 for w in words]
    starts = np.concatenate(([0], np.cumsum(lengths)))
    return [digest(text[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), (starts[k:] - 1).tolist())]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """A bit is one if it is set in over half the hashes; no hashes give zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.asarray(hashes[at : at + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def other_bits(hashes: np.ndarray) -> np.ndarray:
    """64 bits more of each hash, for a second half of the fingerprint."""
    x = hashes ^ hashes >> np.uint64(32)
    for _ in range(2):
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def with_fingerprint(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fingerprint (a long of the 64 bits) of each row; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(shingle_hashes(words_of(t), k)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, dtype=np.uint64).astype(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint long")


def text_classes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, class (128 bits of its words), first, second (both halves of a fingerprint of 128 bits), n (shingles)."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, prints, sizes = [], [], []
            for t in batch.column(2).to_pylist():
                words = words_of(t)
                hashes = np.array(shingle_hashes(words, k), dtype=np.uint64)
                classes.append(xxhash.xxh3_128_digest(b" ".join(words))), sizes.append(len(hashes))
                prints.append((fingerprint(hashes), fingerprint(other_bits(hashes))))
            halves = np.array(prints, dtype=np.uint64).reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(classes, pa.binary()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes, pa.int64())], names=["doc_id", "text_hash", "class", "first", "second", "n"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash binary, class binary, first long, second long, n long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the order of reflected Gray codes."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


def close_pairs(codes: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) with i < j of all pairs within radius bits in each group; groups of these sizes lie one after the
    other in codes, each sorted by Gray rank."""
    levels = [(codes, codes, None, None)]  # bits set in all, bits set in any, first child, children
    while int(sizes.max(initial=0)) > 1:
        every, some = levels[-1][:2]
        starts = np.cumsum(sizes) - sizes
        nodes = -(-sizes // FAN)
        inner = np.arange(int(nodes.sum())) - np.repeat(np.cumsum(nodes) - nodes, nodes)
        first = np.repeat(starts, nodes) + FAN * inner
        count = np.minimum(FAN, np.repeat(starts + sizes, nodes) - first)
        levels.append((np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first), first, count))
        sizes = nodes
    every, some = levels[-1][:2]
    roots = np.arange(len(every))
    stack = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.int64))] if len(levels) > 1 else []
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    while stack:
        level, a, b, differ = stack.pop()
        if len(a) > SLICE // (FAN * FAN):
            for at in range(0, len(a), SLICE // (FAN * FAN)):
                part = slice(at, at + SLICE // (FAN * FAN))
                stack.append((level, a[part], b[part], differ[part]))
            continue
        every, some, first, count = levels[level]
        if level == 1:
            # The codes themselves: all bits of FAN x FAN pairs are counted, for PACE pairs of nodes at a time.
            for at in range(0, len(a), PACE):
                u, v = first[a[at : at + PACE]], first[b[at : at + PACE]]
                x, y = (codes[np.minimum(n + np.arange(FAN)[:, None], len(codes) - 1)] for n in (u, v))
                bits = np.bitwise_count(x[:, None] ^ y[None]).reshape(-1)
                hit = np.flatnonzero(bits <= radius)
                place, of = np.divmod(hit, len(u))
                i, j = np.divmod(place, FAN)
                x, y = u[of] + i, v[of] + j
                keep = (i < count[a[at + of]]) & (j < count[b[at + of]]) & (x < y)
                held.append((x[keep], y[keep], bits[hit[keep]].astype(np.int64)))
                size += len(held[-1][0])
                if size > HELD:
                    yield tuple(np.concatenate(x) for x in zip(*held))
                    held, size = [], 0
            continue
        shared = ~(every ^ some)
        common = shared[a] & shared[b]
        below_every, below_some = levels[level - 1][:2]
        below_shared = ~(below_every ^ below_some)
        n = count[a] * count[b]
        of = np.repeat(np.arange(len(a)), n)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        x, y = first[a][of] + inner // count[b][of], first[b][of] + inner % count[b][of]
        keep = x <= y
        of, x, y = of[keep], x[keep], y[keep]
        fresh = below_shared[x] & below_shared[y] & ~common[of]
        total = differ[of] + np.bitwise_count((below_every[x] ^ below_every[y]) & fresh)
        keep = total <= radius
        stack.append((level - 1, x[keep], y[keep], total[keep]))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def spanning_links(codes: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[list[int], list[int], list[int]]:
    """Links that connect whatever the close pairs connect, nearest pairs first within each portion, and their distances."""
    parent = list(range(len(codes)))
    label = np.arange(len(codes))
    left, right, bits = [], [], []
    for i, j, d in close_pairs(codes, sizes, radius):
        apart = label[i] != label[j]
        if not apart.any():
            continue
        i, j, d = i[apart], j[apart], d[apart]
        order = np.argsort(d, kind="stable")
        touched = []
        for a, b, n in zip(i[order].tolist(), j[order].tolist(), d[order].tolist()):
            x, y = a, b
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
                left.append(a), right.append(b), bits.append(n)
                touched.append(max(x, y))
        if touched:
            roots = np.array(parent)
            while True:
                up = roots[roots]
                if np.array_equal(up, roots):
                    break
                roots = up
            label = roots
            parent = roots.tolist()
    return left, right, bits


def blocks(radius: int) -> list[int]:
    """Masks of the groups: 64 bits fall into radius + 2 blocks, and two codes within the radius agree on some two of them."""
    edges = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(parts, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int) -> DataFrame:
    """a, b, bits: links within radius bits that connect all that any such links connect; prints has distinct fingerprints.

    A group of more than GROUP fingerprints is dealt to pairs of tiles, of which each task holds one pair.
    """
    masks = [signed(m) for m in blocks(radius)]
    keyed = prints.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "bits"))
    large = written(keyed.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP), shared_dir(prints.sparkSession))
    if large.isEmpty():
        dealt = keyed.withColumn("tile", F.lit(0).cast("long"))
    else:
        tiles = F.coalesce(F.ceil(F.col("n") / (GROUP // 2)), F.lit(1)).cast("long")
        own = F.pmod(F.xxhash64("fingerprint"), F.col("tiles"))
        dealt = keyed.join(large, ["mask", "bits"], "left").withColumn("tiles", tiles).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        dealt = dealt.withColumn("tile", F.least("own", "other") * F.col("tiles") + F.greatest("own", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(key: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
            group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]).any(axis=1)))) if len(key) else np.empty(0, np.int64)
            sizes = np.bincount(group)
            codes = codes[np.lexsort((gray_rank(codes), group))]
            many = np.repeat(sizes > 1, sizes)
            left, right, bits = spanning_links(codes[many], sizes[sizes > 1], radius)
            ends = codes[many].astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ends[left]), pa.array(ends[right]), pa.array(bits, pa.int32())], names=["a", "b", "bits"])

        rest_key, rest = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3)], axis=1)
            key = np.concatenate((rest_key, key))
            codes = np.concatenate((rest, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
            upto = int(change[-1]) + 1 if len(change) else 0
            if upto > 1 << 14 or upto and len(key) > 1 << 16:
                yield found(key[:upto], codes[:upto])
            else:
                upto = 0
            rest_key, rest = key[upto:], codes[upto:]
        if len(rest):
            yield found(rest_key, rest)

    placed = dealt.select("fingerprint", "mask", "bits", "tile").repartition("mask", "bits", "tile").sortWithinPartitions("mask", "bits", "tile")
    return placed.mapInArrow(run, "a long, b long, bits int").distinct()


def with_component(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """fingerprint, component_id: the least doc_id of all rows whose fingerprints are connected. prints: doc_id, fingerprint."""
    stars = components(edges.select("a", "b"))
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    rooted = distinct.join(stars, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fingerprint", "component_id")


def simhash_components(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row of docs.

    Texts without a word have the fingerprint zero and are linked like others. Null ids are left out of a component's least id; a
    component without any id has none. Equal rows are linked at distance zero.
    """
    prints = written(with_fingerprint(docs, k), shared_dir(docs.sparkSession))
    edges = links(prints.select("fingerprint").distinct(), radius)
    found = with_component(prints, edges)
    return prints.join(found, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def similar_links(prints: np.ndarray, group: np.ndarray, own: np.ndarray, sets: list[np.ndarray], radius: int, least: float) -> tuple[list[int], list[int]]:
    """Links of ``least`` similarity that connect whatever all such pairs within the radius, by any column of prints, connect in
    each group.

    A pair is only left out if links that passed join its ends already. In a group of two tiles (own) only pairs across them count.
    Rows are sorted by group.
    """
    n = np.array([len(x) for x in sets])
    sizes = np.bincount(group)
    starts = np.cumsum(sizes) - sizes
    mixed = (np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts))[group]
    parent = list(range(len(prints)))
    label = np.arange(len(prints))
    left, right = [], []
    for codes in prints.T:
        sorted_ = np.lexsort((gray_rank(codes), group))
        for i, j, d in close_pairs(codes[sorted_], sizes, radius):
            i, j = sorted_[i], sorted_[j]
            keep = (~mixed[i] | (own[i] != own[j])) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]))
            order = np.argsort(d[keep], kind="stable")
            i, j = i[keep][order], j[keep][order]
            while len(i):
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                for a, b in zip(i[:PORTION].tolist(), j[:PORTION].tolist()):
                    x, y = a, b
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    while parent[y] != y:
                        parent[y] = y = parent[parent[y]]
                    if x != y:
                        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if both >= least * (n[a] + n[b] - both):
                            parent[max(x, y)] = min(x, y)
                            left.append(a), right.append(b)
                i, j = i[PORTION:], j[PORTION:]
                if len(left):
                    label = np.array(parent)
                    while not np.array_equal(label, label[label]):
                        label = label[label]
                    parent = label.tolist()
    return left, right


def candidate_links(classes: DataFrame, half: str, radius: int) -> DataFrame:
    """a, b: links between classes that connect all whose prints of this half are within radius bits. A print's least class stands
    for the others of it."""
    named = written(classes.groupBy(half).agg(F.min("class").alias("least")), shared_dir(classes.sparkSession))
    edges = links(named.select(F.col(half).alias("fingerprint")), radius)
    ends = edges.join(named.select(F.col(half).alias("a"), F.col("least").alias("x")), "a").join(named.select(F.col(half).alias("b"), F.col("least").alias("y")), "b")
    same = classes.select("class", half).join(named, half).where("class <> least")
    return ends.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same.select(F.col("class").alias("a"), F.col("least").alias("b")))


def verified(classes: DataFrame, stars: DataFrame, docs: DataFrame, k: int, radius: int, least: float) -> DataFrame:
    """a, b: links between classes (class, first, second, n, doc_id, text_hash) that connect all that pairs within radius bits, in
    either half, and of a Jaccard similarity of ``least`` or more on their distinct k-word shingles connect.

    Such pairs lie within a component of candidates (stars), so each component's classes meet in one task, or, of more than TILE
    classes or TILE_SHINGLES shingles, in one task for each pair of tiles. The first document of a class stands for it.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.unique(np.array(shingle_hashes(words_of(t), k), dtype=np.uint64)).tobytes() for t in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(values, pa.binary())], names=["class", "first", "second", "root", "tiles", "own", "shingles"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: np.ndarray, names: list[bytes], fresh: np.ndarray, values: list[bytes]) -> pa.RecordBatch:
            group = np.concatenate(([0], np.cumsum(fresh)))
            left, right = similar_links(rows[:, 2:].copy().view(np.uint64), group, rows[:, 1], [np.frombuffer(x, np.uint64) for x in values], radius, least)
            return pa.RecordBatch.from_arrays([pa.array([names[x] for x in ends], pa.binary()) for ends in (left, right)], names=["a", "b"])

        rest, names, roots, held = np.empty((0, 4), np.int64), [], [], []
        for batch in batches:
            rest = np.concatenate((rest, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)], axis=1)))
            for kept, c in ((names, 4), (roots, 5), (held, 6)):
                kept += batch.column(c).to_pylist()
            fresh = (rest[1:, 0] != rest[:-1, 0]) | np.array([x != y for x, y in zip(roots, roots[1:])], bool)
            if fresh.any():
                upto = int(np.flatnonzero(fresh)[-1]) + 1
                yield found(rest[:upto], names[:upto], fresh[: upto - 1], held[:upto])
                rest, names, roots, held = rest[upto:], names[upto:], roots[upto:], held[upto:]
        if held:
            yield found(rest, names, np.zeros(len(held) - 1, bool), held)

    rooted = written(classes.join(stars, F.col("class") == F.col("node"), "left").select("class", "first", "second", "n", "doc_id", "text_hash", F.coalesce("root", "class").alias("root")), shared_dir(docs.sparkSession))
    counted = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).where("m > 1")
    tiles = F.least("m", F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("s") / TILE_SHINGLES))).cast("long")
    dealt = rooted.join(counted.select("root", tiles.alias("tiles")), "root").withColumn("own", F.pmod(F.xxhash64("class"), F.col("tiles")))
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), text_hash(whole).alias("t"), whole.alias("text"))
    texts = texts.join(dealt, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t"))).dropDuplicates(["class"])
    shingles = texts.select("class", "first", "second", "root", "tiles", "own", "text").mapInArrow(sets, "class binary, first long, second long, root binary, tiles long, own long, shingles binary")
    paired = shingles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).withColumn("tile", F.least("own", "other") * F.col("tiles") + F.greatest("own", "other"))
    placed = paired.select("tile", "own", "first", "second", "class", "root", "shingles").repartition("root", "tile").sortWithinPartitions("root", "tile")
    return placed.mapInArrow(close, "a binary, b binary")


def near_dedup(docs: DataFrame, k: int = 5, radius: int = 10, least: float = 0.8) -> DataFrame:
    """One row of docs for each group of near-duplicates: the one of the least doc_id (then the least text hash). Columns stay.

    Candidates are texts whose fingerprints of 128 bits are within radius bits in either half; each link counts if the texts' k-word
    shingles have a similarity of ``least`` or more. Only texts of the same words count as copies without it, texts without words,
    null ones among them. A null id comes first. Of equal rows one stays. Columns of docs may have any names.
    """
    spark = docs.sparkSession
    rows = written(text_classes(docs, k), shared_dir(spark))
    least_row = F.min(F.struct("doc_id", "text_hash")).alias("least")
    classes = rows.groupBy("class").agg(F.min("first").alias("first"), F.min("second").alias("second"), F.max("n").alias("n"), least_row)
    classes = written(classes.select("class", "first", "second", "n", "least.doc_id", "least.text_hash"), shared_dir(spark))
    stars = components(candidate_links(classes, "first", radius).unionByName(candidate_links(classes, "second", radius)))
    groups = components(verified(classes, stars, docs, k, radius, least))
    rooted = classes.join(groups, F.col("class") == F.col("node"), "left").groupBy(F.coalesce("root", "class").alias("root")).agg(least_row)
    found = written(rooted.select(F.col("least.doc_id").alias("d"), F.col("least.text_hash").alias("t")), shared_dir(spark))
    boxes = boxed(docs, id=F.col("doc_id").cast("long"), text_hash=text_hash(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = boxes.join(found, F.col("id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left_semi")
    repeated = rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["id", "text_hash"])
    return unboxed(kept, docs.columns)


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents: null, empty and wordless texts share the fingerprint zero and are linked like any other, repeated rows are
    in one component, a text of any length counts whole, other columns are left out, and no rows give no rows."""
    return simhash_components(table(spark, sf_dir, "documents"))
