"""Removal of repeated byte strings through the Burrows-Wheeler transform.

Every string of LENGTH bytes has an anchor: of the GRAM-byte strings inside it, the one of the least hash (the leftmost, if equal).
Equal strings have equal anchors at equal places, so only strings of one anchor can be equal, and anchors that occur once need no
look. The stretch of text that the strings of one anchor cover goes, with the stretches of the same anchor elsewhere, to one block.
The strings of an anchor with too many unlike stretches are parted by more of their own bytes: each of them holds either so many
bytes right of its anchor or so many left of it, and these join the anchor in the key. Equal strings still have equal keys, and a
key that can't be parted further is a whole string, so every string meets all its like in one block, whatever their number.
A block's stretches are suffix-sorted and transformed; its intervals are extended backward, breadth first, which yields the common
prefixes of neighbouring suffixes by increasing value. The extension stops at LENGTH: what has no value then is a repeat.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, shared_dir, table, text_hash, unboxed, written

LENGTH, GRAM = 200, 48
#: Bytes of text that anchors are looked for in at once, of a block, and of stretches gathered before they are handed on.
PORTION, BLOCK, GATHERED = 1 << 20, 1 << 19, 1 << 22
#: Stretches of one key in a block; the strings of a more frequent key are parted by more of their bytes.
SPLIT = 1500
BASE, MASK24 = 0x9E3779B97F4A7C15, np.uint64(0xFFFFFF)


class Anchors:
    """Finds the anchors of all strings of LENGTH bytes."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.window = length, min(gram, length), length - min(gram, length) + 1
        self.up = self.down = np.empty(0, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate((one, np.full(n - 1, BASE, np.uint64))))
            self.down = np.cumprod(np.concatenate((one, np.full(n - 1, pow(BASE, -1, 1 << 64), np.uint64))))

    def of(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, first, last, anchor, hash) of every run of strings with one anchor; places are those in text (under 2 ** 24
        bytes), where document i lies from starts[i] to ends[i]."""
        none = np.empty(0, np.int64)
        long = np.flatnonzero(ends - starts >= self.length)
        if not len(long):
            return none, none, none, none, none
        self.powers(len(text) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(text.astype(np.uint64) * self.up[: len(text)])))
        x = (sums[self.gram :] - sums[: -self.gram]) * self.down[: len(text) - self.gram + 1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        keys = x & ~MASK24 | np.arange(len(x), dtype=np.uint64)
        w = self.window
        padded = np.full(-(-len(keys) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(keys)] = keys
        table_ = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(table_, axis=1).reshape(-1)
        behind = np.minimum.accumulate(table_[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        counts = ends[long] - starts[long] - self.length + 1
        doc = np.repeat(long, counts)
        places = np.repeat(starts[long], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        anchor = (np.minimum(behind[places], ahead[places + w - 1]) & MASK24).astype(np.int64)
        heads = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
        tails = np.concatenate((heads[1:], [len(anchor)])) - 1
        return doc[heads], places[heads], places[tails], anchor[heads], x[anchor[heads]].astype(np.int64)


def portions(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """(documents, their offsets in the text, joined bytes) of at most about PORTION bytes; a longer text comes in pieces that
    overlap by length - 1 bytes."""
    held, offsets, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 1), PORTION):
            piece = t[at : at + PORTION + length - 1]
            if size and size + len(piece) > PORTION + length:
                yield held, offsets, parts
                held, offsets, parts, size = [], [], [], 0
            held.append(i), offsets.append(at), parts.append(piece)
            size += len(piece)
    if held:
        yield held, offsets, parts


def text_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """text_hash, anchors (hash), place (of the anchor), lo, hi (of the strings it stands for) as arrays, one row per document that
    is long enough; docs has text_hash and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length, gram)
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            names = batch.column(0).to_pylist()
            for held, offsets, parts in portions(texts, length):
                sizes = np.array([len(p) for p in parts])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                doc, lo, hi, anchor, hashes = finder.of(np.frombuffer(b"".join(parts), np.uint8), starts, ends)
                if not len(doc):
                    continue
                shift = np.array(offsets)[doc] - starts[doc]
                heads = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)])).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(heads), pa.array(v, k)) for v, k in ((hashes, pa.int64()), (anchor + shift, pa.int64()), (lo + shift, pa.int64()), (hi + shift, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([names[held[d]] for d in doc[heads[:-1]]], pa.binary()), *lists], names=["text_hash", "anchors", "place", "lo", "hi"])

    return docs.select("text_hash", "text").mapInArrow(run, "text_hash binary, anchors array<long>, place array<long>, lo array<long>, hi array<long>")


def transformed(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): suffixes of text (bytes + 1; 0 parts the stretches) sorted by their first ``depth`` symbols or more, and for
    each suffix the place in the order where those equal to it so far begin."""
    n = len(text)
    packed = np.zeros(n, np.uint64)
    for k in range(7):
        packed <<= np.uint64(9)
        packed[: max(n - k, 0)] |= text[k:]
    order = np.argsort(packed).astype(np.int32)
    ordered = packed[order]
    fresh = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    group = np.empty(n, np.int32)
    group[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))
    done = 7
    slots = np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True])))).astype(np.int32)
    while done < depth and len(slots):
        at = order[slots]
        follow = at + done
        second = np.where(follow < n, group[np.minimum(follow, n - 1)] + 1, 0)
        key = group[at].astype(np.int64) * (n + 2) + second
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(slots), dtype=np.int32), 0))
        group[at] = slots[head]
        slots = slots[~(fresh & np.concatenate((fresh[1:], [True])))]
        done *= 2
    return order, group


def long_prefixes(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, repeats): sorted suffixes; repeats[j] if the suffixes at j - 1 and j of the order share ``least`` bytes or more, as
    far as neither reaches the end of its stretch before that."""
    n = len(text)
    order, group = transformed(text, least)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    symbol = text[order - 1]  # the transform; what stands before the first is a parting 0
    back = place[order - 1]
    head = group[order]
    last = np.flatnonzero(np.concatenate((head[1:] != head[:-1], [True]))).astype(np.int32)
    tail = np.repeat(last + 1, np.diff(np.concatenate(([-1], last))))  # behind the last of each group
    by = np.argsort(symbol, kind="stable").astype(np.int32)
    same = symbol[by[1:]] == symbol[by[:-1]]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[by[1:][same]] = by[:-1][same]
    after[by[:-1][same]] = by[1:][same]
    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    open_[: int((text == 0).sum()) + 1] = False
    lb, rb = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(least):
        if not len(lb):
            break
        sizes = rb - lb
        of = np.repeat(np.arange(len(lb), dtype=np.int32), sizes)
        flat = np.arange(len(of), dtype=np.int32) + np.repeat(lb - (np.cumsum(sizes, dtype=np.int32) - sizes), sizes)
        real = symbol[flat] != 0
        first = real & (before[flat] < lb[of])
        final = real & (after[flat] >= rb[of])
        a, b = flat[first], flat[final]
        # One child for each symbol in an interval: its first and its last place there, brought together by interval and symbol.
        a = a[np.argsort(of[first] * np.int64(257) + symbol[a])]
        b = b[np.argsort(of[final] * np.int64(257) + symbol[b])]
        lb, rb = head[back[a]], tail[back[b]]
        unset = open_[rb]
        lb, rb = lb[unset], rb[unset]
        open_[rb] = False
    return order, open_[:n]


def block_repeats(stretches: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, place, class, members) of every string of ``length`` bytes that starts in a stretch, strings of one class being
    equal; in the order of the stretches and places."""
    sizes = np.array([len(s) for s in stretches])
    text = np.frombuffer(b"".join(s + b"\0" for s in stretches), np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes + 1)
    text[ends - 1] = 0
    order, repeats = long_prefixes(text, length)
    owner = np.repeat(np.arange(len(stretches)), sizes + 1)
    inner = np.arange(len(text)) - (ends - sizes - 1)[owner]
    whole = inner + length <= sizes[owner]
    ordered = whole[order]
    joined = repeats & ordered & np.concatenate(([False], ordered[:-1]))
    number = np.cumsum(~joined) - 1
    class_of = np.empty(len(text), np.int64)
    class_of[order] = number
    strings = np.flatnonzero(whole)
    members = np.bincount(class_of[strings], minlength=int(number[-1]) + 1)
    return owner[strings], inner[strings], class_of[strings], members[class_of[strings]]


def runs(places: np.ndarray) -> tuple[list[int], list[int]]:
    """Firsts and ends of the runs of ascending places."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate(([0], cut + 1))].tolist(), (places[np.concatenate((cut, [len(places) - 1]))] + 1).tolist()


def repeated_places(stretches: DataFrame, length: int) -> DataFrame:
    """From rows (anchor, name, bytes, n): name with starts, ends (runs of places whose strings are repeats).

    A stretch that is there n times is transformed once. A key of one stretch has nothing to compare: no two strings of a stretch
    are equal, as their anchor lies elsewhere in each.
    """

    def solved(rows: dict) -> pa.RecordBatch:
        of_key = Counter(r[2] for r in rows.values())
        out: list[tuple] = [(name, [0], [len(text) - length + 1]) for name, (text, n, key) in rows.items() if of_key[key] == 1 and n > 1]
        several = {name: r for name, r in rows.items() if of_key[r[2]] > 1}
        if several:
            owner, place, _, members = block_repeats([r[0] for r in several.values()], length)
            bounds = np.searchsorted(owner, np.arange(len(several) + 1))
            for (name, (_, n, _)), a, b in zip(several.items(), bounds, bounds[1:]):
                found = place[a:b] if n > 1 else place[a:b][members[a:b] > 1]
                if len(found):
                    out.append((name, *runs(found)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.binary(), *[pa.list_(pa.int32())] * 2))], names=["name", "starts", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[bytes, list] = {}
        size, group = 0, None
        for batch in batches:
            for anchor, name, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                if anchor != group:
                    if size > BLOCK:
                        yield solved(rows)
                        rows, size = {}, 0
                    group = anchor
                if name in rows:
                    rows[name][1] += n
                else:
                    rows[name] = [text, n, anchor]
                    size += len(text)
        if rows:
            yield solved(rows)

    dealt = stretches.select("anchor", "name", "bytes", "n").repartition("anchor").sortWithinPartitions("anchor", "name")
    return dealt.mapInArrow(run, "name binary, starts array<int>, ends array<int>")


def stretch_name(text: bytes, anchor_at: int) -> bytes:
    """Equal stretches around equal anchors have one name."""
    import xxhash

    return xxhash.xxh3_128_digest(text + struct.pack("<I", anchor_at))


def flat_hits(column: pa.ListArray) -> tuple[list[int], dict[str, list]]:
    """Where each row's hits begin and end, and the hits' fields one after the other."""
    flat = column.flatten()
    return np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).tolist(), {f.name: flat.field(f.name).to_pylist() for f in flat.type}


def parted(text: bytes, hit: dict, length: int) -> Iterator[dict]:
    """The strings of a hit in two parts. All share the bytes from ``left`` before the anchor's place to ``right`` behind it. Of the
    others, a string has one half (rounded up) right of these bytes, or else over one half left of them: those bytes join the key."""
    import xxhash

    place, left, right = hit["place"], hit["left"], hit["right"]
    free = length - left - right
    bound = place - left - free // 2  # strings from here on have half of the free bytes on the right
    more = free - free // 2
    for lo, hi, at, side, grown in ((max(hit["lo"], bound), hit["hi"], (place + right, place + right + more), 0, (left, right + more)), (hit["lo"], min(hit["hi"], bound - 1), (place - left - free // 2 - 1, place - left), 1, (left + free // 2 + 1, right))):
        if lo <= hi:
            key = xxhash.xxh3_64_intdigest(struct.pack("<qB", hit["anchor"], side) + text[at[0] : at[1]])
            yield {"anchor": key - (1 << 64) if key >> 63 else key, "place": place, "lo": lo, "hi": hi, "left": grown[0], "right": grown[1]}


HIT = "struct<anchor: long, place: long, lo: long, hi: long, left: int, right: int>"


def finer_hits(texts: DataFrame, length: int) -> DataFrame:
    """text_hash, packed, hits, keys, names from texts whose hits all have frequent keys: their parts, and the distinct pairs of a key
    and the name of a stretch."""
    kind = pa.struct([*((f, pa.int64()) for f in ("anchor", "place", "lo", "hi")), ("left", pa.int32()), ("right", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            parts, keys, names = [], [], []
            for packed, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = unpack(packed)
                parts.append([part for h in hits for part in parted(text, h, length)])
                pairs = {(h["anchor"], int.from_bytes(stretch_name(text[h["lo"] : h["hi"] + length], h["place"] - h["lo"])[:8], "little", signed=True)) for h in parts[-1]}
                keys.append([k for k, _ in pairs]), names.append([n for _, n in pairs])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.list_(kind)), pa.array(keys, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.int64()))], names=["text_hash", "packed", "hits", "keys", "names"])

    return texts.select("text_hash", "packed", "hits").mapInArrow(run, f"text_hash binary, packed binary, hits array<{HIT}>, keys array<long>, names array<long>")


def with_rare_keys(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """text_hash, packed, hits: those of texts (text_hash, packed, hits, hot), hits of frequent keys in parts of rarer ones; a text
    may have several rows.

    Every round halves the free bytes of what is still frequent, so there are eight at most. A key counts by its unlike stretches;
    the count, an estimate of a few percent, only tells whether to go on.
    """
    spark = texts.sparkSession
    done = texts.where(F.size("hits") > 0).select("text_hash", "packed", "hits")
    now = texts.where(F.size("hot") > 0).select("text_hash", "packed", F.col("hot").alias("hits"))
    for _ in range(max(length - gram, 0).bit_length()):
        if now.isEmpty():
            break
        finer = written(finer_hits(now, length), shared_dir(spark))
        pairs = finer.select(F.explode(F.arrays_zip("keys", "names")).alias("x")).select("x.keys", "x.names")
        frequent = pairs.groupBy("keys").agg(F.approx_count_distinct("names").alias("n")).where(F.col("n") > SPLIT).select("keys")
        of_text = finer.select("text_hash", F.explode(F.array_distinct("keys")).alias("keys")).join(frequent, "keys", "left_semi").groupBy("text_hash").agg(F.collect_list("keys").alias("frequent"))
        hot = F.filter("hits", lambda h: F.array_contains("frequent", h["anchor"]) & (h["left"] + h["right"] < length))
        rest = F.filter("hits", lambda h: ~F.array_contains("frequent", h["anchor"]) | (h["left"] + h["right"] >= length))
        split = F.col("frequent").isNotNull()
        marked = finer.select("text_hash", "packed", "hits").join(of_text, "text_hash", "left").select("text_hash", "packed", F.when(split, rest).otherwise(F.col("hits")).alias("hits"), F.when(split, hot).alias("hot"))
        judged = written(marked, shared_dir(spark))
        done = done.unionByName(judged.where(F.size("hits") > 0).select("text_hash", "packed", "hits"))
        now = judged.where(F.size("hot") > 0).select("text_hash", "packed", F.col("hot").alias("hits"))
    return done


def stretches_of(texts: DataFrame, length: int) -> DataFrame:
    """anchor, name, bytes, n from texts with hits; equal stretches of a task are counted before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[bytes, list] = {}
        size = 0

        def handed() -> pa.RecordBatch:
            columns = list(zip(*((a, name, t, n) for name, (a, t, n) in held.items())))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=["anchor", "name", "bytes", "n"])

        for batch in batches:
            bounds, h = flat_hits(batch.column(1))
            for packed, a, b in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                text = unpack(packed)
                for anchor, place, lo, hi in zip(h["anchor"][a:b], h["place"][a:b], h["lo"][a:b], h["hi"][a:b]):
                    stretch = text[lo : hi + length]
                    name = stretch_name(stretch, place - lo)
                    if name in held:
                        held[name][2] += 1
                    else:
                        held[name] = [anchor, stretch, 1]
                        size += len(stretch)
                if size > GATHERED:
                    yield handed()
                    held.clear()
                    size = 0
        if held:
            yield handed()

    return texts.select("packed", "hits").mapInArrow(run, "anchor long, name binary, bytes binary, n long")


def named_hits(texts: DataFrame, length: int) -> DataFrame:
    """name, text_hash, lo of every stretch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            names = []
            bounds, h = flat_hits(batch.column(2))
            for packed, a, b in zip(batch.column(1).to_pylist(), bounds, bounds[1:]):
                text = unpack(packed)
                names += [stretch_name(text[lo : hi + length], place - lo) for place, lo, hi in zip(h["place"][a:b], h["lo"][a:b], h["hi"][a:b])]
            of = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch.column(0))), np.diff(bounds))))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), of, pa.array(h["lo"], pa.int64())], names=["name", "text_hash", "lo"])

    return texts.select("text_hash", "packed", "hits").mapInArrow(run, "name binary, text_hash binary, lo long")


def cut(text: bytes, starts: list[int], ends: list[int], length: int) -> tuple[bytes, int]:
    """text without the bytes that strings starting from starts[i] to ends[i] cover, and how many maximal runs went."""
    kept, at, removed = [], 0, 0
    for s, e in sorted(zip(starts, ends)):
        e += length - 1
        if s > at or not removed:
            kept.append(text[at:s])
            removed += 1
        at = max(at, e)
    return b"".join(kept) + text[at:], removed


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(texts, copies). texts: text_hash, packed (the text, compressed), starts, ends (runs of places at which a string of ``length``
    bytes starts that also starts elsewhere) of every distinct text with any; copies: text_hash of the texts of several rows, whose
    strings all repeat. Null texts are empty."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", text_hash(F.col("text")))
    copies = rows.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_hash")
    long = rows.where(F.octet_length("text") >= length)
    found = written(text_anchors(long, length, gram), shared_dir(spark))
    places = found.select("text_hash", F.explode(F.arrays_zip("anchors", "place", "lo", "hi")).alias("x")).select("text_hash", F.col("x.anchors").alias("anchor"), "x.place", "x.lo", "x.hi")
    where = F.xxhash64("text_hash", "place")
    often = places.withColumn("where", where).groupBy("anchor").agg(F.min("where").alias("least"), F.max("where").alias("most"), F.count(F.lit(1)).alias("n"))
    often = written(often.where("least <> most").select("anchor", (F.col("n") > SPLIT).alias("frequent")), shared_dir(spark))
    hit = F.struct("anchor", "place", "lo", "hi", F.lit(0).alias("left"), F.lit(min(gram, length)).alias("right"))
    hits = places.join(often, "anchor").groupBy("text_hash").agg(F.collect_set(F.when(~F.col("frequent"), hit)).alias("hits"), F.collect_set(F.when(F.col("frequent"), hit)).alias("hot"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, seen = zstandard.ZstdCompressor(level=3).compress, set()
        for batch in batches:
            new = [(h, t) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if h not in seen and not seen.add(h)]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in new], pa.binary()), pa.array([pack(t.encode()) for _, t in new], pa.binary())], names=["text_hash", "packed"])

    short = long.select("text_hash", "text").mapInArrow(packed, "text_hash binary, packed binary")
    texts = written(short.join(hits, "text_hash").dropDuplicates(["text_hash"]), shared_dir(spark))
    rare = with_rare_keys(texts, length, min(gram, length))
    solved = written(repeated_places(stretches_of(rare, length), length), shared_dir(spark))
    spans = named_hits(rare, length).join(solved, "name").select("text_hash", F.transform("starts", lambda x: x + F.col("lo")).alias("starts"), F.transform("ends", lambda x: x + F.col("lo")).alias("ends"))
    spans = spans.groupBy("text_hash").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    return texts.select("text_hash", "packed").join(spans, "text_hash"), copies


def removal(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs.

    Each byte goes that a string of ``length`` bytes covers which also starts elsewhere, in this or another row; strings are judged
    on the input. Null texts are empty, shorter ones keep all, and rows of one text, null ids included, lose all of it.
    """
    spans, copies = repeated_spans(docs, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            removed, counts, digests = [], [], []
            for packed, starts, ends in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                text = unpack(packed)
                kept, n = cut(text, starts, ends, length)
                removed.append(len(text) - len(kept)), counts.append(n), digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["text_hash", "removed", "spans", "sha"])

    parts = spans.select("text_hash", "packed", "starts", "ends").mapInArrow(run, "text_hash binary, removed long, spans long, sha string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text_hash(text).alias("text_hash"), F.sha2(text, 256).alias("all"))
    rows = rows.join(parts, "text_hash", "left").join(copies.withColumn("copied", F.lit(True)), "text_hash", "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)
    return rows.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "all")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with repeated strings taken out of their texts, and n_chars set anew; columns as they were, whatever their names.

    Bytes of a character of which others went are dropped too. Texts that lose nothing, null among them, stay as they are; rows
    whose text goes as a whole stay with an empty text.
    """
    spans, copies = repeated_spans(docs, length, gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            kept = [cut(unpack(p), s, e, length)[0].decode("utf-8", "ignore") for p, s, e in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["hash", "left"])

    parts = spans.select("text_hash", "packed", "starts", "ends").mapInArrow(run, "hash binary, left string")
    text = F.col("text").cast("string")
    boxes = boxed(docs, text=text, key=text_hash(F.coalesce(text, F.lit(""))))
    rows = boxes.join(parts, F.col("key") == F.col("hash"), "left").join(copies.select(F.col("text_hash").alias("copy")), F.col("key") == F.col("copy"), "left")
    rows = rows.withColumn("left", F.when(F.col("copy").isNotNull() & (F.octet_length("text") >= length), F.lit("")).otherwise(F.coalesce("left", "text")))
    changed = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.length("left"), F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return unboxed(rows, docs.columns, **changed)


def op8_suffix_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, one row each; see removal for nulls, empty and long texts, repeats and ids."""
    return removal(table(spark, sf_dir, "documents"))
