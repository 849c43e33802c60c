"""Token ids in Re-Pair blocks.

A file is a Parquet folder whose rows are blocks. A block holds whole documents in ascending order: their ids after grammar
compression, the rules, the length that each rule expands to, and the documents' bounds. Rules and lengths let a reader decode any
range of ids without expanding the rest, and each block tells its least and its largest doc_id, so a reader of some documents opens
only the blocks that may hold them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import loaded
from .common import shared_dir, table

#: Slots of the table that pairs are looked up in, and pairs that a round replaces at least, if so many are frequent.
TABLE_BITS, SHARE = 18, 4096
HEADER = struct.Struct("<4sIIIII")
MAGIC = b"RPB2"
BLOCK_SCHEMA = "part int, block int, part_start long, n_ids long, n_docs int, first_doc long, last_doc long, payload binary"


def grammar(ids: np.ndarray, base: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, rules): rule r, an id pair, is symbol base + r.

    Every round replaces, at once, the more frequent half of the pairs that occur ``least`` times or more (at least SHARE of them);
    where chosen pairs overlap, every other one from the left is taken. Rounds go on until no pair occurs that often. A rule only
    names earlier symbols. A pair that is too rare stays so unless a new symbol is in it, so after the first round only pairs around
    replaced places and those that were frequent before are counted.
    """
    seq, rules, made = ids.astype(np.uint32), [], 0
    live = np.arange(max(len(seq) - 1, 0), dtype=np.int32)  # left places of the pairs that may be frequent
    while len(live) >= least:
        half = 16 if base + made <= 1 << 16 else 32
        kind = np.uint32 if half == 16 else np.uint64
        keys = seq[:-1].astype(kind) << kind(half) | seq[1:].astype(kind)
        keys = keys if len(live) == len(keys) else keys[live]
        ordered = np.sort(keys)
        heads = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
        counts = np.diff(np.concatenate((heads, [len(ordered)])))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        often = often[np.argsort(-counts[often], kind="stable")]
        pairs = ordered[heads[often]]
        slot = places_of(keys, pairs, half)
        known = slot >= 0
        live, slot = live[known], slot[known]
        chosen = slot < max(SHARE, len(often) // 2)
        at, slot = live[chosen], slot[chosen]
        place = np.arange(len(at), dtype=np.int32)
        run = place - np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(at) != 1)), place, 0))
        even = run & 1 == 0
        at, slot = at[even], slot[even]
        present = np.bincount(slot, minlength=len(pairs)) > 0
        used, slot = pairs[present], (np.cumsum(present) - 1)[slot]
        rules.append(np.stack([used >> kind(half), used & kind((1 << half) - 1)], axis=1).astype(np.uint32))
        seq[at] = base + made + slot
        made += len(used)
        keep, again = np.ones(len(seq), bool), np.zeros(len(seq) + 1, bool)
        keep[at + 1] = False
        again[live] = again[at] = again[at - 1] = True  # the pair before the first place is a spare one at the end
        again[at[at + 2 < len(seq)] + 1] = False
        seq, again = seq[keep], again[:-1][keep]
        live = np.flatnonzero(again[:-1]).astype(np.int32)
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def places_of(keys: np.ndarray, pairs: np.ndarray, half: int) -> np.ndarray:
    """For each key its place in pairs, or -1. A hash table finds most; of two pairs in one slot the first is there, and the others
    are searched for."""
    kind = keys.dtype.type
    factor = kind(0x9E3779B1 if half == 16 else 0x9E3779B97F4A7C15)
    spread = lambda x: (x * factor) >> kind(2 * half - TABLE_BITS)
    slots = np.full(1 << TABLE_BITS, -1, np.int32)
    slots[spread(pairs[::-1])] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)
    out = np.take(slots, spread(keys))
    missed = np.flatnonzero((np.take(pairs, out, mode="wrap") != keys) & (out >= 0))
    moved = np.flatnonzero(slots[spread(pairs)] != np.arange(len(pairs)))
    moved = moved[np.argsort(pairs[moved])]
    out[missed] = -1
    if len(moved) and len(missed):
        found = moved[np.minimum(np.searchsorted(pairs[moved], keys[missed]), len(moved) - 1)]
        same = pairs[found] == keys[missed]
        out[missed[same]] = found[same]
    return out


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    lengths = [1] * base
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    return np.array(lengths[base:], dtype=np.uint32)


def planes(symbols: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of each symbol, then one packed plane for each higher bit."""
    return b"".join((symbols.astype("<u2").tobytes(), *(np.packbits(symbols >> k & 1 != 0).tobytes() for k in range(16, bits))))


def pack(ids: np.ndarray, doc_ids: list[int | None], doc_lengths: list[int], base: int, least: int = 8) -> bytes:
    """One block. doc_ids may hold None; the lengths sum up to len(ids)."""
    seq, rules = grammar(ids, base, least)
    bits = max(16, (base + len(rules) - 1).bit_length())
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    return b"".join((
        HEADER.pack(MAGIC, base, len(rules), len(seq), len(doc_ids), bits),
        planes(rules.reshape(-1), bits),
        expansion_lengths(rules, base).astype("<u4").tobytes(),
        planes(seq, bits),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        null.tobytes(),
        np.array(doc_lengths, dtype="<u8").tobytes(),
    ))


class Block:
    """A packed block, opened."""

    def __init__(self, payload: bytes):
        magic, self.base, n_rules, n_seq, n_docs, bits = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        def symbols(n: int) -> np.ndarray:
            out = take("<u2", n).astype(np.uint32)
            for k in range(16, bits):
                out |= np.unpackbits(take("u1", -(-n // 8)), count=n).astype(np.uint32) << np.uint32(k)
            return out

        self.rules = symbols(2 * n_rules).reshape(-1, 2)
        self.rule_lengths = take("<u4", n_rules)
        self.seq = symbols(n_seq)
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist())]
        self.doc_starts = np.concatenate(([0], np.cumsum(take("<u8", n_docs)))).astype(np.int64)
        self.lengths = np.concatenate((np.ones(self.base, np.int64), self.rule_lengths.astype(np.int64)))
        self.ends = np.cumsum(self.lengths[self.seq])

    def all_ids(self) -> np.ndarray:
        """All ids of the block, from a table of what every symbol stands for."""
        starts = np.concatenate((np.arange(self.base), self.base + np.cumsum(self.rule_lengths) - self.rule_lengths)).astype(np.int64)
        flat = np.concatenate((np.arange(self.base), np.zeros(int(self.rule_lengths.sum()), np.int64))).astype(np.uint32)
        begin, lengths = starts.tolist(), self.lengths.tolist()
        for r, (a, b) in enumerate(self.rules.tolist(), self.base):
            middle = begin[r] + lengths[a]
            flat[begin[r] : middle] = flat[begin[a] : begin[a] + lengths[a]]
            flat[middle : begin[r] + lengths[r]] = flat[begin[b] : begin[b] + lengths[b]]
        n = self.lengths[self.seq]
        at = np.repeat(starts[self.seq] - self.ends + n, n)
        at += np.arange(len(at))
        return flat[at]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the block. Only symbols that reach into this range are expanded, level by level."""
        stop = min(stop, int(self.ends[-1]) if len(self.ends) else 0)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = int(np.searchsorted(self.ends, start, side="right")), int(np.searchsorted(self.ends, stop - 1, side="right"))
        seq, before = self.seq[first : last + 1], int(self.ends[first - 1]) if first else 0
        start, stop = start - before, stop - before
        while (rule := seq >= self.base).any():
            n = rule + 1
            place = (np.cumsum(n) - n)[rule]
            grown = np.repeat(seq, n)
            grown[place], grown[place + 1] = self.rules[seq[rule] - self.base].T
            lengths = self.lengths[grown]
            ends = np.cumsum(lengths)
            keep = (ends > start) & (ends - lengths < stop)
            seq, before = grown[keep], int((ends - lengths)[keep][0])
            start, stop = start - before, stop - before
        return seq[start:stop]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the block."""
        return self.ids(int(self.doc_starts[k]), int(self.doc_starts[k + 1]))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0, block_ids: int = 1 << 20) -> None:
    """Encodes docs.text whole and writes blocks of about block_ids ids to path, documents in ascending doc_id order.

    Null ids come first; rows with equal ids follow each other in the order of their texts. A null text counts as empty, and end_id
    follows each document. A document is never divided, so a block is as large as block_ids or as one document. Equal rows give
    equal entries. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        end = b"" if end_id is None else np.array([end_id], dtype=bpe.dtype).tobytes()
        width = bpe.dtype.itemsize
        part, block, start, held, ids, n = 0, 0, 0, [], [], 0

        def closed() -> pa.RecordBatch:
            lengths = [len(x) // width for x in ids]
            payload = pack(np.frombuffer(b"".join(ids), dtype=bpe.dtype), held, lengths, bpe.size)
            named = [d for d in held if d is not None]
            values = (part, block, start, n, len(held), min(named, default=None), max(named, default=None), payload)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["part", "block", "part_start", "n_ids", "n_docs", "first_doc", "last_doc", "payload"])

        for batch in batches:
            doc_ids, texts, parts = (batch.column(k).to_pylist() for k in range(3))
            for doc_id, encoded, part in zip(doc_ids, bpe.encode_many(texts), parts):
                encoded += end
                if held and n + len(encoded) // width > block_ids:
                    yield closed()
                    block, start, held, ids, n = block + 1, start + n, [], [], 0
                held.append(doc_id)
                ids.append(encoded)
                n += len(encoded) // width
        if held:
            yield closed()

    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, BLOCK_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """What a folder of blocks holds: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, one row per document.

    The ids are decoded from the blocks. The driver only gets one total for each partition that was written.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip([p for p, _ in totals], accumulate([n for _, n in totals], initial=0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                block = Block(payload)
                ids = block.all_ids().astype("<u4")
                bounds = block.doc_starts
                data, edges = memoryview(ids.tobytes()), (4 * bounds).tolist()
                sums = [zlib.crc32(data[a:b]) for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(before[part] + start + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("part", "part_start", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """doc_id, ids (array of int) of the documents whose id lies from first to last. Blocks that can't hold any are not opened, and of
    the others only these documents are decoded. Documents of null id are in no range; repeated rows come as often."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path).where((F.col("last_doc") >= first) & (F.col("first_doc") <= last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                block = Block(payload)
                wanted = [k for k, d in enumerate(block.doc_ids) if d is not None and first <= d <= last]
                yield pa.RecordBatch.from_arrays([pa.array([block.doc_ids[k] for k in wanted], pa.int64()), pa.array([block.document(k).astype(np.int32) for k in wanted], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return blocks.select("payload").mapInArrow(run, "doc_id long, ids array<int>")


def op1_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, encoded, written in blocks and read back. Null and empty texts hold the end id alone; equal rows give equal
    entries, each with its own start; a long text is one entry of its block; other columns are left out; no rows give no rows."""
    import public_tokenizers

    path = shared_dir(spark)
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, path)
