"""BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no token of the vocabulary is a certain cut: no merge can ever join its two bytes. Such cuts before
ASCII white space, and before punctuation that follows a word, split a text into fragments, which are encoded independently and
concatenated. Fragments repeat a lot, so each task keeps the ids of those it has met.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, table

#: White space as Unicode defines it (the tokenizer's own \s); Python's \s differs from it by \x1c-\x1f.
ASCII_SPACE = "\t\n\x0b\x0c\r "
OTHER_SPACE = "\x85\xa0  -     　"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte, as byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Characters of texts that are parted and looked up together; bytes of those that are made into lists of ids together.
PORTION, LIST_PORTION = 1 << 22, 1 << 20


class ForcedBoundaryBpe:
    """Encoder and decoder over a tokenizers JSON file of the byte-level BPE kind.

    Truncation and padding are off. Strings of special tokens in a text become their ids, as the tokenizers library does.
    ``cache_entries`` and ``cache_key_chars`` bound the memory of fragments: at most two generations of so many entries and one
    portion's fragments are held, and longer fragments are not kept.
    """

    def __init__(self, path: str, cache_entries: int = 400_000, cache_key_chars: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        alphabet = byte_alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.size = max(vocabulary.values()) + 1
        self.token_bytes = [b""] * self.size
        for token, i in vocabulary.items():
            self.token_bytes[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        self.lengths = np.array([len(t) for t in self.token_bytes], dtype=np.int64)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.decimal = [str(i) for i in range(self.size)]
        self.never = self.pairs_never_inside([b for t, b in zip(vocabulary, map(self.token_bytes.__getitem__, vocabulary.values())) if t not in special])
        self.space, self.ascii_letter, self.word, self.mark, self.wide_space = self.kinds_of_bytes()
        self.limit, self.key_chars = cache_entries, cache_key_chars
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def pairs_never_inside(tokens: Iterable[bytes]) -> np.ndarray:
        """[a, b]: byte b never follows byte a inside a token."""
        never = np.ones((256, 256), dtype=bool)
        for t in tokens:
            if len(t) > 1:
                x = np.frombuffer(t, dtype=np.uint8)
                never[x[:-1], x[1:]] = False
        return never

    def kinds_of_bytes(self) -> tuple[np.ndarray, ...]:
        """Tables of bytes: ASCII white space, ASCII letters, bytes of words (letters up to U+024F), punctuation that never follows a
        letter inside a token; and [a, b]: bytes a, b may end other white space."""
        space, letter, word, mark = np.zeros((4, 256), dtype=bool)
        space[[*map(ord, ASCII_SPACE)]] = True
        letter[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
        word[:] = letter
        word[0x80:0xC0] = word[0xC3:0xCA] = True  # a character beyond starts with another byte
        mark[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and self.never[letter, c].all()]] = True
        wide = np.zeros((256, 256), dtype=bool)
        for c in re.findall(f"[{OTHER_SPACE}]", "".join(map(chr, range(0xD800)))):
            wide[tuple(c.encode()[-2:])] = True
        return space, letter, word, mark, wide

    def edges(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where fragments of data begin, ascending: UTF-8 bytes of texts that begin at starts, and one zero byte after them.

        A cut lies where a character that isn't white space meets ASCII white space, or an ASCII letter that ends the word at the start
        of a fragment meets punctuation, and the pair of bytes there is never inside a token. The pre-tokenizer also parts the text
        at these places.
        """
        pair = lambda table, a, b: np.take(table.reshape(-1), a.astype(np.uint16) << np.uint16(8) | b)
        space = np.take(self.space, data)
        at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        before = data[at - 1]
        at = at[pair(self.never, before, data[at]) & ~pair(self.wide_space, data[at - 2], before)]
        begins = np.zeros(len(data), dtype=bool)
        begins[at] = begins[starts] = True
        begins[-1] = False
        first = np.flatnonzero(begins)
        first += space[first]
        others = np.flatnonzero(~np.take(self.word, data))
        end = others[np.searchsorted(others, first)]
        # a word that runs on into the next text ends where that text's own first word does
        begins[end[(end > first) & np.take(self.mark, data[end]) & np.take(self.ascii_letter, data[end - 1])]] = True
        return np.flatnonzero(begins)

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, fragments: Iterable[str]) -> dict[str, bytes]:
        """Ids of fragments. Those between two certain cuts are joined into longer texts, encoded at once and parted by byte lengths."""
        out: dict[str, bytes] = {}
        alone, joined = [], []
        for f in fragments:  # one without white space before it, or that may end in some, can't stand between others
            (joined if f[0] in ASCII_SPACE and "!" <= f[-1] <= "~" else alone).append(f)
        out.update(zip(alone, self.ids_of(alone)))
        while joined:
            n, chars = 0, 0
            while n < len(joined) and chars < 1 << 16:
                chars += len(joined[n])
                n += 1
            now, joined = joined[:n], joined[n:]
            ids = np.frombuffer(self.ids_of(["".join(now)])[0], dtype=self.dtype)
            ends = np.cumsum([len(f) if f.isascii() else len(f.encode()) for f in now])
            done = np.cumsum(self.lengths[ids])
            at = np.searchsorted(done, ends)
            if len(ids) == 0 or at[-1] != len(ids) - 1 or not np.array_equal(done[at], ends):
                raise ValueError("a token crosses a forced boundary")
            raw, edges = ids.tobytes(), (self.dtype.itemsize * np.concatenate(([0], at + 1))).tolist()
            out.update((f, raw[a:b]) for f, a, b in zip(now, edges, edges[1:]))
        return out

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each whole text, as little-endian integers of dtype's width. Null counts as empty."""
        at = 0
        while at < len(texts):
            chars, end = 0, at
            while end < len(texts) and chars < PORTION:
                chars += len(texts[end] or "")
                end += 1
            yield from self._portion(texts[at:end])
            at = end

    def _portion(self, texts: list[str | None]) -> Iterator[bytes]:
        if len(self.known) > self.limit:
            self.older, self.known = self.known, {}
        known = self.known
        raw = [(t or "").encode() for t in texts]
        bounds = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join((*raw, b"\0")), dtype=np.uint8)
        edges = self.edges(data, bounds[:-1])
        parted = pa.LargeStringArray.from_buffers(len(edges), pa.py_buffer(np.append(edges, bounds[-1])), pa.py_buffer(data)).dictionary_encode()
        different = parted.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = set(different).difference(known)
        if new:
            unknown = new.difference(self.older)
            known.update((f, self.older[f]) for f in new - unknown)
            if unknown:
                known.update(self.learn(unknown))
        ids = list(map(known.__getitem__, different))
        for f in new:
            if len(f) > self.key_chars:
                del known[f]
        which = parted.indices.to_numpy()
        lengths = np.array([*map(len, ids)], dtype=np.int64) // self.dtype.itemsize
        n = np.take(lengths, which)
        done = np.cumsum(n)
        at = np.repeat(np.take(np.cumsum(lengths) - lengths, which) - done + n, n)
        at += np.arange(len(at))
        out = np.take(np.frombuffer(b"".join(ids), dtype=self.dtype), at)
        ends = np.concatenate(([0], done))[np.searchsorted(edges, bounds)].tolist()
        for a, b in zip(ends, ends[1:]):
            yield out[a:b].tobytes()

    def encode_lists(self, texts: pa.Array) -> Iterator[pa.Array]:
        """The ids of each text as lists of int, in arrays of texts of about LIST_PORTION bytes."""
        sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // LIST_PORTION)) + 1
        for a, b in pairwise([0, *cuts.tolist(), len(texts)]):
            parts = list(self.encode_many(texts.slice(a, b - a).to_pylist()))
            offsets = np.cumsum([0, *map(len, parts)]) // self.dtype.itemsize
            yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), self.dtype).astype(np.int32)))

    def forget(self) -> None:
        """Drop the fragments that are held. Spark keeps a task's Python worker for the tasks of later stages, which have no use for them."""
        self.known, self.older = {}, {}
        pa.default_memory_pool().release_unused()

    def encode_bytes(self, text: str | None) -> bytes:
        return next(self.encode_many([text]))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype=self.dtype)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes U+FFFD."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def loaded(path: str) -> ForcedBoundaryBpe:
    """One encoder in each Python worker."""
    return ForcedBoundaryBpe(path)


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids (array of int) of the whole text. A null text gives no ids; other columns are kept as they are.

    ``tokenizer`` is the path of the JSON file on every machine. An existing column named like ``ids``, in any case of letters, is
    replaced; other names may hold any characters. Only the text travels to Python.
    """

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = loaded(tokenizer)
        try:
            for texts in batches:
                yield from bpe.encode_lists(texts)
        finally:
            bpe.forget()

    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() != ids.lower()]
    return docs.select(*kept, encoded(F.col(quoted(text)).cast("string")).alias(ids))


def decode_documents(docs: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with the text of a column of ids; null ids give the empty text. A column named like ``text``, in any case, is replaced."""

    @F.pandas_udf("string")
    def texts(column):
        bpe = loaded(tokenizer)
        return column.map(lambda x: "" if x is None else bpe.decode(np.asarray(x)))

    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() != text.lower()]
    return docs.select(*kept, texts(F.col(quoted(ids))).alias(text))


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: the text is encoded, and decoded again from the ids alone.

    One row for each row of docs, repeated rows and null ids included; a null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            n, digests, decoded = [], [], []
            for encoded in bpe.encode_many(batch.column(1).to_pylist()):
                ids = np.frombuffer(encoded, bpe.dtype).tolist()
                n.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of documents, one row each, as ``round_trip`` gives them: a null text counts as empty and has no ids, texts are encoded whole,
    repeated rows and null ids stay rows of their own, other columns have no say, and an empty table gives no rows."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
