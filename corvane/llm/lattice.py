"""Language model scores from a subword lattice.

The pieces of an existing vocabulary get log probabilities from the training documents: every distinct word is divided by the
tokenizer, and its pieces count as often as the word; then a few rounds of expectation maximisation replace these counts by those
expected over all divisions. (The scores that the vocabulary's file holds are ranks of merges, no log probabilities, so they can't
weigh anything.) A word's probability is the sum over all ways to divide it into pieces, by a forward recursion in log space. No piece crosses the space before a word, so a text's probability is the product over its words and
its end. Words are scored once each; a bounded number of the most frequent ones is held by every task, the others are joined.
"""

from __future__ import annotations

import functools
import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written

#: Every task holds the words that are one in FREQUENT of all words or more, so at most FREQUENT of them, up to so many bytes long.
FREQUENT, FREQUENT_BYTES = 1 << 20, 48
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: Rounds of expectation maximisation.
ROUNDS = 2
#: Cells of a table of word and place that the recursion handles at once.
CELLS = 1 << 17
#: Words of more bytes are gone through place by place, each alone, in space and time in proportion to their length.
LONG = 1 << 12
HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text, parted by ASCII white space."""
    return (text or "").encode().lower().split()


def held_out(doc_id) -> bool:
    """Null ids count as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def piece_bytes(model: str) -> list[bytes | None]:
    """The bytes of each piece, a word's space as b' '; a byte piece is its byte, and control pieces are None."""
    sp = processor(model)
    out: list[bytes | None] = []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            out.append(bytes([int(sp.id_to_piece(i)[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            out.append(None)
        else:
            out.append(sp.id_to_piece(i).replace("▁", " ").encode())
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), total, trained: occurrences of each word in all documents and in those that aren't held out. Empty texts add
    none. A task hands on partial counts, so a frequent word is one row per task and no task holds more than COUNTED words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        out: Counter = Counter()

        def counted() -> pa.RecordBatch:
            words = list(total)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(total.values(), pa.int64()), pa.array([total[w] - out[w] for w in words], pa.int64())], names=["word", "total", "trained"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                total.update(words)
                if held_out(doc_id):
                    out.update(words)
                if len(total) > COUNTED:
                    yield counted()
                    total.clear(), out.clear()
        if total:
            yield counted()

    parts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word binary, total long, trained long")
    return parts.groupBy("word").agg(F.sum("total").alias("total"), F.sum("trained").alias("trained"))


def piece_counts(words: DataFrame, model: str) -> np.ndarray:
    """How often each piece of the vocabulary occurs in the training words, as the tokenizer divides them. The driver gets one
    number for each piece of the vocabulary, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        counts = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            texts = [w.decode() for w in batch.column(0).to_pylist()]
            divided = sp.encode(texts, num_threads=1)
            lengths = np.array([len(d) for d in divided], np.int64)
            if lengths.sum():
                ids = np.concatenate([np.array(d, np.int64) for d in divided])
                np.add.at(counts, ids, np.repeat(batch.column(1).to_numpy(), lengths))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["piece", "n"])

    found = words.where("trained > 0").select("word", "trained").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(processor(model).get_piece_size(), np.int64)
    for r in found:
        counts[r["piece"]] = r["n"]
    return counts


class Lattice:
    """Sums over all divisions of words into pieces with the given natural log probabilities; pieces of equal bytes add up, and the
    first of them gives their place."""

    def __init__(self, pieces: list[bytes | None], log_probs: np.ndarray):
        scores: dict[bytes, float] = {}
        for p, s in zip(pieces, log_probs.tolist()):
            if p:
                scores[p] = float(np.logaddexp(scores[p], s)) if p in scores else s
        self.longest = max(map(len, scores), default=1)
        place = {p: i for i, p in enumerate(scores)}
        self.size = len(place)
        self.pieces = {p: (s, place[p]) for p, s in scores.items()}
        self.tables = {}
        for n in range(1, self.longest + 1):
            of_n = [p for p in scores if len(p) == n]
            if of_n:
                keys = self.hashes(np.frombuffer(b"".join(of_n), np.uint8).reshape(-1, n))
                order = np.argsort(keys)
                places = np.array([place[p] for p in of_n], np.int64)[order]
                self.tables[n] = keys[order], np.array([scores[p] for p in of_n])[order], np.frombuffer(b"".join(of_n), np.uint8).reshape(-1, n)[order], places

    @staticmethod
    def hashes(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            out = out * HASH_BASE + (rows[:, k].astype(np.uint64) + np.uint64(1))
        return out

    def _parts(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """Places of the words that aren't long, those of about equal length together, as many as the recursion handles at once."""
        order = np.array(sorted((i for i, w in enumerate(words) if len(w) < LONG), key=lambda i: len(words[i])), np.int64)
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * (len(words[order[end]]) + 2) <= CELLS:
                end += 1
            yield order[at:end]
            at = end

    def word_log_probs(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word with the space before it."""
        out = np.empty(len(words))
        for part in self._parts(words):
            lengths, hits = self._hits([b" " + words[i] for i in part])
            out[part] = self._forward(lengths, self._steps(lengths, hits))[lengths, np.arange(len(part))]
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = self._along((b" " + w).decode("latin-1"), self.automata[0])[-1]
        return out

    @functools.cached_property
    def automata(self) -> tuple:
        """What finds all pieces of a word, and of one read from its end, in one pass; a byte is the character of its number."""
        import ahocorasick

        both = ahocorasick.Automaton(), ahocorasick.Automaton()
        for p, (score, place) in self.pieces.items():
            text = p.decode("latin-1")
            both[0].add_word(text, (len(p), score, place))
            both[1].add_word(text[::-1], (len(p), score, place))
        for one in both:
            one.make_automaton()
        return both

    @staticmethod
    def _along(text: str, automaton) -> array:
        """Log sums over the divisions of what lies before each place of one word."""
        forward = array("d", [-math.inf]) * (len(text) + 1)
        forward[0] = 0.0
        here, ways = 0, [0.0]
        exp, log = math.exp, math.log
        for at, (k, s, _) in automaton.iter(text):
            if at + 1 != here:
                top = max(ways)
                forward[here] = top if len(ways) == 1 or top == -math.inf else top + log(sum([exp(w - top) for w in ways]))
                here, ways = at + 1, []
            ways.append(forward[at + 1 - k] + s)
        top = max(ways)
        forward[here] = top if len(ways) == 1 or top == -math.inf else top + log(sum([exp(w - top) for w in ways]))
        return forward

    def _count_along(self, word: bytes, times: float, out: np.ndarray) -> None:
        """Adds the expected counts of one word: sums from both ends, then every piece at every place."""
        text = word.decode("latin-1")
        forward, backward = self._along(text, self.automata[0]), self._along(text[::-1], self.automata[1])
        n, whole = len(text), forward[-1]
        if whole == -math.inf:
            return
        counts = [0.0] * self.size
        for at, (k, s, place) in self.automata[0].iter(text):
            counts[place] += math.exp(forward[at + 1 - k] + s + backward[n - at - 1] - whole)
        out += times * np.array(counts)

    def expected_counts(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """How often each piece occurs in the words, each so many times, as the mean over all their divisions by probability."""
        out = np.zeros(self.size)
        for part in self._parts(words):
            lengths, hits = self._hits([b" " + words[i] for i in part])
            steps = self._steps(lengths, hits)
            forward, backward = self._forward(lengths, steps), self._backward(lengths, steps)
            whole, weight = forward[lengths, np.arange(len(part))], times[part].astype(float)
            for k, (row, col, slot) in hits.items():
                inside = (col + k <= lengths[row]) & ~np.isneginf(whole[row])
                row, col, slot = row[inside], col[inside], slot[inside]
                _, values, _, places = self.tables[k]
                share = np.exp(forward[col, row] + values[slot] + backward[col + k, row] - whole[row])
                out += np.bincount(places[slot], weights=share * weight[row], minlength=self.size)
        for w, n in zip(words, times.tolist()):
            if len(w) >= LONG:
                self._count_along(b" " + w, float(n), out)
        return out

    def _hits(self, words: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Lengths of the words, and for each length of a piece: word, place and piece of every occurrence."""
        n, lengths = len(words), np.array([len(w) for w in words])
        width = int(lengths.max())
        text = np.zeros((n, width), np.uint8)
        text[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        codes = text.astype(np.uint64) + np.uint64(1)
        hashes = np.zeros((n, width), np.uint64)
        hits = {}
        for k in range(1, min(self.longest, width) + 1):
            hashes = hashes[:, : width - k + 1] * HASH_BASE + codes[:, k - 1 :]
            if k in self.tables:
                keys, _, rows, _ = self.tables[k]
                flat = hashes.reshape(-1)
                slot = np.searchsorted(keys, flat)
                slot[slot == len(keys)] = 0
                hit = np.flatnonzero(keys[slot] == flat)
                row, col = hit // (width - k + 1), hit % (width - k + 1)
                same = np.ones(len(hit), bool)
                for j in range(k):  # equal hashes, equal bytes
                    same &= text[row, col + j] == rows[slot[hit], j]
                if same.any():
                    hits[k] = row[same], col[same], slot[hit[same]]
        return lengths, hits

    def _steps(self, lengths: np.ndarray, hits: dict) -> dict[int, np.ndarray]:
        """For each length of a piece: the log probability of the piece at a place (row) of a word (column)."""
        width, steps = int(lengths.max()), {}
        for k, (row, col, slot) in hits.items():
            steps[k] = np.full((width - k + 1, len(lengths)), -np.inf)
            steps[k][col, row] = self.tables[k][1][slot]
        return steps

    @staticmethod
    def _summed(ways: list[np.ndarray]) -> np.ndarray:
        if len(ways) == 1:
            return ways[0]
        ways = np.stack(ways)
        top = ways.max(axis=0)
        top[np.isneginf(top)] = 0.0
        with np.errstate(divide="ignore"):
            return top + np.log(np.exp(ways - top).sum(axis=0))

    def _forward(self, lengths: np.ndarray, steps: dict[int, np.ndarray]) -> np.ndarray:
        """Log sums over the divisions of what lies before each place (row) of each word (column)."""
        forward = np.full((int(lengths.max()) + 1, len(lengths)), -np.inf)
        forward[0] = 0.0
        for end in range(1, len(forward)):
            ways = [forward[end - k] + steps[k][end - k] for k in steps if k <= end]
            if ways:
                forward[end] = self._summed(ways)
        return forward

    def _backward(self, lengths: np.ndarray, steps: dict[int, np.ndarray]) -> np.ndarray:
        """Log sums over the divisions of what lies from each place to the end of its word."""
        width = int(lengths.max())
        backward = np.full((width + 1, len(lengths)), -np.inf)
        for at in range(width, -1, -1):
            ways = [steps[k][at] + backward[at + k] for k in steps if at + k <= width]
            if ways:
                backward[at] = self._summed(ways)
            backward[at, lengths == at] = 0.0
        return backward


def expected_counts(words: DataFrame, names: list[bytes], log_probs: np.ndarray) -> np.ndarray:
    """How often each piece occurs in the training words, over all their divisions. The driver gets one number for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, counts = Lattice(names, log_probs), np.zeros(len(names))
        for batch in batches:
            counts += lattice.expected_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy())
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["piece", "n"])

    found = words.where("trained > 0").select("word", "trained").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(names))
    for r in found:
        counts[r["piece"]] = r["n"]
    return counts


def lattice_scores(docs: DataFrame, model: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs; score is a log10 probability.

    ``model`` is the path of a sentencepiece model on every machine; rounds: of expectation maximisation over the training words, none
    leaves the counts of one division of each word. Pieces are smoothed by adding one to each count, so every text
    has a probability; the end of a text is one more piece. A null text is empty and has its end only; repeated rows count each.
    Without training documents all counts are zero. Words of any length are scored whole.
    """
    spark = docs.sparkSession
    words = written(word_counts(docs), shared_dir(spark))
    n_docs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id")).agg(F.count_if(F.crc32("id") % 7 != 2)).first()[0]
    row = words.agg(F.sum("trained"), F.count_if(F.col("trained") > 0), F.sum("total")).first()
    train_tokens = (row[0] or 0) + n_docs
    distinct = (row[1] or 0) + (1 if n_docs else 0)
    unit = np.log10(train_tokens + distinct + 1)
    pieces = piece_bytes(model)
    counts = piece_counts(words, model)
    names: dict[bytes, int] = {}
    place = np.array([-1 if not p else names.setdefault(p, len(names)) for p in pieces])
    shared = np.bincount(place[place >= 0], minlength=len(names))  # pieces of equal bytes are one, smoothed once each
    used = np.bincount(place[place >= 0], weights=counts[place >= 0], minlength=len(names))
    log_total = lambda n: np.log(float(n.sum() + n_docs + shared.sum() + 1))
    for _ in range(rounds if row[0] else 0):
        used = expected_counts(words, list(names), np.log(used + shared) - log_total(used))
    log_total = log_total(used)
    log_probs, pieces = np.log(used + shared) - log_total, list(names)
    end_score = float((np.log(n_docs + 1.0) - log_total) / np.log(10))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, log_probs)
        for batch in batches:
            found = lattice.word_log_probs(batch.column(0).to_pylist()) / np.log(10)
            base = np.log10(batch.column(2).to_numpy() + 1.0) - unit
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base), pa.array(found)], names=["word", "total", "trained", "base", "lattice"])

    table_of = written(words.select("word", "total", "trained").mapInArrow(scored, "word binary, total long, trained long, base double, lattice double"), shared_dir(spark))
    often = (F.octet_length("word") <= FREQUENT_BYTES) & (F.col("total") * FREQUENT >= (row[2] or 0))
    top = table_of.where(often).select("word", "trained", "base", "lattice").toArrow()
    frequent = spark.sparkContext.broadcast((top.column("word").combine_chunks(), top.column("trained").to_numpy(), top.column("base").to_numpy(), top.column("lattice").to_numpy()))
    end_base = float(np.log10(n_docs + 1.0) - unit)

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, trained, base, lattice = frequent.value
        place = dict(zip(names.to_pylist(), range(len(names))))
        part, row = None, 0
        for batch in batches:
            columns: list[list] = [[] for _ in range(9)]
            for part, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = words_of(text)
                at = list(map(place.get, found))
                rare = Counter(w for w, a in zip(found, at) if a is None) if None in at else {}
                known = np.array([a for a in at if a is not None] if rare else at, np.int64)
                values = ((part << 40) + row, doc_id, held_out(doc_id), len(found) + 1, int((trained[known] > 0).sum()), float(base[known].sum()), float(lattice[known].sum()), list(rare), list(rare.values()))
                for c, v in zip(columns, values):
                    c.append(v)
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "lattice", "rare", "times"])

    rows = docs.select(F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, lattice double, rare array<binary>, times array<long>"
    rows = written(rows.mapInArrow(partly, schema), shared_dir(spark))
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rest = rare.join(table_of.select("word", "trained", F.col("base").alias("b"), F.col("lattice").alias("l")), "word").groupBy("row").agg(
        F.sum(F.when(F.col("trained") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.col("b")).alias("b"), F.sum(F.col("times") * F.col("l")).alias("l")
    )
    whole = rows.drop("rare", "times").join(rest, "row", "left")
    ends_known = 1 if n_docs else 0
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0)) + ends_known).cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) + end_base).alias("base_score"), (F.col("lattice") + F.coalesce("l", F.lit(0.0)) + end_score).alias("score"),
    )


def op6_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of documents, as ``lattice_scores`` gives them; an empty table gives no rows."""
    import public_tokenizers

    return lattice_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
