"""Token counts kept by deltas.

A store holds signed deltas of additive totals by source, language and tokenizer version. A batch of changes (inserts, deletes,
revised counts) is aggregated and committed under its id; committing an id again replaces the same folder by the same content, so
retries and replays change nothing. Totals are the sum of a compacted base and the deltas that it does not hold; the base names the
batches folded into it, so one that arrives late, below the newest, still counts, and once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import loaded
from .common import quoted, shared_dir, table, written
from .mixing import word_count

KEYS = ("source", "lang", "tokenizer")
#: Documents of fewer words are deleted in the query's last batch.
SHORT = 20
CHANGE = "source string, lang string, tokenizer string, op string, old_tokens long, new_tokens long"
DELTA = "source string, lang string, tokenizer string, docs long, tokens long, changes long"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed totals by key of rows (source, lang, tokenizer, op, old_tokens, new_tokens).

    An insert adds a document and its new tokens, a delete takes a document and its old tokens away, a revision adds the difference.
    Null keys are keys of their own, null counts are zero, and an unknown op stops the job. A key of any size is pre-aggregated.
    """
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
    old = F.when(F.col("op") == "insert", F.lit(0)).otherwise(F.coalesce("old_tokens", F.lit(0)))
    new = F.when(F.col("op") == "delete", F.lit(0)).otherwise(F.coalesce("new_tokens", F.lit(0)))
    return changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("docs"), F.sum(new - old).cast("long").alias("tokens"), F.count(F.lit(1)).alias("changes"))


class RollupStore:
    """Deltas and compacted bases in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _ids(self, kind: str) -> list[int]:
        """Ids that are committed: Spark leaves _SUCCESS when a write has ended whole."""
        jvm, files = self._files()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        if not files.exists(top):
            return []
        names = [s.getPath().getName() for s in files.listStatus(top)]
        return sorted(int(n) for n in names if n.isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _base(self) -> tuple[int, set[int]]:
        """Number of the newest base that is whole, and the batches in it. It is whole once its list of batches is written; the list
        holds runs of ids, so batches without gaps are one row."""
        bases = self._ids("folded")
        if not bases:
            return 0, set()
        runs = self.spark.read.schema("first long, last long").parquet(f"{self.path}/folded/{bases[-1]:012d}").collect()
        return bases[-1], {i for r in runs for i in range(r["first"], r["last"] + 1)}

    def committed(self) -> list[int]:
        """Batches that count."""
        return sorted({*self._ids("deltas"), *self._base()[1]})

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Adds a batch, in any order of ids; False if it counts already, and is left as it is."""
        if batch < 0:
            raise ValueError("ids of batches are not negative")
        if batch in self._base()[1] or batch in self._ids("deltas"):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/deltas/{batch:012d}")
        return True

    def _rows(self) -> DataFrame:
        base, folded = self._base()
        paths = [f"{self.path}/base/{base:012d}"] * bool(base) + [f"{self.path}/deltas/{i:012d}" for i in self._ids("deltas") if i not in folded]
        return self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, changes over all committed batches; keys at zero stay."""
        return self._rows().groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("docs", "tokens", "changes")])

    def compact(self) -> None:
        """Folds all committed batches into a new base. A run that breaks off leaves the old base in force."""
        base, ids = self._base()[0] + 1, self.committed()
        if ids:
            self.totals().write.mode("overwrite").parquet(f"{self.path}/base/{base:012d}")
            firsts, lasts = [i for i in ids if i - 1 not in ids], [i for i in ids if i + 1 not in ids]
            self.spark.createDataFrame(list(zip(firsts, lasts)), "first long, last long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folded/{base:012d}")


def token_counts(docs: DataFrame, tokenizer: str, counts: Mapping[str, str] = {"text": "n_tokens"}) -> DataFrame:
    """docs with the number of tokens of each of some whole texts (counts: text column to the name of its number) in the place of
    these texts; a null text has none. One encoder in a task serves them all."""
    kept = [c for c in docs.columns if c not in {*counts, *counts.values()}]
    rows = docs.select(*[F.col(quoted(c)) for c in kept], *[F.col(quoted(t)).cast("string") for t in counts])
    schema = StructType([*rows.schema.fields[: len(kept)], *[StructField(n, LongType()) for n in counts.values()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer)
        for batch in batches:
            found = [[len(x) // bpe.dtype.itemsize for x in bpe.encode_many(c.to_pylist())] for c in batch.columns[len(kept) :]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[pa.array(n, pa.int64()) for n in found]], names=schema.names)

    return rows.mapInArrow(run, schema)


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents, each under two tokenizer versions: inserts; revised counts of texts that hold a repeated
    line, which they lose; deletes of documents of fewer than SHORT words by then. The first arrives late, after a compaction, and
    the last is committed twice. Null texts have no words and are deleted; null sources and languages are keys of their own."""
    import public_tokenizers

    lines = F.split("text", "\n", -1)
    now = F.when(F.size(F.array_distinct(lines)) < F.size(lines), F.array_join(F.array_distinct(lines), "\n"))
    docs = table(spark, sf_dir, "documents").select("source", "lang", word_count(F.col("text")).alias("words"), F.col("text"), now.alias("now"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = docs.select("source", "lang", "words", "text", "now", word_count(F.col("now")).alias("words_now"), F.col("now").isNotNull().alias("revised"))
    counted = written(token_counts(docs, path, {"text": "tokens", "now": "tokens_now"}), shared_dir(spark))
    sides = F.array(*[F.struct(F.lit(name).alias("tokenizer"), F.col(n).alias("old"), F.when(F.col("revised"), F.col(f"{n}_now")).otherwise(F.col(n)).alias("new")) for name, n in (("words-1", "words"), ("byte_bpe_50k", "tokens"))])
    short = F.when(F.col("revised"), F.col("words_now")).otherwise(F.col("words")) < SHORT
    both = counted.select("source", "lang", "revised", short.alias("short"), F.explode(sides).alias("x")).select("source", "lang", "revised", "short", "x.tokenizer", "x.old", "x.new")
    changes = lambda op, old, new: (F.lit(op).alias("op"), old.cast("long").alias("old_tokens"), new.cast("long").alias("new_tokens"))
    store, none = RollupStore(spark, shared_dir(spark)), F.lit(None)
    deleted = both.where("short").select(*KEYS, *changes("delete", F.col("new"), none))
    store.commit(2, both.where("revised").select(*KEYS, *changes("revise", F.col("old"), F.col("new"))))
    store.commit(3, deleted)
    store.compact()
    store.commit(1, both.select(*KEYS, *changes("insert", none, F.col("old"))))
    store.commit(3, deleted)
    store.compact()
    return store.totals()
