"""Append and resume as streams: new input files are read once, a checkpoint tells which, and it holds the state of open windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import leak_tokens, text_checks


def checked(rows: DataFrame, identifiers: list[str], forbidden: list[str], max_words: int) -> DataFrame:
    """rows with leaks, violations and disposition: a leak rejects, a violation is for review. One row in, one row out."""
    rows = rows.withColumns({"leaks": leak_tokens(F.col("text"), identifiers), "violations": text_checks(F.col("text"), forbidden, max_words)})
    return rows.withColumn("disposition", F.when(F.size("leaks") > 0, "reject").when(F.size("violations") > 0, "review").otherwise("accept"))


def arriving(spark: SparkSession, source: str, schema, kind: str = "parquet", files: int | None = None) -> DataFrame:
    """The files of a folder as a stream, Parquet, JSON lines or another kind with a schema; files: so many in a batch, oldest first."""
    reader = spark.readStream.schema(schema).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(source)


def resume(spark: SparkSession, source: str, schema, out: str, checkpoint: str, kind: str = "parquet", **limits) -> None:
    """Decides all input that came since the last call. Each batch is written under its number, so a retried one replaces itself."""
    rows = checked(arriving(spark, source, schema, kind), **limits)

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def counts_by_window(events: DataFrame, at: str, key: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """start, key, n of a stream or table of events; of a stream, windows close once the watermark has passed. A stream's times without
    a zone are taken in the session's, since a watermark needs one."""
    seen = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events
    return seen.groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def resume_counts(spark: SparkSession, source: str, schema, out: str, checkpoint: str, at: str, key: str, late: str = "10 minutes", width: str = "1 hour", kind: str = "parquet", files: int | None = None) -> list[dict]:
    """Counts all events that came since the last call, and appends the windows that are closed now to out (start, key, n).

    The watermark is the latest time of all batches before, less ``late``. A window closes once the watermark has passed its end: its
    count is written once and its state dropped, so the state holds open windows only; an event of a closed window is late and isn't
    counted. Windows, watermark and the files seen live in the checkpoint, and out tells which files belong to finished batches, so a
    call that fails may be made again, and one without new input changes nothing. Returns what each batch reports of its state.
    """
    counts = counts_by_window(arriving(spark, source, schema, kind, files), at, key, late, width)
    stream = counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    reports = [p.stateOperators[0] for p in stream.recentProgress if p.stateOperators]
    return [{"rows": r.numRowsTotal, "dropped": r.numRowsDroppedByWatermark, "closed": r.numRowsRemoved} for r in reports]


def seen_windows(spark: SparkSession, out: str, key: str, of: str = "string") -> DataFrame:
    """start, key, n of all windows closed so far; none before the first is."""
    return spark.read.schema(f"start timestamp, {key} {of}, n bigint").parquet(out)
