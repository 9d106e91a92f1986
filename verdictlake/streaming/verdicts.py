"""Verdict streams: frames in, verdicts appended batch by batch, errors set apart, a summary at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdictlake.operators.relational import summary
from verdictlake.schemas import EVENT
from verdictlake.sources.sinks import remove


def read_frames(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of the lines of frame files; Spark's text source puts partial lines together."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)


def events(frames: DataFrame, line: str = "value") -> DataFrame:
    """Events out of `data: ` lines. Lines that aren't JSON, or lack a type, are left out."""
    body = F.regexp_extract(F.col(line), r"^data: (.*)$", 1)
    parsed = F.from_json(F.nullif(body, F.lit("")), EVENT)
    return frames.select(parsed.alias("e")).filter(F.col("e.type").isNotNull()).select("e.*")


def append_verdicts(stream: DataFrame, store: str, errors: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's verdicts and errors to their stores; a batch is written once, whole, under its number.

    An error is a row of its own and doesn't stop the verdicts around it. The query stops when all that is there is read.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for kind, path in (("verdict", store), ("error", errors)):
                kept.filter(F.col("type") == kind).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_summary(verdicts: DataFrame, expected: int) -> DataFrame:
    """The event that ends a run: all scenarios that were parsed, and the verdicts by status."""
    counted = summary(verdicts, [], F.col("status"), F.lit(True))
    return counted.select(F.lit("complete").alias("type"), F.lit(expected).cast("int").alias("total"), F.col("passed").cast("int").alias("passed"), F.col("failed").cast("int").alias("failed"))


def running_counts(stream: DataFrame) -> DataFrame:
    """Counts so far by status, for outputMode complete."""
    return stream.filter(F.col("type") == "verdict").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def verify_stream(prompts: DataFrame, verify: Callable[[DataFrame], DataFrame], store: str, checkpoint: str) -> StreamingQuery:
    """Verifies each batch of prompts (with models that look things up, say) and writes its verdicts, whole, under its number.

    A batch that fails leaves nothing behind and is tried again; those before it stay.
    """

    def write(batch: DataFrame, number: int) -> None:
        verify(batch).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return prompts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cancel(spark: SparkSession, query: StreamingQuery, *folders: str) -> None:
    """Stops a stream, if it still runs, and removes what it kept: its checkpoint, and stores nobody reads any more."""
    query.stop()
    for folder in folders:
        remove(spark, folder)
