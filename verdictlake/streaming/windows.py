"""Windows over event time, with a watermark: rows may come out of order, and those that come too late are set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, time: str, delay: str, size: str, *keys: str, **aggregates) -> DataFrame:
    """Aggregates by window and keys; a window is final, and written once, when the watermark has passed its end."""
    grouped = events.withWatermark(time, delay).groupBy(F.window(time, size), *keys).agg(*(c.alias(name) for name, c in aggregates.items()))
    return grouped.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def sessions(events: DataFrame, time: str, delay: str, gap: str, *keys: str, **aggregates) -> DataFrame:
    """The same by session: a key's events that follow each other within the gap."""
    grouped = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(*(c.alias(name) for name, c in aggregates.items()))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, *aggregates)


def write_final(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends windows as they become final."""
    return windows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()


def set_apart_late(events: DataFrame, time: str, delay: str, size: str, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the rows that `tumbling` leaves out over the same batches: those whose window had ended by the watermark of their batch.

    Spark lets rows pass that come after the watermark which the last batch had when it began: the greatest time of the batches before
    that one, less the delay. That time is written with each batch, under its number, and read from there, so that a restart goes
    on with the same one.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = f"{path}/seen"
        before = spark.createDataFrame([(None,)], f"t {batch.schema[time].dataType.simpleString()}")
        if number:
            before = spark.read.parquet(f"{seen}/batch={number - 1}")
        passed = spark.read.parquet(f"{seen}/batch={number - 2}") if number > 1 else before.limit(0)
        kept = batch.persist()
        try:
            mark = passed.agg((F.max("t") - F.expr(f"interval {delay}")).alias("mark"))
            ending = kept.select(F.struct(*kept.columns).alias("row"), F.window(time, size)["end"].alias("end"))
            late = ending.join(F.broadcast(mark), F.col("end") <= F.col("mark"), "left_semi").select("row.*")  # mark is one row
            late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            kept.agg(F.max(time).alias("t")).unionByName(before).agg(F.max("t").alias("t")).write.mode("overwrite").parquet(f"{seen}/batch={number}")
        finally:
            kept.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def late_rows(events: DataFrame, path: str) -> DataFrame:
    """The rows set apart so far."""
    return events.sparkSession.read.schema(events.schema).parquet(f"{path}/late")
