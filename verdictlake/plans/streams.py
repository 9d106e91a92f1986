"""Stream queries, run to the end of what is there and read back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.plans.registry import query, table
from verdictlake.streaming import verdicts as S

_VERDICTS = "select event_id, case when value > 50 then 'pass' else 'fail' end status from events where event_type <> 'error'"


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; only a local session may do without spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(root or tempfile.mkdtemp(prefix="stream"), f"stream-{uuid.uuid4().hex}")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    root = folder(spark)
    kind = F.when(F.col("event_type") == "error", "error").otherwise("verdict")
    body = F.to_json(F.struct(kind.alias("type"), F.col("event_id").cast("string").alias("scenario_id"), F.when(F.col("value") > 50, "pass").otherwise("fail").alias("status"), F.col("event_type").alias("message")))
    table(spark, d, "events").select(F.concat(F.lit("data: "), body).alias("value")).write.text(f"{root}/frames")
    run = S.append_verdicts(S.events(S.read_frames(spark, f"{root}/frames")), f"{root}/verdicts", f"{root}/errors", f"{root}/checkpoint")
    run.awaitTermination()
    S.cancel(spark, run, f"{root}/frames", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/verdicts")


@query("verdict_stream", _VERDICTS)
def verdict_stream(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts that a stream has appended."""
    return _stored(spark, d).select(F.col("scenario_id").cast("bigint").alias("event_id"), "status")


@query("verdict_stream_summary", f"select 'complete' type, (select count(*) from events)::int total, count(*) filter (status = 'pass')::int passed, count(*) filter (status = 'fail')::int failed from ({_VERDICTS})")
def verdict_stream_summary(spark: SparkSession, d: str) -> DataFrame:
    """The event that ends a run."""
    return S.run_summary(_stored(spark, d), table(spark, d, "events").count())
