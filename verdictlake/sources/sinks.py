"""Sinks: appends, keyed upserts, CSV and feature exports."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.functions.text import csv_line
from verdictlake.operators.gherkin import HEADER, csv_lines
from verdictlake.operators.relational import create_if_absent, upsert


def append(rows: DataFrame, path: str) -> None:
    """Append-only tables: sessions, files, verdicts, messages."""
    rows.write.mode("append").parquet(path)


def append_if_absent(rows: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the table doesn't have."""
    append(create_if_absent(rows.sparkSession.read.parquet(path), rows, key), path)


def upsert_vectors(rows: DataFrame, path: str, new_path: str) -> None:
    """Writes the table with the rows' keys replaced to a new place; readers move over once it is whole. Keys not written again stay."""
    spark = rows.sparkSession
    old = spark.read.parquet(path).withColumn("_write", F.lit(0))
    upsert(old.unionByName(rows.withColumn("_write", F.lit(1))), ["namespace", "id"], "_write").write.parquet(new_path)


def write_csv(steps: DataFrame, path: str, key: str) -> None:
    """The export: a header without quotes, then each scenario's line with every field in quotes, in order. The files are sorted by range, so no task has all."""
    lines = csv_lines(steps).select(key, "pos", F.col("line").alias("value"))
    header = steps.sparkSession.range(1).select(F.lit(None).cast(lines.schema[key].dataType).alias(key), F.lit(-1).cast(lines.schema["pos"].dataType).alias("pos"), F.lit(HEADER).alias("value"))
    header.unionByName(lines).orderBy(F.asc_nulls_first(key), "pos").select("value").write.text(path)


def write_features(texts: DataFrame, path: str, key: str, text: str) -> None:
    """One folder a key with its feature text."""
    texts.select(F.col(key), F.col(text).alias("value")).write.partitionBy(key).text(path)


REPORT = "AC Clause,Scenario,Status,Justification,Code Reference,Implementation Suggestion,RAG Context"


def report_lines(rows: DataFrame) -> DataFrame:
    """Adds `line`, a row of the traceability report, to rows of clause, scenario and verdict; what is missing is empty."""
    return rows.withColumn("line", csv_line(*(F.col(c) for c in ("source_ac_clause", "scenario_title", "status", "justification", "code_reference", "implementation_suggestion", "context"))))


def once(df: DataFrame) -> DataFrame:
    """The rows, worked out now and kept in the folder that all executors share, so that what they took to make (a model's answer) isn't made again.

    The folder is that of spark.checkpoint.dir; only a local session may do without it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="once"))
    return df.checkpoint()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder with all below it, through the file system that the path names; False if it isn't there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
