"""Keyed tables that are changed in place: hash buckets of namespaces, of which a write reads and replaces only those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.operators.relational import upsert

BUCKETS = 256


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("namespace"), F.lit(buckets)).cast("int"))


def create(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes a new table with columns namespace and id, of one row a key."""
    _bucketed(rows, buckets).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("bucket").parquet(path)


def write_in_place(rows: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """Replaces the rows with the same (namespace, id), adds the others, and leaves the rest of the table alone; gives the buckets it wrote.

    Of rows with the same key the greatest (by all columns, in order) is written. Keys of a namespace that aren't written again stay.
    Readers see a bucket's old files or its new ones; only the buckets of the rows' namespaces are read at all.
    """
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in ("namespace", "id")]
    new = _bucketed(rows, buckets).groupBy("namespace", "id", "bucket").agg(F.max(F.struct(*rest)).alias("_new")).select("namespace", "id", "bucket", *(F.col(f"_new.{c}").alias(c) for c in rest))
    touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # BUCKETS rows at most
    if touched:
        old = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).withColumn("_write", F.lit(0))
        merged = upsert(old.unionByName(new.withColumn("_write", F.lit(1))), ["namespace", "id", "bucket"], "_write")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def read(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")
