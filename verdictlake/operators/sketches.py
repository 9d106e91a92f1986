"""Aggregates that merge: sketches kept by day and source, so that a report over any days reads sketches instead of rows; and grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14


def daily(rows: DataFrame, by: list[str], value: Column, amount: Column) -> DataFrame:
    """A row a group: n, the sketch of distinct values, and the sketch of amounts."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(value, LG_K).alias("distinct_sketch"), F.kll_sketch_agg_double(amount).alias("amount_sketch"))


def merged(kept: DataFrame, by: list[str], share: float = 0.5) -> DataFrame:
    """n, about how many distinct values, and about the amount that `share` of the rows stay within."""
    both = kept.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("d"), F.kll_merge_agg_double("amount_sketch").alias("a"))
    return both.select(*by, "n", F.hll_sketch_estimate("d").alias("distinct"), F.kll_sketch_get_quantile_double("a", F.lit(share)).alias("amount"))


def report(results: DataFrame, sets: list[list[str]], status: Column) -> DataFrame:
    """total, passed and failed for every one of the sets of columns, in one pass; `level` is grouping_id's number of the set."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = results.withColumn("_status", status).groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("_status") == "pass").alias("passed"), F.count_if(F.col("_status") == "fail").alias("failed"))
