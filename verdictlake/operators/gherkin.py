"""Gherkin: segmentation, step tables, rendering, CSV and feature exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictlake.functions.text import csv_line, strip

HEADER = "Feature,Scenario,Given,When,Then,Expected Result"
_START = r"(?d)^[ \t\r\n]*Scenario(?:\s+Outline)?\s*:"


def segments(text: Column) -> Column:
    """array<struct<title, text>>: from each scenario's header to the next. A header without a title takes the next line that isn't blank, even if that is a header."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?md)(?=^[ \t]*Scenario(?:\s+Outline)?\s*:)", -1)
    bare = r"(?d)^\s*Scenario(?:\s+Outline)?\s*:\s*$"
    joined = F.aggregate(
        F.filter(parts, lambda p: p.rlike(_START)),
        F.array().cast("array<string>"),
        lambda a, p: F.when((F.size(a) > 0) & F.get(a, F.size(a) - 1).rlike(bare), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(F.get(a, F.size(a) - 1), p)))).otherwise(F.concat(a, F.array(p))),
        # a header at the end without a title starts nothing
        lambda a: F.when((F.size(a) > 1) & F.get(a, F.size(a) - 1).rlike(bare), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 2, F.lit(0))), F.array(F.concat(F.get(a, F.size(a) - 2), F.get(a, F.size(a) - 1))))).otherwise(a),
    )
    titled = F.transform(joined, lambda p: F.struct(strip(F.regexp_extract(p, r"(?d)^\s*Scenario(?:\s+Outline)?\s*:\s*([^\n]+)", 1)).alias("title"), strip(p).alias("text")))
    return F.filter(titled, lambda s: s["title"] != "")


def scenarios(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each scenario: key, pos, scenario_id (a hash of key and place, so that it stays the same), title, text."""
    return df.select(key, F.posexplode(segments(F.col(text))).alias("pos", "s")).select(key, F.col("pos").cast("bigint").alias("pos"), F.sha2(F.concat_ws("#", F.col(key).cast("string"), F.col("pos").cast("string")).cast("binary"), 256).alias("scenario_id"), "s.title", "s.text")


def steps(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each scenario: key, pos, feature, scenario, given, when, then; And and But go with the step before.

    Lines get the feature and scenario they stand in by window functions within their document. A scenario belongs to the
    feature above it.
    """
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "raw")).withColumn("t", strip(F.col("raw"))).filter((F.col("t") != "") & ~F.col("t").startswith("#"))
    t = F.col("t")
    word = F.when(t.startswith("Given "), "given").when(t.startswith("When "), "when").when(t.startswith("Then "), "then")
    is_scenario = t.rlike("^Scenario( Outline)?:")
    order = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select(key, "line", "t", word.alias("word"), is_scenario.alias("is_scenario"), F.last(F.when(t.startswith("Feature:"), F.regexp_replace(t, r"^Feature:\s*", "")), ignorenulls=True).over(order).alias("feature"), F.sum(is_scenario.cast("int")).over(order).alias("pos"))
    within = Window.partitionBy(key, "pos").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.coalesce(F.col("word"), F.when(t.rlike("^(And|But) "), F.last("word", ignorenulls=True).over(within)))
    rows = marked.filter("pos > 0").withColumn("kw", kept)
    gathered = lambda w: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kw") == w, F.struct("line", "t")))), lambda x: x["t"]), "\n").alias(w)
    return rows.groupBy(key, "pos").agg(F.coalesce(F.max(F.when(F.col("is_scenario"), F.col("feature"))), F.lit("")).alias("feature"), F.max(F.when(F.col("is_scenario"), F.regexp_replace(t, r"^Scenario( Outline)?:\s*", ""))).alias("scenario"), gathered("given"), gathered("when"), gathered("then")).filter(F.col("scenario") != "")


def csv_lines(steps_: DataFrame) -> DataFrame:
    """Adds `line`, all six fields in quotes and the last one empty."""
    return steps_.withColumn("line", csv_line(F.col("feature"), F.col("scenario"), F.col("given"), F.col("when"), F.col("then"), F.lit("")))


def change_headers(rows: DataFrame, key: str) -> DataFrame:
    """Adds `header`, set where the feature differs from the row before in its document."""
    before = F.lag("feature").over(Window.partitionBy(key).orderBy("pos"))
    return rows.withColumn("header", F.when(before.isNull() | (before != F.col("feature")), F.concat(F.lit("Feature: "), F.col("feature"))))


def render(scenarios_: Column) -> Column:
    """Gherkin text of an array of scenario structs in order; a feature's header is repeated when it comes back after another."""
    block = F.transform(
        scenarios_,
        lambda s, i: F.concat(
            F.when((i == 0) | (F.get(scenarios_, i - 1)["feature"] != s["feature"]), F.concat(F.when(i > 0, F.lit("\n")).otherwise(""), F.lit("Feature: "), s["feature"], F.lit("\n\n"))).otherwise(""),
            F.lit("  # Source AC: "), s["source_ac_clause"], F.lit("\n  Scenario: "), s["scenario"], F.lit("\n    "), s["given"], F.lit("\n    "), s["when"], F.lit("\n    "), s["then"], F.lit("\n"),
        ),
    )
    return strip(F.array_join(block, "\n"))
