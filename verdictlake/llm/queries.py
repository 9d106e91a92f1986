"""The queries of this package, over the whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm import collocations, decontamination, divergence, html_extraction, langid, licenses, media, quality, sentencepiece_codec, sharding, simhash, toxicity, url_filters
from verdictlake.llm.common import fold

MIB = 1 << 20


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that share a window."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license mentions."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of at most 64 MiB."""
    return sharding.extendible_shards(_table(spark, sf_dir, "documents"), 64 * MIB)


def sharding_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with shards of at most 64 KiB, so that small tables split too."""
    return sharding.extendible_shards(_table(spark, sf_dir, "documents"), MIB // 16)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint over three-word shingles, and its component at three bits or fewer."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, distance=3)


def toxicity_index(spark: SparkSession, sf_dir: str) -> toxicity.Index:
    return toxicity.learn(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; a quarter of the ids is never learned from."""
    found = toxicity.score(_table(spark, sf_dir, "documents"), toxicity_index(spark, sf_dir))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.array_join("evidence", " ").alias("evidence"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's piece ids, and whether they decode to the text."""
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), sentencepiece_codec.Vocabulary.load())


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Trees:
    return quality.learn(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality; a third of the ids is never learned from."""
    found = quality.score(_table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's article."""
    return html_extraction.extract(_table(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; a quarter of the ids is never learned from."""
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.learn(docs, fold(F.col("doc_id"), 4) != 2))
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as audio: digests of the stored bytes and tensors, the features read back from them, and the segments."""
    return media.media_columns(_table(spark, sf_dir, "documents"), keep=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality": op7_quality,
    "op8_html": op8_html,
    "op9_language": op9_language,
    "op10_media": op10_media,
    "op11_divergence": divergence.query,
    "op12_url_filter": url_filters.query,
    "op13_collocations": collocations.query,
    "sharding_fine": sharding_fine,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE,
    "op2_license_scan": licenses.oracle(),
    "op3_sharding": sharding.oracle(64 * MIB),
    "op11_divergence": divergence.ORACLE,
    "op12_url_filter": url_filters.oracle(),
    "op13_collocations": collocations.ORACLE,
    "sharding_fine": sharding.oracle(MIB // 16),
}
