"""The corpus pipeline: documents in, piece ids of the documents worth training on out.

STAGES names the steps in order. Each takes (spark, docs, sf_dir) and returns documents with the columns they came with, but
for the last, which returns doc_id, ids, n_tokens and exact. Each is written and read again before the next one.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from verdictlake.llm import common, decontamination, quality, queries, sentencepiece_codec, simhash, toxicity
from verdictlake.sources.sinks import remove

#: Near-duplicates: texts that share 80 % of their sets of five-word shingles. Candidates come from 192-bit fingerprints, in
#: which such texts differ by 29 bits on average (their standard deviation is 5): all up to 35, from probes in all three words,
#: and those up to 51 that agree but for two bits in one of twelve partitions (all but 6 in 100,000 of those at 0.8).
NEAR = {"shingle": 5, "percent": 80, "words": 3, "distance": 51, "probe_distance": 11, "probes": 3}


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality of 0.5 or more."""
    return quality.accepted(docs, queries.quality_model(spark, sf_dir))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.3."""
    return toxicity.accepted(docs, queries.toxicity_index(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that similarities of 0.8 or more link."""
    return simhash.one_of_each(docs, **NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontamination.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's pieces."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.Vocabulary.load())


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pieces", encode_pieces),
]

#: SQL can express neither the trained stages nor the piece search; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; the steps in between are Parquet in the folder that all executors share.

    Each step goes once the next one is written; the last one stays, as the returned rows are read from it.
    """
    folder = os.path.join(common.shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    old = None
    for name, stage in before:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if old is not None:
            remove(spark, old)
        old = path
    return last(spark, docs, sf_dir)
