"""Every operator and pipeline stage on tables with clashing columns, repeated rows, null ids and no rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from verdictlake.llm import collocations, decontamination, divergence, html_extraction, langid, licenses, media, quality, sentencepiece_codec, sharding, simhash, toxicity, url_filters

CLASHES = "row_key row_key_ shard row_hash key k u v fp sid root node of lang_pred score block w0 judged _key _n _part phrase term ids".split()
WORDS = "the sea is wide and cold while winds of autumn carry leaves over the old stone bridge near our quiet village green".split()


def text(k):
    return " ".join(WORDS[(k * 7 + j * (k % 5 + 1)) % len(WORDS)] + (f"x{k}" if j % 3 == 0 else "") for j in range(30))


ROWS = [(None, text(1), "en", "a", 1), (None, text(2), "en", "a", 1), (3, text(3), "en", None, 1), (3, text(3), "en", None, 1), (3, text(4), "de", "b", 1), (5, None, None, "b", 1), (6, "", "de", "", 1), (None, None, None, None, None), *((10 + k, text(10 + k), "en" if k % 2 else "de", "c", k) for k in range(12))]


def table(spark, rows=ROWS):
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return base.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    table(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (3, 1, 0), (10, 1, 0), (11, 0, 1), (None, 1, 0), (12, 1, 0), (13, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, text(4)), (None, text(12))], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


OPERATORS = {
    "decontamination": lambda s, d, r: decontamination.contaminated(d, s.read.parquet(f"{r}/benchmark.parquet")),
    "licenses": lambda s, d, r: licenses.scan(d),
    "sharding": lambda s, d, r: sharding.extendible_shards(d, 500),
    "simhash": lambda s, d, r: simhash.near_duplicates(d),
    "toxicity": lambda s, d, r: toxicity.score(d, toxicity.learn(d, s.read.parquet(f"{r}/labels.parquet"), F.lit(True))),
    "sentencepiece": lambda s, d, r: sentencepiece_codec.encode(d, sentencepiece_codec.Vocabulary.load()),
    "quality": lambda s, d, r: quality.score(d, quality.learn(d, s.read.parquet(f"{r}/labels.parquet"), F.lit(True))),
    "html": lambda s, d, r: html_extraction.extract(d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h/"), "doc_id").alias("url"), F.col("text").alias("html"), *CLASHES)),
    "language": lambda s, d, r: langid.predict(d, langid.learn(d, F.lit(True))),
    "media": lambda s, d, r: media.media_columns(d),
    "divergence": lambda s, d, r: divergence.audit(d),
    "urls": lambda s, d, r: url_filters.judge(d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h/"), "doc_id").alias("url"), *CLASHES), d.select(F.lit("http://h/3").alias("url"))),
    "collocations": lambda s, d, r: collocations.collocations(d, least=2),
}
EACH = {"licenses", "sharding", "simhash", "toxicity", "sentencepiece", "quality", "html", "language", "media", "urls"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators_on_hard_tables(spark, sf_dir, name):
    plain = OPERATORS[name](spark, table(spark).drop(*CLASHES) if name not in ("html", "urls") else table(spark), sf_dir)
    got = OPERATORS[name](spark, table(spark), sf_dir)
    assert got.columns == plain.columns
    rows = sorted(map(repr, got.collect()))
    assert rows == sorted(map(repr, plain.collect()))  # columns of such names change nothing
    if name in EACH:
        assert len(rows) == len(ROWS)
    assert OPERATORS[name](spark, table(spark, []), sf_dir).count() == 0


@pytest.mark.parametrize(("name", "stage"), C.STAGES)
def test_stages_on_hard_tables(spark, sf_dir, name, stage):
    docs = table(spark)
    got = stage(spark, docs, sf_dir)
    rows = got.collect()
    if name != C.STAGES[-1][0]:
        assert got.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in rows for c in CLASHES)
        there = [tuple(r) for r in docs.collect()]
        assert all(tuple(r) in there for r in rows) and len(rows) <= len(there)
    assert stage(spark, table(spark, []), sf_dir).count() == 0


def test_shards_hold_every_row_as_often_as_it_is_there(spark, tmp_path):
    docs = table(spark)
    name = sharding.write_shards(docs, f"{tmp_path}/shards", 700)
    assert name == "shard_"
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(repr, back.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    folders = [f for f in os.listdir(f"{tmp_path}/shards") if f.startswith("shard_=")]
    assert len(folders) > 3
    folder = F.regexp_extract("_metadata.file_path", "shard_=([^/]+)", 1)  # read as numbers, bits would lose their zeros
    sizes = back.groupBy(folder).agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n"), F.count_distinct(F.struct("doc_id", "text")).alias("d")).collect()
    assert all(r.n <= 700 or r.d <= 1 for r in sizes)


def test_repeated_rows_are_learned_once_and_languages_are_bounded(spark, monkeypatch):
    rows = [(1, text(1), "en")] * 3000 + [(k, text(k), "en") for k in range(2, 40)] + [(50, text(50), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once = langid.learn(docs.dropDuplicates(), F.lit(True))
    again = langid.learn(docs, F.lit(True))
    assert json.dumps([*once.langs]) == json.dumps([*again.langs]) == '["en", "xx"]'
    assert (once.bits == again.bits).all()
    monkeypatch.setattr(langid, "LANGS", 1)
    assert list(langid.learn(docs, F.lit(True)).langs) == ["en"]
