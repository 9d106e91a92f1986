"""The pipeline's stages and the queries of this package on the smallest tables."""

import math
import os

import pytest
from test_models import brute_scores
from test_one_of_each import brute as one_of_each_brute

import corpus_pipeline as C
from verdictlake.llm import quality, sentencepiece_codec
from verdictlake.llm import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def walk(model, text):
    """The quality by the trees, one node after the other."""
    x, total = quality.statistics(text), model.base
    for f, c, leaf in zip(model.features, model.cuts, model.leaves, strict=True):
        at = 0
        for _ in range(quality.DEPTH):
            at = 2 * at + 1 + int(x[f[at]] > c[at])
        total += leaf[at - (2**quality.DEPTH - 1)]
    return 1 / (1 + math.exp(-total))


def test_stages_in_order_against_brute_force(spark, tmp_path):
    """Each stage's rows, worked out from its input in the plainest way."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, texts, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}, {}
    last, before = None, set(texts)
    for name, stage in C.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        kept[name] = set(ids)
        assert kept[name] <= before and len(ids) == len(kept[name])
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
        last, before = name, kept[name]
    assert last == "pieces" and len(kept["quality"]) > 0.7 * len(texts)
    trees = Q.quality_model(spark, DATA)
    assert kept["quality"] == {k for k, t in texts.items() if walk(trees, t) >= 0.5}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(labels[k].quality for k in kept["quality"] if k in labels)
    index = Q.toxicity_index(spark, DATA)
    examples = [(i, float(labels[int(i)].toxic), texts[int(i)]) for i in sorted(index.ids)]
    wanted = sorted(kept["quality"])
    scores = brute_scores(index, [texts[k] for k in wanted], examples)
    assert kept["toxicity"] == {k for k, s in zip(wanted, scores, strict=True) if s[0] < 0.3}
    assert kept["near_duplicates"] == one_of_each_brute({k: texts[k] or "" for k in kept["toxicity"]})
    leaks = {r.doc_id for r in Q.op1_decontamination(spark, DATA).collect()}
    assert kept["decontamination"] == kept["near_duplicates"] - leaks
    assert kept["pieces"] == kept["decontamination"]
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    for r in docs.collect():
        assert r.exact and list(r.ids) == library.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)


def test_run_gives_what_the_stages_give(spark):
    got = C.run(spark, DATA)
    assert got.columns == ["doc_id", "ids", "n_tokens", "exact"] and got.count() > 0


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = Q.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    cursor = c.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    assert sorted(tuple(str(r[x]) for x in cols) for r in df.collect()) == sorted(tuple(str(r[names.index(x)]) for x in cols) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_queries_return_every_row(spark, name):
    table = "pages" if "html" in name else "documents"
    assert Q.QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()
