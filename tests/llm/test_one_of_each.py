"""The pipeline's near-duplicate stage: similarity 0.8 exactly, nothing below it, rows rather than ids."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline as C
from verdictlake.llm import simhash as S

DOC = "doc_id long, text string"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    """Kept ids: the smallest of each group that similarities of 0.8 or more link."""
    ids, root = sorted(texts), {i: i for i in texts}
    sets = {i: shingles(t) for i, t in texts.items()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b:
                both = len(sets[a] & sets[b])
                if both * 10 >= (len(sets[a]) + len(sets[b]) - both) * 8:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def stage(spark, df):
    return C.drop_near_duplicates(spark, df, "")


def test_links_at_exactly_eight_tenths_and_not_below(spark):
    rng = random.Random(3)
    docs = []
    for k in range(150):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(94)]
        docs.append((k, " ".join(w)))
        changed = 10 if k % 2 else 11  # 80 of 100 shingles, 79 of 101
        docs.append((1000 + k, " ".join(w[:-changed] + [f"v{rng.randint(0, 10**6)}" for _ in range(changed)])))
    kept = {r.doc_id for r in stage(spark, spark.createDataFrame(docs, DOC)).collect()}
    assert kept == brute(dict(docs)) == {*range(150), *range(1000, 1150, 2)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("data", [DATA, DATA.replace("sf0.001", "sf0.01")])
def test_same_groups_as_brute_force(spark, data):
    """No pair of similarity 0.8 or more is lost, and no other document goes: the rows that stay are those of brute force."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = stage(spark, docs)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == brute({r.doc_id: r.text for r in docs.collect()})


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "TEXTS", 5)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    docs = []
    for k in range(60):
        w = list(base)
        for at in rng.sample(range(300), 5):
            w[at] = f"x{rng.randint(0, 9)}"
        docs.append((k, " ".join(w)))
    docs += [(100 + k, t) for k, t in docs[:20]] + [(200, None), (201, ""), (202, "few words")]
    kept = {r.doc_id for r in stage(spark, spark.createDataFrame(docs, DOC)).collect()}
    assert kept == brute({k: t or "" for k, t in docs})


def test_forest_of_sets_against_pairs():
    rng = random.Random(6)
    sets = [np.array(sorted(rng.sample(range(14), rng.randint(0, 12))), np.uint64) for _ in range(120)]
    root = list(range(len(sets)))
    for a, b in S.similar(sets, 80):
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    want = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both * 10 >= 8 * (len(sets[a]) + len(sets[b]) - both):
                want = [min(want[a], want[b]) if r in (want[a], want[b]) else r for r in want]
    assert root == want and len(set(want)) < len(sets)


def test_rows_without_an_id_or_with_a_shared_one_are_judged_one_by_one(spark):
    docs = [(1, "same words in every copy of it"), (None, "same words in every copy of it"), (None, "all alone here and nowhere else"), (7, "a b c d e f"), (7, "same words in every copy of it"), (8, "twice the very same row"), (8, "twice the very same row")]
    kept = stage(spark, spark.createDataFrame(docs, DOC)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("1", docs[0][1]), ("7", docs[3][1]), ("8", docs[5][1]), ("None", docs[2][1])]
