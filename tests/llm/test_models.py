"""Quality, toxicity and language: accuracy on unseen rows, exact parts against brute force, hard cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlake.llm import langid, quality, toxicity
from verdictlake.llm.common import fold

DOC = "doc_id long, text string"


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        w = [rng.choice(["the", "of", "and", "in"]) if rng.random() < 0.4 else f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(20, 200))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(1 + len(w) // 40):
                w[rng.randrange(len(w))] = rng.choice(["scum", "trash", "vile" + rng.choice(["ly", "ness", "r"])])
        text = "!! ".join(w).upper() if bad else " ".join(w).capitalize() + "."
        docs.append((k, text))
        labels.append((k, int(not bad), int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame([(*d, "score") for d in docs], DOC + ", label string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r for r in labels}


def test_quality_and_toxicity_on_unseen_rows(spark, tables):
    docs, labels, truth = tables
    seen = fold(F.col("doc_id"), 4) != 2
    for name, place, found, least in (("quality", 1, quality.score(docs, quality.learn(docs, labels, seen)), 0.5), ("toxic", 2, toxicity.score(docs, toxicity.learn(docs, labels, seen)), 0.3)):
        rows = found.withColumn("held", ~seen).filter("held").collect()
        assert len(rows) > 100
        right = sum((r.score >= least) == bool(truth[r.doc_id][place]) for r in rows)
        assert right / len(rows) > 0.95, name
        assert all(0 <= r.score <= 1 for r in rows)


def test_rows_with_nothing_in_them(spark, tables):
    docs, labels, _ = tables
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "\n\n"), (3, "x" * 300_000), (4, "a " * 100_000)], DOC)
    everything = F.lit(True)
    q, t, p = quality.learn(docs, labels, everything), toxicity.learn(docs, labels, everything), langid.learn(docs.withColumn("lang", F.lit("xx")), everything)
    assert quality.score(odd, q).count() == toxicity.score(odd, t).count() == 6
    got = langid.predict(odd, p).collect()
    assert [r.lang_pred for r in got if r.doc_id != 3 and r.doc_id != 4] == ["und"] * 4
    for model, score in ((q, quality.score), (t, toxicity.score)):
        assert score(odd.limit(0), model).count() == 0
        assert all(r.score is not None for r in score(odd, model).collect())
    none = labels.limit(0)
    assert {r.score for r in quality.score(odd, quality.learn(docs, none, everything)).collect()} == {0.5}
    assert {r.score for r in toxicity.score(odd, toxicity.learn(docs, none, everything)).collect()} == {0.0}
    nulls = labels.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    assert {r.score for r in quality.score(odd, quality.learn(docs, nulls, everything)).collect()} == {0.5}
    ones = labels.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
    assert min(r.score for r in quality.score(odd, quality.learn(docs, ones, everything)).collect()) > 0.9
    assert min(r.score for r in toxicity.score(odd, toxicity.learn(docs, ones, everything)).collect()) > 0.9


def test_filters_keep_columns_and_rows(spark, tables):
    docs, labels, truth = tables
    kept = quality.accepted(docs, quality.learn(docs, labels, F.lit(True)))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in truth.items() if r[1]}
    clean = {r.doc_id for r in toxicity.accepted(docs, toxicity.learn(docs, labels, F.lit(True))).collect()}
    assert len(clean ^ {k for k, r in truth.items() if not r[2]}) < 12


def brute_scores(index, texts, examples):
    """The query's scores by the definition, with a dense matrix: cosines over all terms, the K highest, the vote, the fit."""
    names = {t: k for k, t in enumerate(sorted({w for _, _, t in examples for w in toxicity.words(t)}))}
    n, prior = len(examples), sum(y for _, y, _ in examples) / len(examples)

    def counts(text):
        out = np.zeros(len(names))
        for w in toxicity.words(text):
            if w in names:
                out[names[w]] += 1
        return out

    raw = np.array([counts(t) for _, _, t in examples])
    y = np.array([y for _, y, _ in examples])
    df, bad = (raw > 0).sum(0), (raw > 0).T @ y
    lean = np.log((bad + toxicity.SHRINK * prior) / (df - bad + toxicity.SHRINK * (1 - prior))) - np.log(prior / (1 - prior))
    weight = (np.log((1 + n) / (1 + df)) + 1) * (toxicity.BASE + lean**2)

    def unit(c):
        w = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * weight
        return w / max(np.sqrt((w**2).sum()), 1e-12)

    dense = np.array([unit(c) for c in raw])
    place = {i: k for k, i in enumerate(index.ids)}
    at = np.array([place.get(i, n) for i, _, _ in examples])
    out = []
    for t in texts:
        cos = np.round(dense @ unit(counts(t)), 10)
        top = np.lexsort((at, -cos))[: toxicity.K]
        top = top[cos[top] > 0]
        w = 1 / (1.05 - np.minimum(cos[top], 1))
        out.append((float(np.interp((w @ y[top] + prior) / (w.sum() + 1), index.knots, index.levels)) if len(top) else index.empty_score, [examples[k][0] for k in top], cos[top]))
    return out


def test_toxicity_query_against_a_dense_matrix(spark, tables):
    """Every row's score, neighbours and cosines; no text with a known word goes without neighbours."""
    docs, labels, truth = tables
    index = toxicity.learn(docs, labels, fold(F.col("doc_id"), 4) != 2)
    texts = {r.doc_id: r.text for r in docs.collect()}
    examples = [(i, float(truth[int(i)][2]), texts[int(i)]) for i in sorted(index.ids)]
    assert len(examples) > 400 and index.blocks > 8
    got = {r.doc_id: r for r in toxicity.score(docs, index).collect()}
    wanted = sorted(got)
    for k, (score, ids, cos) in zip(wanted, brute_scores(index, [texts[k] for k in wanted], examples), strict=True):
        assert abs(got[k].score - score) < 1e-7 and len(ids) == toxicity.K
        near = [e[1:].split(":") for e in got[k].evidence if e.startswith("#")]
        assert len(near) == 3 and np.allclose([float(e[1]) for e in near], cos[:3], atol=1e-4)
    # blocks are really left out
    dims, weights = index.vector(texts[0])
    rows, cosines = index.nearest([(dims, weights)])[0]
    assert len(rows) == toxicity.K and (np.diff(cosines) <= 0).all()


def test_isotonic_rises_and_fits():
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])
    knots, levels = toxicity.isotonic(x, np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(levels) >= 0).all() and len(knots) == len(levels) and levels[0] < 0.5 < levels[-1]


def test_trees_match_a_walk_row_by_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.Trees.fit(x, y)
    raw = []
    for row in x[:50]:
        total = model.base
        for f, c, leaf in zip(model.features, model.cuts, model.leaves, strict=True):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + 1 + int(row[f[at]] > c[at])
            total += leaf[at - (2**quality.DEPTH - 1)]
        raw.append(total)
    assert np.allclose(raw, model.raw(x[:50]))
    assert ((model.probability(x) > 0.5) == y).mean() > 0.97


def phrases(text, known):
    """Greedy parse by plain substring search."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in known:
            size += 1
        at += max(1, size - 1)
        n += 1
    return n


code = lambda s: np.array([ord(c) for c in s], np.uint32)


def test_cross_parsing_against_substring_search():
    rng = random.Random(2)
    known = {k: "".join(rng.choice(a) for _ in range(300)) for k, a in (("aa", "abc "), ("bb", "bcd "), ("cc", "c🎉𝔸 "))}
    parser = langid.Parser({k: code(v) for k, v in known.items()})
    docs = ["".join(rng.choice("abcdz 𝔸") for _ in range(rng.randint(0, 1300))) for _ in range(30)] + ["", "z", "zz", "a", "".join(rng.choice("abcd ") for _ in range(5000)), known["aa"] * 3]
    got = parser.phrases([code(d) for d in docs])
    for d, row in zip(docs, got, strict=True):
        assert row.tolist() == [phrases(d, known[k]) for k in parser.langs], d[:40]
    assert parser.phrases([]).shape == (0, 3) and parser.phrases([code("")]).tolist() == [[0, 0, 0]]


def test_large_alphabets_take_little_room():
    rng = random.Random(4)
    text = "".join(chr(0x4E00 + rng.randint(0, 19_999)) for _ in range(24_000))
    parser = langid.Parser({"zz": code(text), "yy": code("ab" * 50)})
    assert parser.nbytes < 10_000_000  # the states by COMMON, and the edges
    doc = text[500:900] + "ab" + text[5:9]
    assert parser.phrases([code(doc)]).tolist() == [[phrases(doc, "ab" * 50), phrases(doc, text)]]


def test_the_whole_language_query_against_substring_search(spark):
    """Sample, parse and choice, row by row."""
    docs, _ = corpus(120, 5)
    rows = [(k, t, "xx" if k % 2 else "yy") for k, t in docs]
    df = spark.createDataFrame(rows, DOC + ", lang string")
    parser = langid.learn(df, fold(F.col("doc_id"), 4) != 2)
    got = {r.doc_id: r for r in langid.predict(df, parser).collect()}
    lower = lambda t: "".join(map(chr, langid.symbols(t)))
    lengths = 2 ** parser.bits
    for k, text, _ in rows[:40]:
        s = lower(text)
        counts = parser.phrases([code(s)])[0]
        bits = [n * np.log2(m) / len(s) for n, m in zip(counts, lengths, strict=True)]
        assert got[k].lang_pred == parser.langs[int(np.argmin(bits))] and 0 < got[k].score <= 1


def test_languages(spark):
    rng = random.Random(6)
    sounds = {"xx": ["ka", "lo", "mi", "ré"], "yy": ["tz", "ung", "ein", "ö"], "zz": ["ción", "ado", "que"]}
    rows = [(k, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(30)), lang) for k in range(150) for lang in [rng.choice(sorted(sounds))]]
    docs = spark.createDataFrame([*rows, (900, "abc", None), (901, None, "xx"), (902, "12 34 !!", "xx"), (903, "🎉🎉 😀", "xx"), (None, "ka lo", "xx")], DOC + ", lang string")
    parser = langid.learn(docs, fold(F.col("doc_id"), 4) != 2)
    got = {r.doc_id: r for r in langid.predict(docs, parser).collect()}
    held = [r for r in rows if got[r[0]].lang_pred == r[2]]
    assert len(held) == len(rows) and got[901].lang_pred == got[902].lang_pred == got[903].lang_pred == "und" and got[901].score == 0
    assert set(parser.langs) == set(sounds)
    empty = langid.learn(docs.filter("lang is null"), F.lit(True))
    assert empty is None and {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}


def test_words_of_texts():
    assert toxicity.words("Scum! vile_1  É") == ["scum", "vile_1", "é"] and toxicity.words(None) == []


def test_quality_query_against_a_walk_row_by_row(spark, tables):
    """Every row's score from its own statistics and the trees, one node after the other."""
    docs, labels, _ = tables
    model = quality.learn(docs, labels, fold(F.col("doc_id"), 3) != 1)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for row in docs.collect():
        x, total = quality.statistics(row.text), model.base
        for f, c, leaf in zip(model.features, model.cuts, model.leaves, strict=True):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + 1 + int(x[f[at]] > c[at])
            total += leaf[at - (2**quality.DEPTH - 1)]
        assert abs(got[row.doc_id] - 1 / (1 + np.exp(-total))) < 1e-9


def test_a_hot_id_does_not_swell_the_sample(spark):
    docs = spark.range(500).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(4, "x"), (None, "y")], DOC))
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 1), (5, 1), (None, 1), (4, None)], "doc_id long, quality int")
    rows = quality.labelled_sample(docs, labels, "quality", F.lit(True), 10).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(3, 0.0), (3, 1.0), (4, 1.0)] and len({r.text for r in rows if r.doc_id == 3}) == 1
