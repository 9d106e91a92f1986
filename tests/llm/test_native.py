"""Decontamination, license scans and sharding: hard cases, and brute force or SQL on small fixtures."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from verdictlake.llm import decontamination as D
from verdictlake.llm import licenses as L
from verdictlake.llm import sharding as S

DOC = "doc_id long, text string"


def test_masks_meet_every_choice_of_two_substitutions():
    places = [{o + x for x in m} for m in D.MASKS for o in range(D.WINDOW - m[-1])]
    for miss in itertools.combinations(range(D.WINDOW), D.WINDOW - D.NEEDED):
        assert any(not p & set(miss) for p in places)


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def brute(docs, items):
    out = {}
    for (d, t), (i, b) in itertools.product(docs, items):
        a, c = words(t), words(b)
        n = min(len(c), D.WINDOW)
        need = D.NEEDED if n == D.WINDOW else n
        for x, y in itertools.product(range(len(a) - n + 1), range(len(c) - n + 1)):
            same = sum(p == q for p, q in zip(a[x : x + n], c[y : y + n], strict=True))
            if n and same >= need:
                o = out.setdefault((d, i), [0, 0, 10**9])
                out[d, i] = [o[0] + 1, max(o[1], same), min(o[2], x)]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("bound", [D.MAX_BROADCAST_SEEDS, 0])
def test_decontamination_against_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(D, "MAX_BROADCAST_SEEDS", bound)
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", *(f"w{k}" for k in range(30)), "é", "日本"]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate((1, 3, 7, 8, 12, 13, 14, 20, 30))]
    docs = []
    for k in range(60):
        text = rng.choices(vocabulary, k=rng.randint(0, 40))
        if k % 2:
            part = words(rng.choice(items)[1])
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = part
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(100, None), (101, ""), (102, "...")]
    got = D.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_windows, r.best_equal, r.doc_word) for r in got.collect()} == brute(docs, items)


@pytest.mark.parametrize("bound", [D.MAX_BROADCAST_SEEDS, 0])
def test_one_run_repeated_in_item_and_document(spark, monkeypatch, bound):
    monkeypatch.setattr(D, "MAX_BROADCAST_SEEDS", bound)
    docs, items = [(1, "a " * 60), (2, "b " * 30 + "a " * 14)], [(1, "a " * 40), (None, "b " * 20), (None, "c " * 20)]
    got = D.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): (r.n_windows, r.best_equal, r.doc_word) for r in got.collect()} == brute(docs, items[:2])


@pytest.mark.parametrize("bound", [D.MAX_BROADCAST_SEEDS, 0])
def test_decontamination_hard_cases(spark, monkeypatch, bound):
    monkeypatch.setattr(D, "MAX_BROADCAST_SEEDS", bound)
    item = " ".join(f"b{k}" for k in range(20))
    bench = spark.createDataFrame([(5, item.upper()), (2, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 30000 + item, "a"), (1, item, "b"), (None, item, "c"), (3, "clean", "d"), (None, "clean", "e")], "doc_id long, text string, hashes string")
    got = {(r.doc_id, r.item_id): r.n_windows for r in D.contaminated(docs, bench).collect()}
    assert got == {(1, 2): 16, (None, 2): 8}  # equal items are one, rows of an id add up
    assert sorted(r.hashes for r in D.decontaminate(docs, bench).collect()) == ["d"]
    assert D.contaminated(docs.limit(0), bench).count() == D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == 5


def test_license_words_and_phrases(spark):
    cases = [
        (1, "MIT  License, then the mit-license: General\nPublic (License) é", (10, 3, 0, 6, "gpl,mit", "gpl,mit")),
        (2, None, (0, 0, None, None, "", "")),
        (3, "", (0, 0, None, None, "", "")),
        (4, "permit license; mit licenses; mité license", (6, 0, None, None, "", "")),
        (5, "Licensed under the Apache License, Version 2.0.", (8, 1, 3, 3, "apache", "apache,apache-2.0")),
        (6, "under CC BY-NC 4.0 or CC BY 3.0", (11, 0, None, None, "", "cc-by-3.0,cc-by-nc-4.0")),
        (7, "Kmit license", (2, 0, None, None, "", "")),
        (8, "GNU Lesser General Public License version 2.1", (8, 1, 2, 2, "gpl", "gpl,lgpl-2.1")),
    ]
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in cases], "doc_id long, text string, labels string")
    got = {r.doc_id: tuple(r)[1:7] for r in L.scan(docs).collect()}
    for k, _, want in cases:
        assert got[k] == want, k


def test_license_suppression_keeps_the_surest(spark):
    r = L.scan(spark.createDataFrame([(1, "Released under the MIT License. " * 3)], DOC)).first()
    assert (r.n_base, r.n_detections, r.score, r.labels) == (3, 3, 0.8, "mit")
    assert L.scan(spark.createDataFrame([], DOC)).count() == 0
    assert len(L.RULES) > 200 and len({x.id for x in L.RULES}) == len(L.RULES)


def _renditions(signature):
    """A signature's words without what may be missing, and with all of it."""
    least = re.sub(r"\[[^\]]*\]", "", signature)
    most = re.sub(r"\[([^\]|]*)[^\]]*\]", r"\1", signature)
    return [" ".join(re.sub(r"\(([^)|]*)[^)]*\)", r"\1", x).split()) for x in (least, most)]


def test_every_signature_finds_its_text(spark):
    cases = [(line.split(" | ")[0], text) for line in L.SIGNATURES.strip().split("\n") for text in _renditions(line.split(" | ")[4])]
    cases += [(tag.lower(), f"// SPDX-License-Identifier: {tag}") for tag in L.TAGS]
    cases += [("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\")"), ("gpl-3", "released as GPLv3"), ("isc", "SPDX-License-Identifier: ISC"), ("apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"), ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted")]
    found = {r.doc_id: r for r in L.scan(spark.createDataFrame([(k, f"So: {t.capitalize()}; end") for k, (_, t) in enumerate(cases)], DOC)).collect()}
    for k, (label, text) in enumerate(cases):
        assert label in found[k].labels.split(",") and found[k].score >= 0.6, (label, text, found[k])
    assert all(r.keyword.count("  ") == len(r.keyword.split()) - 1 and L.gate_of(r) for r in L.RULES)


def test_a_text_of_many_mentions(spark):
    """Two thirds of a megabyte of mentions: far from quadratic."""
    import time

    start = time.time()
    r = L.scan(spark.createDataFrame([(1, "licensed under the MIT License, version 2.0. GNU GPL v3 " * 12_000)], DOC)).first()
    assert (r.n_base, r.n_detections, r.labels) == (12_000, 24_000, "gpl-3,mit") and time.time() - start < 60


def _oracle(sql, docs):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", docs)
    cursor = c.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted((dict(zip(names, r, strict=True)) for r in cursor.fetchall()), key=str)


def test_license_sql_agrees_on_made_up_texts(spark):
    rng = random.Random(5)
    pool = ["mit", "license", "apache", "gnu", "gpl", "lgpl", "general", "public", "lesser", "licensed", "under", "the", "terms", "of", "version", "v2", "2", "0", "2.1", "cc", "by", "nc", "sa", "4.0", "bsd", "3", "clause", "or", "later", "released", "é"]
    docs = [(k, " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for k in range(150)]
    got = sorted((r.asDict() for r in L.scan(spark.createDataFrame(docs, DOC)).collect()), key=str)
    key = lambda rows: sorted([sorted((k, str(v)) for k, v in r.items()) for r in rows])
    assert key(got) == key(_oracle(L.oracle(), docs))


def test_shards_agree_with_sql_and_fit(spark):
    rng = random.Random(7)
    docs = [(k, "é" * rng.randint(0, 300)) for k in range(400)] + [(7, "same"), (7, "other"), (1000, None), (None, "x")]
    df = spark.createDataFrame(docs, DOC)
    got = sorted((r.asDict() for r in S.extendible_shards(df, 2000).collect()), key=str)
    key = lambda rows: sorted([sorted((k, str(v)) for k, v in r.items()) for r in rows])
    assert key(got) == key(_oracle(S.oracle(2000), docs))
    assert all(r["fits"] for r in got) and len({r["shard"] for r in got}) > 8
    total = {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["n_bytes"]
    assert all(total[r["shard"]] == r["shard_bytes"] for r in got)
    shards = sorted(total)
    assert not any(b.startswith(a) for a, b in itertools.combinations(shards, 2))  # no shard inside another


def test_shards_that_cannot_split(spark, tmp_path):
    docs = [(1, "a" * 500)] * 3 + [(2, "b" * 5000), (3, "c")]
    got = S.extendible_shards(spark.createDataFrame(docs, DOC), 1000).collect()
    assert {(r.doc_id, r.fits) for r in got} == {(1, False), (2, False), (3, True)}
    assert S.extendible_shards(spark.createDataFrame([], DOC), 1000).count() == 0
    hot = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit(1).alias("h"))
    got = S.extendible_shards(hot, 1000).agg(F.count("*"), F.max("shard_bytes"), F.min("fits")).first()
    assert got[0] == 3000 and got[1] <= 1000 and got[2]
    S.write_shards(spark.createDataFrame([(k, "x" * 100) for k in range(50)], DOC), f"{tmp_path}/s", 1000)
    assert spark.read.parquet(f"{tmp_path}/s").count() == 50
