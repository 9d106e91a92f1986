"""Joins by time, intervals, vectors by an index, writes in place and sketches, against brute force; and their plans."""

import bisect
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlake.functions import tools
from verdictlake.operators import sketches as S
from verdictlake.operators import temporal as T
from verdictlake.operators import vector_index as V
from verdictlake.sources import keyed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("many", [None, 7, 50, 1])
def test_asof_join_against_brute_force(spark, many):
    rng = random.Random(1)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(key(), rng.choice([rng.randint(0, 60), 30, None]), k) for k in range(300)]
    right = [(key(), rng.choice([rng.randint(0, 60), 31, None]), rng.choice([None, "x", "y"]), k % 3) for k in range(200)]
    found = T.asof_join(spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, v string, w int"), "k", "t", many)
    order = lambda r: (r[1], r[2] is not None, r[2] or "", r[3])  # noqa: E731  nulls first
    want = {}
    for k, t, i in left:
        before = [r for r in right if r[0] == k and k is not None and t is not None and r[1] is not None and r[1] <= t]
        best = max(before, key=order) if before else None
        want[i] = (k, t, best and best[1:])
    got = {r.i: (r.k, r.t, r.found and tuple(r.found)) for r in found.collect()}
    assert got == want
    assert "Window" in plan(found) and not re.search("NestedLoop|Cartesian", plan(found))


def test_asof_join_of_timestamps_of_one_hot_key(spark):
    left = spark.range(3000).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 7).alias("t"), "id")
    right = spark.range(100).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 200 + 3).alias("t"), F.col("id").alias("r"))
    got = {x.id: x.found and x.found.r for x in T.asof_join(left, right, "k", "t", 100).collect()}
    assert got == {i: (min((7 * i - 3) // 200, 99) if 7 * i >= 3 else None) for i in range(3000)}


def test_asof_join_of_empty_tables(spark):
    rows, none = spark.createDataFrame([("k", 1)], "k string, t int"), spark.createDataFrame([], "k string, t int")
    assert [tuple(r) for r in T.asof_join(rows, none, "k", "t").collect()] == [("k", 1, None)]
    assert T.asof_join(none, rows, "k", "t").count() == 0


@pytest.mark.parametrize("on", [[], ["k"]])
def test_interval_join_against_brute_force(spark, on):
    rng = random.Random(2)

    def rows(n):
        out = []
        for i in range(n):
            start = rng.choice([rng.randint(-300, 300), rng.randint(-(2**40), 2**40), 0, None])
            length = rng.choice([1, 2, 3, 8, 100, 2**20, 2**41, 0, -5, None])
            out.append((rng.choice(["a", "b", None]), start, None if start is None or length is None else start + length, i, "left"))
        return out + out[:3]

    a, b = rows(150), rows(150)
    kinds = "k string, start long, end long, i int, left string"
    got = sorted((r.left.i, r.right.i) for r in T.interval_join(spark.createDataFrame(a, kinds), spark.createDataFrame(b, kinds), on).collect())
    whole = lambda r: r[1] is not None and r[2] is not None and r[1] < r[2]
    want = sorted((x[3], y[3]) for x in a for y in b if whole(x) and whole(y) and x[1] < y[2] and y[1] < x[2] and (not on or (x[0] is not None and x[0] == y[0])))
    assert want and got == want


def test_interval_join_has_no_nested_loop_and_spreads_no_long_interval(spark):
    short = spark.range(1000).select(F.col("id").alias("start"), (F.col("id") + 1).alias("end"))
    long = spark.createDataFrame([(0, 2**45)], "start long, end long")
    df = T.interval_join(short, long, [])
    assert not re.search("NestedLoop|Cartesian", plan(df))
    assert df.count() == 1000
    rows = T._leveled(long, [], "left", "start", "end")
    assert rows.first()["_lleft"] == 45


VEC = "vec_id long, embedding array<float>"


def brute_top(rows, k, every=1):
    ids = np.array([r[0] for r in rows])
    unit = V.unit(np.array([r[1] for r in rows], np.float64))
    out = set()
    for i in range(0, len(rows), every):
        cos = np.round(unit @ unit[i], 6)
        cos[ids == ids[i]] = -np.inf
        order = np.lexsort((ids, -cos))[:k]
        out |= {(int(ids[i]), int(ids[j]), float(cos[j]), n) for n, j in enumerate(order, 1) if cos[j] > -np.inf}
    return out


@pytest.mark.parametrize(("part", "queries"), [(V.PART, V.QUERIES), (7, 3)])
def test_vector_index_is_exact_and_reads_a_share(spark, monkeypatch, part, queries):
    monkeypatch.setattr(V, "PART", part)
    monkeypatch.setattr(V, "QUERIES", queries)
    rng = np.random.default_rng(3)
    spots = rng.normal(size=(30, 16))
    rows = [(k, [float(x) for x in np.float32(spots[k % 30] + rng.normal(size=16) * 0.05)]) for k in range(900)]
    rows += [(900 + k, rows[0][1]) for k in range(40)] + [(950, [0.0] * 16)]  # equal vectors, and one of zeros
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in rows]
    df = spark.createDataFrame([*rows, (None, rows[1][1]), (960, None)], VEC)
    found = V.search(V.build(df), df.filter("vec_id % 9 = 0"), 5).collect()
    assert {(r.query_id, r.vec_id, round(r.cosine, 6), r.rank) for r in found} == brute_top(rows, 5, 9)
    seen = {r.query_id: r.seen for r in found}
    assert sum(seen.values()) < 0.35 * len(rows) * len(seen)


def test_vector_index_of_spread_and_of_few_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=8)]) for k in range(200)]
    df = spark.createDataFrame(rows, VEC)
    assert {(r.query_id, r.vec_id, round(r.cosine, 6), r.rank) for r in V.search(V.build(df, count=12), df, 3).collect()} == brute_top(rows, 3)
    two = spark.createDataFrame(rows[:2], VEC)
    assert {(r.query_id, r.vec_id) for r in V.search(V.build(two), two, 5).collect()} == {(0, 1), (1, 0)}
    assert V.search(V.build(df.limit(0)), df, 5).count() == 0
    assert V.search(V.build(df), df.limit(0), 5).count() == 0


def test_a_write_in_place_leaves_other_files_alone(spark, tmp_path):
    path = f"{tmp_path}/vectors"
    rows = [(f"n{k % 40}", k, float(k)) for k in range(400)]
    keyed.create(spark.createDataFrame(rows, "namespace string, id int, v double"), path, 16)
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}
    before = files()
    change = [("n1", 1, -1.0), ("n1", 1, -2.0), ("n1", 1_000, 5.0), ("n2", 2, -3.0)]
    touched = keyed.write_in_place(spark.createDataFrame(change, "namespace string, id int, v double"), path, 16)
    after = files()
    assert len(touched) <= 2
    kept = {f for f in before if after.get(f) == before[f]}
    assert kept == {f for f in before if int(re.search(r"bucket=(\d+)", f)[1]) not in touched} and len(kept) >= len(before) * 0.7
    want = {(n, i): v for n, i, v in rows} | {("n1", 1): -1.0, ("n1", 1_000): 5.0, ("n2", 2): -3.0}
    assert {(r.namespace, r.id): r.v for r in keyed.read(spark, path).collect()} == want
    assert keyed.write_in_place(spark.createDataFrame([], "namespace string, id int, v double"), path, 16) == []
    assert keyed.read(spark, path).count() == len(want)


def test_sketches_merge(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("source"), (F.col("id") % 7).alias("day"), (F.col("id") % 9_000).alias("user"), (F.col("id") % 1000).cast("double").alias("v"))
    S.daily(rows, ["source", "day"], F.col("user"), F.col("v")).write.parquet(f"{tmp_path}/s")
    kept = spark.read.parquet(f"{tmp_path}/s")
    assert kept.count() == 21
    for r in S.merged(kept, ["source"]).collect():
        assert r.n == 20_000 and abs(r.distinct - 3_000) < 60 and abs(r.amount - 500) < 20
    half = S.merged(kept.filter("day < 3"), ["source"], 0.9).first()
    assert abs(half.amount - 900) < 20


def test_grouping_sets_are_one_pass(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3), (None, "x", 4)], "p string, q string, v int")
    report = S.report(rows, [["p", "q"], ["p"], []], F.when(F.col("v") > 1, "pass").otherwise("fail"))
    got = {(r.level, r.p, r.q): (r.total, r.passed, r.failed) for r in report.collect()}
    assert got[3, None, None] == (4, 3, 1) and got[1, "a", None] == (2, 1, 1) and got[1, None, None] == (1, 1, 0) and len(got) == 8
    assert plan(report).partition("== Initial Plan")[0].count("Expand") == 1 and "Union" not in plan(report)


def test_tools_as_table_functions(spark):
    tools.register(spark)
    files = [("r", "a/x.py", "one\nTwo one\n" + "one\n" * 20), ("r", "a/b/y.py", None), ("r", "z.py", ""), ("s", "a/q.py", "none"), ("s", None, "one")]
    spark.createDataFrame(files, "repo string, path string, content string").createOrReplaceTempView("tool_files")
    hits = spark.sql("select f.repo, f.path, s.line from tool_files f, lateral search_code(f.content, 'ONE') s").collect()
    assert sorted((r.repo, str(r.path), r.line) for r in hits) == sorted([("r", "a/x.py", k) for k in range(1, 11)] + [("s", "a/q.py", 1), ("s", "None", 1)])[: len(hits)]
    assert spark.sql("select s.* from tool_files f, lateral search_code(f.content, '') s").count() == 0
    call = "select * from list_directory(table(select repo, path from tool_files) partition by (repo) order by (path), '{}')"
    assert {tuple(r) for r in spark.sql(call.format("/a/")).collect()} == {("r", "b/", 1), ("r", "x.py", 1), ("s", "q.py", 1)}
    assert {tuple(r) for r in spark.sql(call.format("")).collect()} == {("r", "a/", 2), ("r", "z.py", 1), ("s", "a/", 1)}
    assert spark.sql(call.format("a/x.py")).count() == 0


def test_cut_points_are_looked_up_in_two_short_steps(spark):
    """The part of a row is the number of cut points below it, and no row carries more than about the square root of them."""
    cuts = {1: sorted(random.Random(1).sample(range(100_000), 2000)), 2: [5], 3: []}
    cut = spark.createDataFrame(list(cuts.items()), "_key long, _cuts array<long>")
    rows = [(k, at) for k in (1, 2, 3, 4) for at in [*range(-1, 100_001, 997), 4, 5, 6, *cuts.get(k, [])[:50], *cuts.get(k, [])[-2:]]]
    found = T._dealt(spark.createDataFrame(rows, "_key long, _at long").withColumn("at", F.col("_at")), cut, 2001)
    assert sorted((r._key, r.at, r._part) for r in found.collect()) == sorted((k, at, bisect.bisect_left(cuts.get(k, []), at)) for k, at in rows)


def test_probes_come_in_batches_of_bounded_size(spark, monkeypatch):
    """Queries that look into every cluster: what a task makes at once doesn't grow with its queries."""
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(k, rng.normal(size=6).tolist()) for k in range(900)], "vec_id long, embedding array<double>").coalesce(1)
    index = V.build(vectors, count=30)
    made = []
    monkeypatch.setattr(type(vectors), "mapInPandas", lambda df, run, kinds: made.append(run) or df)
    V._probes(vectors.selectExpr("vec_id query_id", "embedding values", "-2.0D floor"), index, 0, True)
    whole = vectors.selectExpr("vec_id query_id", "embedding values", "-2.0D floor").toPandas()
    sizes = [len(x) for x in made[0](iter([whole]))]
    assert sum(sizes) == 900 * 30 and max(sizes) <= V.ASKED * 30
