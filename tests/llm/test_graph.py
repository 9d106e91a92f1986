"""Components of links: contraction within tasks changes none."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdictlake.llm import graph


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_stars_of_paths_rings_and_none():
    n = 500
    path = np.arange(n - 1)
    assert (graph.stars(path, path + 1, n) == 0).all()
    assert (graph.stars(path[::-1] + 1, path[::-1], n) == 0).all()
    assert graph.stars(np.array([3, 1]), np.array([4, 2]), 6).tolist() == [0, 1, 1, 3, 3, 5]
    none = np.zeros(0, int)
    assert graph.stars(none, none, 3).tolist() == [0, 1, 2]


@pytest.mark.parametrize("together", [graph.TOGETHER, 1, 40])
@pytest.mark.parametrize("kind", ["long", "binary", "string"])
def test_components_against_brute_force(spark, monkeypatch, together, kind):
    monkeypatch.setattr(graph, "TOGETHER", together)
    rng = random.Random(together)
    edges = [(k, k + 1) for k in range(0, 90)] + [(200 + rng.randint(0, 150), 200 + rng.randint(0, 150)) for _ in range(120)] + [(400, k) for k in range(401, 480)] + [(5, 5), (5, 6), (6, 5)]
    rng.shuffle(edges)
    name = lambda x: F.lpad(F.col(x).cast("string"), 4, "0").cast(kind)
    df = spark.createDataFrame(edges, "u long, v long").repartition(5).select(name("u").alias("u"), name("v").alias("v"))
    plain = lambda x: int(bytes(x).decode()) if kind == "binary" else int(x)
    got = {plain(r.node): plain(r.root) for r in graph.components(df).collect()}
    assert got == {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert graph.components(df.limit(0)).count() == 0


def test_a_group_that_many_tasks_see_needs_no_rounds(spark, monkeypatch):
    """Each task has another part of the links of 300 nodes; before any round they are left with one link a node."""
    rng = random.Random(3)
    edges = [(k, rng.choice(range(max(0, k - 20), k))) for k in range(1, 300) for _ in range(30)] + [(k, k + 1) for k in range(1000, 1200, 2)]
    rng.shuffle(edges)
    met = []
    stars = graph._are_stars
    monkeypatch.setattr(graph, "_are_stars", lambda links, total: met.append(total) or stars(links, total))
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long").repartition(60)).collect()}
    assert got == brute(edges)
    assert met == [299 + 100]  # a link for each node but the smallest of its component


def test_tasks_pass_on_one_link_of_a_node(monkeypatch):
    monkeypatch.setattr(graph, "TOGETHER", 64)
    batches = [pa.RecordBatch.from_arrays([pa.array([k + 1 for k in range(20)]), pa.array(range(20))], ["u", "v"]) for _ in range(50)]
    made = [(u, v) for b in graph.contract(iter(batches)) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert sorted(made) == [(k, 0) for k in range(1, 21)]
