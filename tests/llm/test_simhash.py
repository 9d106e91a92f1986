import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from verdictlake.llm import simhash as S
from verdictlake.llm.graph import components

DOC = "doc_id long, text string"


def plain(text, shingle=3):
    """The fingerprint's definition, bit by bit."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def texts(n=250, seed=1):
    rng = random.Random(seed)
    out, base = [], []
    for k in range(n):
        if k % 3 and base:
            w = rng.choice(base).split(" ")
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(["x", "Y", "é"])
            t = " ".join(w)
        else:
            t = " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(1, 120)))
            base.append(t)
        out.append((k, t))
    return [*out, (1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "A  b\x0bC d")]


def brute(prints, distance):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components_against_brute_force(spark):
    docs = texts()
    prints = {k: plain(t) for k, t in docs}
    df = spark.createDataFrame(docs, DOC).withColumn("fp", F.lit(1)).repartition(4)
    for distance in (0, 3, 7, 11):
        got = S.near_duplicates(df, distance=distance).collect()
        assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in prints.items()}
        assert {r.doc_id: r.component_id for r in got} == brute(prints, distance)


def test_large_buckets_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 8)
    rng = random.Random(2)
    prints = sorted({rng.choice([0, 0xFFFF << 20]) | sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(150)})
    nodes = spark.createDataFrame([(p.to_bytes(8, "big"),) for p in prints], "fp binary")
    got = components(S.links(nodes, 3)).collect()
    root = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in got}
    assert {p: root.get(p, p) for p in prints} == brute({p: p for p in prints}, 3)


def test_thresholds_cover_the_distance_and_avoid_hot_values():
    even = np.full((4, 1 << 16), 1, np.int64)
    assert S.allocate(even, 3) == [0, 0, 0, 0]
    hot = even.copy()
    hot[2] = 0
    hot[2, 5] = 1 << 16
    chosen = S.allocate(hot * 100, 3)
    assert chosen[2] == -1 and sum(t + 1 for t in chosen) >= 4
    near = S.within(even, 2)
    assert near[0, 1, 7] == 17 and near[0, 2, 7] == 137


def test_hard_cases(spark):
    many = spark.range(600).select("id", F.lit("same words in every copy").alias("text")).withColumnRenamed("id", "doc_id")
    odd = spark.createDataFrame([(None, "same words in every copy"), (None, "all alone here and nowhere else"), (5000, None), (5001, "")], DOC)
    got = S.near_duplicates(many.unionByName(odd))
    assert got.count() == 604
    by = {(r.doc_id, r.component_id) for r in got.filter("doc_id is null or doc_id >= 5000").collect()}
    assert by == {(None, 0), (None, None), (5000, 5000), (5001, 5000)}
    kept = S.deduplicate(many.unionByName(odd))
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["0", "5000"] or kept.count() == 2
    assert S.near_duplicates(many.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "a b c " * 40000), (1, "a b c " * 40000)], DOC)
    assert [r.component_id for r in S.near_duplicates(long).collect()] == [1, 1]


def test_components_of_a_long_path_and_a_hub(spark):
    path = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    hub = spark.range(300).select(F.lit(1000).cast("long").alias("u"), (F.col("id") + 2000).alias("v"))
    got = components(path.unionByName(hub).unionByName(hub)).collect()
    assert {r.root for r in got if r.node <= 200} == {0} and {r.root for r in got if r.node >= 1000} == {1000}
    assert len(got) == 201 + 301
    assert components(path.limit(0)).count() == 0


def test_wide_fingerprints_find_near_copies(spark):
    rng = random.Random(4)
    base = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(200)) for _ in range(30)]
    docs = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base):
        w = t.split(" ")
        w[50] = w[150] = "changed"
        docs.append((100 + k, " ".join(w)))
    got = S.near_duplicates(spark.createDataFrame(docs, DOC), shingle=5, words=4, distance=40, probe_distance=11).collect()
    assert sum(r.component_id == r.doc_id % 100 for r in got if r.doc_id >= 100) >= 29
    assert all(r.component_id == r.doc_id for r in got if r.doc_id < 100)


def test_a_hub_is_dealt_to_several_tasks(spark):
    """A node with 100,000 links, and a chain: components, and the rows that any task of the join back gets."""
    from verdictlake.llm.graph import with_groups

    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "20")
        star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
        chain = spark.range(200_000, 200_005).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
        got = {r.root: r.n for r in components(star.unionByName(chain)).groupBy("root").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert got == {0: 100_001, 200_000: 6}
        joined = with_groups(star, "u", 100_000, F.col("v"), low=F.min("v"))
        assert joined.filter("low = 1").count() == 100_000
        most = joined.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most < 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[2])


def test_a_group_that_meets_in_all_tasks_is_linked_once(spark):
    """Near copies meet in most buckets: their links grow with the group, not with the tasks, and join what a brute force joins."""
    rng = np.random.default_rng(4)
    flip = lambda k: sum(1 << int(b) for b in rng.choice(192, k, replace=False))
    base = int.from_bytes(rng.bytes(24), "big")
    prints = {base} | {base ^ flip(int(rng.integers(1, 26))) for _ in range(400)} | {base ^ flip(50) for _ in range(40)}
    prints |= {int.from_bytes(rng.bytes(24), "big") for _ in range(300)}
    prints = sorted(prints)
    nodes = spark.createDataFrame([(x.to_bytes(24, "big"),) for x in prints], "fp binary")
    setting = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in setting}
    for k, v in setting.items():
        spark.conf.set(k, v)
    try:
        found = [(int.from_bytes(r.u, "big"), int.from_bytes(r.v, "big")) for r in S.links(nodes, 51, 3, 11, 3, any_part=True).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(found) < 8 * len(prints)

    def groups(edges):
        root = {x: x for x in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in prints}

    sure = groups((a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= 35)
    most = groups((a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= 51)
    got = groups(found)
    assert all(got[x] == got[sure[x]] for x in prints) and all(most[x] == most[got[x]] for x in prints)


def test_members_known_to_be_linked_are_one():
    keys, prints = np.array([1, 1, 1, 1, 2, 2, 2]) << 40, np.array([[0], [7], [7 << 20], [7 << 20 | 1], [0], [7], [1]], np.uint64)
    known = np.array([3, 3, -1, 5, -1, 3, 3])
    link = lambda *a: [x.tolist() for x in S.forest(*a)]
    assert link(keys, prints, 1, 1) == [[2, 4], [3, 6]]
    assert link(keys, prints, 1, 1, known) == [[2, 4], [3, 5]]
