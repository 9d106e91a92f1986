"""Exact nearest vectors by an index: coarse clusters, and bounds that tell which of them can hold a nearer vector.

Centres come from a bounded sample; every vector belongs to its nearest centre, and a cluster's radius is the greatest angle
between its centre and a vector of it. No vector of a cluster is nearer to a query than the angle to its centre less the radius, so
a cluster whose bound is beyond the k-th nearest vector so far needn't be read. A query first looks into the clusters with the
best bounds, then into the others that may still matter; the result is exact.

Queries and vectors meet by cluster, in parts of bounded size: large clusters are cut by hash, and so are the queries of a cluster.
Nothing but the centres (CENTRES at most) and the clusters' sizes is known to all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CENTRES, SAMPLE, ROUNDS = 1024, 20_000, 10
#: Vectors and queries that a task compares at once; clusters that a query looks into first.
PART, QUERIES, FIRST = 20_000, 5_000, 2
#: Rows that a task holds against all centres at once: each becomes up to CENTRES rows.
ASKED = 64
#: Cosines are compared after rounding to DIGITS; bounds give way by as much and by what floating point may err.
DIGITS = 6
SLACK = 10.0**-DIGITS + 1e-9


class Index(NamedTuple):
    vectors: DataFrame  # key, values, cluster, part
    centres: np.ndarray
    radius: np.ndarray
    parts: np.ndarray  # of each cluster; 0 if it is empty
    sizes: np.ndarray


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    return values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-300)


def _matrix(column: pd.Series) -> np.ndarray:
    return unit(np.array(column.tolist(), np.float64).reshape(len(column), -1))


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), ASKED):
            yield pdf.iloc[at : at + ASKED]


def centres_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means over the sample; starts from rows spread over it, so that the same sample gives the same centres."""
    centres = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        nearest = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        some = np.linalg.norm(sums, axis=1) > 1e-12
        centres = np.where(some[:, None], unit(sums), centres)
    return centres


def build(vectors: DataFrame, key: str = "vec_id", values: str = "embedding", count: int | None = None) -> Index:
    """An index of all vectors that have a key and values. The sample is the SAMPLE first by hash of key, so it is the same every time."""
    rows = vectors.filter(F.col(key).isNotNull() & F.col(values).isNotNull()).select(F.col(key).alias("key"), F.col(values).alias("values"))
    sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toPandas()
    if not len(sample):
        none = np.zeros(0)
        return Index(rows.withColumns({"cluster": F.lit(0), "part": F.lit(0)}), np.zeros((0, 0)), none, none.astype(int), none.astype(int))
    total = rows.count()
    centres = centres_of(_matrix(sample["values"]), count or int(min(CENTRES, max(1, total**0.5))))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches):
            cos = _matrix(pdf["values"]) @ centres.T
            yield pdf.assign(cluster=np.argmax(cos, axis=1).astype(np.int32), angle=np.arccos(np.clip(cos.max(axis=1), -1, 1)))

    kinds = f"key {vectors.schema[key].dataType.simpleString()}, values {vectors.schema[values].dataType.simpleString()}, cluster int, angle double"
    assigned = rows.mapInPandas(assign, kinds)
    radius, sizes = np.zeros(len(centres)), np.zeros(len(centres), int)
    for cluster, far, n in assigned.groupBy("cluster").agg(F.max("angle"), F.count(F.lit(1))).collect():  # CENTRES rows at most
        radius[cluster], sizes[cluster] = far, n
    parts = -(-sizes // PART)
    of = F.get(F.array(*map(F.lit, parts.tolist())), F.col("cluster"))
    dealt = assigned.withColumn("part", F.pmod(F.xxhash64("key"), F.greatest(of, F.lit(1))).cast("int"))
    return Index(dealt.select("key", "values", "cluster", "part"), centres, radius, parts, sizes)


def bounds(index: Index, queries: np.ndarray) -> np.ndarray:
    """The greatest cosine that a vector of each cluster can have with each query; -2 for empty clusters."""
    angle = np.arccos(np.clip(queries @ index.centres.T, -1, 1))
    return np.where(index.sizes[None, :] > 0, np.cos(np.maximum(angle - index.radius[None, :], 0)), -2.0)


def _probes(queries: DataFrame, index: Index, first: int, second: bool) -> DataFrame:
    """A row for each cluster that a query looks into: the `first` with the best bounds, or the others that `floor` doesn't rule out.

    A task makes the rows of ASKED queries at once, so that its memory doesn't grow with the queries or with those that rule out little.
    """
    _, centres, radius, parts, sizes = index
    known = index._replace(vectors=None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches):
            most = bounds(known, _matrix(pdf["values"]))
            order = np.argsort(-most, axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], 1)
            wanted = (most > -2) & ((rank >= first) & (most + SLACK >= pdf["floor"].to_numpy()[:, None]) if second else rank < first)
            row, cluster = np.nonzero(wanted)
            yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[row], "values": pd.Series([pdf["values"].iloc[k] for k in row], dtype=object), "cluster": cluster.astype(np.int32)})

    kind, values = queries.schema["query_id"].dataType.simpleString(), queries.schema["values"].dataType.simpleString()
    return queries.mapInPandas(run, f"query_id {kind}, values {values}, cluster int")


def _compared(probes: DataFrame, index: Index, k: int) -> DataFrame:
    """The k nearest vectors of each query in each part of a cluster it looks into, and how many there were (`seen`)."""
    counts = probes.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("groups"))  # CENTRES rows at most
    parts = F.get(F.array(*map(F.lit, np.maximum(index.parts, 1).tolist())), F.col("cluster"))
    asked = probes.join(F.broadcast(counts), "cluster").withColumn("group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("groups")
    held = index.vectors.join(F.broadcast(counts), "cluster").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def nearest(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(vectors):
            return pd.DataFrame({"query_id": [], "key": [], "cosine": [], "seen": []})
        vectors = vectors.sort_values("key", kind="stable")
        keys, v = vectors["key"].to_numpy(), _matrix(vectors["values"])
        out = []
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            cos = np.round(_matrix(part["values"]) @ v.T, DIGITS)
            ids = part["query_id"].to_numpy()
            cos = np.where(keys[None, :] == ids[:, None], -np.inf, cos)
            best = np.argsort(-cos, axis=1, kind="stable")[:, :k]  # equal ones by key
            near = np.take_along_axis(cos, best, 1)
            there = near > -np.inf
            row = np.nonzero(there)[0]
            out.append(pd.DataFrame({"query_id": ids[row], "key": keys[best][there], "cosine": near[there], "seen": np.where(np.arange(len(row)) == np.searchsorted(row, row), len(keys), 0)}))
        return pd.concat(out)

    ids, key = probes.schema["query_id"].dataType.simpleString(), index.vectors.schema["key"].dataType.simpleString()
    by = ["cluster", "part", "group"]
    return held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(nearest, f"query_id {ids}, key {key}, cosine double, seen long")


def search(index: Index, queries: DataFrame, k: int, key: str = "vec_id", values: str = "embedding", first: int = FIRST) -> DataFrame:
    """query_id, key, cosine, rank, seen: each query's k nearest other vectors, ties by key, and how many vectors it was compared with."""
    if not len(index.centres):
        return queries.limit(0).select(F.col(key).alias("query_id"), F.col(key), F.lit(0.0).alias("cosine"), F.lit(0).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("seen"))
    asked = queries.filter(F.col(values).isNotNull()).select(F.col(key).alias("query_id"), F.col(values).alias("values"))
    near = _compared(_probes(asked, index, first, False), index, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "key")
    floor = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query_id", F.col("cosine").alias("floor"))
    rest = asked.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
    every = near.unionByName(_compared(_probes(rest, index, first, True), index, k))
    ranked = every.withColumn("rank", F.row_number().over(order).cast("bigint")).withColumn("seen", F.sum("seen").over(Window.partitionBy("query_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("key").alias(key), "cosine", "rank", "seen")
