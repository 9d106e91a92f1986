"""Connected components by alternating large-star and small-star steps, and joins of rows with what their groups add up to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import durable, release

#: Rows of a key from which it is dealt to several tasks, and the share of all rows from which it is: at most PARTS keys are.
MANY, PARTS = 100, 1000
#: Links that a task contracts together.
TOGETHER = 400_000


def with_groups(rows: DataFrame, key: str, total: int, spread: Column, **aggregates: Column) -> DataFrame:
    """The rows with aggregates of the rows of their key. Keys of many rows are dealt by `spread` to several tasks on the way back.

    Aggregates are partial before their shuffle. Which keys have more than total / PARTS rows (PARTS at most) is broadcast, so
    that no task gathers the rows of a hot key, whatever its share.
    """
    many = max(MANY, total // PARTS)
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *(c.alias(name) for name, c in aggregates.items()))
    groups = groups.withColumn("_parts", F.ceil(F.col("_n") / many).cast("int")).drop("_n")
    hot = groups.filter(F.col("_parts") > 1).select(key, F.col("_parts").alias("_of"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_of", F.lit(1))).cast("int")).drop("_of")
    copies = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def _smallest(pairs: DataFrame, total: int) -> DataFrame:
    """u, v and the smallest of u and its v."""
    return with_groups(pairs, "u", total, F.col("v"), low=F.min("v")).withColumn("low", F.least("u", "low"))


def _both(first: tuple[str, str], second: tuple[str, str]) -> Column:
    """Two links out of a row, as rows u, v."""
    return F.inline(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (first, second))))


def stars(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node, of 0 to n - 1, that links between u and v reach from each."""
    low = np.arange(n)
    while True:
        a, b = low[u], low[v]
        if (a == b).all():
            return low
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := low[low], low):
            low = up


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inside a task: links u, v with the components of the given ones, the smallest node seen in place of paths, up to TOGETHER links at once.

    A node has one link to a smaller one at most in what is made of TOGETHER links.
    """
    held: list[pa.RecordBatch] = []

    def taken() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        size = table.num_rows
        coded = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks().dictionary_encode()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes = rank[coded.indices.to_numpy(zero_copy_only=False)]
        low = stars(codes[:size], codes[size:], len(order))
        names = coded.dictionary.take(pa.array(order))
        moved = np.flatnonzero(low != np.arange(len(low)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(low[moved]))], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER:
            # what is made of them goes on, so that a task that sees the same nodes again and again passes each on once
            small = taken()
            held[:] = [small]
            if small.num_rows > TOGETHER // 2:
                yield small
                held.clear()
    if held:
        yield taken()
        held.clear()
    release()


def contracted(edges: DataFrame) -> DataFrame:
    """The links, contracted in the tasks that hold them."""
    return edges.select("u", "v").mapInArrow(contract, edges.select("u", "v").schema)


def gathered(links: DataFrame) -> DataFrame:
    """The links with those of a node met in one task, twice, and contracted each time."""
    return contracted(contracted(contracted(links).repartition("u")).repartition("u"))


def _are_stars(links: DataFrame, total: int) -> bool:
    """Whether every u of the distinct links has one v, and no v is a u: then each v is the smallest node of its component."""
    if links.select("u").distinct().count() < total:
        return False
    return links.select("v").distinct().join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """From links (u, v) of any sortable type: node and root, the smallest node of its component. Nodes without a link are left out.

    Tasks contract the links that they see, then those of a node meet in one task and are contracted again, twice: a node that many
    tasks have seen with different smallest nodes is left with one link before any round begins. A task passes on one link of a
    node at most, so that no node brings more of them than there are tasks. Rounds follow while the links aren't stars; each
    half of a round is kept, so that plans stay small, however many there are.
    """
    # kept first: where links come out of Python, a task that contracts them at once would hold two workers
    found = durable(edges.filter(F.col("u") != F.col("v")).select("u", "v"))
    once = durable(contracted(contracted(found).repartition("u")))
    now = durable(contracted(once.repartition("u")).distinct())
    while not _are_stars(now, total := now.count()):
        large = _smallest(now.select(_both(("u", "v"), ("v", "u"))), 2 * total).filter(F.col("v") > F.col("u"))
        large = durable(large.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        small = _smallest(large, 2 * total).select(_both(("v", "low"), ("u", "low"))).filter(F.col("u") != F.col("v"))
        now = durable(contracted(contracted(small).repartition("u")).distinct())
    return now.select(_both(("u", "v"), ("v", "v"))).select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
