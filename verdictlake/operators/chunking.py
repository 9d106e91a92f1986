"""Overlapping chunks of whole sentences, and vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictlake.functions.text import sentences, word_count

SIZE, OVERLAP = 500, 50


def bounds_of(counts: Sequence[int], size: int, overlap: int) -> list[dict[str, int]]:
    """First and last sentence (from 0) of each chunk, from the sentences' word counts; linear in their number.

    A chunk closes before the sentence that would take it over `size` words. The next one starts as far back as `overlap`
    words allow, one sentence at least.
    """
    out, start, words = [], 0, 0
    for at, count in enumerate(counts):
        if words + count > size and at > start:
            out.append({"first": start, "last": at - 1})
            back, words = at - 1, counts[at - 1]
            while back > start and words + counts[back - 1] <= overlap:
                back -= 1
                words += counts[back]
            start = back
        words += count
    return [*out, {"first": start, "last": len(counts) - 1}]


def chunk_bounds(counts: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The same for a column of arrays. Each step depends on the last one, and arrays that grow by built-ins are copied at every step."""

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for each in batches:
            yield each.map(lambda x: bounds_of(x.tolist(), size, overlap))

    return run(counts)


def chunks(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk (from 0), n_words, text; empty texts have none. Chunks are cut before they become rows, so no row carries a whole text."""
    parts = df.filter(F.coalesce(F.col(text), F.lit("")) != "").select(key, sentences(F.col(text)).alias("parts"))
    counted = parts.withColumn("counts", F.transform("parts", lambda x: word_count(x)))
    bounded = counted.withColumn("bounds", chunk_bounds(F.col("counts"), size, overlap))
    cut = lambda c, b: F.slice(c, b["first"] + 1, b["last"] - b["first"] + 1)
    made = F.transform("bounds", lambda b: F.struct(F.aggregate(cut("counts", b), F.lit(0), lambda a, x: a + x).cast("bigint").alias("n_words"), F.array_join(cut("parts", b), " ").alias("text")))
    rows = bounded.select(key, F.posexplode(made).alias("chunk", "c"))
    return rows.select(key, F.col("chunk").cast("bigint").alias("chunk"), "c.n_words", "c.text")


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A stand-in for a model: components in [-1, 1) from hashes, the same for the same text."""
    digest = F.md5(text.cast("binary"))
    part = lambda i: F.conv(F.left(F.md5(F.concat(digest, F.lit(":"), i.cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.pmod(part(i), F.lit(2_000_000)) / 1_000_000.0 - 1).cast("float"))


#: Queries that go to the tasks at once.
BLOCK = 2048


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", values: str = "embedding") -> DataFrame:
    """query_id, key, cosine, rank: each query's nearest other vectors, ties by key.

    The queries go to every task in blocks of about BLOCK, by hash of their key; each task keeps its best k a query, and only
    those are shuffled. So neither the driver nor a task holds more than a block of queries, however many there are.
    """
    import numpy as np

    kind = vectors.schema[key].dataType.simpleString()
    blocks = max(1, -(-queries.count() // BLOCK))

    def nearest(block: int) -> DataFrame:
        rows = queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == block).select(key, values).collect()
        held = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)))

        def run(batches):
            ids, q = held.value
            if not len(ids):
                return
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            # the best so far of each query: cosines, then keys
            best, own = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), ids.dtype)
            for pdf in batches:
                for at in range(0, len(pdf), 1024):
                    part = pdf.iloc[at : at + 1024]
                    v = np.array(part[values].tolist(), np.float64)
                    cos = np.round(q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T, 6)
                    new = np.broadcast_to(part[key].to_numpy(), cos.shape)
                    cos = np.where(new == ids[:, None], -np.inf, cos)
                    best, own = np.concatenate([best, cos], 1), np.concatenate([own, new], 1)
                    order = np.lexsort((own, -best), axis=1)[:, :k]
                    best, own = np.take_along_axis(best, order, 1), np.take_along_axis(own, order, 1)
            there = best > -np.inf
            yield pd.DataFrame({"query_id": np.broadcast_to(ids[:, None], best.shape)[there], key: own[there], "cosine": best[there]})

        return vectors.select(key, values).mapInPandas(run, f"query_id {kind}, {key} {kind}, cosine double")

    near = nearest(0)
    for block in range(1, blocks):
        near = near.unionByName(nearest(block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), key))
    return near.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k)
