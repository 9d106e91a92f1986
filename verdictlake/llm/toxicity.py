"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Every lower-case word of the labelled sample is a term. A term's weight in a text is (1 + log count) * idf * (BASE + lean**2),
where lean is the shrunken log odds of the label given the term: words that say nothing about it count little, but all count.
The examples form an inverted index in blocks of BLOCK like examples; for each term it keeps, block by block, the highest
weight and where the block's postings begin. A query bounds each block's best cosine by these maxima, scores the blocks of
the highest bounds, and after that only blocks whose bound reaches the K-th best cosine found: the neighbours are exact.
Votes are weighted by distance and mapped to probabilities by a rising fit on the examples' own leave-one-out votes. The
evidence is the query's terms that weigh most, and the nearest examples.

The labelled sample is bounded at SAMPLE rows, chosen by hash of the id; each row's whole text is learned.

Defined cases: a null text is an empty one; a text none of whose words is a term has no neighbour and gets the share of
toxic ones among such examples; equal cosines go to the example that lies first in the index; null labels are left out; with
no labels every score is 0; repeated rows each get their score; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictlake.llm.common import durable, release
from verdictlake.llm.quality import labelled_sample

SAMPLE, K, BLOCK = 3000, 15, 32
#: Weight of a term that leans nowhere, and documents' worth of average labels that every term's odds start from.
BASE, SHRINK = 0.15, 4.0
#: Blocks that are scored first, and the share of examples (one in COMMON) from which a term is common.
FIRST, COMMON = 8, 16

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Labelled examples by term, from columns of ids, labels, and each example's terms and their counts. Terms stay in Arrow until a task needs them."""

    def __init__(self, ids: list[str], labels: np.ndarray, terms: pa.ListArray, counts: pa.ListArray):
        n, flat = len(ids), terms.flatten()
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False).astype(np.int64) if n else np.zeros(0, np.int64)
        self.names = names = pc.unique(flat).sort()
        term = pc.index_in(flat, names).to_numpy(zero_copy_only=False).astype(np.int64)
        count = counts.flatten().to_numpy(zero_copy_only=False).astype(float)
        row = np.repeat(np.arange(n), sizes)
        df, toxic = np.bincount(term, minlength=len(names)), np.bincount(term, labels[row], len(names))
        self.prior = float(labels.mean()) if n else 0.0
        share = min(max(self.prior, 1e-3), 1 - 1e-3)
        lean = np.log((toxic + SHRINK * share) / (df - toxic + SHRINK * (1 - share))) - np.log(share / (1 - share))
        self.weight = (np.log((1 + n) / (1 + df)) + 1) * (BASE + lean**2)

        w = (1 + np.log(count)) * self.weight[term]
        norm = np.sqrt(np.bincount(row, w**2, n))
        w = w / norm[row]
        # like examples lie side by side, so that bounds are tight: by the term that weighs most, then the commonest word
        top, common = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = np.lexsort((w, row))
        last = np.cumsum(sizes)[sizes > 0] - 1
        top[sizes > 0] = np.where(np.abs(lean[term[order[last]]]) > 2, term[order[last]], -1)
        common[sizes > 0] = term[np.lexsort((df[term], count, row))[last]]
        some = np.flatnonzero(sizes > 0)
        some = some[np.lexsort((some, sizes[some], common[some], top[some]))]
        place = np.full(n, -1)
        place[some] = np.arange(len(some))
        self.ids, self.labels, self.blocks = [ids[i] for i in some], labels[some], -(-len(some) // BLOCK)
        without = labels[sizes == 0]
        self.empty_score = float((without.sum() + self.prior) / (len(without) + 1))

        # the lists of common terms are nearly full: they are kept as rows over all examples
        self.common_at = np.full(len(names) + 1, -1, np.int64)
        often = np.flatnonzero(df * COMMON > n)
        self.common_at[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.blocks * BLOCK))
        full = self.common_at[term] >= 0
        self.dense[self.common_at[term[full]], place[row[full]]] = w[full]

        order = np.flatnonzero(~full)
        order = order[np.lexsort((place[row[order]], term[order]))]
        self.rows, self.weights = place[row[order]].astype(np.int32), w[order]
        # an entry for each other term and block: the block, its highest weight, where its postings begin
        key = term[order] * max(1, self.blocks) + self.rows // BLOCK
        self.entry = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else np.zeros(1, np.int64)
        self.entry_block = (key[self.entry[:-1]] % max(1, self.blocks)).astype(np.int32)
        self.entry_max = np.maximum.reduceat(self.weights, self.entry[:-1]) if len(key) else np.zeros(0)
        self.term_entry = np.searchsorted(key[self.entry[:-1]] // max(1, self.blocks), np.arange(len(names) + 1))
        self.knots, self.levels = np.zeros(1), np.full(1, self.prior)

    @functools.cached_property
    def terms(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(self.names.to_pylist())}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "terms"}

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms and their weights, of length 1."""
        found = Counter(words(text))
        dims = np.fromiter(map(self.terms.get, found, itertools.repeat(-1)), np.int64, len(found))
        counts = np.fromiter(found.values(), float, len(found))[dims >= 0]
        dims = dims[dims >= 0]
        w = (1 + np.log(counts)) * self.weight[dims]
        return dims, w / np.sqrt(max(w @ w, 1e-300))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: list[str | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the K nearest examples and their cosines, exact; equal cosines by place. Examples of the id in `skip` don't count."""
        often = np.zeros((len(vectors), len(self.dense)))
        for q, (dims, weights) in enumerate(vectors):
            at = self.common_at[dims]
            often[q, at[at >= 0]] = weights[at >= 0]
        return [self._nearest(d, w, c, None if skip is None else skip[q]) for q, ((d, w), c) in enumerate(zip(vectors, often @ self.dense, strict=True))]

    def _nearest(self, dims: np.ndarray, weights: np.ndarray, cosines: np.ndarray, skip: str | None) -> tuple[np.ndarray, np.ndarray]:
        """`cosines` holds what the common terms add to each example's."""
        sizes = self.term_entry[dims + 1] - self.term_entry[dims]
        entries, w = _ragged(self.term_entry[dims], sizes), np.repeat(weights, sizes)
        block = self.entry_block[entries]
        bound = cosines.reshape(-1, BLOCK).max(1) + np.bincount(block, w * self.entry_max[entries], self.blocks)
        order = np.argsort(-bound, kind="stable")
        best, place = np.zeros(0), np.zeros(0, np.int64)
        at, step, least = 0, FIRST, 0.0
        while at < len(order) and bound[order[at]] > 0 and bound[order[at]] >= least - 1e-9:
            now = order[at : at + step]
            now = now[bound[now] >= least - 1e-9]
            at, step = at + len(now), step * 2
            wanted = np.zeros(self.blocks, bool)
            wanted[now] = True
            use = wanted[block]
            e = entries[use]
            n = self.entry[e + 1] - self.entry[e]
            p = _ragged(self.entry[e], n)
            np.add.at(cosines, self.rows[p], np.repeat(w[use], n) * self.weights[p])
            rows = (now[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            rows = rows[cosines[rows] > 0]
            best, place = np.concatenate([best, np.round(cosines[rows], 10)]), np.concatenate([place, rows])
            if skip is not None:
                stay = [r >= len(self.ids) or self.ids[r] != skip for r in place.tolist()]
                best, place = best[stay], place[stay]
            if len(best) >= K:
                top = np.lexsort((place, -best))[:K]
                best, place, least = best[top], place[top], best[top[-1]]
        top = np.lexsort((place, -best))
        return place[top], best[top]

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """The toxic neighbours' share of weight, which grows as the distance shrinks; one weak vote of the average is added."""
        weight = 1 / (1.05 - np.minimum(cosines, 1.0))
        return float((weight @ self.labels[rows] + self.prior) / (weight.sum() + 1))

    def own_votes(self, texts: list[str | None], ids: list[str]) -> list[float | None]:
        """The vote on each example by the others; None without a neighbour."""
        return [self.vote(*near) if len(near[0]) else None for near in self.nearest([self.vector(t) for t in texts], ids)]

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        if len(votes):
            self.knots, self.levels = isotonic(votes, labels)

    def score(self, texts: list[str | None]) -> list[tuple[float, list[str]]]:
        """For each text the probability, and what it rests on: the five terms that weigh most, then the three nearest examples as #id:cosine:label."""
        if not len(self.labels):
            return [(self.empty_score, [])] * len(texts)
        vectors, out = [self.vector(t) for t in texts], []
        for (dims, weights), (rows, cosines) in zip(vectors, self.nearest(vectors), strict=True):
            if not len(rows):
                out.append((self.empty_score, []))
                continue
            most = dims[np.argsort(-weights, kind="stable")[:5]]
            level = float(np.interp(self.vote(rows, cosines), self.knots, self.levels))
            out.append((level, [*(self.names[t].as_py() for t in most.tolist()), *(f"#{self.ids[r]}:{c:.4f}:{int(self.labels[r])}" for r, c in zip(rows[:3].tolist(), cosines, strict=False))]))
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and levels of the rising fit (pool adjacent violators), each pool at its mean place, with half a vote of either class."""
    pools: list[list[float]] = []
    order = np.lexsort((y, x))
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            a, s, n = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + s, pools[-1][2] + n]
    return np.array([p[0] / p[2] for p in pools]), np.maximum.accumulate([(p[1] + 0.5) / (p[2] + 1) for p in pools]) if pools else np.zeros(0)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic") -> Index:
    """An index of the bounded sample of labelled rows that are usable. Texts become counts, and votes are cast, in the tasks."""
    sample = durable(labelled_sample(docs, labels, label_col, usable, SAMPLE).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text", "label"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(Counter(words(t.as_py())).items()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([[w for w, _ in f] for f in found], pa.list_(pa.string())), pa.array([[n for _, n in f] for f in found], pa.list_(pa.int64()))], ["id", "label", "terms", "n"])

    rows = sample.mapInArrow(counted, "id string, label double, terms array<string>, n array<long>").toArrow()
    order = sorted(range(len(rows)), key=lambda k, ids=rows.column("id").to_pylist(), labels=rows.column("label").to_pylist(): (ids[k], labels[k], k))
    rows = rows.take(pa.array(order, pa.int64())).combine_chunks()
    whole = lambda name: rows.column(name).combine_chunks() if len(rows) else pa.array([], rows.schema.field(name).type)
    index = Index(rows.column("id").to_pylist(), rows.column("label").to_numpy().astype(float), whole("terms"), whole("n"))
    held = docs.sparkSession.sparkContext.broadcast(index)

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            votes = held.value.own_votes(b.column(1).to_pylist(), b.column(0).to_pylist()) if len(held.value.labels) else [None] * b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), b.column(2)], ["vote", "label"])

    votes = sorted(map(tuple, sample.mapInArrow(voted, "vote double, label double").filter(F.col("vote").isNotNull()).collect()))
    index.calibrate(np.array([v for v, _ in votes]), np.array([y for _, y in votes]))
    del rows, votes
    release()
    return index


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def score(df: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, evidence (terms and nearest examples as #id:cosine:label)."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = df.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            found = held.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.string()))], ["doc_id", "score", "evidence"])

    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.StringType()))]))


def accepted(df: DataFrame, index: Index, most: float = 0.3) -> DataFrame:
    """The rows whose text scores less than `most`, with the columns they had; rows never leave their partition."""
    held = df.sparkSession.sparkContext.broadcast(index)
    column = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield b.filter(pa.array([s < most for s, _ in held.value.score(b.column(column).to_pylist())], pa.bool_()))
        release()

    return df.mapInArrow(run, df.schema)
