"""Quality classification with histogram gradient-boosted trees over document statistics.

Statistics are taken from whole texts inside the tasks. Trees are grown on the driver from at most SAMPLE labelled rows,
chosen by hash of the id: each statistic is cut into at most BINS bins by quantiles, a node's gradients and Hessians are
summed by bin, and the cut of highest gain that leaves a Hessian of LEAST on either side is taken, level by level. A tree of depth DEPTH is three flat arrays; scoring
walks all trees of all rows of a batch together.

Defined cases: a null text is an empty one, whose statistics are 0; labels that are null or lack a document are left out;
with one class or no labels every score is that class's share (0.5 without labels); repeated labels of an id count as often
as they occur; repeated rows each get their score; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE, BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 10_000, 64, 4, 60, 0.15, 1.0, 0.2

NAMES = ("log_chars", "log_words", "mean_word", "upper", "digit", "space", "newline", "comma_stop", "bang_question", "pipe", "symbol", "non_ascii", "distinct_words", "top_word", "distinct_lines", "mean_line", "distinct_trigrams", "short_words", "long_words", "letters_only", "ends_stop", "upper_words", "digit_words")

_CLASS = np.zeros((256, 9))
for _c in range(256):
    _s = chr(_c) if _c < 128 else ""
    _CLASS[_c] = [_s.isupper(), _s.isdigit(), _s.isspace(), _s == "\n", _s in (",", "."), _s in ("!", "?"), _s == "|", _s in tuple("#$%&*@^~+=<>{}[]\\/_"), 0x80 <= _c < 0xC0]


def statistics(text: str | None) -> list[float]:
    """The values of NAMES for a whole text."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(NAMES)
    n = len(raw)
    upper, digit, space, newline, stop, bang, pipe, symbol, far = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    words = raw.split()
    m = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    trigrams = set(zip(words, words[1:], words[2:]))
    alpha = sum(map(bytes.isalpha, words))
    return [
        np.log1p(n), np.log1p(len(words)), float(sizes.mean()) if len(words) else 0.0, upper / n, digit / n, space / n, newline / n, stop / m, bang / m, pipe / m, symbol / m, far / n,
        len(counts) / m**0.8, max(counts.values(), default=0) / m, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), len(trigrams) / max(1, len(words) - 2),
        float((sizes <= 3).sum()) / m, float((sizes > 12).sum()) / m, alpha / m, float(raw.rstrip()[-1:] in (b".", b"!", b"?")), sum(map(bytes.isupper, words)) / m, sum(map(bytes.isdigit, words)) / m,
    ]


class Trees:
    """Boosted trees for one probability: features, cuts and leaf values in flat arrays, a row for each tree."""

    def __init__(self, base: float):
        self.base = base
        self.features = np.zeros((0, 2**DEPTH - 1), np.int64)
        self.cuts = np.zeros((0, 2**DEPTH - 1))
        self.leaves = np.zeros((0, 2**DEPTH))

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if not len(self.features):
            return total
        at, tree, rows = np.zeros((len(x), len(self.features)), np.int64), np.arange(len(self.features)), np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.features[tree, at]] > self.cuts[tree, at])
        return total + self.leaves[tree, at - (2**DEPTH - 1)].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        model = cls(float(np.log(share / (1 - share))))
        if len(np.unique(y)) < 2:
            return model
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        score, grown = np.full(len(y), model.base), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, cut, node = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf), np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                width = 2**level
                best, where, bin_ = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, BINS)
                for j in range(x.shape[1]):
                    key = node * BINS + binned[:, j]
                    gs, hs = (np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                    gain[(hs < LEAST) | (ht - hs < LEAST)] = 0
                    k = gain.argmax(1)
                    better = gain[np.arange(width), k] > best
                    best[better], where[better], bin_[better] = gain[np.arange(width), k][better], j, k[better]
                first = width - 1
                for w in range(width):
                    if bin_[w] < len(edges[where[w]]):
                        feature[first + w], cut[first + w] = where[w], edges[where[w]][bin_[w]]
                node = 2 * node + (x[np.arange(len(y)), feature[first + node]] > cut[first + node])
            leaves = -RATE * np.bincount(node, g, 2**DEPTH) / (np.bincount(node, h, 2**DEPTH) + RIDGE)
            score = score + leaves[node]
            grown.append((feature, cut, leaves))
        model.features, model.cuts, model.leaves = (np.stack(v) for v in zip(*grown, strict=True))
        return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, bound: int) -> DataFrame:
    """doc_id, text and label of at most `bound` labelled rows, by hash of the id; the ids are broadcast, so other texts stay in place.

    An id on several documents gives the text that sorts first by its hash, so that a hot id doesn't swell the sample.
    """
    chosen = labels.filter(usable & F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label_col).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    return texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).join(F.broadcast(chosen), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality") -> Trees:
    """Trees from the labelled rows that are usable. Texts become statistics in the tasks; only those reach the driver."""
    sample = labelled_sample(docs, labels, label_col, usable, SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64())), b.column(2)], ["doc_id", "x", "label"])

    rows = sorted(map(tuple, sample.select(F.col("doc_id").cast("string"), "text", "label").mapInArrow(run, "doc_id string, x array<double>, label double").collect()))
    return Trees.fit(np.array([r[1] for r in rows]).reshape(-1, len(NAMES)), np.array([r[2] for r in rows]))


def score(df: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the probability of label 1."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                x = np.array([statistics(t.as_py()) for t in b.column(1)]).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.probability(x))], ["doc_id", "score"])

    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())]))


def accepted(df: DataFrame, model: Trees, least: float = 0.5) -> DataFrame:
    """The rows whose text scores at least `least`, with the columns they had; rows never leave their partition."""
    held = df.sparkSession.sparkContext.broadcast(model)
    column = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                x = np.array([statistics(t.as_py()) for t in b.column(column)]).reshape(-1, len(NAMES))
                yield b.filter(pa.array(held.value.probability(x) >= least))

    return df.mapInArrow(run, df.schema)
