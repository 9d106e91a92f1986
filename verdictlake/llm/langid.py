"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A document is parsed against it greedily: each phrase is the
longest run of letters from where the last one ended that occurs in the language's text. Phrases times log2 of the automaton's
text length, over the document's length, estimates the cross entropy in bits a letter; the language that needs least wins.

Edges of the COMMON commonest symbols lie in a table by state in which a missing edge already counts a phrase and restarts;
those of all others in one pair of arrays by row displacement (a state's edge to a symbol is at the state's base plus the
symbol, if that place names the state), so that memory follows the edges, whatever the alphabet. The documents of a batch,
longest first, advance together, one symbol a step in all languages; the last few go on alone. Phrases are never cut.

The labelled sample is bounded: of at most LANGS languages, those of the most rows, and at most DOCS different documents of each, chosen by hash, whole documents (those of an eighth of
the bound or less first) while they stay within SYMBOLS characters, and at least one; with many languages the bound of each
falls so that all stay within ALL_SYMBOLS, down to LEAST_SYMBOLS.

Defined cases: null texts and texts without a letter are `und` with score 0; rows without lang, or without an id, are never
learned from; with nothing to learn from all rows are `und`; equal entropies go to the language that sorts first; repeated
rows each get their result, and are learned once; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS, SYMBOLS, ALL_SYMBOLS, LEAST_SYMBOLS = 200, 24_000, 240_000, 2_000
#: Languages that are learned at most: those of the most rows.
LANGS = 500
COMMON = 63
#: Documents from which they advance together.
FEW = 8
#: Symbols that advance together.
BATCH = 6_000_000


def symbols(text: str) -> np.ndarray:
    """Code points in lower case, each run of non-letters as one space; none if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.where(_letters()[points], points, np.uint32(32))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points = points[keep]
    return points if (points != 32).any() else points[:0]


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def suffix_automaton(text: np.ndarray) -> list[dict[int, int]]:
    """The edges of each state; state 0 is the start."""
    edges: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        new = len(edges)
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(edges)
                edges.append(dict(edges[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return edges


class Parser:
    """The automata of all languages. Symbol 0 is any code point that no language has, 1 to COMMON are common; a language's first state is its start."""

    def __init__(self, texts: dict[str, np.ndarray]):
        self.langs = sorted(texts)
        points, counts = np.unique(np.concatenate([texts[k] for k in self.langs]), return_counts=True)
        self.points = points[np.lexsort((points, -counts))]
        place = np.argsort(self.points)
        self.bits = np.array([math.log2(max(2, len(texts[k]))) for k in self.langs])
        self.width = min(len(points), COMMON) + 1
        tables, base, owner, target, starts = [], [], [], [], []
        self.begin = np.zeros((len(self.langs), len(points) + 1), np.int32)
        states = places = 0
        for j, k in enumerate(self.langs):
            edges = suffix_automaton(place[np.searchsorted(self.points, texts[k], sorter=place)] + 1)
            starts.append(states)
            self.begin[j] = states
            for c, to in edges[0].items():
                self.begin[j, c] = to + states
            again = self.begin[j, : self.width].astype(np.int64)
            # next state times four times the width, plus how many phrases end: the one before, if it can't go on, and the symbol's own
            table = np.empty((len(edges), self.width), np.int64)
            table[:] = again * 4 * self.width + 1 + (again == states)
            table[0] -= 1  # at the start no phrase is open
            rare: list[tuple[int, int, int]] = []
            for s, own in enumerate(edges):
                for c, to in own.items():
                    if c < self.width:
                        table[s, c] = (to + states) * 4 * self.width
                    else:
                        rare.append((s, c, to))
            tables.append(table.astype(np.int32))
            own_base, own_owner, own_target = self._laid(len(edges), rare)
            base.append(own_base + places)
            owner.append(np.where(own_owner >= 0, own_owner + states, -1))
            target.append(own_target + states)
            states, places = states + len(edges), places + len(own_owner)
        self.table = np.concatenate(tables).ravel()
        # places beyond the last one, which no state names
        self.base = np.concatenate(base).astype(np.int32)
        self.owner = np.concatenate([*owner, np.full(len(points) + 1, -1)]).astype(np.int32)
        self.target = np.concatenate([*target, np.zeros(len(points) + 1)]).astype(np.int32)
        self.starts = np.array(starts, np.int32)[:, None]

    @staticmethod
    def _laid(states: int, edges: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each state's base, and for each place its state (or -1) and the edge's end. A base may be negative: places name their state."""
        by: dict[int, list[tuple[int, int]]] = {}
        for s, c, to in edges:
            by.setdefault(s, []).append((c, to))
        base = np.zeros(states, np.int64)
        owner: dict[int, tuple[int, int]] = {}
        at = end = 0
        for s, own in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
            low = min(c for c, _ in own)
            at = max(at, 0)
            tries = 0
            while any(at + c - low in owner for c, _ in own):
                tries += 1
                at = at + 1 if tries % 16 else end
            base[s] = at - low
            for c, to in own:
                owner[at + c - low] = (s, to)
                end = max(end, at + c - low + 1)
            at += 1
            if len(own) == 1 and at > end:
                at = end
        owners, targets = np.full(end, -1), np.zeros(end, np.int64)
        for k, (s, to) in owner.items():
            owners[k], targets[k] = s, to
        return base, owners, targets

    @property
    def nbytes(self) -> int:
        return self.table.nbytes + self.base.nbytes + self.owner.nbytes + self.target.nbytes + self.begin.nbytes + self.points.nbytes

    def _lookup(self) -> np.ndarray:
        if not hasattr(self, "_symbol"):
            self._symbol = np.zeros(0x110000, np.int32)
            self._symbol[self.points] = np.arange(1, len(self.points) + 1)
        return self._symbol

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_symbol"}

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrases of each document in each language."""
        out = np.zeros((len(docs), len(self.langs)), np.int64)
        if not docs:
            return out
        sizes = np.array([len(d) for d in docs])
        order = np.argsort(-sizes, kind="stable")
        falling = sizes[order]
        # the documents that still go on at each step, and where the step's symbols lie
        live = np.searchsorted(-falling, -np.arange(falling[0]), side="left") if falling[0] else np.zeros(0, np.int64)
        cuts = np.r_[0, np.cumsum(live)]
        flat = self._lookup()[np.concatenate([docs[k] for k in order])] if len(cuts) > 1 else np.zeros(0, np.int32)
        laid = np.empty(len(flat), np.int32)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(falling) - falling, falling)
        laid[cuts[:-1][at] + np.repeat(np.arange(len(docs)), falling)] = flat
        del at, flat
        odd = laid >= self.width
        some_odd = np.logical_or.reduceat(odd, cuts[:-1]).tolist() if len(laid) else []
        state = np.repeat(self.starts * self.width, len(docs), 1)  # where a state's row of the table begins
        count = np.zeros(state.shape, np.int32)
        together = int(np.searchsorted(-live, -FEW, side="right"))
        for a, b, rare in zip(cuts[:together].tolist(), cuts[1 : together + 1].tolist(), some_odd, strict=False):
            n = b - a
            symbol, now = laid[a:b], state[:, :n]
            if rare:
                at = np.flatnonzero(symbol >= self.width)
                then = self._rare(now[:, at] // self.width, symbol[at])
                symbol = np.where(symbol < self.width, symbol, 0)
            got = self.table.take(now + symbol)
            if rare:
                got[:, at] = then
            count[:, :n] += got & 3
            state[:, :n] = got >> 2
        for d in range(int(live[together]) if together < len(live) else 0):
            rest = laid[cuts[together : falling[d]] + d]
            for j in range(len(self.langs)):
                count[j, d], state[j, d] = self._alone(rest, int(state[j, d]), int(count[j, d]), j)
        count += state != self.starts * self.width
        out[order] = count.T
        return out

    def _rare(self, states: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """What the table would say of symbols that it lacks."""
        place = self.base[states] + symbol
        again = self.begin[:, symbol]
        new = again.astype(np.int64) * 4 * self.width + (states != self.starts) + (again == self.starts)
        return np.where(self.owner[place] == states, self.target[place].astype(np.int64) * 4 * self.width, new).astype(np.int32)

    def _alone(self, symbols_: np.ndarray, state: int, count: int, lang: int) -> tuple[int, int]:
        """The same walk for the rest of one document in one language."""
        table, width = memoryview(self.table), self.width
        start = np.arange(len(self.langs)) == lang
        for symbol in symbols_.tolist():
            if symbol < width:
                got = table[state + symbol]
            else:
                got = int(self._rare(np.full((len(self.langs), 1), state // width, np.int32), np.array([symbol]))[start][0, 0])
            count += got & 3
            state = got >> 2
        return count, state

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        docs = [symbols(t) if t else np.zeros(0, np.uint32) for t in texts]
        sizes = np.array([len(d) for d in docs])
        bits = self.phrases(docs) * self.bits / np.maximum(sizes, 1)[:, None]
        best = bits.argmin(1)
        odds = np.exp2(-4 * (bits - bits.min(1, keepdims=True)))
        score = np.where(sizes > 0, 1 / odds.sum(1), 0.0)
        return [self.langs[k] if n else "und" for k, n in zip(best, sizes, strict=True)], score


def learn(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Parser | None:
    """A parser from the rows that are usable and have an id, a lang and a text, on the bounded sample; None if there is none."""
    rows = df.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    langs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).select("lang")
    keyed = rows.join(F.broadcast(langs), "lang", "left_semi").withColumn("key", F.xxhash64("doc_id", "lang", "text"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "key")
    distinct = keyed.select("lang", "doc_id", "key", F.length("text").alias("size")).dropDuplicates(["lang", "key"])
    chosen = distinct.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= DOCS)
    sizes = sorted(map(tuple, chosen.select("lang", "nth", "key", "size").collect()))
    bound = max(LEAST_SYMBOLS, min(SYMBOLS, ALL_SYMBOLS // max(1, len({r[0] for r in sizes}))))
    wanted: dict[str, list[int]] = {}
    room: dict[str, int] = {}
    for lang, _, key, size in sorted(sizes, key=lambda r: (r[0], r[3] * 8 > bound, r[1])):
        if lang not in wanted or size <= room[lang]:
            wanted.setdefault(lang, []).append(key)
            room[lang] = room.get(lang, bound) - size
    keys = df.sparkSession.createDataFrame([(lang, k) for lang, own in wanted.items() for k in own], "lang string, key long")
    found: dict[str, list[np.ndarray]] = {}
    for lang, _, text in sorted(map(tuple, keyed.join(F.broadcast(keys), ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"]).select("lang", "key", "text").collect())):
        if len(s := symbols(text)):
            found.setdefault(lang, []).append(np.r_[s, np.uint32(32)])
    return Parser({k: np.concatenate(v) for k, v in found.items()}) if found else None


def predict(df: DataFrame, parser: Parser | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    model = df.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy()
            at = 0
            while at < whole.num_rows:
                batch = whole.slice(at, max(1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH))))
                at += batch.num_rows
                texts = batch.column(1).to_pylist()
                langs, score = model.value.predict(texts) if model.value else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], schema.names)

    return source.mapInArrow(run, schema)
