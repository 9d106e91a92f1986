"""Divergence of a language's sources: how far each source's shares of terms are from those of every other source, and by which terms.

Terms are integers. A language keeps the terms of KEPT documents or more; sorted, they are cut into chunks (the dictionary), so
that an id is a chunk and a place in its array, and ids are ordered as the terms' UTF-8 bytes are. Tasks that read texts count a slice's
terms by source (bincount) and send each run of sorted terms to the chunk whose first term it starts at or after; only these
first terms are known to all (one for CHUNK terms). A chunk's task looks the terms up in the sorted array (searchsorted; what isn't
kept isn't there) and adds the counts up source by source. With the sums over all chunks known, each chunk becomes a dense
array of sources by terms; its shares, divergences and best terms are integer vectors, and a chunk ranks by id. CHUNK falls
with the number of a language's sources, so that such an array stays within CELLS numbers. No task holds a whole dictionary or
all of a source.

Arithmetic is exact: shares come from long division by thousands, so that nothing passes 64 bits as long as a group has
fewer than 9e15 terms.

Defined cases: null lang, source and text are empty; a document without a term still makes its group occur; without kept terms all
sources of a language diverge by 0; repeated rows are documents of their own; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictlake.llm import terms
from verdictlake.llm.common import ASCII_LOWER, durable

KEPT, TERMS = 3, 200
CHUNK, CELLS = 2048, 1 << 22
#: Bytes up to which terms are compared as arrays of one width.
WIDTH = 32
UNIT = 1_000_000_000

_CLASSES = terms.classes(bytes(range(0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)))
_CELL = "lang string, chunk int, source string, ids array<int>, n array<long>"
_FOUND = "lang string, source string, part string, item string, value long"


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, terms.Codes]]:
    for part in terms.slices(batch):
        numbers, names = terms.numbered(part.column("lang"))
        for k, name in enumerate(names.to_pylist()):
            own = part.filter(pa.array(numbers == k))
            yield name, own, terms.encode(own.column("text"), _CLASSES)


def kept_terms(docs: DataFrame, kept: int) -> DataFrame:
    """lang and term of the terms that `kept` of a language's documents have, or more."""

    def run(batches):
        for batch in batches:
            for lang, _, c in _by_language(batch):
                pairs = np.unique(terms.fold(c.codes.astype(np.int64), c.rows.astype(np.int64)))
                codes = pairs // (int(c.rows.max()) + 1) if len(pairs) else pairs
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(c.words)), c.words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(c.words)), pa.int64())], names=["lang", "term", "n"])

    return docs.mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= kept).select("lang", "term")


def dictionary(kept: DataFrame, size: int) -> DataFrame:
    """lang, first and terms: sorted arrays of at most `size` terms that no other chunk's terms lie between."""

    def run(batches):
        lang, now = None, []

        def chunk():
            return pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array(now[:1], pa.string()), pa.array([now], pa.list_(pa.string()))], names=["lang", "first", "terms"])

        for batch in batches:
            for of, term in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist(), strict=True):
                if now and (of != lang or len(now) == size):
                    yield chunk()
                    now = []
                lang = of
                now.append(term)
        if now:
            yield chunk()

    parts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, "lang string, first string, terms array<string>")


def _sent(lang: str, sources: pa.Array, c: terms.Codes, firsts: list[bytes]) -> pa.RecordBatch | None:
    """A slice's counts by chunk and source: sorted terms, a line each."""
    if not firsts or not len(c.codes):
        return None
    order = pc.sort_indices(c.words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = c.words.take(pa.array(order))
    local = words.to_pylist()
    edges = np.array([bisect_left(local, x) for x in firsts])
    numbers, names = terms.numbered(sources)
    width = len(local)
    keys, n = np.unique(numbers[c.rows] * width + rank[c.codes], return_counts=True)
    of, term = keys // width, keys % width
    chunk = np.searchsorted(edges, term, "right") - 1
    of, term, chunk, n = (x[chunk >= 0] for x in (of, term, chunk, n))
    if not len(n):
        return None
    starts = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(chunk) != 0)))
    offsets = pa.array(np.append(starts, len(n)), pa.int64())
    lines = pc.binary_join(pa.LargeListArray.from_arrays(offsets, words.take(pa.array(term)).cast(pa.large_string())), pa.scalar("\n", pa.large_string()))
    counts = pa.LargeListArray.from_arrays(offsets, pa.array(n.astype(np.int64))).cast(pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(starts)), pa.array(chunk[starts].astype(np.int32)), names.take(pa.array(of[starts])), lines.cast(pa.string()), counts], names=["lang", "chunk", "source", "terms", "n"])


def table(known: list[bytes]) -> np.ndarray:
    """A sorted array of terms, cut to one width."""
    return np.array(known, f"S{WIDTH + 1}") if known else np.empty(0, f"S{WIDTH + 1}")


def ids(known: list[bytes], cut: np.ndarray, looked: pa.Array) -> np.ndarray:
    """The places of terms in a sorted array; -1 for those that aren't there. cut: table(known)."""
    found = np.full(len(looked), -1, np.int64)
    if not known or not len(looked):
        return found
    words = looked.to_pylist()
    asked = np.array(words, cut.dtype)
    short = pc.binary_length(looked).to_numpy(zero_copy_only=False) <= WIDTH
    at = np.minimum(np.searchsorted(cut, asked), len(known) - 1)
    hit = short & (cut[at] == asked)
    found[hit] = at[hit]
    for k in np.flatnonzero(~short):
        place = bisect_left(known, words[k])
        if place < len(known) and known[place] == words[k]:
            found[k] = place
    return found


def count_cells(docs: DataFrame, chunks: DataFrame, firsts: dict[str, list[bytes]]) -> DataFrame:
    """lang, chunk, source, and the ids and counts of its terms in the chunk. chunks: lang, chunk, terms."""

    def send(batches):
        for batch in batches:
            for lang, own, c in _by_language(batch):
                sent = _sent(lang, own.column("source"), c, firsts.get(lang, []))
                if sent is not None:
                    yield sent

    def add(batches):
        chunk, known, cut = None, [], table([])
        source, total = None, np.empty(0, np.int64)  # the source whose rows may go on in the next batch

        def taken():
            some = np.flatnonzero(total)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([chunk[0]], pa.string()), pa.array([chunk[1]], pa.int32()), pa.array([source], pa.string()), pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([total[some]], pa.list_(pa.int64()))], names=["lang", "chunk", "source", "ids", "n"])

        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("chunk").to_pylist(), strict=True))
            sources = batch.column("source").to_pylist()
            texts = batch.column("terms").cast(pa.binary())
            counts, offsets = batch.column("n").values.to_numpy(zero_copy_only=False), batch.column("n").offsets.to_numpy()
            at = 0
            while at < len(keys):
                if keys[at] != chunk:
                    yield from taken()
                    chunk, source, total = keys[at], None, np.empty(0, np.int64)
                if sources[at] is None:  # the chunk's own row comes first
                    known = texts[at].as_py().split(b"\n")
                    cut = table(known)
                    at += 1
                    continue
                end = at
                while end < len(keys) and keys[end] == chunk:
                    end += 1
                place = ids(known, cut, pc.list_flatten(pc.split_pattern(texts.slice(at, end - at), b"\n")))
                row = np.repeat(np.arange(at, end), np.diff(offsets[at : end + 1]))
                of = np.cumsum([k > at and sources[k] != sources[k - 1] for k in range(at, end)])
                there = place >= 0
                # sums of a batch's counts are far below 2 ** 53
                sums = np.bincount((of[row - at] * len(known) + place)[there], counts[offsets[at] : offsets[end]][there], (int(of[-1]) + 1) * len(known)).astype(np.int64).reshape(-1, len(known))
                for k, name in enumerate(dict.fromkeys(sources[at:end])):
                    if name != source:
                        yield from taken()
                        source, total = name, sums[k]
                    else:
                        total = total + sums[k]
                at = end
        yield from taken()

    sent = docs.mapInArrow(send, "lang string, chunk int, source string, terms string, n array<long>")
    words = chunks.select("lang", "chunk", F.lit(None).cast("string").alias("source"), F.array_join("terms", "\n").alias("terms"), F.array().cast("array<bigint>").alias("n"))
    return sent.unionByName(words).repartition("lang", "chunk").sortWithinPartitions("lang", "chunk", "source").mapInArrow(add, _CELL)


def shares(counts: np.ndarray, of: np.ndarray | int) -> np.ndarray:
    """1 + floor(UNIT * (counts + 1) / of), by long division; 0 < counts + 1 <= of."""
    rest = counts + 1
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // of
        rest = rest % of
    return out + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _judged(lang: str, words: list[str], sources: list[str], totals: np.ndarray, size: int, counts: np.ndarray, best: int) -> Iterator[pa.RecordBatch]:
    """A chunk's part of all pairs, and its best terms of each source. counts: sources by terms."""

    def rows(source: str, part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
        k = len(items)
        return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), k), pa.repeat(pa.scalar(source), k), pa.repeat(pa.scalar(part), k), pa.array(items, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "part", "item", "value"])

    p = shares(counts, (totals + size)[:, None]) if len(words) else counts
    q = shares(counts.sum(axis=0), int(totals.sum()) + size) if len(words) else None
    for k, source in enumerate(sources):
        values = divergences(p[k], p).sum(axis=1)
        yield rows(source, "pair", sources[:k] + sources[k + 1 :], np.delete(values, k))
        if q is not None:
            mine = np.flatnonzero((counts[k] > 0) & (p[k] > q))
            values = divergences(p[k][mine], q[mine])
            order = np.argsort(-values, kind="stable")[:best]  # ids are in the order of terms
            yield rows(source, "term", [words[x] for x in mine[order]], values[order])


def judge_chunks(cells: DataFrame, chunks: DataFrame, profiles: DataFrame, best: int) -> DataFrame:
    """Each chunk's parts of pairs and its best terms. profiles: lang, sources (sorted), totals, size (kept terms)."""

    def run(batches):
        key, own, counts = None, None, None

        def close():
            if own is not None:
                words, sources, totals, size = own
                yield from _judged(key[0], words, sources, totals, size, counts, best)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["lang"], row["chunk"]) != key:
                    yield from close()
                    key = (row["lang"], row["chunk"])
                if row["source"] is None:
                    own = row["terms"], row["sources"], np.array(row["totals"], np.int64), row["size"]
                    counts = np.zeros((len(own[1]), len(own[0])), np.int64)
                    place = {s: k for k, s in enumerate(own[1])}
                else:
                    counts[place[row["source"]], row["ids"]] = row["n"]
        yield from close()

    every = chunks.unionByName(profiles.select("lang", F.lit(-1).alias("chunk"), F.array().cast("array<string>").alias("terms")))  # one without terms, so that all pairs appear
    heads = every.join(profiles, "lang").withColumn("source", F.lit(None).cast("string"))
    both = heads.unionByName(cells, allowMissingColumns=True).select("lang", "chunk", "source", "terms", "sources", "totals", "size", "ids", "n")
    return both.repartition("lang", "chunk").sortWithinPartitions("lang", "chunk", "source").mapInArrow(run, _FOUND)


def audit(docs: DataFrame, kept: int = KEPT, best: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language, and the terms that a source has more of."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = docs.select("lang", "source").distinct()
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    chunks = durable(dictionary(kept_terms(docs, kept), max(1, min(CHUNK, CELLS // most))))
    firsts: dict[str, list[bytes]] = {}
    for lang, first in sorted((lang, first.encode()) for lang, first in chunks.select("lang", "first").collect()):
        firsts.setdefault(lang, []).append(first)
    place = F.udf(lambda lang, first: bisect_left(firsts[lang], first.encode()), "int")
    chunks = chunks.select("lang", place("lang", "first").alias("chunk"), "terms")
    cells = durable(count_cells(docs, chunks, firsts))
    sums = cells.groupBy("lang", "source").agg(F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("total"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("size"))
    known = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("s"))
    profiles = known.join(sizes, "lang", "left").select("lang", F.col("s.source").alias("sources"), F.col("s.total").alias("totals"), F.coalesce("size", F.lit(0)).alias("size"))
    found = durable(judge_chunks(cells, chunks, durable(profiles), best))
    pairs = found.filter(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return pairs.withColumn("rank", rank).unionByName(found.filter(F.col("part") == "term").withColumn("rank", rank).filter(F.col("rank") <= best))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
with docs as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source, {ASCII_LOWER} t from documents),
words as (select id, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from docs),
kept as (select lang, term from words group by 1, 2 having count(distinct id) >= {KEPT}),
sizes as (select lang, count(*) v from kept group by 1),
counts as (select lang, source, term, count(*) c from words semi join kept using (lang, term) group by 1, 2, 3),
groups as (select lang, source, coalesce(sum(c), 0) + coalesce(any_value(v), 0) d from (select distinct lang, source from docs) left join counts using (lang, source) left join sizes using (lang) group by 1, 2),
dense as (select lang, source, term, coalesce(c, 0) c, 1 + ({UNIT}::hugeint * (coalesce(c, 0) + 1)) // d p from groups join kept using (lang) left join counts using (lang, source, term)),
langs as (select lang, sum(c) + any_value(v) d from counts join sizes using (lang) group by 1),
whole as (select lang, term, 1 + ({UNIT}::hugeint * (sum(c) + 1)) // any_value(d) q from counts join langs using (lang) group by 1, 2),
pairs as (select g.lang, g.source, h.source item from groups g join groups h on g.lang = h.lang and g.source <> h.source),
sums as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) value from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pair as (select lang, source, 'pair' part, item, coalesce(value, 0) value from pairs left join sums using (lang, source, item)),
term as (select lang, source, 'term' part, term item, (p - q) * (p - q) // q value from dense join whole using (lang, term) where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) rank from (from pair union all from term))
select lang, source, part, item, value::bigint value, rank::int rank from ranked where part = 'pair' or rank <= {TERMS}"""
