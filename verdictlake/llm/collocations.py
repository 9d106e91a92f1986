"""Phrase collocations by pattern growth: contiguous phrases of each language that occur often, scored by their weakest cut.

First words are counted. Then every place of a word that starts a window of up to LONGEST words becomes an occurrence pointer
in the projection of its prefix: equal windows of a slice of text are one row with a count, and all rows of a prefix meet in one
task, which grows it to the right, depth-first: pointers are split by their next word, and followed as long as FREQUENT of them are
left. A prefix of which a task would get too many (its words are all hot: more than one place in HOT_SHARE of all, or HOT_PLACES) is
dealt by the word after it, in as many parts as needed, so that no task gathers more than that, however frequent a phrase
is; its counts are then partial sums. Counts below the threshold go where a prefix is whole, so that only frequent phrases are
joined with the counts of what they are cut into. Hot parts of cuts are dealt as well.

A phrase's score is floor(10^6 a a / (l r)) of the cut that gives least. Phrases inside a longer one that occurs at least half as
often are dropped. The best TOP of each language are ranked, in two steps, so that no task ranks all phrases of a language.

Defined cases: null texts are empty; a null language is `und`, as is the language of that name; words are bytes other than spaces and
tabs, and may be of any length; repeated rows count each time; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictlake.llm import graph, terms
from verdictlake.llm.common import ASCII_LOWER, durable

LONGEST, FREQUENT, TOP = 3, 10, 2000
#: A word is hot if it is at more than one in HOT_SHARE of all places, or at more than HOT_PLACES: HOT_SHARE words at most, and one for every HOT_PLACES places.
HOT_SHARE, HOT_PLACES = 400, 1 << 22
#: Windows of a projection that are put into one row.
TAILS = 1 << 16

_CLASSES = terms.classes(b" \t", b".,;:!?\n\x0b\x0c\r")
PHRASE = "lang string, phrase string, words int, n long"


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, terms.Codes]]:
    for part in terms.slices(batch):
        numbers, names = terms.numbered(pc.fill_null(part.column("lang"), "und"))
        for k, name in enumerate(names.to_pylist()):
            yield name, terms.encode(part.column("text").filter(pa.array(numbers == k)), _CLASSES)


def count_words(docs: DataFrame) -> DataFrame:
    """lang, phrase, words, n of every word, and of each language's null word: all its places."""

    def run(batches):
        for batch in batches:
            for lang, c in _by_language(batch):
                n = np.bincount(c.codes, minlength=len(c.words))
                phrases = pa.concat_arrays([c.words.cast(pa.string()), pa.nulls(1, pa.string())])
                size = len(phrases)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), size), phrases, pa.repeat(pa.scalar(1, pa.int32()), size), pa.array(np.append(n, len(c.codes)), pa.int64())], names=["lang", "phrase", "words", "n"])

    return docs.mapInArrow(run, PHRASE).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def _windows(c: terms.Codes, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows from every place, to the end of its piece at most, as rows of codes (-1: none), and how often each occurs."""
    size = len(c.codes)
    found = np.full((longest, size), -1, np.int64)
    for k in range(min(longest, size)):
        same = c.pieces[: size - k] == c.pieces[k:]
        found[k, : size - k][same] = c.codes[k:][same]
    key = found[0] + 1
    for k in range(1, longest):
        key = terms.fold(key, found[k] + 1)
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return found[:, first].T, n


def _joined(words: pa.Array, codes: np.ndarray) -> pa.Array:
    """Rows of codes as texts, a space between words; those of -1 are left out."""
    columns = [words.take(pa.array(np.where(codes[:, k] < 0, 0, codes[:, k]), mask=codes[:, k] < 0)) for k in range(codes.shape[1])]
    if not columns:
        return pa.repeat(pa.scalar("", pa.large_string()), len(codes))
    return pc.ascii_rtrim(pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()), null_handling="replace"), characters=" ")


def _projected(lang: str, c: terms.Codes, longest: int, hot: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """A slice's windows by prefix: lang, prefix, part, tails (a line each), n."""
    windows, n = _windows(c, longest)
    if not len(n):
        return
    words = c.words.cast(pa.large_string())
    parts = np.ones(len(words), np.int64)
    at = pc.index_in(words, pa.array(list(hot), pa.large_string())).to_numpy(zero_copy_only=False) if hot else np.full(len(words), np.nan)
    parts[~np.isnan(at)] = np.array([*hot.values()], np.int64)[at[~np.isnan(at)].astype(int)]
    warm = np.zeros(len(words) + 1, bool)  # its last row stands for none
    warm[:-1] = parts > 1
    run = np.cumprod(warm[windows], axis=1).sum(axis=1)  # hot words that a window starts with
    for length in np.unique(run):
        own = windows[run == length]
        counts = n[run == length]
        depth = max(1, int(length))
        part = np.zeros(len(own), np.int64)
        if 0 < length < longest:
            of = parts[own[:, :depth]].min(axis=1)
            after = own[:, depth]
            used = np.unique(after[after >= 0])
            hashes = np.zeros(len(words) + 1, np.int64)
            hashes[used] = [zlib.crc32(w) for w in words.take(pa.array(used)).cast(pa.large_binary()).to_pylist()]
            part = hashes[after] % of
        key = own[:, 0] + 1
        for k in range(1, depth):
            key = terms.fold(key, own[:, k] + 1)
        key = terms.fold(key, part)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        edges = np.unique(np.concatenate([starts, np.arange(0, len(order), TAILS)]))  # long projections are cut
        tails = _joined(words, own[order][:, depth:])
        offsets = pa.array(np.append(edges, len(order)), pa.int64())
        lines = pc.binary_join(pa.LargeListArray.from_arrays(offsets, tails), pa.scalar("\n", pa.large_string()))
        head = order[edges]
        yield pa.RecordBatch.from_arrays(
            [
                pa.repeat(pa.scalar(lang), len(head)),
                _joined(words, own[head][:, :depth]).cast(pa.string()),
                pa.array(part[head].astype(np.int32)),
                lines.cast(pa.string()),
                pa.LargeListArray.from_arrays(offsets, pa.array(counts[order])).cast(pa.list_(pa.int64())),
            ],
            names=["lang", "prefix", "part", "tails", "n"],
        )


def _grow(pointers: np.ndarray, depth: int, after: np.ndarray, n: np.ndarray, least: int, path: list[int], out: list[tuple[list[int], int]]) -> None:
    """Extends a prefix by each next word that `least` of its occurrences have, depth-first. after: next words by pointer (-1: none)."""
    if depth == after.shape[1]:
        return
    nexts = after[pointers, depth]
    order = np.argsort(nexts, kind="stable")
    nexts, pointers = nexts[order], pointers[order]
    starts = np.flatnonzero(np.append(True, nexts[1:] != nexts[:-1]))
    sums = np.add.reduceat(n[pointers], starts)
    ends = np.append(starts[1:], len(nexts))
    for k in np.flatnonzero((sums >= least) & (nexts[starts] >= 0)):
        grown = [*path, int(nexts[starts[k]])]
        out.append((grown, int(sums[k])))
        _grow(pointers[starts[k] : ends[k]], depth + 1, after, n, least, grown, out)


def _grown(prefix: str, rows: list[tuple[pa.Array, np.ndarray]], total: int, longest: int, least: int, whole: bool) -> tuple[list[str], list[int], list[int]]:
    """Frequent phrases that start with the prefix, their words and counts. whole: all the prefix's `total` occurrences are here."""
    n = np.concatenate([x for _, x in rows])
    known = prefix.count(" ") + 1
    phrases, words, counts = ([prefix], [known], [total]) if known > 1 else ([], [], [])
    if not whole and known > 2:  # its beginnings are dealt as well: this is their part
        pieces = prefix.split(" ")
        for k in range(2, known):
            phrases.append(" ".join(pieces[:k])), words.append(k), counts.append(total)
    if known < longest:
        tails = pa.concat_arrays([x for x, _ in rows])
        split = pc.split_pattern(pc.list_flatten(pc.split_pattern(tails, "\n")), " ")
        size = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        flat, names = terms.numbered(pc.list_flatten(split))
        after = np.full((len(n), longest - known), -1, np.int64)
        row = np.repeat(np.arange(len(n)), size)
        after[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat
        none = names.index("").as_py()
        if none >= 0:
            after[after == none] = -1
        # a dealt prefix's next words are all here, but for those that are hot themselves, whose places lie under longer prefixes
        out: list[tuple[list[int], int]] = []
        _grow(np.arange(len(n)), 0, after, n, least, [], out)
        texts = names.to_pylist()
        for path, count in out:
            phrases.append(" ".join([prefix, *(texts[k] for k in path)])), words.append(known + len(path)), counts.append(count)
    return phrases, words, counts


def grow(docs: DataFrame, hot: dict[str, dict[str, int]], longest: int, least: int) -> DataFrame:
    """lang, phrase, words, n of the phrases of two words or more that occur `least` times or more."""

    def project(batches):
        for batch in batches:
            for lang, c in _by_language(batch):
                yield from _projected(lang, c, longest, hot.get(lang, {}))

    def tasks(batches):
        now, rows, total = None, [], 0
        found: tuple[list, list, list, list] = ([], [], [], [])

        def close():
            if not rows:
                return
            lang, prefix, _ = now
            whole = prefix.partition(" ")[0] not in hot.get(lang, {})
            if whole and total < least:  # not frequent, and so is nothing that it grows into
                return
            phrases, words, counts = _grown(prefix, rows, total, longest, least, whole)
            for column, values in zip(found, ([lang] * len(phrases), phrases, words, counts), strict=True):
                column.extend(values)

        def taken():
            batch = pa.RecordBatch.from_arrays([pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int32()), pa.array(found[3], pa.int64())], names=["lang", "phrase", "words", "n"])
            for column in found:
                column.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            lists, tails = batch.column("n"), batch.column("tails")
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sums = np.add.reduceat(values, offsets[:-1])  # no list is empty
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("prefix").to_pylist(), batch.column("part").to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if keys[at] != now:
                    close()
                    now, rows, total = keys[at], [], 0
                rows.append((tails.slice(at, end - at), values[offsets[at] : offsets[end]]))
                total += int(sums[at:end].sum()) if end - at > 1 else int(sums[at])
                at = end
            if len(found[0]) >= 10_000:
                yield taken()
        close()
        yield taken()

    rows = docs.mapInArrow(project, "lang string, prefix string, part int, tails string, n array<long>").repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")
    return rows.mapInArrow(tasks, PHRASE).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _cuts(phrases: DataFrame) -> DataFrame:
    """Each phrase with its cuts: k, left and right."""
    pieces = F.split("phrase", " ")
    cut = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    return cut.select("lang", "phrase", F.col("n").alias("a"), "k", F.array_join(F.slice(pieces, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(pieces, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"))


def _with_count(rows: DataFrame, column: str, into: str, counts: DataFrame, total: int) -> DataFrame:
    """The rows with the count of the phrase in a column; phrases of many rows are dealt to several tasks."""
    keyed = rows.withColumn("_key", F.struct("lang", column))
    known = counts.select(F.struct("lang", F.col("phrase").alias(column)).alias("_key"), F.col("n").alias("_known"))
    both = keyed.unionByName(known, allowMissingColumns=True)
    met = graph.with_groups(both, "_key", total, F.struct("phrase", "k"), **{into: F.max("_known")})
    return met.filter(F.col("phrase").isNotNull()).drop("_key", "_known")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = FREQUENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    docs = docs.select("lang", "text")
    words = durable(count_words(docs).filter((F.col("n") >= least) | F.col("phrase").isNull()))
    places = words.filter(F.col("phrase").isNull()).select("lang", "n")
    total = places.agg(F.sum("n")).first()[0] or 0
    most = max(least, min(HOT_PLACES, total // HOT_SHARE))
    hot: dict[str, dict[str, int]] = {}
    for lang, word, n in words.filter(F.col("phrase").isNotNull() & (F.col("n") > most)).select("lang", "phrase", "n").collect():
        hot.setdefault(lang, {})[word] = 1 + n // most
    phrases = durable(grow(docs, hot, longest, least))
    count = phrases.count()
    counts = words.filter(F.col("phrase").isNotNull()).unionByName(phrases)
    cuts = _with_count(_with_count(_cuts(phrases), "left", "l", counts, longest * count), "right", "r", counts, longest * count)
    big = {x: F.col(x).cast("decimal(38,0)") for x in ("a", "l", "r")}
    cuts = cuts.withColumns({f"_{x}": c for x, c in big.items()}).withColumn("score", F.expr("(cast(1000000 as decimal(7,0)) * _a * _a) div (_l * _r)"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    pieces = F.split("phrase", " ")
    inside = phrases.filter(F.col("words") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inside = inside.select("lang", F.array_join(F.slice(pieces, F.col("at"), F.col("size")), " ").alias("phrase"), F.col("n").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 50))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = kept.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(math.isqrt(count // top) + 1)))
    first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(places, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
with pieces as (select coalesce(lang, 'und') lang, unnest(string_split_regex({ASCII_LOWER}, '[.,;:!?\\x0A-\\x0D]')) piece from documents),
lists as (select lang, regexp_extract_all(piece, '[^ \\t]+') w from pieces),
places as (select lang, w, unnest(generate_series(1, len(w))) i from lists where len(w) > 0),
totals as (select lang, count(*) n from places group by 1),
grams as (select lang, m words, array_to_string(w[i:i + m - 1], ' ') phrase, count(*) f from places, (values (1), (2), (3)) t(m) where i + m - 1 <= len(w) group by 1, 2, 3 having count(*) >= {FREQUENT}),
candidates as (select * from grams where words > 1),
cuts as (select lang, phrase, f a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') y from candidates, (values (1), (2)) t(k) where k < words),
scores as (select c.lang, c.phrase, a, k, g.f l, h.f r, (1000000::hugeint * a * a) // (g.f::hugeint * h.f) score from cuts c join grams g on g.lang = c.lang and g.phrase = x join grams h on h.lang = c.lang and h.phrase = y),
least as (select * from scores qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (select lang, phrase, max(f) f from (select lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) phrase from candidates where words = 3) group by 1, 2),
ranked as (select s.lang, s.phrase, a, l, r, score, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) rank from least s left join longer g using (lang, phrase) where g.f is null or 100 * g.f < 50 * a)
select lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from ranked join totals using (lang) where rank <= {TOP}"""
