"""Lexical relevance of files for scenarios, links to files, and prompts."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictlake.functions.text import PROMPT_CHARS, SAMPLE_CHARS, keywords
from verdictlake.sources.sinks import once

TOP = 6
#: Distinct (keyword, scenario) pairs that may be broadcast; more scenarios are taken in blocks.
BLOCK_PAIRS = 500_000


def _pairs(scenarios: DataFrame) -> DataFrame:
    return scenarios.select("scenario_id", F.explode(keywords(F.concat_ws(" ", "title", "text"))).alias("keyword"))


def _best(rows: list[np.ndarray], top: int) -> list[np.ndarray]:
    """Of rows (scenario, score, pos, path) the `top` of each scenario: the highest scores, equal ones by place."""
    order = np.lexsort((rows[2], -rows[1], rows[0]))
    s = rows[0][order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    nth = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
    return [x[order[nth < top]] for x in rows]


def top_files(scenarios: DataFrame, files: DataFrame, top: int = TOP) -> DataFrame:
    """scenario_id, path, pos, score, rank: the best files of each scenario, equal scores by place.

    A keyword scores 3 inside the path and 1 inside the start of the content, as a substring. Files stay where they are:
    every task walks a file's text once with an automaton of all keywords, makes rows of the scenarios it hits only and keeps
    its best `top` a scenario, and only those are shuffled. Scenarios come in blocks of bounded size. With `top` files or fewer all are taken, in order.
    """
    pairs = _pairs(scenarios)
    total = pairs.count()
    blocks = max(1, -(-total // BLOCK_PAIRS))
    few = len(files.select("pos").take(top + 1)) <= top
    cut = files.select("pos", "path", F.lower("path").alias("p"), F.lower(F.left("content", F.lit(SAMPLE_CHARS))).alias("c"))
    found = None
    for b in range(blocks):
        part = scenarios.filter(F.pmod(F.xxhash64("scenario_id"), F.lit(blocks)) == b) if blocks > 1 else scenarios
        ids = [r[0] for r in part.select("scenario_id").distinct().orderBy("scenario_id").collect()]
        place = {s: k for k, s in enumerate(ids)}
        by_word: dict[str, list[int]] = {}
        for s, w in _pairs(part).collect():
            by_word.setdefault(w, []).append(place[s])
        held = files.sparkSession.sparkContext.broadcast((ids, sorted(by_word), [np.array(by_word[w]) for w in sorted(by_word)]))
        kind = scenarios.schema["scenario_id"].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            import ahocorasick

            ids, words, owners = held.value
            automaton = ahocorasick.Automaton()
            for k, w in enumerate(words):
                automaton.add_word(w, k)
            if words:
                automaton.make_automaton()
            # the best hits so far as rows of scenario, score, pos, path; and the first files, which fill up scenarios with few hits
            best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)]
            first: dict[int, str] = {}
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    part = pdf.iloc[at : at + 256]
                    keys, weights = [], []
                    for row, (p, c) in enumerate(zip(part["p"], part["c"], strict=True)):
                        for text, weight in ((p, 3), (c, 1)):
                            for k in {k for _, k in automaton.iter(text)} if words and text else ():
                                keys.append(owners[k] * 256 + row)
                                weights.append(np.full(len(owners[k]), weight))
                    pos, path = part["pos"].to_numpy(), part["path"].to_numpy()
                    first = dict(sorted([*first.items(), *zip(pos.tolist(), path, strict=True)])[:top])
                    if keys:
                        key, back = np.unique(np.concatenate(keys), return_inverse=True)
                        new = (key // 256, np.bincount(back, np.concatenate(weights)).astype(np.int64), pos[key % 256], path[key % 256])
                        best = _best([np.concatenate(x) for x in zip(best, new, strict=True)], top)
            if first:
                n = len(ids)
                fill = [np.repeat(np.arange(n), len(first)), np.zeros(n * len(first), np.int64), np.tile(np.array(list(first)), n), np.tile(np.array(list(first.values()), object), n)]
                taken = np.isin(fill[0] * (1 << 40) + fill[2], best[0] * (1 << 40) + best[2]) if len(best[0]) else np.zeros(len(fill[0]), bool)
                best = _best([np.concatenate([x, y[~taken]]) for x, y in zip(best, fill, strict=True)], top)
                yield pd.DataFrame({"scenario_id": [ids[k] for k in best[0]], "path": best[3], "pos": best[2], "score": best[1]})

        got = cut.mapInPandas(run, f"scenario_id {kind}, path string, pos {files.schema['pos'].dataType.simpleString()}, score bigint")
        found = got if found is None else found.unionByName(got)
    order = [F.asc("pos")] if few else [F.desc("score"), F.asc("pos")]
    rank = F.row_number().over(Window.partitionBy("scenario_id").orderBy(*order))
    return found.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= top)


def prompts(scenarios: DataFrame, files: DataFrame, chosen: DataFrame) -> DataFrame:
    """scenario_id and prompt: the scenario and its files in order, each file's start."""
    part = F.concat(F.lit("[F:"), F.col("path"), F.lit("]\n"), F.left("content", F.lit(PROMPT_CHARS)), F.lit("\n[/F]"))
    code = chosen.select("scenario_id", "pos", "rank").join(files, "pos").groupBy("scenario_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "\n").alias("code"))
    head = F.concat(F.lit("SCENARIO_ID:"), F.col("scenario_id").cast("string"), F.lit("\nTITLE:"), F.col("title"), F.lit("\n"), F.col("text"), F.lit("\n\nCODE:"))
    return scenarios.join(code, "scenario_id", "left").select("scenario_id", F.concat(head, F.coalesce(F.concat(F.lit("\n"), F.col("code")), F.lit(""))).alias("prompt"))


def _matches(rows: Iterable[tuple], before: list[tuple]) -> Iterator[tuple[str, bool, int, str]]:
    """link, whether the match is inexact, pos and URL of the best files that a link is a beginning of or that are one of it.

    rows: (reversed text, whether it is a link, pos, URL) in order of text, files first. before: the texts of earlier parts with which
    the first one begins, shortest first. In order, the texts with which one begins are those on a stack: each text is
    put on it and taken off once. What a file adds to the links it begins with goes to the last of them, and on when that is taken off.
    """
    files: list[tuple[str, tuple, tuple]] = []  # text, the best of it and those below, itself
    links: list[list] = []  # text, the best file that begins with it

    def close() -> Iterator[tuple]:
        text, best = links.pop()
        if best:
            yield text, True, *best
            if links:
                links[-1][1] = min(best, links[-1][1] or best)

    for here, part in ((False, before), (True, rows)):
        for text, is_link, pos, url in part:
            while files and not text.startswith(files[-1][0]):
                files.pop()
            while links and not text.startswith(links[-1][0]):
                yield from close()
            if is_link:
                if files and here:
                    exact = files[-1][0] == text
                    yield text, not exact, *files[-1][2 if exact else 1]
                links.append([text, None])
            else:
                own = (pos, url)
                files.append((text, min(own, files[-1][1]) if files else own, own))
                if links and here:
                    links[-1][1] = min(own, links[-1][1] or own)
    while links:
        yield from close()


def suffix_matches(links: DataFrame, files: DataFrame) -> DataFrame:
    """From distinct links (link) and files (path, pos, github_url): link and found, the URL of the file that is the link, else of the
    first file that ends with the link or with which the link ends. Links without any are left out.

    Reversed, an ending is a beginning, and texts with the same beginning follow each other in sort order. So all texts are
    sorted into parts by range, and a part is gone through once; what it must know of the parts before it are the texts that its first
    one begins with, no more than that one is long. Rows shuffled are twice the links and files, whatever they end with.
    """
    both = files.select(F.reverse("path").alias("text"), F.lit(False).alias("is_link"), "pos", "github_url")
    both = both.unionByName(links.select(F.reverse("link").alias("text"), F.lit(True).alias("is_link")), allowMissingColumns=True)
    rows = once(both.repartitionByRange("text").withColumn("part", F.spark_partition_id()))
    firsts = rows.groupBy("part").agg(F.min("text").alias("first"))  # a row for each part
    begins = firsts.select(F.col("part").alias("of"), F.explode(F.transform(F.sequence(F.lit(0), F.length("first")), lambda n: F.left("first", n))).alias("text"))
    before: dict[int, list[tuple]] = {}
    for of, *row in rows.join(F.broadcast(begins), "text").filter(F.col("part") < F.col("of")).select("of", "text", "is_link", "pos", "github_url").collect():
        before.setdefault(of, []).append(tuple(row))
    for own in before.values():
        own.sort(key=lambda r: (len(r[0]), r[1]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = ((row[0], row[1:]) for pdf in batches for row in zip(pdf["part"].tolist(), pdf["text"], pdf["is_link"].tolist(), pdf["pos"].tolist(), pdf["github_url"], strict=True))
        for part, own in itertools.groupby(each, key=lambda x: x[0]):
            found = _matches((row for _, row in own), before.get(part, []))
            while some := list(itertools.islice(found, 10_000)):
                yield pd.DataFrame(some, columns=["text", "inexact", "pos", "url"])

    kind = files.schema["pos"].dataType.simpleString()
    dealt = rows.repartition("part").sortWithinPartitions("part", "text", "is_link")
    best = dealt.mapInPandas(run, f"text string, inexact boolean, pos {kind}, url string").groupBy("text").agg(F.min_by("url", F.struct("inexact", "pos")).alias("found"))
    return best.select(F.reverse("text").alias("link"), "found")


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """links (link_id, link) with `url`: URLs stay; else the file with that path; else the first whose path ends with the link
    or with whose path the link ends; else the link. Files without a URL don't count; of equal paths the first place and the
    last URL do.
    """
    usable = files.filter(F.coalesce("github_url", F.lit("")) != "").groupBy("path").agg(F.min("pos").alias("pos"), F.max_by("github_url", "pos").alias("github_url")).filter("path is not null")
    absolute = F.col("link").startswith("http://") | F.col("link").startswith("https://")
    best = suffix_matches(links.filter(~absolute & F.col("link").isNotNull()).select("link").distinct(), usable)
    return links.join(best, "link", "left").select("link_id", "link", F.when(absolute, F.col("link")).otherwise(F.coalesce("found", "link")).alias("url"))
