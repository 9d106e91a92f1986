"""HTML extraction: the article's text, with boilerplate found by suffix arrays over the token streams of each host's pages.

A page is walked tag by tag into blocks. A block's mark is a feature: it lies in the article (article, else main), or in an
element that is no content by what it is (script, style, nav, header, footer, aside, form, ...) or by its role, class or id
(menus, adverts, notices, comments, ...), or nothing is known about it.

What a host repeats is counted over all its pages. The words outside articles form a token stream a page; the streams of one
host (dealt to several parts if it is large) are joined, each ended by a token of its own, and a suffix array over them brings
equal runs together. The order need only be right to RUN words: a longer repeat is covered by its runs of RUN words, each on
as many pages. Pages of one part count once for each content: copies of an article, which always come to one part, are one
page. A run is a repeat if it stands outside articles on PAGES of the host's distinct pages or more.

A slot is the way of elements and classes to a block. For each host and slot the share of words that repeats cover says
whether the slot holds boilerplate: TELLING of them do in slots without a mark, TELLING_INSIDE in articles. On every page, marked or not, the covered words of such slots go, and what is unique
stays: of a marked article what is left of its blocks, of other pages what is left of the blocks that no mark leaves out. So a
passage that several articles share stays, and an unmarked menu goes.

Defined cases: null or empty html gives an empty text; markup may be cut off or unbalanced; a null url is a host of its own
name, empty; repeated rows each get their text and count as one page; an element left out by its class doesn't hide an article
or main element inside, but for comments; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from verdictlake.llm.common import durable
from verdictlake.llm.graph import PARTS, with_groups

RUN, PAGES = 8, 2
TELLING, TELLING_INSIDE = 0.5, 0.9
#: Pages of a host, and bytes of their streams, from which they are dealt to several parts.
PART, PART_BYTES = 256, 8 << 20
#: Boilerplate runs (16 bytes each) that are broadcast at most, once they have been counted.
MAX_BROADCAST_RUNS = 2_000_000
#: Words from which a block tells pages apart.
LONG = 20

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|title|iframe|object|canvas|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[|<([/!?]?)([a-zA-Z][a-zA-Z0-9:-]*|)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|itemprop|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Never content.
_OUT = frozenset("head nav header footer aside form button select menu dialog label option fieldset audio video map".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MARKED = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|breadcrumbs?|masthead|header|topbar|footer|sidebar|side-?bar|widgets?|ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|sign-?up|share|sharing|social|related|recommended|recommendations|trending|comments?|commentlist|comment-list|disqus\w*|respond|replies|login|search|paywall|toolbar|pagination|pager|skip-link)(?=$|[\s_-]|\d)", re.I)
#: Class names that speak of the page's other parts.
_OF_OTHERS = re.compile(r"\b(?:has|with|no|is|without)-[\w-]+|[\w-]+-(?:open|closed|enabled|disabled)\b", re.I)
#: Parts whose articles are not the page's.
_OTHERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|comment-list|disqus\w*|respond|replies|related|recommended|recommendations|trending|sidebar|side-?bar|widgets?|ads?|advert\w*|sponsor\w*|promo\w*|modal|popup|overlay)(?=$|[\s_-]|\d)", re.I)
_COMMENT = re.compile(r"(?:^|[\s_\"'-])comments?(?=$|[\s_\"'-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar alertdialog".split())
_SPACE = re.compile(r"\s+")


def _left_out(tag: str, attributes: str) -> bool:
    if tag in _OUT:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return any(n.lower() in ("class", "id") and _COMMENT.search(v) for n, v in _ATTRIBUTE.findall(attributes))
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name in ("class", "id") and _MARKED.search(_OF_OTHERS.sub("", value)):
            return True
    return False


def _may_hold_article(tag: str, attributes: str) -> bool:
    """Whether an element that is left out could still be a wrapper around the page's article."""
    return tag not in _OUT and not any(n.lower() in ("class", "id") and _OTHERS.search(_OF_OTHERS.sub("", v.strip("\"'"))) for n, v in _ATTRIBUTE.findall(attributes or ""))


class Block(NamedTuple):
    text: str
    inside: int  # 0 outside, 1 in main, 2 in article
    out: bool  # markup leaves it out
    slot: int  # hash of the way to it


#: Elements that a new one of their kind closes.
_CLOSED_BY_NEXT = frozenset("p li dt dd tr td th".split())
_CLASS = re.compile(r"""\bclass\s*=\s*["']?([^"'>]*)""", re.I)


def blocks(page: str | None) -> list[Block]:
    """The page's blocks in order."""
    page = page or ""
    out: list[Block] = []
    way: list[str] = []
    text: list[str] = []
    inside = {"article": 0, "main": 0}
    stop, depth = "", 0  # the element that is left out, and how deep it nests in itself
    wrapper = False  # it may hold the article

    def flush() -> None:
        if text:
            joined = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            text.clear()
            if joined:
                out.append(Block(joined, 2 if inside["article"] else 1 if inside["main"] else 0, bool(stop), xxhash.xxh64_intdigest(">".join(way[-4:])) >> 1))

    at = 0
    for m in _TOKEN.finditer(page):
        start, end = m.span()
        if start > at:
            text.append(page[at:start])
        at = end
        tag = m[3]
        if not tag:
            if m[1]:
                text.append(" ")
            continue
        tag, closing, attributes = tag.lower(), m[2] == "/", m[4]
        if tag not in _BLOCK and tag not in _OUT:
            if tag == "br":
                text.append(" ")
            if not stop and not closing and attributes and tag not in _VOID and not attributes.rstrip().endswith("/") and _left_out(tag, attributes):
                flush()
                stop, depth, wrapper = tag, 1, _may_hold_article(tag, attributes)
            elif stop == tag:
                depth += -1 if closing else 1
                if depth <= 0:
                    flush()
                    stop = ""
            continue
        flush()
        if tag in _VOID:
            continue
        if closing:
            for k in range(len(way) - 1, -1, -1):
                if way[k].partition(".")[0] == tag:
                    del way[k:]
                    break
        else:
            while way and (own := way[-1].partition(".")[0]) in _CLOSED_BY_NEXT and (own == "p" or own == tag):
                way.pop()
            named = _CLASS.search(attributes) if attributes else None
            way.append(f"{tag}.{named[1]}" if named else tag)
        if stop:
            if (stop == "p" and tag != "p" and not closing) or (wrapper and tag in inside and not closing and not _left_out(tag, attributes)):
                stop = ""  # a block ends an open paragraph, an article its wrapper's mark
            elif tag == stop or tag in ("body", "html"):
                depth = 0 if tag in ("body", "html") or (stop == "p" and not closing) else depth + (-1 if closing else 1)
                if depth <= 0:
                    stop = ""
                if closing or stop:
                    continue
            else:
                continue
        if closing:
            if tag in inside and inside[tag]:
                inside[tag] -= 1
        elif _left_out(tag, attributes):
            stop, depth, wrapper = tag, 1, _may_hold_article(tag, attributes)
        elif tag in inside:
            inside[tag] += 1
    if at < len(page):
        tail = page[at:]
        cut = re.search(r"<[a-zA-Z/!][^>]*\Z", tail)  # a tag that the page's end cuts
        text.append(tail[: cut.start()] if cut else tail)
    flush()
    return out


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "replace")) for w in words), np.uint64, len(words))


def runs(stream: np.ndarray, length: int = RUN) -> np.ndarray:
    """For each place the rank of the run of `length` tokens that starts there, by prefix doubling; the suffix order to that depth."""
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < length:
        step = min(done, length - done)
        later = np.full(len(rank), -1, np.int64)
        later[:-step] = rank[step:] if step < len(rank) else later[:-step]
        rank = np.unique(rank * (len(rank) + 1) + later + 1, return_inverse=True)[1].astype(np.int64)
        done += step
    return rank


def _gram_hashes(words: np.ndarray, length: int = RUN) -> np.ndarray:
    """A hash of each run of `length` words, the same in every batch."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[k : k + n]
    return h


def repeated_runs(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """From the streams of distinct pages: runs (hashes), and on how many of the pages each occurs."""
    sizes = np.array([len(w) for w in streams], np.int64)
    # a token of its own ends each page, so that no run reaches into the next
    stream = np.concatenate([np.zeros(0, np.uint64), *(np.r_[w, np.uint64(0)] for w in streams)])
    page, ends = np.repeat(np.arange(len(streams)), sizes + 1), np.cumsum(sizes + 1) - 1
    ids = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    ids[ends] = len(stream) + 1 + np.arange(len(streams))
    rank = runs(ids)
    grams = np.zeros(len(stream), np.uint64)
    whole = _gram_hashes(stream)[: len(stream)]
    grams[: len(whole)] = whole
    order = np.lexsort((page, rank))
    order = order[order + RUN <= ends[page[order]]]
    if not len(order):
        return grams[:0], np.zeros(0, np.int64)
    r, p = rank[order], page[order]
    first = np.r_[True, r[1:] != r[:-1]]
    counts = np.add.reduceat((first | np.r_[True, p[1:] != p[:-1]]).astype(np.int64), np.flatnonzero(first))
    return grams[order[first]], counts


def _split(found: list[Block]) -> tuple[list[Block], list[Block]]:
    """The blocks of the page's article (of main if it has none), and those outside. Without any article or main the first are none."""
    level = max((b.inside for b in found if not b.out), default=0)
    return [b for b in found if level and b.inside >= level and not b.out], [b for b in found if not level or b.inside < level or b.out]


def outside(page: str | None) -> tuple[bytes, int]:
    """The page's stream of words outside its article, as hashes, and a hash of its content: of its long blocks, or of all it has."""
    article, rest = _split(blocks(page))
    content = [b.text for b in [*article, *rest] if not b.out]
    long = [t for t in content if t.count(" ") + 1 >= LONG] or [b.text for b in [*rest, *article]]
    stream = _hashes(" ".join(b.text for b in rest).split())
    return stream.tobytes(), xxhash.xxh64_intdigest("\n".join(long).encode("utf-8", "replace")) >> 1


def _covered(found: list[Block], boilerplate: np.ndarray) -> list[np.ndarray]:
    """For each block which of its words boilerplate runs cover; runs reach over blocks. `boilerplate` is sorted."""
    sizes = [b.text.count(" ") + 1 for b in found]
    cover = np.zeros(sum(sizes), bool)
    if len(boilerplate) and len(cover) >= RUN:
        grams = _gram_hashes(_hashes(" ".join(b.text for b in found).split(" ")))
        hit = np.flatnonzero(boilerplate[np.minimum(np.searchsorted(boilerplate, grams), len(boilerplate) - 1)] == grams)
        for k in range(RUN):
            cover[hit + k] = True
    return np.split(cover, np.cumsum(sizes)[:-1]) if found else []


def slots(page: str | None, boilerplate: np.ndarray) -> dict[tuple[int, bool], tuple[int, int]]:
    """Words, and covered ones, by slot and whether it is in the article; slots that markup leaves out aside."""
    out: dict[tuple[int, bool], tuple[int, int]] = {}
    for inside, part in zip((True, False), _split(blocks(page)), strict=True):
        for b, gone in zip(part, _covered(part, boilerplate), strict=True):
            if not b.out:
                n, c = out.get((b.slot, inside), (0, 0))
                out[b.slot, inside] = n + len(gone), c + int(gone.sum())
    return out


def main_text(page: str | None, boilerplate: np.ndarray, telling: frozenset[int] | set[int]) -> str:
    """The page's text, given its host's boilerplate runs (sorted hashes) and the slots that hold boilerplate."""
    article, rest = _split(blocks(page))
    part = article or rest
    if not telling:
        return "\n\n".join(b.text for b in part if not b.out)
    kept = []
    for b, gone in zip(part, _covered(part, boilerplate), strict=True):
        if not b.out:
            kept.append(" ".join(w for w, c in zip(b.text.split(" "), gone.tolist(), strict=True) if not c) if b.slot in telling and gone.any() else b.text)
    return "\n\n".join(t for t in kept if t)


_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)"


def boilerplate(pages: DataFrame) -> DataFrame:
    """From host and html: host and run (hash) of what each host repeats outside articles."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [outside(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in found], pa.binary()), pa.array([c for _, c in found], pa.int64())], ["host", "stream", "content"])

    # of the pages of one content one counts: that of the most words outside
    streams = pages.select("host", "html").mapInArrow(streamed, "host string, stream binary, content long")
    streams = durable(streams.groupBy("host", "content").agg(F.max("stream").alias("stream")))
    dealt = with_groups(streams, "host", streams.count(), F.col("content"), pages=F.count(F.lit(1)), size=F.sum(F.length("stream")))
    parts = F.ceil(F.greatest(F.col("pages") / PART, F.col("size") / PART_BYTES))
    dealt = dealt.select("host", F.pmod("content", F.greatest(parts, F.lit(1))).cast("int").alias("part"), "stream")

    def counted(group: pa.Table) -> pa.Table:
        grams, n = repeated_runs([np.frombuffer(x, np.uint64) for x in group.column("stream").to_pylist()])
        host = group.column("host")[0].as_py()
        return pa.table({"host": pa.array([host] * len(grams), pa.string()), "run": pa.array(grams.astype(np.int64)), "n": pa.array(n, pa.int64())})

    counts = dealt.groupBy("host", "part").applyInArrow(counted, "host string, run long, n long").groupBy("host", "run").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= PAGES).select("host", "run")


def _by_host(pages: DataFrame, known: DataFrame, make: Callable[[list[tuple], np.ndarray, set[int]], pa.Table], result: T.StructType) -> DataFrame:
    """`make` over the pages' rows (host last), each with its host's runs and slots from `known` (host, run, slot; one of them null).

    Few known rows are broadcast, and pages stay in place; else a host's pages and rows come together, a part of the pages at a time.
    """
    none = np.zeros(0, np.uint64)
    if known.count() <= MAX_BROADCAST_RUNS:
        found: dict[str, tuple[np.ndarray, set[int]]] = {}
        table = known.toArrow().sort_by([("host", "ascending"), ("run", "ascending")])
        hosts = table.column("host").combine_chunks().dictionary_encode() if len(table) else pa.array([], pa.string()).dictionary_encode()
        place = hosts.indices.to_numpy()
        cuts = np.r_[0, np.flatnonzero(place[1:] != place[:-1]) + 1, len(place)] if len(place) else np.zeros(1, np.int64)
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = table.slice(a, b - a)
            found[hosts[int(a)].as_py()] = _known(own)
        held = pages.sparkSession.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                by: dict[str, list[tuple]] = {}
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    by.setdefault(row[-1], []).append(row)
                for host, rows in by.items():
                    yield from make(rows, *held.value.get(host, (none, set()))).to_batches()

        return pages.mapInArrow(run, result)

    names = pages.columns

    def together(own: pa.Table, rows: pa.Table) -> pa.Table:
        columns = [own.column(name).to_pylist() for name in names]
        return make(list(zip(*columns, strict=True)), *_known(rows))

    sizes = durable(pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = sizes.select("host", F.ceil(F.col("n") / max(PART, total // PARTS)).cast("int").alias("parts"))
    hot = F.broadcast(sizes.filter(F.col("parts") > 1))  # PARTS hosts at most
    dealt = pages.join(hot, "host", "left").withColumn("part", F.pmod(F.xxhash64("html"), F.coalesce("parts", F.lit(1))).cast("int")).select(*pages.columns, "part")
    spread = known.join(sizes, "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("host", "part", "run", "slot")
    return dealt.groupBy("host", "part").cogroup(spread.groupBy("host", "part")).applyInArrow(together, result)


def _known(rows: pa.Table) -> tuple[np.ndarray, set[int]]:
    """Sorted runs and the slots from rows of both."""
    return np.sort(rows.column("run").drop_null().to_numpy().astype(np.uint64)), set(rows.column("slot").drop_null().to_pylist())


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), _HOST, 1))
    source = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    result = T.StructType([source.schema["page_id"], source.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    kinds = to_arrow_schema(result)
    runs_ = durable(boilerplate(source).select("host", "run", F.lit(None).cast("long").alias("slot")))

    def measured(rows: list[tuple], known: np.ndarray, _: set[int]) -> pa.Table:
        sums: dict[tuple[int, bool], list[int]] = {}
        for page, _host in rows:
            for key, (n, c) in slots(page, known).items():
                had = sums.setdefault(key, [0, 0])
                had[0] += n
                had[1] += c
        some = list(sums)
        return pa.table({"host": pa.array([rows[0][1]] * len(some) if rows else [], pa.string()), "slot": pa.array([k[0] for k in some], pa.int64()), "inside": pa.array([k[1] for k in some], pa.bool_()), "n": pa.array([v[0] for v in sums.values()], pa.int64()), "covered": pa.array([v[1] for v in sums.values()], pa.int64())})

    def made(rows: list[tuple], known: np.ndarray, telling: set[int]) -> pa.Table:
        texts = [main_text(r[2], known, telling) for r in rows]
        return pa.table([pa.array(c, kinds.field(k).type) for k, c in enumerate(([r[0] for r in rows], [r[1] for r in rows], texts, [len(t) for t in texts]))], schema=kinds)

    measures = _by_host(source.select("html", "host"), runs_, measured, T._parse_datatype_string("host string, slot long, inside boolean, n long, covered long"))
    sums = measures.groupBy("host", "slot", "inside").agg(F.sum("n").alias("n"), F.sum("covered").alias("covered"))
    telling = sums.filter((F.col("covered") > 0) & (F.col("covered") >= F.when(F.col("inside"), TELLING_INSIDE).otherwise(TELLING) * F.col("n")))
    known = durable(runs_.unionByName(telling.select("host", F.lit(None).cast("long").alias("run"), "slot").distinct()))
    return _by_host(source, known, made, result)
