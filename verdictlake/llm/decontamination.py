"""Benchmark decontamination by spaced-seed hashing, as DataFrame operations only.

Texts become words (ASCII letters in lower case, digits and every non-ASCII character; all else separates). A benchmark item
leaks into a document where WINDOW consecutive words of each, side by side, agree in at least NEEDED places: substitutions
are tolerated, up to two in thirteen words. Items with fewer words must occur whole, word for word.

A spaced seed is a mask over word positions that ignores some of them. Every window with two substitutions or fewer leaves
at least one placement of one of MASKS untouched (a test tries all), so joining the hashes under the masks of documents and
items finds every leak; each joined place is then checked word by word. Hashes of document places are made and probed inside
one generated loop a document, so only hits become rows. The benchmark side is broadcast while it has at most
MAX_BROADCAST_SEEDS rows of some 60 bytes. Beyond that places are shuffled as text key, place and hash only, and the words of
texts with a hit are fetched once.

Defined cases: null and word-free texts never match; benchmark rows with the same words count once, under the smallest
item_id; items without an id give a row each, with a null item_id; the same document id on several rows gives one row an item; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import ASCII_LOWER, MAX_BROADCAST_KEYS, NON_WORD, durable, free_name, row_key, spaced, without_keys

WINDOW, NEEDED = 13, 11
#: Two masks of six words; together they meet every choice of two substitutions in thirteen words.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
MAX_BROADCAST_SEEDS = 1_000_000


def _hashes(text: Column) -> Column:
    words = spaced(text)
    return F.when(words == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(words, " "), lambda w: F.xxhash64(w)))


def _keys(hashes: Column, pos: Column, n: Column, masks: list[tuple[int, ...]]) -> Column:
    """The hash under each mask at a place; null where the mask would leave the text."""
    return F.array(*(F.when(pos + mask[-1] < n, F.xxhash64(F.lit(k), *(F.get(hashes, pos + i) for i in mask))) for k, mask in enumerate(masks)))


def _places(df: DataFrame, id_name: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """A row for each mask and place: id, hashes, n, pos, key."""
    each = df.select(id_name, "hashes", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "word"))
    return each.select(id_name, "hashes", "n", "pos", F.explode(_keys(F.col("hashes"), F.col("pos"), F.col("n"), masks)).alias("key"))


def _text_key(hashes: Column) -> Column:
    """128 bits that tell texts apart by their words."""
    return F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(k), hashes)), 16, "0") for k in (1, 2)))


def _fetched(corpus: DataFrame, seeds: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """doc_id, item_key, shift, n_item, n and hashes of the hits where seeds are many: no place carries its text's words through the shuffle."""
    texts = corpus.withColumn("text_key", _text_key(F.col("hashes")))
    places = _places(texts, "text_key", masks).select("text_key", "n", "pos", "key").filter(F.col("key").isNotNull())
    hits = durable(places.join(seeds, "key").select("text_key", "item_key", (F.col("pos") - F.col("item_pos")).alias("shift"), "n_item", "n").distinct())
    hit_texts = durable(hits.select("text_key").distinct())
    of = F.broadcast(hit_texts) if hit_texts.count() <= MAX_BROADCAST_KEYS else hit_texts
    words = durable(texts.join(of, "text_key").select("doc_id", "text_key", "hashes"))
    return hits.join(words, "text_key")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_windows (pairs of windows that agree), best_equal (most equal words in one), doc_word (where the first starts)."""
    items = benchmark.select(F.col(item_col).alias("item_id"), _hashes(F.col(item_text_col)).alias("item_hashes")).filter(F.size("item_hashes") > 0)
    items = items.groupBy("item_hashes").agg(F.min("item_id").alias("item_id")).select(_text_key(F.col("item_hashes")).alias("item_key"), "item_id", F.col("item_hashes").alias("hashes"), F.size("item_hashes").alias("n"))
    # items too short for the masks get one mask over all their words
    span = max(m[-1] for m in MASKS) + 1
    short = sorted(r[0] for r in items.filter(F.col("n") < span).select("n").distinct().collect())
    masks = [*MASKS, *(tuple(range(n)) for n in short)]
    seeds = _places(items.select("item_key", "hashes"), "item_key", masks).filter(F.col("key").isNotNull()).select("key", "item_key", F.col("pos").alias("item_pos"), F.col("n").alias("n_item"))
    bounded = seeds.count() <= MAX_BROADCAST_SEEDS
    small = F.broadcast if bounded else (lambda x: x)

    corpus = docs.select(F.col(id_col).alias("doc_id"), _hashes(F.col(text_col)).alias("hashes"))
    if bounded:
        shift = F.col("pos") - F.col("item_pos")  # where the item would start in the document
        hits = _places(corpus, "doc_id", masks).join(small(seeds), "key").withColumn("shift", shift)
    else:
        hits = _fetched(corpus, seeds, masks)
    start = F.greatest("shift", F.lit(0))
    hits = hits.select("doc_id", "item_key", "shift", F.slice("hashes", start + 1, F.least(F.col("n_item") + F.col("shift"), F.col("n")) - start).alias("part")).dropDuplicates()

    beside = hits.join(small(items), "item_key").withColumn("own", F.slice("hashes", F.greatest(-F.col("shift"), F.lit(0)) + 1, F.size("part")))
    width, least = F.least(F.col("n"), F.lit(WINDOW)), F.when(F.col("n") < WINDOW, F.col("n")).otherwise(NEEDED)
    equal = F.zip_with("part", "own", lambda a, b: (a == b).cast("int"))
    beside = beside.select("doc_id", "item_key", "item_id", "shift", width.alias("width"), least.alias("least"), equal.alias("equal")).filter(F.size("equal") >= F.col("width"))
    sums = F.transform(F.sequence(F.lit(1), F.size("equal") - F.col("width") + 1), lambda i: F.aggregate(F.slice("equal", i, F.col("width")), F.lit(0), lambda a, x: a + x))
    beside = beside.withColumn("sums", sums)
    agree = F.transform("sums", lambda x: x >= F.col("least"))
    found = beside.select("doc_id", "item_id", F.when(F.col("item_id").isNull(), F.col("item_key")).alias("of"), F.size(F.filter(agree, lambda x: x)).alias("n"), F.array_max("sums").alias("best"), (F.greatest(F.col("shift"), F.lit(0)) + F.array_position(agree, F.lit(True)) - 1).alias("at")).filter(F.col("n") > 0)
    return found.groupBy("doc_id", "item_id", "of").agg(F.sum("n").cast("bigint").alias("n_windows"), F.max("best").cast("bigint").alias("best_equal"), F.min("at").cast("bigint").alias("doc_word")).drop("of")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents into which no benchmark item leaks; rows without an id go if any row without one has a leak."""
    leaks = contaminated(docs, benchmark).select(F.col("doc_id").alias("leak_id")).distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak_id"]), "left_anti")


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows into whose own text no benchmark item leaks, whatever other rows of the same id hold."""
    name = free_name(docs, "row_key")
    keyed = docs.withColumn(name, row_key(docs))
    leaks = contaminated(keyed, benchmark, id_col=name).select("doc_id").distinct()
    return without_keys(keyed, leaks, name).select(*docs.columns)


#: The same pairs by comparing every word of every document with every word of every item.
ORACLE = f"""
with d as (select doc_id, string_split(trim(regexp_replace({ASCII_LOWER}, '{NON_WORD}', ' ', 'g')), ' ') w from documents),
dn as (select doc_id, w, len(w) n from d where w[1] <> ''),
b as (select min(item_id) item_id, w from (select item_id, string_split(trim(regexp_replace({ASCII_LOWER}, '{NON_WORD}', ' ', 'g')), ' ') w from benchmark) where w[1] <> '' group by w),
bw as (select item_id, len(w) m, unnest(w) word, generate_subscripts(w, 1) - 1 j from b),
dw as (select doc_id, n, unnest(w) word, generate_subscripts(w, 1) - 1 i from dn),
p as (select doc_id, item_id, i - j shift, j, n, m, least(m, {WINDOW}) width, case when m < {WINDOW} then m else {NEEDED} end need from dw join bw using (word)),
k as (select doc_id, item_id, shift from p group by all having count(*) >= min(need)),
s as (select p.*, unnest(range(greatest(0, j - width + 1, -shift), least(j, m - width, n - width - shift) + 1)) s from p join k using (doc_id, item_id, shift)),
v as (select doc_id, item_id, shift, s, count(*) c, any_value(need) need from s group by 1, 2, 3, 4 having count(*) >= any_value(need))
select doc_id, item_id, count(*) n_windows, max(c) best_equal, min(shift + s)::bigint doc_word from v group by 1, 2
"""
