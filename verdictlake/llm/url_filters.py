"""URL filters: prefix rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

Rules are a bounded set (RULES_AT_MOST) and lie in broadcast tables, one for each shape (labels of the host, length of the
path) that occurs, so that a URL asks one hash table a shape, whatever the number of rules; the longest that fits wins.

The list may be of any size. Its canonical URLs set eight bits each in one block of 512, eight words of 64; a block is a row,
and MAX_BLOCKS bounds what is broadcast (a fuller filter passes more, and drops nothing). Distinct URLs that the filter passes
go to an exact hash join with the list, which takes the false positives out; pages stay where they are, unless so many distinct
listed URLs occur that they can't be broadcast. Then they meet in a shuffle in which URLs of many pages are dealt to several tasks.

Only DataFrame functions are used. A canonical URL has neither scheme, user, default port, fragment nor `www.` or `m.`; host
letters A-Z are lower-cased, slashes in a row or at the end of the path count once or not at all, parameters that track are left out
and the others sorted.

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule but those that have neither, and is
never listed; null or such entries of the list are passed over; repeated entries count once; repeated rules: the first holds;
repeated pages each get their verdict; extra columns may have any name; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm.common import _LOWER, _UPPER, MAX_BROADCAST_KEYS, durable

#: (verdict, host and path): the rule fits the host and its subdomains, and all paths that start with its own.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
RULES_AT_MOST, SHAPES_AT_MOST = 100_000, 64
#: Words of 64 bits a block, bits that tell a word's bit, entries a block where there is room, and blocks at most (30 MB).
WORDS, BITS, PER_BLOCK, MAX_BLOCKS = 8, 6, 32, 1 << 18
#: Rows of a URL from which it is dealt to several tasks, and the share of all rows from which it is.
MANY, PARTS = 100, 1000

TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|msclkid|mc_eid)(=|$)"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and query; all empty if the URL is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    piece = lambda pattern, group: F.regexp_extract(rest, pattern, group)
    return F.translate(piece(r"^[^/?#]*", 0), _UPPER, _LOWER), piece(r"^[^/?#]*([^?#]*)", 1), piece(r"^[^?#]*\?([^#]*)", 1)


def canonical(url: Column) -> Column:
    """The canonical URL; null where there is none."""
    host, path, query = parts(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.*(:80|:443)?$", "")
    host = F.regexp_replace(host, r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    return F.when(F.locate("://", url) > 0, F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The key's bit in each word of its block."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, BITS * w).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")) for w in range(WORDS)]


def blocked_filter(keys: DataFrame, count: int) -> tuple[DataFrame, int]:
    """The filter of the one column's keys, a row for each block that isn't empty, and the number of blocks."""
    blocks = max(1, min(MAX_BLOCKS, -(-count // PER_BLOCK)))
    (key,) = (F.col(c) for c in keys.columns)
    marked = keys.select(_block(key, blocks).alias("block"), *(b.alias(f"w{w}") for w, b in enumerate(_bits(key))))
    return durable(marked.groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)))), blocks


def passes(rows: DataFrame, key: Column, found: DataFrame, blocks: int, into: str) -> DataFrame:
    """The rows with a boolean column: whether the filter may hold their key. Nulls don't pass."""
    words = [f"{into}_w{w}" for w in range(WORDS)]
    found = F.broadcast(found.toDF(f"{into}_block", *words))
    hit = F.lit(True)
    for bit, word in zip(_bits(key), words, strict=True):
        hit = hit & (F.col(word).bitwiseAND(bit) != 0)
    joined = rows.join(found, _block(F.when(key.isNotNull(), key), blocks) == F.col(f"{into}_block"), "left")
    return joined.withColumn(into, F.coalesce(hit & key.isNotNull(), F.lit(False))).drop(f"{into}_block", *words)


def _free(df: DataFrame, name: str) -> str:
    """The name, with underlines added until no column starts with it."""
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def with_rule(rows: DataFrame, host: Column, path: Column, rules: Sequence[tuple[str, str]], into: str) -> DataFrame:
    """The rows with a struct (length, labels, rule, verdict) of the longest rule that fits, or null."""
    known: dict[str, str] = {}
    for verdict, rule in rules:
        known.setdefault(rule.translate(str.maketrans(_UPPER, _LOWER)) if "/" not in rule else rule.partition("/")[0].translate(str.maketrans(_UPPER, _LOWER)) + "/" + rule.partition("/")[2], verdict)
    shapes: dict[tuple[int, int], list[tuple[str, str]]] = {}
    for rule, verdict in known.items():
        shapes.setdefault((rule.partition("/")[0].count(".") + 1, len(rule) - len(rule.partition("/")[0])), []).append((rule, verdict))
    if len(known) > RULES_AT_MOST or len(shapes) > SHAPES_AT_MOST:
        raise ValueError(f"more than {RULES_AT_MOST} rules, or {SHAPES_AT_MOST} shapes of rules; put single URLs on the list")
    fits = [F.lit(None).cast("struct<length:int,labels:int,rule:string,verdict:string>")] * 2  # greatest wants two at least
    for n, ((labels, length), group) in enumerate(shapes.items()):
        name = f"{into}_{n}"
        of = F.broadcast(rows.sparkSession.createDataFrame(group, f"{name}r string, {name}v string"))
        rows = rows.join(of, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)) == F.col(f"{name}r"), "left")
        fits.append(F.when(F.col(f"{name}r").isNotNull(), F.struct(F.length(f"{name}r").alias("length"), F.lit(labels).alias("labels"), F.col(f"{name}r").alias("rule"), F.col(f"{name}v").alias("verdict"))))
    return rows.withColumn(into, F.greatest(*fits)).drop(*(f"{into}_{n}{x}" for n in range(len(shapes)) for x in "rv"))


def _confirmed(rows: DataFrame, key: str, possible: str, listed: DataFrame, into: str) -> DataFrame:
    """The rows with a boolean column: whether their key is on the list, which holds each key once."""
    counts = rows.filter(possible).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    found = durable(counts.join(listed.toDF(key).hint("shuffle_hash"), key, "left_semi").toDF(f"{into}_key", f"{into}_n"))
    distinct, most, total = found.agg(F.count(F.lit(1)), F.max(f"{into}_n"), F.sum(f"{into}_n")).first()
    same = F.col(key) == F.col(f"{into}_key")
    if distinct <= MAX_BROADCAST_KEYS:
        return rows.join(F.broadcast(found.drop(f"{into}_n")), same, "left").withColumn(into, F.col(f"{into}_key").isNotNull()).drop(f"{into}_key")
    many = max(MANY, total // PARTS)
    found = found.select(f"{into}_key", F.ceil(F.col(f"{into}_n") / many).cast("int").alias(f"{into}_parts"))
    hot = found.filter(F.col(f"{into}_parts") > 1).toDF(f"{into}_hot", f"{into}_of")
    dealt = rows.filter(possible).join(F.broadcast(hot), F.col(key) == F.col(f"{into}_hot"), "left").withColumn(f"{into}_at", F.pmod(F.monotonically_increasing_id(), F.coalesce(f"{into}_of", F.lit(1))).cast("int"))
    copies = found.withColumn(f"{into}_part", F.explode(F.sequence(F.lit(0), F.col(f"{into}_parts") - 1)))
    met = dealt.join(copies, same & (F.col(f"{into}_at") == F.col(f"{into}_part")), "left").withColumn(into, F.col(f"{into}_key").isNotNull())
    return met.select(*rows.columns, into).unionByName(rows.filter(~F.col(possible)).withColumn(into, F.lit(False)))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame, into: str, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """The pages with a struct (host, path, rule, listed, verdict): the rule's verdict, else block if listed, else `otherwise`."""
    keys = durable(listed.select(canonical(F.col(url)).alias("key")).filter(F.col("key").isNotNull()).distinct())
    found, blocks = blocked_filter(keys, keys.count())
    host, path, _ = parts(pages[url])
    key, possible, on, rule, h, p = (f"{into}_{x}" for x in ("key", "possible", "listed", "rule", "host", "path"))
    rows = pages.withColumns({h: host, p: path, key: canonical(pages[url])})
    rows = with_rule(rows, F.col(h), F.col(p), rules, rule)
    rows = _confirmed(passes(rows, F.col(key), found, blocks, possible), key, possible, keys, on)
    verdict = F.coalesce(F.col(f"{rule}.verdict"), F.when(F.col(on), "block").otherwise(otherwise))
    return rows.withColumn(into, F.struct(F.col(h).alias("host"), F.col(p).alias("path"), F.col(f"{rule}.rule").alias("rule"), F.col(on).alias("listed"), verdict.alias("verdict"))).select(*pages.columns, into)


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Every page's page_id, host, path, rule, verdict, and whether its canonical URL is on the list (a column url)."""
    return judged(pages.select("page_id", "url"), rules, listed, "judged").select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.listed")


def allowed(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The pages whose verdict is allow, with the columns they came with."""
    into = _free(pages, "judged")
    return judged(pages, rules, listed, into).filter(F.col(f"{into}.verdict") == "allow").drop(into)


#: Words of hosts of casinos, adverts and the like; what pages under them link to is listed URL by URL.
LISTED_HOSTS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def listed_pages(pages: DataFrame) -> DataFrame:
    """The URLs of pages on hosts that have one of the listed words as a label."""
    host, _, _ = parts(F.col("url"))
    return pages.filter(F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_HOSTS)))).select("url")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, listed_pages(pages))


def oracle() -> str:
    rules = ", ".join(f"('{v}', '{r}')" for v, r in RULES)
    words = ", ".join(f"'{x}'" for x in LISTED_HOSTS)
    lower = f"translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"
    return f"""
with rests as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
urls as (select page_id, coalesce({lower}, '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path,
    case when instr(url, '://') > 0 then regexp_replace(regexp_replace(regexp_replace({lower}, '^.*@', ''), '\\.*(:80|:443)?$', ''), '^(www|m)\\.', '')
        || regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', '')
        || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '{TRACKING}'))), '&'), ''), '') end key
  from rests),
listed as (select distinct key from urls where key is not null and list_has_any(string_split(host, '.'), [{words}])),
rules as (select v, r, split_part(r, '/', 1) rh, substr(r, length(split_part(r, '/', 1)) + 1) rp from (values {rules}) t(v, r)),
fits as (select host, path, max_by(r, length(r)) rule, max_by(v, length(r)) v
  from (select distinct host, path from urls), rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1, 2)
select page_id, host, path, rule, coalesce(v, case when key in (from listed) then 'block' else 'allow' end) verdict, coalesce(key in (from listed), false) listed
from urls left join fits using (host, path)"""
