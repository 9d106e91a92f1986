"""Divergence, collocations and URL filters: brute force on small tables, hard cases, and both ways of every switch of scale."""

import collections
import random
import re
import urllib.parse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdictlake.llm import collocations as C
from verdictlake.llm import divergence as D
from verdictlake.llm import terms as T
from verdictlake.llm import url_filters as U

DOC = "doc_id long, text string, lang string, source string, term string, n long, phrase string, _key string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """Rows of (text, lang, source), with columns whose names the operators use inside."""
    return spark.createDataFrame([(k, *r, "x", 7, "y", "z") for k, r in enumerate(rows)], DOC)


def corpus(seed, size=300):
    rng = random.Random(seed)
    common = ["The", "of", "in", "Große", "été", "日本", "a\u00a0b", "x" * 40, "x" * 41]
    words = [*common * 6, *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for _ in range(size):
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "; ", "-"]) for w in rng.choices(words, k=rng.randint(0, 30)))
        rows.append((rng.choice([text, text, text, None, ""]) if rng.random() < 0.2 else text, rng.choice(["en", "en", "de", "", None, "und"]), rng.choice(["a", "a", "a", "b", "é", "", None])))
    return rows + [rows[0]] * 5 + [(" ".join(["the of in"] * 400), "en", "a"), ("The of " * 300, "en", "only"), (None, "empty", "p"), ("1 2 3", "empty", "q")]


# --- words as codes


def test_words_as_codes_are_those_of_a_plain_split():
    rng = random.Random(1)
    texts = [None, "", " ", "a", ".", *("".join(rng.choices("aB é.\t\n\x00日", k=rng.randint(0, 40))) for _ in range(300)), "z"]
    for array in (pa.array(texts, pa.string()), pa.array(["no", *texts, "no"], pa.string()).slice(1, len(texts))):
        c = T.encode(array, T.classes(b" \t", b".\n"))
        names = c.words.to_pylist()
        got = collections.defaultdict(lambda: collections.defaultdict(list))
        for code, row, piece in zip(c.codes, c.rows, c.pieces, strict=True):
            got[int(row)][int(piece)].append(names[code].decode())
        want = {}
        for k, text in enumerate(texts):
            pieces = [w for p in re.split(r"[.\n]", (text or "").translate(LOWER)) if (w := re.findall(r"[^ \t]+", p))]
            if pieces:
                want[k] = pieces
        assert {k: [p[x] for x in sorted(p)] for k, p in got.items()} == want


def test_slices_keep_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(T, "SLICE", 10)
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["aaaa", None, "b" * 50, "", "cccccc", "dddd", "e"])})
    parts = [p.column("text").to_pylist() for p in T.slices(batch)]
    assert sum(parts, []) == batch.column("text").to_pylist()
    assert all(len(p) == 1 or sum(len(x or "") for x in p) <= 10 for p in parts)
    assert not list(T.slices(batch.slice(0, 0)))


def test_folded_pairs_stay_apart():
    a, b = np.array([0, 5, 1 << 40, 1 << 40, 5]), np.array([3, 1 << 30, 0, 1, 1 << 30])
    key = T.fold(a, b)
    assert len(set(key.tolist())) == 4 and key[1] == key[4]


# --- divergence


def brute_divergence(rows, kept, best):
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))) for text, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        seen = collections.Counter(w for of, _, ws in words if of == lang for w in set(ws))
        keep = [w for w, n in seen.items() if n >= kept]
        counts = {s: collections.Counter() for of, s, _ in words if of == lang}
        for of, s, ws in words:
            if of == lang:
                counts[s].update(w for w in ws if seen[w] >= kept)

        def share(c):
            total = sum(c.values()) + len(keep)
            return {w: 1 + 10**9 * (c[w] + 1) // total for w in keep}

        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), collections.Counter()))

        def ranked(s, part, found, top):
            order = sorted(found.items(), key=lambda x: (-x[1], x[0].encode()))
            out.update((lang, s, part, item, value, k) for k, (item, value) in enumerate(order[:top], 1))

        for s in counts:
            ranked(s, "pair", {t: sum((p[s][w] - p[t][w]) ** 2 // p[t][w] for w in keep) for t in counts if t != s}, None)
            ranked(s, "term", {w: (p[s][w] - q[w]) ** 2 // q[w] for w in keep if counts[s][w] and p[s][w] > q[w]}, best)
    return out


@pytest.mark.parametrize(("chunk", "best", "size"), [(D.CHUNK, D.TERMS, T.SLICE), (3, 4, 500), (1, 200, T.SLICE)])
def test_divergence_against_brute_force(spark, monkeypatch, chunk, best, size):
    monkeypatch.setattr(D, "CHUNK", chunk)
    rows = corpus(2)
    monkeypatch.setattr(T, "SLICE", size)
    got = [tuple(r) for r in D.audit(docs(spark, rows).repartition(3), best=best).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, D.KEPT, best)


def test_divergence_of_few_rows(spark):
    assert D.audit(docs(spark, [])).count() == 0
    assert {tuple(r) for r in D.audit(docs(spark, [(None, None, None), ("a", "x", "s")])).collect()} == set()
    got = {tuple(r) for r in D.audit(docs(spark, [("a", "x", "s"), ("a a", "x", "t")])).collect()}
    assert got == {("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)}  # nothing kept


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**9 + 7, 8 * 10**14, 3 * 10**15 - 1], np.int64)
    of = 4 * 10**15 + 3
    assert D.shares(counts, of).tolist() == [1 + 10**9 * (int(c) + 1) // of for c in counts]
    assert D.shares(np.array([of - 1]), of).tolist() == [1 + 10**9]


def test_ids_of_terms_long_and_short():
    known = sorted(x.encode() for x in ["a", "ab", "b" * 32, "b" * 33, "b" * 34, "é", "日本"])
    looked = [*known[::-1], b"", b"b" * 31, b"b" * 35, "zz".encode()]
    assert D.ids(known, D.table(known), pa.array(looked, pa.binary())).tolist() == [*range(len(known))][::-1] + [-1] * 4
    assert D.ids([], D.table([]), pa.array([b"a"], pa.binary())).tolist() == [-1]


# --- collocations


def brute_collocations(rows, longest, least, top):
    counts, places = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            places[lang] += len(words)
            counts[lang].update(tuple(words[i : i + k]) for i in range(len(words)) for k in range(1, longest + 1) if i + k <= len(words))
    out = set()
    for lang, f in counts.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        longer = collections.Counter()
        for p, n in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], n)
        rated = []
        for p, a in found.items():
            if p in longer and 100 * longer[p] >= 50 * a:
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, k, p.decode(), -a, left, right, places[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rated)[:top], 1)}
    return out


@pytest.mark.parametrize(("share", "longest", "top", "size"), [(C.HOT_SHARE, 3, 2000, T.SLICE), (5, 3, 7, 700), (10**9, 3, 2000, 300), (10**9, 5, 50, 2000), (C.HOT_SHARE, 2, 2000, T.SLICE)])
def test_collocations_against_brute_force(spark, monkeypatch, share, longest, top, size):
    monkeypatch.setattr(C, "HOT_SHARE", share)
    monkeypatch.setattr(C, "TAILS", 5)
    rows = corpus(3)
    monkeypatch.setattr(T, "SLICE", size)
    got = [tuple(r) for r in C.collocations(docs(spark, rows).repartition(3), longest=longest, top=top).collect()]
    want = brute_collocations(rows, longest, C.FREQUENT, top)
    assert want and len(got) == len(set(got)) and set(got) == want


def test_collocations_of_no_rows_and_large_products(spark, monkeypatch):
    assert C.collocations(docs(spark, [])).count() == 0
    many = 3 * 10**12
    monkeypatch.setattr(C, "count_words", lambda d: d.sparkSession.createDataFrame([("en", "a", 1, many), ("en", "b", 1, many - 1), ("en", None, 1, 5 * many)], C.PHRASE))
    monkeypatch.setattr(C, "grow", lambda d, *_: d.sparkSession.createDataFrame([("en", "a b", 2, many - 5)], C.PHRASE))
    (row,) = C.collocations(docs(spark, [])).collect()
    assert (row.score, row.n) == (10**6 * (many - 5) ** 2 // (many * (many - 1)), 5 * many)


def test_a_hot_prefix_is_dealt_to_several_tasks(spark):
    rows = [("the " + " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(j, j + 3)), "en", "a") for j in range(600)]
    batch = pa.RecordBatch.from_pydict({"text": [r[0] for r in rows], "lang": [r[1] for r in rows]})
    (of,) = {tuple(sorted(b.column("part").to_pylist())) for lang, c in C._by_language(batch) for b in C._projected(lang, c, 3, {"the": 8}) if set(b.column("prefix").to_pylist()) == {"the"}}
    assert set(of) == set(range(8))


# --- URL filters

PAGE = "page_id long, url string, judged string, key string, block int, w0 long, n long"


def pages(spark, urls):
    return spark.createDataFrame([(k if k % 7 else None, u, "j", "k", 1, 2, 3) for k, u in enumerate(urls)], PAGE)


def brute_parts(url):
    if url is None or "://" not in url:
        return "", "", None
    host, path, rest = re.match(r"([^/?#]*)([^?#]*)(.*)", url.split("://", 1)[1], re.S).groups()
    query = rest[1:].split("#")[0] if rest.startswith("?") else ""
    name = re.sub(r"^(www|m)\.", "", re.sub(r"\.*(:80|:443)?$", "", re.sub(r"^.*@", "", host.translate(LOWER))))
    keep = sorted(x for x in query.split("&") if x and not re.match(r"(utm_[^=]*|ref|fbclid|gclid|msclkid|mc_eid)(=|$)", x))
    return host.translate(LOWER), path, name + re.sub("/$", "", re.sub("/+", "/", path)) + ("?" + "&".join(keep) if keep else "")


def brute_rule(host, path, rules):
    fits = []
    for verdict, rule in rules:
        of = rule.partition("/")[0]
        if (host == of or host.endswith("." + of)) and path.startswith(rule[len(of) :]):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else None


HARD = [None, "", "no scheme", "://", "http://", "http://example.com", "http://EXAMPLE.com/EN/", "HTTP://www.Example.com/en/x#a?b", "http://notexample.com/en/", "http://a.b.example.com/en/1", "http://example.com/en", "https://x.net?/es/", "https://x.net/es/q", "https://net/fr/", "http://u@h.net:80//a//b/?b=2&a=1&utm_x=3", "http://h.net/a/b?a=1&b=2", "http://a://b/c", "x" * 5000 + "://h.net/es/", "http://" + "a." * 200 + "net/es/", "http://h.net/a\nb", "http://ÉX.net/fr/É"]


@pytest.mark.parametrize(("keys", "blocks"), [(U.MAX_BROADCAST_KEYS, U.MAX_BLOCKS), (0, U.MAX_BLOCKS), (U.MAX_BROADCAST_KEYS, 1), (0, 1)])
def test_urls_against_brute_force(spark, monkeypatch, keys, blocks):
    monkeypatch.setattr(U, "MAX_BROADCAST_KEYS", keys)
    monkeypatch.setattr(U, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(U, "MANY", 5)
    rng = random.Random(5)
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'm.', 'x.'])}{rng.choice(['a', 'b', 'example'])}.{rng.choice(['com', 'net', 'org'])}{rng.choice(['', '/en/', '/es/', '/fr/', '/q//'])}{rng.randint(0, 40)}{rng.choice(['', '/', '?ref=x', '#top', '?k=1'])}" for _ in range(1500)]
    urls += HARD + ["http://m.hot.org/1"] * 800
    listed = [None, "nothing", "https://www.hot.org/1/", *rng.sample(urls[:1500], 200), *(f"http://elsewhere.org/{k}" for k in range(3000))]
    keys = {brute_parts(u)[2] for u in listed} - {None}
    want = collections.Counter()
    for k, u in enumerate(urls):
        host, path, key = brute_parts(u)
        rule = brute_rule(host, path, U.RULES)
        on = key in keys
        want[k if k % 7 else None, host, path, rule and rule[0], rule[1] if rule else "block" if on else "allow", on] += 1
    table, list_ = pages(spark, urls), spark.createDataFrame([(u,) for u in listed], "url string")
    assert collections.Counter(tuple(r) for r in U.judge(table.repartition(4), list_).collect()) == want
    kept = U.allowed(table, list_)
    assert kept.columns == table.columns
    assert collections.Counter(r.page_id for r in kept.collect()) == collections.Counter(k[0] for k, n in want.items() for _ in range(n) if k[4] == "allow")


def test_many_rules_and_repeated_ones(spark):
    rng = random.Random(6)
    rules = [(rng.choice(["allow", "block"]), rng.choice(["a", "b.a", "c.b.a", "b", "A.b"]) + "/" * rng.randint(0, 1) + rng.choice(["", "x", "xy/", "X"])) for _ in range(60)]
    rules = [(v, r if "/" in r else r.rstrip("xyX/")) for v, r in rules]
    urls = [f"http://{h}/{p}" for h in ("a", "b.a", "c.b.a", "b", "z.a.b", "aa") for p in ("", "x", "xy/q", "X", "q")]
    first = {}
    for v, r in rules:
        host, slash, path = r.partition("/")
        first.setdefault(host.translate(LOWER) + slash + path, v)
    got = {r.host + "/" + r.path[1:]: (r.rule, r.verdict) for r in U.judge(pages(spark, urls), spark.createDataFrame([], "url string"), rules).collect()}
    assert got == {u[7:]: brute_rule(*brute_parts(u)[:2], [(v, r) for r, v in first.items()]) or (None, "allow") for u in urls}
    with pytest.raises(ValueError, match="more than"):
        U.judge(pages(spark, urls), spark.createDataFrame([], "url string"), [("allow", "a/" + "x" * k) for k in range(100)])


def test_the_filter_drops_no_listed_key_and_few_others_pass(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    found, blocks = U.blocked_filter(keys, 20_000)
    rows = spark.range(60_000).select("id", F.concat(F.lit("k"), "id").alias("key"))
    passed = U.passes(rows, F.col("key"), found, blocks, "p").filter("p")
    assert passed.filter("id < 20000").count() == 20_000
    assert passed.filter("id >= 20000").count() < 400
    assert U.passes(spark.range(3).select(F.lit(None).cast("string").alias("key")), F.col("key"), found, blocks, "p").filter("p").count() == 0


def test_urls_stay_in_the_jvm_and_meet_the_list_by_hash_join(spark, tmp_path):
    pages(spark, [u for u in HARD if u]).write.parquet(f"{tmp_path}/pages.parquet")
    table = spark.read.parquet(f"{tmp_path}/pages.parquet")
    plan = U.judge(table, U.listed_pages(table))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
    assert "BroadcastHashJoin" in plan


def test_canonical_urls(spark):
    rows = spark.createDataFrame([(u,) for u in HARD], "url string").select("url", U.canonical(F.col("url")).alias("key")).collect()
    assert {r.url: r.key for r in rows} == {u: brute_parts(u)[2] for u in HARD}
    assert urllib.parse.urlsplit("http://" + brute_parts("http://u@h.net:80//a//b/?b=2&a=1&utm_x=3")[2]).query == "a=1&b=2"
