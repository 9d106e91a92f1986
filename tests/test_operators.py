import random
import re
import time
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdictlake.functions import text as X
from verdictlake.operators import chunking as C
from verdictlake.operators import gherkin as G
from verdictlake.operators import relational as R
from verdictlake.operators import relevance as V

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_session_list(spark):
    sessions = spark.createDataFrame([("a", "u"), ("b", "u"), ("c", "v")], "id string, user_id string")
    t = datetime(2024, 1, 1)
    files = spark.createDataFrame([("a", "generated", t, 1), ("a", "uploaded", t, 2), ("c", "generated", t, 1), ("zz", "uploaded", t, 1)], "session_id string, source string, created_at timestamp, n int")
    got = {r.id: r.bdd_status for r in R.session_list(sessions, files, "id", "session_id", F.col("source"), ["created_at", "n"]).collect()}
    assert got == {"a": "uploaded", "b": "none", "c": "generated"}
    assert R.session_list(sessions.limit(0), files, "id", "session_id", F.col("source"), ["created_at"]).count() == 0


def test_access_and_upsert(spark):
    sessions = spark.createDataFrame([("a", "u")], "id string, user_id string")
    wanted = spark.createDataFrame([("a", "u"), ("a", "v"), ("x", "u"), ("a", None)], "session_id string, user_id string")
    assert sorted(r.code for r in R.access_code(sessions, wanted, "id", "user_id").collect()) == [200, 403, 403, 404]
    rows = spark.createDataFrame([("n", "1", 1, "old"), ("n", "1", 2, "new"), ("n", "2", 1, "kept")], "namespace string, id string, w int, v string")
    assert sorted(map(tuple, R.upsert(rows, ["namespace", "id"], "w").collect())) == [("n", "1", "new"), ("n", "2", "kept")]


def test_summary_counts_errors_in_total_only(spark):
    rows = spark.createDataFrame([("pass",), ("fail",), (None,)], "status string")
    assert tuple(R.summary(rows, [], F.col("status"), F.lit(True)).first()) == (3, 1, 1)


def _segments(text):
    found = list(re.finditer(r"^\s*(Scenario(?:\s+Outline)?)\s*:\s*(.+?)$", text, re.M))
    return [(m[2].strip(), text[m.start() : (found[k + 1].start() if k + 1 < len(found) else len(text))].strip()) for k, m in enumerate(found)]


@SLOW
@given(st.lists(st.lists(st.sampled_from(["Scenario: a", "Scenario Outline: <r> b", "  Scenario:", "Feature: f", "", "  Given x", "\tWhen y", "Scenario : c", "And Scenario: no"]), max_size=8), min_size=5, max_size=25))
def test_segments_match_the_pattern(spark, texts):
    texts = ["\n".join(t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", G.segments(F.col("t")).alias("s")).collect()
    for r in rows:
        assert [(s.title, s.text) for s in r.s] == _segments(texts[r.k]), texts[r.k]


def _steps(text):
    out, feature, row, last = [], "", None, None
    for line in text.split("\n"):
        t = line.strip()
        if not t or t.startswith("#"):
            continue
        if t.startswith("Feature:"):
            feature = re.sub(r"^Feature:\s*", "", t)
        elif re.match(r"Scenario( Outline)?:", t):
            row, last = {"feature": feature, "scenario": re.sub(r"^Scenario( Outline)?:\s*", "", t), "given": [], "when": [], "then": []}, None
            out.append(row)
        elif row is not None:
            word = t.split(" ")[0].lower() if re.match(r"(Given|When|Then) ", t) else None
            last = word or last
            if word or (re.match(r"(And|But) ", t) and last):
                row[last].append(t)
    return [(r["feature"], r["scenario"], *("\n".join(r[k]) for k in ("given", "when", "then"))) for r in out if r["scenario"]]


@SLOW
@given(st.lists(st.lists(st.sampled_from(["Scenario: a", "Scenario Outline: <r>", "Feature: f", "Feature: g", "", "  Given x", "When y", "Then z", "  And w", "But v", "# c", "And"]), max_size=12), min_size=5, max_size=25))
def test_steps_match_a_line_reader(spark, texts):
    texts = ["\n".join(t) for t in texts]
    got = {}
    for r in G.steps(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append((r.feature, r.scenario, r.given, r["when"], r.then))
    for k, t in enumerate(texts):
        assert got.get(k, []) == _steps(t), t


def test_render_repeats_headers(spark):
    s = "struct<source_ac_clause:string,feature:string,scenario:string,given:string,when:string,then:string>"
    rows = spark.createDataFrame([([("c", f, f"s{k}", "Given g", "When w", "Then t") for k, f in enumerate("ABA")],)], f"s array<{s}>")
    text = rows.select(G.render(F.col("s"))).first()[0]
    assert text.count("Feature: A") == 2 and text.count("Feature: B") == 1 and text.startswith("Feature: A\n\n  # Source AC: c\n  Scenario: s0\n    Given g")


def _chunks(text, size, overlap):
    if not text:
        return []
    sentences, chunks, now, n = re.split(r"(?<=[.!?])\s+", text), [], [], 0
    for s in sentences:
        w = len(s.split())
        if n + w > size and now:
            chunks.append(" ".join(now))
            tail, k = [], 0
            for x in reversed(now):
                if k + len(x.split()) > overlap and tail:
                    break
                tail.insert(0, x)
                k += len(x.split())
            now, n = tail, k
        now.append(s)
        n += w
    return [*chunks, " ".join(now)]


@pytest.mark.parametrize("size, overlap", [(10, 3), (5, 5), (500, 50)])
def test_chunks_match_a_sequential_model(spark, size, overlap):
    rng = random.Random(size)
    texts = ["", *(" ".join(" ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 7))) + rng.choice(".!?") for _ in range(rng.randint(1, 30))) for _ in range(60)), "one. ", "no end", " . . "]
    got = {}
    for r in C.chunks(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t", size, overlap).orderBy("k", "chunk").collect():
        got.setdefault(r.k, []).append(r.text)
    for k, t in enumerate(texts):
        assert got.get(k, []) == _chunks(t, size, overlap)


def test_top_files_against_brute_force(spark):
    rng = random.Random(1)
    words = ["port", "report", "login", "user", "given", "café", "auth", "db"]
    files = [(k, f"src/{rng.choice(words)}{k % 3}.py", " ".join(rng.choices(words, k=5)) + ("x" * 3000 + "login" if k == 3 else "")) for k in range(40)]
    scenarios = [(f"s{k}", " ".join(rng.sample(words, 2)), rng.choice(words)) for k in range(7)] + [("none", "", "")]
    f = spark.createDataFrame(files, "pos int, path string, content string").repartition(3)
    s = spark.createDataFrame(scenarios, "scenario_id string, title string, text string")
    stop = {"user", "given"}
    for df, chosen in ((f, files), (f.filter("pos < 5"), files[:5])):
        got = {}
        for r in V.top_files(s, df).orderBy("scenario_id", "rank").collect():
            got.setdefault(r.scenario_id, []).append((r.pos, r.score))
        for sid, title, text in scenarios:
            kw = {w for w in re.findall(r"\b[a-z]{3,}\b", f"{title} {text}".lower()) if w not in stop}
            scored = [(pos, sum(3 * (w in path.lower()) + (w in content[:2000].lower()) for w in kw)) for pos, path, content in chosen]
            want = scored if len(scored) <= 6 else sorted(scored, key=lambda x: -x[1])[:6]
            assert got[sid] == want


def test_links_against_brute_force(spark):
    files = [(0, "src/app/login.py", "u0"), (1, "login.py", "u1"), (2, "src/app/login.py", "u2"), (3, "x/none.py", None), (4, "a.py", "u4")]
    links = ["http://h/x", "src/app/login.py", "app/login.py", "deep/src/app/login.py", "login.py", "none.py", "", "zz", "a.py"]
    url_map = {}
    for _, p, u in files:
        if u:
            url_map[p] = u
    want = [x if x.startswith("http") else url_map.get(x) or next((u for p, u in url_map.items() if p.endswith(x) or x.endswith(p)), x) for x in links]
    got = V.resolve_links(spark.createDataFrame(list(enumerate(links)), "link_id int, link string"), spark.createDataFrame(files, "pos int, path string, github_url string")).orderBy("link_id").collect()
    assert [r.url for r in got] == want


def test_cosine_top_ties_and_self(spark):
    v = spark.createDataFrame([(k, [float(k % 2), 1.0]) for k in range(6)], "vec_id long, embedding array<float>")
    got = C.cosine_top(v.filter("vec_id = 0"), v, 2).orderBy("rank").collect()
    assert [(r.vec_id, r.cosine) for r in got] == [(2, 1.0), (4, 1.0)]


def test_long_texts_are_chunked_in_linear_time(spark):
    counts = [3] * 200_000
    began = time.perf_counter()
    bounds = C.bounds_of(counts, 500, 50)
    assert time.perf_counter() - began < 2 and len(bounds) > 1000
    text = "One two three. " * 200_000
    began = time.perf_counter()
    rows = C.chunks(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").agg(F.count(F.lit(1)), F.max("n_words")).first()
    assert time.perf_counter() - began < 30 and rows[0] > 1000 and rows[1] == 498


def test_spaces_of_all_kinds_part_words_and_sentences(spark):
    text = lambda x: f"One{x}two.{x}{x}Three{x}four! Five"
    rows = spark.createDataFrame([(x, text(x)) for x in X.SPACES], "x string, t string").select("x", X.sentences(F.col("t")).alias("s"), X.word_count(F.col("t")).alias("n")).collect()
    assert {r.x: (r.s, r.n) for r in rows} == {x: ([f"One{x}two.", f"Three{x}four!", "Five"], 5) for x in X.SPACES}
    assert all(text(x).split() == ["One", "two.", "Three", "four!", "Five"] for x in X.SPACES)


@pytest.mark.parametrize("parts", [1, 8, 60])
def test_endings_are_found_across_parts(spark, parts):
    rng = random.Random(parts)
    word = lambda n: "".join(rng.choices("ab/é", k=rng.randint(0, n)))
    files = [(k, word(6) if k % 3 else word(14), f"u{k}" if k % 7 else None) for k in range(150)] + [(200, None, "u")]
    links = [word(8) for _ in range(150)] + ["", "b", None, "https://x/b"]
    url_map, place = {}, {}
    for pos, path, url in files:
        if url and path is not None:
            place.setdefault(path, pos)
            url_map[path] = url
    ordered = sorted(url_map.items(), key=lambda x: place[x[0]])
    want = [x if x is None or x.startswith("http") else url_map.get(x) or next((u for p, u in ordered if p.endswith(x) or x.endswith(p)), x) for x in links]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = V.resolve_links(spark.createDataFrame(list(enumerate(links)), "link_id int, link string"), spark.createDataFrame(files, "pos int, path string, github_url string"))
        assert [r.url for r in sorted(got.collect(), key=lambda r: r.link_id)] == want
        assert not re.search("NestedLoop|Cartesian", got._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
