import json

import pytest
from pyspark.sql import functions as F

from verdictlake.functions import text as X
from verdictlake.functions import ticket as K
from verdictlake.functions import verdict as D


def one(spark, value, column):
    """The value of an expression over one row with a string column x."""
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    "given, want",
    [("kan-1", "KAN-1"), ("https://o.example.net/browse/KAN-1?x=1", "KAN-1"), ("https://o.example.net/jira/issues/AB-22", "AB-22"), ("https://o.example.net/b?selectedIssue=Q-9", "Q-9"), ("https://kan-7.example.net/", ""), ("https://kan-7.example.net/x/TT-4", "TT-4"), ("nothing", ""), ("", ""), ("see ABC-12 there", "ABC-12")],
)
def test_ticket_key(spark, given, want):
    assert one(spark, given, X.ticket_key(F.col("x"))) == want


def test_urls(spark):
    blob = one(spark, " https://github.com/o/r/blob/feature/x/src/a.py ", X.blob_url(F.col("x")))
    assert tuple(blob) == ("o", "r", "feature", "x/src/a.py")
    assert one(spark, "https://github.com/o/r", X.blob_url(F.col("x"))) is None
    for u in ("https://github.com/o/r", "https://github.com/o/r/", "https://github.com/o/r.git", "https://github.com/o/r.git/"):
        assert tuple(one(spark, u, X.repo_url(F.col("x")))) == ("o", "r")
    assert one(spark, "https://github.com/o/r/pull/1", X.repo_url(F.col("x"))) is None
    assert tuple(one(spark, "https://github.com/o/r/pull/42/files", X.pull_url(F.col("x")))) == ("o", "r", 42)
    assert one(spark, "https://github.com/o/r/pull/x", X.pull_url(F.col("x"))) is None
    assert one(spark, None, X.blob_url(F.col("x"))) is None


@pytest.mark.parametrize("path, ok", [("a/b.PNG", False), ("a/.lock", True), ("a.lock", False), ("x.tar.gz", False), ("x.png/y", True), ("Makefile", True), ("w.py", True)])
def test_text_paths(spark, path, ok):
    assert one(spark, path, X.is_text_path(F.col("x"))) is ok


def test_keywords_are_whole_words_of_any_script(spark):
    assert one(spark, "The naïve caféteria USER logs in twice, logs_out 4ever", F.array_join(X.keywords(F.col("x")), " ")) == "logs twice"


def test_base64_and_quoting(spark):
    assert one(spark, "aGVs\nbG8=", X.decode_base64(F.col("x"))) == "hello"
    assert one(spark, "/w==", X.decode_base64(F.col("x"))) == "\ufffd"
    assert one(spark, "a b+c:/d&", X.quote_query(F.col("x"))) == "a%20b+c:/d%26"
    assert one(spark, 'a "b"', X.csv_line(F.col("x"), F.lit(None).cast("string"))) == '"a ""b""",""'


def test_percent(spark):
    rows = spark.createDataFrame([(3, 4), (1, 8), (0, 0), (4, 4), (0, None)], "p int, t int")
    assert [tuple(r) for r in rows.select(X.pass_percent(F.col("p"), F.col("t")), X.accent(X.pass_percent(F.col("p"), F.col("t")))).collect()] == [(75, "amber"), (13, "amber"), (0, "rose"), (100, "emerald"), (None, "")]


def test_upload_limits(spark):
    rows = spark.createDataFrame([("a.feature", b"x" * X.MAX_UPLOAD_BYTES), ("a.feature", b"x" * (X.MAX_UPLOAD_BYTES + 1)), ("a.txt", b""), ("a.feature", b"\xff")], "n string, c binary")
    assert [r[0] for r in rows.select(X.upload_problem(F.col("n"), F.col("c"))).collect()] == [None, "size", "extension", "encoding"]


@pytest.mark.parametrize(
    "given, want",
    [("Intro\nAcceptance Criteria:\n\n- a\n b \n\nafter", "- a\nb"), ("Business rules\r\nr1\r\nNext part:\r\nx", "r1"), ("A\n ac: inline", "inline"), ("access: no", ""), ("", ""), (None, ""), ("Acceptance Criteria", "")],
)
def test_section(spark, given, want):
    assert one(spark, given, K.section(F.col("x"))) == want


def test_field_scores(spark):
    rows = spark.createDataFrame([("t", 0, "Notes", "it must"), ("t", 1, "AC", "x"), ("t", 2, "ac", "y"), ("t", 3, "Acceptance Criteria / Notes", ""), ("u", 0, "Notes", "plain")], "ticket_id string, pos int, label string, value string")
    assert [tuple(r) for r in K.best_field(rows).collect()] == [("t", "x", 90)]


def test_document_tree(spark):
    tree = '{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]},{"content":[{"type":"text","text":"c"}]}]}'
    for given, want in ((tree, "a b c"), ('"  s "', "s"), ('["a","",{"type":"text","text":"b"}]', "a\nb"), ("3", "3")):
        assert one(spark, given, K.field_text("x")) == want


@pytest.mark.parametrize(
    "reply, status",
    [
        ('```json\n{"scenario_id": "1", "status": "pass",}\n```', "pass"),
        ('{"type": "message"} and {"status": "fail"}', "fail"),
        ("{'status': 'pass', 'justification': None}", "pass"),
        ('{"status": "fail", // why\n "x": [1, 2,]}', "fail"),
        ('{"status": "pass", "a": {"b": 1}', "pass"),
        ('{"status": True}', True),
        ("no json", None),
        ("{}", None),
        ("", None),
    ],
)
def test_verdict_repair(reply, status):
    import json

    found = D.verdict_of(reply)
    assert (json.loads(found)["status"] if found else None) == status


def test_verdict_rules(spark):
    good = '{"scenario_id":"00000000-0000-4000-8000-000000000000","scenario_title":"t","status":"pass","justification":"j","code_reference":{"line":3}}'
    assert one(spark, good, D.problem(D.parse(F.col("x")))) is None
    assert one(spark, good.replace("pass", "maybe"), D.problem(D.parse(F.col("x")))) == "status"
    assert one(spark, good.replace("-0000-", "-"), D.problem(D.parse(F.col("x")))) == "scenario_id"
    assert one(spark, None, D.problem(D.parse(F.col("x")))) == "no verdict"
    forced = one(spark, "pass", D.overridden(F.col("x"), F.lit(None).cast("string"), F.array(*map(F.lit, "abcd")), F.lit(0)))
    assert forced.status == "fail" and forced.suggestion.endswith("a; b; c")
    assert one(spark, "pass", D.overridden(F.col("x"), F.lit(None).cast("string"), F.array(F.lit("a")), F.lit(1))).status == "pass"


WHITE = ["\t", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "\u2028", "\u3000", " \r\n"]


def test_strip_is_that_of_all_white_space(spark):
    texts = [a + "x \t y" + b for a in WHITE for b in WHITE] + ["", "\t \r\n", "\u200bx"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.strip(F.col("t")).alias("s")).collect()
    assert all(r.s == texts[r.k].strip() for r in got)


def test_sections_with_tabs_and_carriage_returns(spark):
    cases = {
        "Acceptance Criteria:\n\tone\n\t\ntwo": "one",
        "x\r\nAcceptance Criteria\r\n\r\n- a\r\n\tb\t\r\n\r\nc": "- a\nb",
        "\tBusiness rules\t\n\xa0r1\xa0\nNext part:\nr2": "r1",
        "\tac:\tinline\t": "inline",
        "each access: no": "",
        "AC\u2003:\u2003wide": "wide",
        "Acceptance criterion\n\x0c\n\x0bpage": "page",
        "acceptance criteria\na b c d e f:\nx": "",
        "acceptance criteria\na b c d e f g:\nx": "a b c d e f g:\nx",
        "": "",
        "\t": "",
    }
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", K.section(F.col("t")).alias("s")).collect()
    for r in got:
        assert r.s == cases[r.t], r.t


def test_texts_of_documents(spark):
    leaf = lambda t: {"type": "text", "text": t}
    cases = {
        json.dumps({"type": "doc", "content": [{"type": "p", "content": [leaf("a"), {"type": "b", "content": [leaf("b ")]}]}, leaf("c"), "stray", 4]}): "a b  c",
        json.dumps([" x ", {"content": [leaf("y")]}, [], [None, ["z", True]], 1.5]): "x\ny\nNone\nz\nTrue\n1.5",
        json.dumps({"type": "text", "text": "t", "content": [leaf("u")]}): "t u",
        json.dumps({"content": {"type": "text", "text": "no list"}}): "",
        json.dumps("\tq\r\n"): "q",
        "\tno json ": "no json",
        "{}": "",
    }
    got = spark.createDataFrame([(k,) for k in cases], "v string").select("v", K.field_text("v").alias("t")).collect()
    for r in got:
        assert r.t == cases[r.v], r.v


def test_long_replies_are_read_in_linear_time():
    import time

    start = time.time()
    broken = "{'scenario_id': 'x', 'justification': '" + "it\\'s so, isn\\'t it; " * 40_000 + "', 'status': 'pass',}"
    assert json.loads(D.verdict_of(broken))["status"] == "pass"
    D.verdict_of("{" + "'a " * 200_000)
    assert time.time() - start < 10
