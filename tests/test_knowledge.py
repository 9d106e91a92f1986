"""Knowledge sources: what filters leave out is not fetched, users stay apart, and plans show what the source took over."""

import os
import re

import pytest

from verdictlake.sources import fetch
from verdictlake.sources import knowledge as K


class Counting(fetch.FolderFetcher):
    """Leaves a file for every place that is fetched, in any process."""

    def __init__(self, options):
        super().__init__(options["root"])
        self.log = options["log"]

    def get(self, place):
        open(os.path.join(self.log, place.replace("/", "|")), "w").close()
        return super().get(place)


PAGE = "space string, day string, page_id string, title string, url string, body string, n long"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("wiki"))
    rows = [(f"s{k % 3}", f"2024-01-{k % 5 + 1:02d}", f"p{k}", f"t{k}", f"u{k}", None if k == 4 else f"body {k}", k) for k in range(60)] + [("a b/c", "2024-01-01", "odd", "t", "u", "b", 1)]
    K.store(spark.createDataFrame(rows, PAGE), "wiki", root, "ann", per_cursor=2)
    K.store(spark.createDataFrame([("s0", "2024-01-01", "secret", "t", "u", "b", 1)], PAGE), "wiki", root, "bob")
    return root


def fetched(spark, root, tmp_path, condition, monkeypatch):
    monkeypatch.setitem(fetch.FETCHERS, "counting", lambda options: Counting(options))
    log = tmp_path / "log"
    log.mkdir(exist_ok=True)
    for f in log.iterdir():
        f.unlink()
    df = K.read(spark, "wiki", root, "ann", log=str(log)).filter(condition) if condition else K.read(spark, "wiki", root, "ann", log=str(log))
    return df, log


@pytest.mark.parametrize(
    ("condition", "keeps"),
    [
        (None, lambda s, d: True),
        ("space = 's1'", lambda s, d: s == "s1"),
        ("space in ('s0', 's2') and day > '2024-01-03'", lambda s, d: s in ("s0", "s2") and d > "2024-01-03"),
        ("space <> 's0' and day <= '2024-01-02'", lambda s, d: s != "s0" and d <= "2024-01-02"),
        ("space like 'a%'", lambda s, d: s.startswith("a")),
        ("space <=> 's2' and day >= '2024-01-05' and day < '2024-01-09'", lambda s, d: s == "s2" and d >= "2024-01-05"),
        ("space = 'none'", lambda s, d: False),
    ],
)
def test_filters_decide_what_is_read(spark, root, condition, keeps):
    df = K.read(spark, "wiki", root, "ann")
    whole = {(r.space, r.day, r.page_id) for r in df.collect()}
    assert len(whole) == 61
    got = {(r.space, r.day, r.page_id) for r in (df.filter(condition) if condition else df).collect()}
    assert got == {x for x in whole if keeps(x[0], x[1])}


def test_planning_lists_only_what_filters_leave(spark, root):
    def places(*filters):
        reader = K.CursorReader({"root": root, "user": "ann"}, "wiki")
        rest = list(reader.pushFilters(list(filters)))
        return sum(len(p.places) for p in reader.partitions()), rest

    everything, _ = places()
    one, rest = places(K.EqualTo(("space",), "s1"), K.EqualTo(("day",), "2024-01-02"), K.EqualTo(("title",), "t1"))
    assert everything >= 31 and one == 2 and [f.attribute for f in rest] == [("title",)]
    assert places(K.EqualTo(("space",), None))[1]  # compared with null: Spark's business


def test_the_plan_shows_what_was_pushed(spark, root):
    df = K.read(spark, "wiki", root, "ann").filter("space = 's1' and title = 't1'")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    (pushed,) = re.findall(r"PushedFilters: \[(.*)\]", plan)
    assert "EqualTo(space,s1)" in pushed and "title" not in pushed
    (after,) = re.findall(r"Condition : (.*)", plan)
    assert "title" in after and "= s1" not in after


def test_users_stay_apart(spark, root):
    assert [r.page_id for r in K.read(spark, "wiki", root, "bob").collect()] == ["secret"]
    assert {r.namespace for r in K.read(spark, "wiki", root, "ann").collect()} == {"ann:knowledge"}
    assert K.read(spark, "wiki", root, "nobody").count() == 0
    for user in ("", "../bob", "..", "a/b"):
        with pytest.raises(Exception, match="not a user"):
            K.read(spark, "wiki", root, user).collect()


def test_a_row_can_not_claim_a_namespace(spark, tmp_path):
    K.store(spark.createDataFrame([("P", "1", "K-1", ["x"], "{}", "bob:knowledge")], "project string, sprint string, key string, labels array<string>, value string, namespace string"), "project", str(tmp_path), "ann")
    (row,) = K.read(spark, "project", str(tmp_path), "ann").collect()
    assert (row.namespace, row.project, row.sprint, row.key, row.labels) == ("ann:knowledge", "P", "1", "K-1", ["x"])
    kept = K.sources(K.read(spark, "project", str(tmp_path), "ann"), "project").first()
    assert (kept.source_type, kept.source) == ("project", "K-1") and kept.ingested_at is not None
