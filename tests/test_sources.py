import json

import pytest
from pyspark.sql import functions as F

from verdictlake.functions import models as M
from verdictlake.sources import code, fetch, sinks, tickets
from verdictlake.streaming import verdicts as S


@pytest.fixture()
def host(tmp_path):
    repo = tmp_path / "o" / "r"
    (repo / "contents" / "dev" / "src").mkdir(parents=True)
    (repo / "contents" / "main").mkdir(parents=True)
    (repo / "pulls" / "7").mkdir(parents=True)
    (repo / "repo.json").write_text('{"default_branch": "dev"}')
    (repo / "contents" / "dev" / "src" / "a.py").write_text("print(1)")
    (repo / "contents" / "main" / "b.py").write_text("b")
    tree = [{"path": "src/a.py", "type": "blob", "size": 524_288}, {"path": "big.py", "type": "blob", "size": 524_289}, {"path": "x.PNG", "type": "blob"}, {"path": "src", "type": "tree"}, {"path": "gone.py", "type": "blob"}]
    (repo / "tree.json").write_text(json.dumps({"tree": tree, "truncated": True}))
    (repo / "pulls" / "7" / "files.json").write_text(json.dumps([{"filename": "a", "status": "modified", "patch": "p"}, {"filename": "b", "status": "removed", "patch": "q"}, {"filename": "c", "status": "added"}, {"filename": "d", "patch": "r"}]))
    return tmp_path


def load(spark, root, mode, text):
    code.register(spark)
    return spark.read.format("code").options(mode=mode, input=text, root=str(root)).load()


def test_code_modes(spark, host):
    assert sorted(r.path for r in load(spark, host, "full_repo", "https://github.com/o/r").collect()) == [code.WARNING, "src/a.py"]
    assert [tuple(r) for r in load(spark, host, "exact_files", "\nhttps://github.com/o/r/blob/main/b.py\n\n").collect()] == [("b.py", "b", "https://github.com/o/r/blob/main/b.py")]
    assert sorted((r.path, r.content) for r in load(spark, host, "pull_request", "https://github.com/o/r/pull/7").collect()) == [("a", "p"), ("d", "r")]


@pytest.mark.parametrize("mode, text", [("exact_files", "https://github.com/o/r/blob/main/b.py\nhttps://github.com/o/r/blob/main/none.py"), ("exact_files", "nope"), ("other", ""), ("pull_request", "https://github.com/o/r")])
def test_code_failures(spark, host, mode, text):
    with pytest.raises(Exception):  # noqa: B017  Spark wraps what the reader raises
        load(spark, host, mode, text).collect()


def test_retry():
    pauses, calls = [], []

    def busy():
        calls.append(1)
        if len(calls) < 4:
            raise fetch.FetchError(429)
        return b"x"

    assert fetch.with_retry(busy, pauses.append) == b"x" and pauses == [1, 2, 4]
    with pytest.raises(fetch.FetchError):
        fetch.with_retry(lambda: (_ for _ in ()).throw(fetch.FetchError(404)), pauses.append)
    assert len(pauses) == 3


def test_tickets(spark, tmp_path):
    doc = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "Do it"}]}]}
    issues = [
        {"key": "A-1", "names": {"customfield_1": "Acceptance Criteria"}, "fields": {"summary": "s", "description": doc, "labels": ["l"], "customfield_1": "Given a", "issuelinks": [{"outwardIssue": {"key": "B-1"}}, {"inwardIssue": {"key": "C-1"}}, {}]}},
        {"key": "A-2", "names": {}, "fields": {"summary": "only"}},
    ]
    for k, issue in enumerate(issues):
        (tmp_path / f"{k}.json").write_text(json.dumps(issue))
    (tmp_path / "x.json").write_text("{broken")
    got = {r.ticket_id: r for r in tickets.read_tickets(spark, str(tmp_path)).collect()}
    assert got["A-1"].acceptance_criteria == "Given a" and got["A-1"].description == "Do it" and got["A-1"].linked_issues == ["B-1", "C-1"]
    assert got["A-2"].acceptance_criteria == "only" and got["A-2"].labels == [] and len(got) == 2
    assert [r.ticket_id for r in tickets.mock_tickets(spark.createDataFrame([("MOCK-1",), ("A-1",)], "ticket_id string")).collect()] == ["MOCK-1"]


def test_uploads_and_objects(spark, tmp_path):
    d = tmp_path / "u1" / "bdd"
    d.mkdir(parents=True)
    (d / "a.feature").write_text("Feature: é")
    (d / "b.feature").write_bytes(b"\xff")
    assert {r.name: (r.content, r.problem) for r in tickets.read_uploads(spark, str(d)).collect()} == {"a.feature": ("Feature: é", None), "b.feature": (None, "encoding")}
    assert sorted(r.path for r in tickets.list_objects(spark, str(tmp_path), "u1", "bdd").collect()) == ["u1/bdd/a.feature", "u1/bdd/b.feature"]


def test_sinks(spark, tmp_path):
    sinks.append(spark.createDataFrame([("a", 1)], "id string, n int"), f"{tmp_path}/t")
    sinks.append_if_absent(spark.createDataFrame([("a", 2), ("b", 3)], "id string, n int"), f"{tmp_path}/t", "id")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/t").collect())) == [("a", 1), ("b", 3)]
    v = "namespace string, id string, v int"
    spark.createDataFrame([("n", "c0", 1), ("n", "c1", 2)], v).write.parquet(f"{tmp_path}/v")
    sinks.upsert_vectors(spark.createDataFrame([("n", "c0", 9)], v), f"{tmp_path}/v", f"{tmp_path}/v2")
    assert sorted((r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/v2").collect()) == [("c0", 9), ("c1", 2)]
    steps = spark.createDataFrame([(1, 1, "f", 'say "x"', "g", "w", "t")], "k int, pos int, feature string, scenario string, given string, when string, then string")
    sinks.write_csv(steps, f"{tmp_path}/csv", "k")
    files = sorted((tmp_path / "csv").glob("part-*"))
    assert "".join(f.read_text() for f in files) == 'Feature,Scenario,Given,When,Then,Expected Result\n"f","say ""x""","g","w","t",""\n'


def broken_model():
    class Broken:  # inside a function, so that it travels to the workers by value
        def generate(self, prompt, system):
            if "previous reply" in prompt.lower():
                return '{"scenario_id":"00000000-0000-4000-8000-000000000000","scenario_title":"t","status":"fail","justification":"j","code_reference":{}}'
            if "boom" in prompt:
                raise RuntimeError("down")
            return "prose"

    return Broken


def test_models(spark):
    Broken = broken_model()
    prompts = spark.createDataFrame([("00000000-0000-4000-8000-000000000001", "SCENARIO_ID:00000000-0000-4000-8000-000000000001\nTITLE:t\n")], "scenario_id string, prompt string")
    assert [r.problem for r in M.verdicts(prompts, M.HashModel).collect()] == [None]
    assert [r.verdict.status for r in M.verdicts(prompts, Broken).collect()] == ["fail"]
    assert [r.reply_error for r in M.generate(spark.createDataFrame([("boom",)], "prompt string"), "prompt", Broken).collect()] == ["down"]
    assert M.FallbackModel(Broken(), M.HashModel()).generate("boom", "").startswith("```json")
    assert isinstance(M.model("HASH"), M.HashModel)
    with pytest.raises(ValueError, match="hash"):
        M.model("none")
    calls = M.ToolCalls({"t": lambda x: 1 / x})
    calls("t", {"x": 0}), calls("t", {"x": 1}), calls("other", {})
    assert len(calls.errors) == 1 and calls.successes == 1


def test_tools(spark):
    files = spark.createDataFrame([("a/b/c.py", "Login"), ("a/d.py", "x" * 9000), ("e.py", "")], "path string, content string").withColumn("github_url", F.lit("u"))
    assert [r.path for r in M.search_code(files, "LOGIN").collect()] == ["a/b/c.py"]
    assert len(M.get_file_contents(files, "/a/d.py").first().content) == 8000
    assert sorted(r.name for r in M.list_directory(files, "a").collect()) == ["b/", "d.py"] and sorted(r.name for r in M.list_directory(files).collect()) == ["a/", "e.py"]


def test_stream_equals_batch(spark, tmp_path):
    lines = ['data: {"type":"verdict","scenario_id":"1","status":"pass"}', "", "data: {broken", 'data: {"type":"error","message":"m"}', 'data: {"type":"verdict","scenario_id":"2","status":"fail"}', 'data: {"type":"complete","total":3}']
    (tmp_path / "in").mkdir()
    for k in range(0, len(lines), 2):
        (tmp_path / "in" / f"{k}.txt").write_text("\n".join(lines[k : k + 2]) + "\n")
    frames = S.read_frames(spark, f"{tmp_path}/in", max_files=1)
    S.append_verdicts(S.events(frames), f"{tmp_path}/v", f"{tmp_path}/e", f"{tmp_path}/c").awaitTermination()
    batch = S.events(spark.read.text(f"{tmp_path}/in"))
    stored = spark.read.parquet(f"{tmp_path}/v")
    assert sorted(r.scenario_id for r in stored.collect()) == sorted(r.scenario_id for r in batch.filter("type = 'verdict'").collect()) == ["1", "2"]
    assert spark.read.parquet(f"{tmp_path}/e").count() == 1
    assert tuple(S.run_summary(stored, 3).first()) == ("complete", 3, 1, 1)
    q = S.running_counts(S.events(frames)).writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.status: r.n for r in spark.table("running").collect()} == {"pass": 1, "fail": 1}


def test_folders_can_be_looked_into_and_searched(tmp_path):
    from verdictlake.functions.agents import repository_tools
    from verdictlake.sources.fetch import FetchError, FolderFetcher

    for k in range(12):
        (tmp_path / f"o/r/s{k % 2}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"o/r/s{k % 2}/f{k:02}.py").write_text("Find ME" if k != 3 else "other")
    (tmp_path / "o/r/top.py").write_text("x" * 9000)
    tools = repository_tools(FolderFetcher(str(tmp_path)), "o/r", "https://h/")
    assert json.loads(tools["list_directory"]("")) == ["s0/", "s1/", "top.py"] and len(json.loads(tools["list_directory"]("/s0/"))) == 6
    found = json.loads(tools["search_code"]("find me"))
    assert len(found) == 10 and found[0] == {"path": "s0/f00.py", "url": "https://h/s0/f00.py"}
    assert len(tools["get_file_contents"]("/top.py")) == 8000
    for call in (lambda: tools["list_directory"]("top.py"), lambda: tools["list_directory"]("../../.."), lambda: tools["get_file_contents"]("none")):
        with pytest.raises(FetchError):
            call()

    class Refuses(FolderFetcher):
        def search(self, place, text, most=10):
            raise FetchError(self.status)

    refuses = Refuses(str(tmp_path))
    refuses.status = 422
    assert repository_tools(refuses, "o/r")["search_code"]("x") == "[]"
    refuses.status = 500
    with pytest.raises(FetchError):
        repository_tools(refuses, "o/r")["search_code"]("x")


def test_cached_views_go_stale(spark):
    from verdictlake.sources.cached import Views

    now, made = [0.0], []
    views = Views(60, lambda: now[0])

    def load():
        made.append(1)
        return spark.range(len(made))

    assert views.read("a", load).count() == views.read("a", load).count() == 1 and len(made) == 1
    now[0] = 61.0
    assert views.read("a", load).count() == 2
    views.drop("a")
    assert views.read("a", load).count() == 3

    def fails():
        raise RuntimeError("down")

    with pytest.raises(RuntimeError):
        views.read("b", fails)


def test_cancelled_streams_leave_nothing(spark, tmp_path):
    import os
    import time

    from verdictlake.streaming import verdicts as S

    rate = spark.readStream.format("rate").option("rowsPerSecond", 5).load()
    run = rate.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").start()
    while not os.path.exists(f"{tmp_path}/c"):
        time.sleep(0.2)
    S.cancel(spark, run, f"{tmp_path}/c", f"{tmp_path}/never")
    assert not run.isActive and not os.path.exists(f"{tmp_path}/c")
