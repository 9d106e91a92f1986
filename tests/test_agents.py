import json
import os
import random
import sys
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from verdictlake.functions import agents as A
from verdictlake.functions import models as M
from verdictlake.schemas import SCENARIO
from verdictlake.sources import objects as O
from verdictlake.sources.fetch import FolderFetcher

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file
UUID = "00000000-0000-4000-8000-00000000000"


def verdict(k, status="pass", links=()):
    return json.dumps({"scenario_id": f"{UUID}{k}", "scenario_title": "t", "status": status, "justification": "j", "code_reference": {"file": "f", "function": None, "line": 1}, "github_links": list(links), "implementation_suggestion": None})


class Looks:
    """Looks at the file that the prompt names, then answers."""

    def step(self, messages, tools):
        k, path = messages[1]["content"].split()
        if k == "9":
            raise RuntimeError("down")
        if tools and (len(messages) == 2 or k == "5"):
            return {"tool": "get_file_contents", "arguments": {"path": path}}
        return {"text": "no verdict" if k == "3" else verdict(k, links=["src/a.py", "https://h/x"])}


class Mends:
    def generate(self, prompt, system):
        return verdict(3, "fail") if "no verdict" in prompt else "still none"


def test_verdicts_by_models_that_look_things_up(spark, tmp_path):
    (tmp_path / "o/r/contents/HEAD").mkdir(parents=True)
    (tmp_path / "o/r/contents/HEAD/a.py").write_text("x = 1")
    root = str(tmp_path)
    rows = [(k, f"{k} {'a.py' if k != 2 else 'missing.py'}", "x") for k in (1, 2, 3, 5, 9)]
    prompts = spark.createDataFrame(rows, "scenario_id long, prompt string, verdict string").repartition(2)
    tools = lambda: A.repository_tools(FolderFetcher(root), "o/r/contents/HEAD")
    got = {r.scenario_id: r for r in A.agentic_verdicts(prompts, Looks, tools, Mends, F.lit("o/r"), rounds=4).collect()}
    assert {k: r.problem for k, r in got.items()} == {1: None, 2: None, 3: None, 5: None, 9: "no verdict"}
    assert {k: r.verdict.status for k, r in got.items() if r.verdict} == {1: "pass", 2: "fail", 3: "fail", 5: "pass"}
    assert got[2].verdict.implementation_suggestion.startswith("Verification incomplete")
    assert got[1].verdict.github_links == ["https://github.com/o/r/blob/HEAD/src/a.py", "https://h/x"]
    counted = {r.scenario_id: (r.tool_successes, len(r.tool_errors)) for r in A.with_tools(prompts, "prompt", Looks, tools, rounds=4).collect()}
    assert counted == {1: (1, 0), 2: (0, 1), 3: (1, 0), 5: (3, 0), 9: (0, 0)}
    assert A.agentic_verdicts(prompts.limit(0), Looks, tools, Mends, F.lit("o/r")).count() == 0


class Writes:
    def generate(self, prompt, system):
        assert '"name":"scenario"' in prompt
        return 'Here: {"feature": "f", "scenario": "s"} done' if "good" in prompt else "nothing"


def test_replies_in_a_schema(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "k int, prompt string")
    got = {r.k: r.found for r in A.structured(df, "prompt", Writes, SCENARIO).collect()}
    assert (got[1].feature, got[1].scenario, got[1].given) == ("f", "s", None) and got[2] is None


def test_objects_are_replaced_and_deleted(spark, tmp_path):
    root = str(tmp_path)
    make = lambda: O.FolderStore(root)
    rows = spark.createDataFrame([("u", "bdd", "a.feature", bytearray(b"one")), ("u", None, "b", None), ("u", "..", "../../out", bytearray(b"x"))], "user_id string, folder string, name string, content binary")
    got = {r.path: r.problem for r in O.put_objects(rows, make).collect()}
    assert got["u/bdd/a.feature"] is None and got["u/b"] is None and "outside" in got["u/../../../out"]
    O.put_objects(rows.limit(1).withColumn("content", F.lit(b"two")), make).collect()
    assert (tmp_path / "u/bdd/a.feature").read_bytes() == b"two" and (tmp_path / "u/b").read_bytes() == b""
    assert all(r.problem is None for r in O.delete_objects(rows.limit(2), make).collect() + O.delete_objects(rows.limit(2), make).collect())
    assert not (tmp_path / "u/b").exists()


class Whimsical:
    """Answers at random, and leaves a mark for every call."""

    def __init__(self, log, tools):
        self.log, self.tools = log, tools

    def _reply(self, prompt):
        open(os.path.join(self.log, uuid.uuid4().hex), "w").close()
        if random.random() < 0.5:
            return "no verdict"
        return json.dumps({"scenario_id": "00000000-0000-4000-8000-000000000000", "scenario_title": "t", "status": "fail", "justification": "j", "code_reference": {"file": None, "function": None, "line": None}, "github_links": [], "implementation_suggestion": None})

    def generate(self, prompt, system):
        return self._reply(prompt)

    def step(self, messages, tools):
        return {"text": self._reply(messages[-1]["content"])}


@pytest.mark.parametrize("tools", [False, True])
def test_every_scenario_is_asked_once_and_none_is_lost(spark, tmp_path, tools):
    log = str(tmp_path)
    prompts = spark.range(200).select(F.col("id").cast("string").alias("scenario_id"), F.lit("p").alias("prompt"))
    make = lambda: Whimsical(log, tools)
    found = A.agentic_verdicts(prompts, make, dict, make, F.lit("https://host/r")) if tools else M.verdicts(prompts, make)
    rows = found.collect()
    first = len(rows), len({r.scenario_id for r in rows}), len(os.listdir(log))
    found.collect()  # looking again asks nobody
    assert first[:2] == (200, 200) and 200 < first[2] < 400 and len(os.listdir(log)) == first[2]


class Once:
    """Answers by one verdict, or none, and leaves a file named by its task."""

    def __init__(self, log):
        from pyspark import TaskContext

        open(os.path.join(log, str(TaskContext.get().partitionId())), "w").close()

    def generate(self, prompt, system):
        return verdict(1) if prompt.startswith("good") else "no verdict"

    def step(self, messages, tools):
        return {"text": self.generate(messages[1]["content"], "")}


@pytest.mark.parametrize("tools", [False, True])
def test_prompts_of_one_file_are_dealt_and_answers_read_once(spark, tmp_path, tools):
    log = str(tmp_path)
    prompts = spark.range(0, 300, 1, 1).select("id", F.when(F.col("id") % 3 == 0, "bad").otherwise("good").alias("prompt")).withColumnRenamed("id", "scenario_id")
    assert prompts.rdd.getNumPartitions() == 1
    make = lambda: Once(log)
    found = A.agentic_verdicts(prompts, make, dict, make, F.lit("o/r")) if tools else M.verdicts(prompts, make)
    assert len(os.listdir(log)) >= spark.sparkContext.defaultParallelism
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    first = plan.split("LogicalRDD")[0]
    assert "from_json" not in first and "regexp_extract" not in first
    got = {r.scenario_id: (r.verdict is None, r.problem) for r in found.collect()}
    assert got == {k: (k % 3 == 0, "no verdict" if k % 3 == 0 else None) for k in range(300)}
