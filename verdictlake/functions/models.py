"""Models as pluggable column functions: a registry by name, stand-ins that need no network, tools as table functions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.functions import verdict as D
from verdictlake.functions.text import READ_CHARS
from verdictlake.sources.sinks import once


class Model(Protocol):
    def generate(self, prompt: str, system: str) -> str: ...


class HashModel:
    """A stand-in: a verdict by the prompt's hash, the same for the same prompt."""

    def generate(self, prompt: str, system: str) -> str:
        digest = hashlib.sha256(f"{system}\0{prompt}".encode()).hexdigest()
        passed = int(digest[0], 16) % 2 == 0
        head = {k: v for k, _, v in (line.partition(":") for line in prompt.split("\n")[:2])}
        verdict = {"scenario_id": head.get("SCENARIO_ID", ""), "scenario_title": head.get("TITLE", ""), "status": "pass" if passed else "fail", "justification": digest[:8], "code_reference": {"file": None, "function": None, "line": None}, "github_links": [], "implementation_suggestion": None if passed else "add it"}
        return "```json\n" + json.dumps(verdict) + "\n```"


class FallbackModel:
    """Asks the first model, and the second where the first fails."""

    def __init__(self, first: Model, second: Model):
        self.first, self.second = first, second

    def generate(self, prompt: str, system: str) -> str:
        try:
            return self.first.generate(prompt, system)
        except Exception:  # whatever the first one's host does
            return self.second.generate(prompt, system)


MODELS: dict[str, Callable[[], Model]] = {"hash": HashModel}


def model(name: str) -> Model:
    if name.lower() not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(MODELS))}")
    return MODELS[name.lower()]()


#: Tasks for each core that prompts are dealt to.
TASKS = 2


def dealt(prompts: DataFrame) -> DataFrame:
    """The prompts in as many tasks as keep all cores busy: calls are slow and rows are short, so that one file holds the prompts of hours."""
    return prompts.repartition(TASKS * prompts.sparkSession.sparkContext.defaultParallelism)


def generate(df: DataFrame, prompt: str, make: Callable[[], Model], system: str = "", out: str = "reply") -> DataFrame:
    """Adds the model's reply; rows are dealt, the model is made once a task, inside it. A call that fails gives null and its error beside it."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = make()
        for pdf in batches:
            replies, errors = [], []
            for p in pdf[prompt]:
                try:
                    replies.append(own.generate(p, system))
                    errors.append(None)
                except Exception as e:  # one row's failure is its own
                    replies.append(None)
                    errors.append(str(e))
            yield pdf.assign(**{out: replies, f"{out}_error": errors})

    return dealt(df).mapInPandas(run, schema)


REASK = "Your previous reply could not be read as a verdict. Return only the corrected verdict as one JSON object, with the same decision and evidence.\n\nPrevious reply:\n"


def verdicts(prompts: DataFrame, make: Callable[[], Model], system: str = "") -> DataFrame:
    """scenario_id, verdict (a struct) and problem. Replies that give no valid verdict are asked for once more, and only those.

    Answers are kept before they are looked at, so every scenario is asked once, and once more at most. What they say is kept as
    well: filters that go by it would read an answer again for each field that they name.
    """
    first = once(generate(prompts, "prompt", make, system)).withColumn("verdict", D.parse(D.read(F.col("reply"))))
    first = once(first.select("scenario_id", "reply", "verdict", D.problem(F.col("verdict")).alias("problem")))
    good = first.filter("problem is null").select("scenario_id", "verdict", "problem")
    again = first.filter("problem is not null").select("scenario_id", F.concat(F.lit(REASK), F.coalesce("reply", F.lit(""))).alias("prompt"))
    second = once(generate(again, "prompt", make, system)).withColumn("verdict", D.parse(D.read(F.col("reply"))))
    return good.unionByName(second.select("scenario_id", "verdict", D.problem(F.col("verdict")).alias("problem")))


#: What the tools take, for models that call them.
TOOLS = {
    "search_code": {"query": "text to look for"},
    "get_file_contents": {"path": "a file's path"},
    "list_directory": {"path": "a folder's path, or nothing for the top"},
}


def search_code(files: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The first files that hold a text."""
    return files.filter(F.contains(F.lower("content"), F.lit(query.lower()))).orderBy("path").limit(limit).select("path", "github_url")


def get_file_contents(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path.lstrip("/")).select("path", F.left("content", F.lit(READ_CHARS)).alias("content"))


def list_directory(files: DataFrame, path: str = "") -> DataFrame:
    """Names below a folder, folders with a slash; nothing if the path is a file."""
    prefix = path.strip("/") + "/" if path.strip("/") else ""
    rest = F.substr(F.col("path"), F.lit(len(prefix) + 1))
    return files.filter(F.col("path").startswith(prefix)).select(F.when(F.contains(rest, F.lit("/")), F.concat(F.substring_index(rest, "/", 1), F.lit("/"))).otherwise(rest).alias("name")).distinct()


class ToolCalls:
    """One scenario's tool calls: never shared between scenarios, so errors and successes can't mix."""

    def __init__(self, tools: dict[str, Callable[..., str]]):
        self.tools, self.errors, self.successes = tools, [], 0

    def __call__(self, name: str, arguments: dict) -> str:
        if name not in self.tools:
            return f"Unknown tool: {name}"
        try:
            out = self.tools[name](**arguments)
        except Exception as e:
            self.errors.append(str(e))
            return f"Tool error: {e}"
        self.successes += 1
        return out
