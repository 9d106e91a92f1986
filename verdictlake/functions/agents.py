"""Models that answer in a schema, and models that call tools before they answer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictlake.functions import verdict as D
from verdictlake.functions.models import REASK, TOOLS, Model, ToolCalls, dealt, generate
from verdictlake.functions.text import READ_CHARS, absolute_link
from verdictlake.sources.fetch import Browser, FetchError, with_retry
from verdictlake.sources.sinks import once

ROUNDS = 20


class ToolModel(Protocol):
    """One step: {"tool": name, "arguments": {...}} to call a tool, {"text": reply} to end. Without tools it must end."""

    def step(self, messages: list[dict], tools: dict | None) -> dict: ...


def schema_text(schema: T.StructType) -> str:
    """A schema as prompts state it."""
    return json.dumps(schema.jsonValue(), separators=(",", ":"))


def structured(df: DataFrame, prompt: str, make: Callable[[], Model], schema: T.StructType, system: str = "", out: str = "found") -> DataFrame:
    """Adds the reply's JSON, from its first brace to its last, as a struct; null where there is none or the call failed."""
    asked = df.withColumn(prompt, F.concat_ws("\n", F.col(prompt), F.lit(f"Reply with JSON of this schema: {schema_text(schema)}")))
    return generate(asked, prompt, make, system).withColumn(out, F.from_json(D.outer_json(F.col("reply")), schema)).drop("reply")


def repository_tools(source: Browser, root: str, url: str = "") -> dict[str, Callable[..., str]]:
    """The three tools that agents may call, over the contents of a repository below `root`; `url` is what file links start with.

    What can't be read, isn't there or isn't a folder is an error of the call. A host that refuses searches (403, 422) has found
    nothing, so that an agent goes on by looking into folders.
    """

    def search_code(query: str, **_: str) -> str:
        try:
            found = source.search(root, query)
        except FetchError as e:
            if e.status not in (403, 422):
                raise
            found = []
        paths = [x.removeprefix(f"{root}/") for x in found]
        return json.dumps([{"path": p, "url": f"{url}{p}"} for p in paths])

    def get_file_contents(path: str, **_: str) -> str:
        return with_retry(lambda: source.get(f"{root}/{path.lstrip('/')}")).decode("utf-8", "replace")[:READ_CHARS]

    def list_directory(path: str = "", **_: str) -> str:
        return json.dumps([name + "/" * folder for name, folder in source.entries(f"{root}/{path.strip('/')}".rstrip("/"))])

    return {f.__name__: f for f in (search_code, get_file_contents, list_directory)}


def converse(model: ToolModel, prompt: str, system: str, calls: ToolCalls, rounds: int = ROUNDS) -> str:
    """The reply after at most `rounds` steps; the last one gets no tools, so it has to answer."""
    messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
    for left in range(rounds - 1, -1, -1):
        said = model.step(messages, TOOLS if left else None)
        if "tool" not in said:
            return said.get("text", "")
        messages += [{"role": "assistant", "content": json.dumps(said)}, {"role": "tool", "content": calls(said["tool"], said.get("arguments", {}))}]
    return ""


def with_tools(df: DataFrame, prompt: str, make: Callable[[], ToolModel], make_tools: Callable[[], dict[str, Callable[..., str]]], system: str = "", rounds: int = ROUNDS) -> DataFrame:
    """Adds reply, reply_error, tool_errors and tool_successes. Rows are dealt, model and tools made once a task; each row counts its own calls."""
    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("reply_error", T.StringType()), T.StructField("tool_errors", T.ArrayType(T.StringType())), T.StructField("tool_successes", T.IntegerType())])

    def one(model: ToolModel, tools: dict, text: str) -> tuple:
        calls = ToolCalls(tools)
        try:
            return converse(model, text, system, calls, rounds), None, calls.errors, calls.successes
        except Exception as e:  # one row's failure is its own
            return None, str(e), calls.errors, calls.successes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, tools = make(), make_tools()
        for pdf in batches:
            got = [one(model, tools, p) for p in pdf[prompt]]
            yield pdf.assign(**{name: [g[k] for g in got] for k, name in enumerate(("reply", "reply_error", "tool_errors", "tool_successes"))})

    return dealt(df).mapInPandas(run, schema)


def agentic_verdicts(prompts: DataFrame, make: Callable[[], ToolModel], make_tools: Callable[[], dict[str, Callable[..., str]]], make_plain: Callable[[], Model], repo: Column, system: str = "", rounds: int = ROUNDS) -> DataFrame:
    """scenario_id, verdict and problem, by models that look things up first.

    A pass that no tool call backs fails; links that are paths become URLs of the repository. Replies that give no valid
    verdict are asked for once more, without tools, and only those. The first answers are kept before they are looked at, so every
    scenario is asked once, and once more at most. What they say is kept as well: filters that go by it would read an answer
    again for each field that they name.
    """
    kept = prompts.select("scenario_id", "prompt", repo.alias("_repo"))

    def finished(asked: DataFrame) -> DataFrame:
        v = D.parse(D.read(F.col("reply")))
        found = asked.withColumn("verdict", v)
        over = D.overridden(F.col("verdict.status"), F.col("verdict.implementation_suggestion"), F.col("tool_errors"), F.col("tool_successes"))
        links = F.transform(F.coalesce("verdict.github_links", F.array().cast("array<string>")), lambda x: absolute_link(x, F.col("_repo")))
        whole = F.col("verdict").withField("status", over["status"]).withField("implementation_suggestion", over["suggestion"]).withField("github_links", links)
        return once(found.withColumn("verdict", F.when(F.col("verdict").isNotNull(), whole)).withColumn("problem", D.problem(F.col("verdict"))))

    first = finished(once(with_tools(kept, "prompt", make, make_tools, system, rounds)))
    again = first.filter("problem is not null").select("scenario_id", F.concat(F.lit(REASK), F.coalesce("reply", F.lit(""))).alias("prompt"), "_repo", "tool_errors", "tool_successes")
    second = finished(once(generate(again, "prompt", make_plain, system)))
    return first.filter("problem is null").select("scenario_id", "verdict", "problem").unionByName(second.select("scenario_id", "verdict", "problem"))
