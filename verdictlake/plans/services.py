"""Queries of what talks to tickets, stores, hosts and models, over stand-ins for them that give the same result every time."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictlake.functions import agents as A
from verdictlake.functions import models as M
from verdictlake.operators import relational as R
from verdictlake.plans.registry import query, table
from verdictlake.plans.streams import folder
from verdictlake.sources import objects, sinks, tickets
from verdictlake.sources.cached import Views
from verdictlake.sources.fetch import FetchError, with_retry
from verdictlake.streaming import verdicts as S

@query("retried_calls", "select p_partkey, case when p_partkey % 7 < 4 then p_partkey % 7 + 1 when p_partkey % 7 = 6 then 1 else 4 end::bigint attempts, case when p_partkey % 7 = 6 then 'gone' when p_partkey % 7 >= 4 then 'busy' end problem from part")
def retried_calls(spark: SparkSession, d: str) -> DataFrame:
    """U8: calls of a host that is busy at first: up to four attempts, and none after another refusal."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key in pdf["p_partkey"].tolist():
                made: list[int] = []

                def call(key=key, made=made) -> bytes:
                    made.append(1)
                    if key % 7 == 6:
                        raise FetchError(404, "gone")
                    if len(made) <= key % 7:
                        raise FetchError(429, "busy")
                    return b""

                problem = None
                try:
                    with_retry(call, lambda _: None)
                except FetchError as e:
                    problem = str(e)
                rows.append((key, len(made), problem))
            yield pd.DataFrame(rows, columns=["p_partkey", "attempts", "problem"])

    return table(spark, d, "part").select("p_partkey").mapInPandas(run, "p_partkey long, attempts long, problem string")


@query("unknown_names", "select r_name, 'unknown model ' || chr(39) || lower(r_name) || chr(39) || '; known: hash' problem from region")
def unknown_names(spark: SparkSession, d: str) -> DataFrame:
    """The error of a name that no model has lists those that are known, sorted."""

    def run(batches):
        for pdf in batches:
            out = []
            for name in pdf["r_name"]:
                try:
                    M.model(name.lower())
                    out.append(None)
                except ValueError as e:
                    out.append(str(e))
            yield pdf.assign(problem=out)

    return table(spark, d, "region").select("r_name").mapInPandas(run, "r_name string, problem string")


#: Issue JSON out of orders: acceptance criteria in a field, in the description, or nowhere; documents as nested nodes; broken ones.
_ISSUE = """case o_orderkey % 5 when 4 then '{"key": "broken' else '{"key":"KAN-' || cast(o_orderkey as string) || '","names":{"customfield_1":"Acceptance Criteria","customfield_2":"Notes"},"fields":{"summary":"Order ' || cast(o_custkey as string) || ' of a kind","labels":["' || o_orderstatus || '"],"issuelinks":[{"outwardIssue":{"key":"OUT-1"},"inwardIssue":{"key":"IN-1"}},{"inwardIssue":{"key":"IN-' || cast(o_custkey as string) || '"}}],"customfield_2":"it must wait",' || case o_orderkey % 5 when 0 then '"customfield_1":{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"Given a"},{"type":"text","text":"order ' || cast(o_custkey as string) || '"}]}]},' else '' end || '"description":' || case o_orderkey % 5 when 1 then '{"type":"doc","content":[{"type":"text","text":"plain ' || cast(o_custkey as string) || '"}]}' when 2 then '"  text ' || cast(o_custkey as string) || '  "' else 'null' end || '}}' end"""


@query("issue_tickets", f"""select 'KAN-' || o_orderkey ticket_id, 'Order ' || o_custkey || ' of a kind' summary, case o_orderkey % 5 when 1 then 'plain ' || o_custkey when 2 then '  text ' || o_custkey || '  ' else '' end description,
case when o_orderkey % 5 = 0 then 'Given a order ' || o_custkey else 'it must wait' end acceptance_criteria, o_orderstatus labels, 'OUT-1,IN-' || o_custkey linked_issues from orders, range(1, 2 + (o_orderkey % 10 = 1)::int + (o_orderkey % 10 = 1)::int) where o_orderkey % 5 <> 4""")
def issue_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Tickets out of issue documents; broken ones are left out, and one of ten is stored three times."""
    copies = F.explode(F.when(F.col("o_orderkey") % 10 == 1, F.sequence(F.lit(1), F.lit(3))).otherwise(F.array(F.lit(1))))
    raw = table(spark, d, "orders").select(F.expr(_ISSUE).alias("value"), copies.alias("copy"))
    return tickets.tickets(raw).select("ticket_id", "summary", "description", "acceptance_criteria", F.array_join("labels", ",").alias("labels"), F.array_join("linked_issues", ",").alias("linked_issues"))


@query("mock_tickets", "select 'MOCK-' || o_orderkey ticket_id, 'Mock summary for MOCK-' || o_orderkey summary, 'This is a mock description.' description, 'Given a mock ticket, When processed, Then it works.' acceptance_criteria, 1::bigint n_labels from orders where o_orderkey % 3 = 0")
def mock_tickets(spark: SparkSession, d: str) -> DataFrame:
    """Made-up tickets for mock ids, and none for others."""
    ids = table(spark, d, "orders").select(F.concat(F.when(F.col("o_orderkey") % 3 == 0, "MOCK-").otherwise("KAN-"), F.col("o_orderkey").cast("string")).alias("ticket_id"))
    return tickets.mock_tickets(ids).select("ticket_id", "summary", "description", "acceptance_criteria", F.size("labels").cast("bigint").alias("n_labels"))


@query("session_append", "select o_orderkey id, o_custkey user_id, 'KAN-' || o_orderkey ticket from orders union all select o_orderkey, o_custkey, 'LATE-' || o_orderkey from orders where o_orderkey % 4 = 0")
def session_append(spark: SparkSession, d: str) -> DataFrame:
    """K1: sessions appended by two writers and read back; what is there is never touched."""
    path = f"{folder(spark)}/sessions"
    rows = lambda prefix: table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.concat(F.lit(prefix), F.col("o_orderkey").cast("string")).alias("ticket"))
    sinks.append(rows("KAN-"), path)
    sinks.append(rows("LATE-").filter("id % 4 = 0"), path)
    return spark.read.parquet(path)


@query("stored_objects", "select 'u' || n_regionkey || '/bdd/' || n_name || '.feature' path, (length(n_name) + case when n_nationkey % 3 = 0 then 4 else 6 end)::bigint length, md5(case when n_nationkey % 3 = 0 then 'new ' else 'first ' end || n_name) digest from nation where n_nationkey % 5 <> 1 and n_regionkey = 2")
def stored_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects stored, replaced and deleted by the tasks that hold them, then listed and read."""
    root = f"{folder(spark)}/objects"
    local = root.removeprefix("file://")
    nation = table(spark, d, "nation").select(F.concat(F.lit("u"), F.col("n_regionkey").cast("string")).alias("user_id"), F.lit("bdd").alias("folder"), F.concat("n_name", F.lit(".feature")).alias("name"), "n_name", "n_nationkey")
    make = lambda: objects.FolderStore(local)
    for rows in (nation.withColumn("content", F.concat(F.lit("first "), "n_name")), nation.filter("n_nationkey % 3 = 0").withColumn("content", F.concat(F.lit("new "), "n_name"))):
        assert objects.put_objects(rows, make).filter("problem is not null").isEmpty()
    assert objects.delete_objects(nation.filter("n_nationkey % 5 = 1"), make).filter("problem is not null").isEmpty()
    return tickets.download_objects(spark, root, "u2", "bdd").select("path", "length", F.md5("content").alias("digest"))


class Counting:
    """A stand-in for a model: answers in JSON about its prompt, or not at all."""

    def generate(self, prompt: str, system: str) -> str:
        name = prompt.split("\n")[0]
        if name.endswith("7"):
            raise RuntimeError("the model is busy")
        return "I can't say." if name.endswith("3") else "Sure: " + json.dumps({"name": name, "letters": len(name)}) + " Done."


_ASKED = "select p_partkey, 'part ' || p_partkey p from part"


@query("structured_replies", f"select p_partkey, case when right(p, 1) not in ('3', '7') then p end name, case when right(p, 1) not in ('3', '7') then length(p) end::bigint letters, case when right(p, 1) = '7' then 'the model is busy' end problem from ({_ASKED})")
def structured_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies in a schema; one call's failure is its own."""
    prompts = table(spark, d, "part").select("p_partkey", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("prompt"))
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("letters", T.LongType())])
    return A.structured(prompts, "prompt", Counting, schema).select("p_partkey", "found.name", "found.letters", F.col("reply_error").alias("problem"))


class Plain:
    def generate(self, prompt: str, system: str) -> str:
        return f"plain {prompt}"


@query("fallback_replies", f"""select p_partkey, case right(p, 1) when '7' then 'plain ' || p when '3' then 'I can''t say.' else 'Sure: {{"name": "' || p || '", "letters": ' || length(p) || '}} Done.' end reply from ({_ASKED})""")
def fallback_replies(spark: SparkSession, d: str) -> DataFrame:
    """The second model where the first one fails."""
    prompts = table(spark, d, "part").select("p_partkey", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("prompt"))
    return M.generate(prompts, "prompt", lambda: M.FallbackModel(Counting(), Plain())).select("p_partkey", "reply")


class Shelf:
    """A stand-in for a host: a file for every number, in folders by its last digit; those that end in 7 can't be read."""

    def get(self, place: str) -> bytes:
        if place.endswith("7"):
            raise FetchError(404, f"not there: {place}")
        return f"text of {place}".encode()

    def entries(self, place: str) -> list[tuple[str, bool]]:
        return [("a", True), (place.rsplit("/", 1)[-1], False)]

    def search(self, place: str, text: str) -> list[str]:
        if text.endswith("5"):
            raise FetchError(403)
        return [f"{place}/{text[-1]}/{text}"]


class Reader:
    """A stand-in for a model that calls tools: searches, looks into a folder, reads what it found, and answers with what it saw."""

    def step(self, messages: list[dict], tools: dict | None) -> dict:
        key, seen = messages[1]["content"], [m["content"] for m in messages if m["role"] == "tool"]
        if not seen:
            return {"tool": "search_code", "arguments": {"query": key, "repo": "o/r"}}
        if len(seen) == 1:
            return {"tool": "list_directory", "arguments": {"path": key[-1]}}
        if len(seen) == 2:
            return {"tool": "get_file_contents", "arguments": {"path": f"{key[-1]}/{key}"}}
        status = "pass" if int(key) % 2 == 0 or key.endswith("7") else "fail"
        verdict = {"scenario_id": f"{int(key):08d}-0000-4000-8000-000000000000", "scenario_title": key, "status": status, "justification": seen[0] + seen[1], "code_reference": {"file": seen[2]}, "github_links": [f"{key[-1]}/{key}"]}
        return {"text": "none" if key.endswith("1") else json.dumps(verdict)}


class Mended:
    """Answers a re-ask; here it only knows that there was none."""

    def generate(self, prompt: str, system: str) -> str:
        return json.dumps({"scenario_id": "00000000-0000-4000-8000-000000000001", "scenario_title": "again", "status": "fail", "justification": "j", "code_reference": {}}) if prompt.endswith("none") else "no"


def _agents(prompts: DataFrame) -> DataFrame:
    tools = lambda: A.repository_tools(Shelf(), "o/r", "https://h/")
    return A.agentic_verdicts(prompts, Reader, tools, Mended, F.lit("o/r"))


def _prompts(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select(F.col("p_partkey").alias("scenario_id"), key.alias("prompt"))


_TOOLS = "select p_partkey, p_partkey::varchar k, right(p_partkey::varchar, 1) e from part"


@query("tool_calls", f"select p_partkey scenario_id, case when e = '7' then 2 else 3 end successes, case when e = '7' then 'not there: o/r/7/' || k else '' end errors from ({_TOOLS})")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Tools called in rounds; each scenario counts its own calls."""
    tools = lambda: A.repository_tools(Shelf(), "o/r", "https://h/")
    return A.with_tools(_prompts(spark, d), "prompt", Reader, tools).select("scenario_id", F.col("tool_successes").alias("successes"), F.array_join("tool_errors", ";").alias("errors"))


_AGENTS = f"""select p_partkey scenario_id, case when e = '1' then 'again' else k end title, case when e = '1' then 'fail' when p_partkey % 2 = 0 or e = '7' then 'pass' else 'fail' end status,
case when e = '1' then 'j' when e = '5' then '[]' else '[{{"path": "' || e || '/' || k || '", "url": "https://h/' || e || '/' || k || '"}}]' end || case when e = '1' then '' else '["a/", "' || e || '"]' end justification,
case when e = '7' then 'Tool error: not there: o/r/7/' || k when e <> '1' then 'text of o/r/' || e || '/' || k end file, case when e = '1' then '' else 'https://github.com/o/r/blob/HEAD/' || e || '/' || k end links from ({_TOOLS})"""


def _shown(found: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return found.select("scenario_id", v["scenario_title"].alias("title"), v["status"].alias("status"), v["justification"].alias("justification"), v["code_reference"]["file"].alias("file"), F.array_join(v["github_links"], ",").alias("links"))


@query("agentic_verdicts", _AGENTS)
def agentic_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of models that look things up; replies without one are asked for once more."""
    return _shown(_agents(_prompts(spark, d)))


@query("agentic_stream", _AGENTS)
def agentic_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same over a stream, written batch by batch; the checkpoint goes when it has ended."""
    root = folder(spark)
    _prompts(spark, d).repartition(4).write.parquet(f"{root}/prompts")
    stream = spark.readStream.schema("scenario_id long, prompt string").option("maxFilesPerTrigger", 2).parquet(f"{root}/prompts")
    run = S.verify_stream(stream, _agents, f"{root}/verdicts", f"{root}/checkpoint")
    run.awaitTermination()
    S.cancel(spark, run, f"{root}/checkpoint", f"{root}/prompts")
    return _shown(spark.read.parquet(f"{root}/verdicts"))


@query("traceability_csv", """select o_orderkey, '"clause ' || o_custkey || '","order ' || o_orderkey || '","' || case when o_orderkey % 3 = 0 then '' when o_orderkey % 2 = 0 then 'pass' else 'fail' end || '","' || case when o_orderkey % 3 = 0 then '' else 'said ""so""' end || '","","",""' line from orders""")
def traceability_csv(spark: SparkSession, d: str) -> DataFrame:
    """The traceability report's lines; scenarios without a verdict have empty fields."""
    orders = table(spark, d, "orders")
    name = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))
    scenarios = orders.select("o_orderkey", F.concat(F.lit("clause "), F.col("o_custkey").cast("string")).alias("source_ac_clause"), name.alias("scenario_title"))
    verdicts = orders.filter("o_orderkey % 3 <> 0").select(name.alias("scenario_title"), F.when(F.col("o_orderkey") % 2 == 0, "pass").otherwise("fail").alias("status"), F.lit('said "so"').alias("justification"))
    none = F.lit(None).cast("string")
    rows = R.traceability(scenarios.select("source_ac_clause").distinct(), scenarios, verdicts).withColumn("code_reference", none).withColumn("implementation_suggestion", none).withColumn("context", none)
    return sinks.report_lines(rows).select("o_orderkey", "line")


@query("cached_sessions", "select o_custkey user_id, count(*) n, 2::bigint reads from orders group by 1")
def cached_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Two reads of one key, of which the second finds the first one's view, and a count over it."""
    views, made = Views(), []

    def load() -> DataFrame:
        made.append(1)
        return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))

    first, second = views.read("sessions", load), views.read("sessions", load)
    assert first is second and len(made) == 1
    return second.select("user_id", "n", F.lit(2).cast("bigint").alias("reads"))
