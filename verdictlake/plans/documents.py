"""Gherkin, chunk, vector and verdict queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictlake.functions import text as X
from verdictlake.functions import verdict as D
from verdictlake.operators import chunking as C
from verdictlake.operators import gherkin as G
from verdictlake.operators import relational as R
from verdictlake.plans.registry import query, table

#: A feature file for each part, the same expression in both dialects.
_FEATURE = "'Feature: ' || p_brand || chr(10) || '# note' || chr(10) || chr(10) || '  Scenario: ' || p_name || chr(10) || '    Given ' || p_type || chr(10) || '    And \"size\" ' || cast(p_size as string) || chr(10) || '    When used' || chr(10) || '    Then fine' || case when p_partkey % 2 = 0 then chr(10) || '    But not ' || p_name else '' end || chr(10) || chr(10) || '  Scenario Outline: <role> ' || p_type || chr(10) || '    Given ' || p_brand || chr(10) || case when p_partkey % 3 = 0 then 'Feature: other' || chr(10) || 'Scenario: last' || chr(10) || '  And lost' || chr(10) || '  Then end' else '' end"

_LINES = rf"""
with l as (select p_partkey, unnest(string_split({_FEATURE}, chr(10))) raw, generate_subscripts(string_split({_FEATURE}, chr(10)), 1) line from part),
n as (select *, trim(raw) t, regexp_matches(raw, '^\s*Scenario(\s+Outline)?\s*:') s, sum(regexp_matches(raw, '^\s*Scenario(\s+Outline)?\s*:')::int) over (partition by p_partkey order by line) pos from l)
"""


@query("scenario_segments", _LINES + r"select p_partkey, (pos - 1)::bigint pos, max(case when s then trim(regexp_extract(raw, ':\s*(.+)$', 1)) end) title, md5(trim(string_agg(raw, chr(10) order by line), ' ' || chr(10))) digest from n where pos > 0 group by 1, 2")
def scenario_segments(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios of each feature file."""
    found = G.scenarios(table(spark, d, "part").select("p_partkey", F.expr(_FEATURE).alias("bdd")), "p_partkey", "bdd")
    return found.select("p_partkey", "pos", "title", F.md5(F.col("text").cast("binary")).alias("digest"))


_STEPS = _LINES + r""",
k as (select *, case when starts_with(t, 'Given ') then 'given' when starts_with(t, 'When ') then 'when' when starts_with(t, 'Then ') then 'then' end word,
  last_value(case when starts_with(t, 'Feature:') then regexp_replace(t, '^Feature:\s*', '') end ignore nulls) over (partition by p_partkey order by line) feature from n where t <> '' and not starts_with(t, '#')),
f as (select *, coalesce(word, case when regexp_matches(t, '^(And|But) ') then last_value(word ignore nulls) over (partition by p_partkey, pos order by line) end) kw from k where pos > 0),
r as (select p_partkey, pos::bigint pos, coalesce(max(case when s then feature end), '') feature, max(case when s then regexp_replace(t, '^Scenario( Outline)?:\s*', '') end) scenario,
  coalesce(string_agg(t, chr(10) order by line) filter (kw = 'given'), '') given, coalesce(string_agg(t, chr(10) order by line) filter (kw = 'when'), '') "when", coalesce(string_agg(t, chr(10) order by line) filter (kw = 'then'), '') "then" from f group by 1, 2)
"""


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return G.steps(table(spark, d, "part").select("p_partkey", F.expr(_FEATURE).alias("bdd")), "p_partkey", "bdd")


@query("scenario_steps", _STEPS + 'select p_partkey, pos, feature, scenario, given, "when" w, "then" t from r')
def scenario_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of each scenario, And and But with the step before."""
    return _steps(spark, d).select("p_partkey", "pos", "feature", "scenario", "given", F.col("when").alias("w"), F.col("then").alias("t"))


@query("scenario_csv_lines", _STEPS + """select p_partkey, pos, array_to_string(list_transform([feature, scenario, given, "when", "then", ''], lambda x: '"' || replace(x, '"', '""') || '"'), ',') line from r""")
def scenario_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """K9, C17: the CSV export's rows."""
    return G.csv_lines(_steps(spark, d)).select("p_partkey", "pos", "line")


@query("feature_change_headers", _STEPS + "select p_partkey, pos, header from (select p_partkey, pos, case when lag(feature) over w is null or lag(feature) over w <> feature then 'Feature: ' || feature end header from r window w as (partition by p_partkey order by pos)) where header is not null")
def feature_change_headers(spark: SparkSession, d: str) -> DataFrame:
    """A header wherever the feature changes."""
    return G.change_headers(_steps(spark, d), "p_partkey").filter("header is not null").select("p_partkey", "pos", "header")


@query("gherkin_render", """
with s as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) i, 'F' || (p_partkey % 3) f, lag('F' || (p_partkey % 3)) over (partition by p_brand order by p_partkey) b, p_name, p_type, p_size from part)
select p_brand, md5(trim(string_agg(case when b is null or b <> f then case when i > 1 then chr(10) else '' end || 'Feature: ' || f || chr(10) || chr(10) else '' end || '  # Source AC: ' || p_type || chr(10) || '  Scenario: ' || p_name || chr(10) || '    Given ' || p_size || chr(10) || '    When w' || chr(10) || '    Then t' || chr(10), chr(10) order by p_partkey), ' ' || chr(10))) digest from s group by 1""")
def gherkin_render(spark: SparkSession, d: str) -> DataFrame:
    """Gherkin text out of structured scenarios."""
    rows = table(spark, d, "part").select("p_brand", F.struct("p_partkey", F.struct(F.col("p_type").alias("source_ac_clause"), F.concat(F.lit("F"), (F.col("p_partkey") % 3).cast("string")).alias("feature"), F.col("p_name").alias("scenario"), F.concat(F.lit("Given "), F.col("p_size").cast("string")).alias("given"), F.lit("When w").alias("when"), F.lit("Then t").alias("then")).alias("s")).alias("x"))
    grouped = rows.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("s"))
    return grouped.select("p_brand", F.md5(G.render(F.col("s")).cast("binary")).alias("digest"))


#: A third of the texts have no-break spaces for spaces.
_SPACED = "case when doc_id % 3 = 0 then replace(text, ' ', chr(160)) else text end"
#: White space of all kinds, as RE2 writes it.
_WHITE = r"[\t-\r\x1c-\x1f\x{85}\pZ]"
_SENT = f"select doc_id, text, string_split(regexp_replace(text, '([.!?]){_WHITE}+', '\\1' || chr(1), 'g'), chr(1)) s from (select doc_id, {_SPACED} text from documents) where text <> ''"


def _spaced(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.expr(_SPACED).alias("text"))


@query("sentence_split", f"select doc_id, len(s)::bigint n, max(len(x)) longest from (select doc_id, s, unnest(s) x from ({_SENT})) group by doc_id, s")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each text."""
    parts = X.sentences(F.col("text"))
    return _spaced(spark, d).filter("text <> ''").select("doc_id", F.size(parts).cast("bigint").alias("n"), F.array_max(F.transform(parts, lambda x: F.length(x))).cast("bigint").alias("longest"))


#: By chunk, not by sentence: p are the sums of words before each sentence, e the sentence that closes a chunk.
_CHUNKS = rf"""
with recursive a as (select doc_id, s parts, list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '{_WHITE}+'), lambda w: w <> ''))) counts from ({_SENT})),
b as (select doc_id, parts, counts, len(parts) n, list_transform(range(0, len(parts) + 1), lambda i: coalesce(list_sum(counts[1:i]), 0)::bigint) p from a),
c(doc_id, chunk, s, e) as (
  select doc_id, 0::bigint, 0::bigint, greatest(1, len(list_filter(p, lambda x: x <= {C.SIZE})) - 1)::bigint from b
  union all
  select doc_id, chunk + 1, t, greatest(e + 1, len(list_filter(p, lambda x: x <= p[t + 1] + {C.SIZE})) - 1) from (
    select c.doc_id, chunk, e, p, least(e - 1, greatest(s, len(list_filter(p, lambda x: x < p[e + 1] - {C.OVERLAP})))) t from c join b using (doc_id) where e < n))
"""


@query("chunk_overlap", _CHUNKS + "select doc_id, chunk, coalesce(list_sum(counts[s + 1:e]), 0)::bigint n_words, md5(array_to_string(parts[s + 1:e], ' ')) digest from c join b using (doc_id)")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 500 words that share about 50 with the one before."""
    return C.chunks(_spaced(spark, d), "doc_id", "text").select("doc_id", "chunk", "n_words", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("vector_upsert_latest", "select l_orderkey namespace, l_linenumber id, arg_max(l_partkey, row(l_shipdate, l_partkey, l_suppkey)) part from lineitem group by 1, 2")
def vector_upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last write of each key stays."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("namespace"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("part"), F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("written"))
    return R.upsert(rows, ["namespace", "id"], "written")


@query("chunk_vectors", "select doc_id, len(text) n, md5(array_to_string(list_transform(range(64), lambda i: (('0x' || left(md5(md5(text) || ':' || i), 8))::bigint % 2000000)), ',')) digest from documents")
def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in embedding for every text, and a digest of its values in millionths."""
    values = F.transform(C.hash_embedding(F.col("text")), lambda x: F.round((x.cast("double") + 1) * 1_000_000).cast("bigint").cast("string"))
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("n"), F.md5(F.array_join(values, ",").cast("binary")).alias("digest"))


@query("cosine_topk", """
with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0),
p as (select q.vec_id query_id, e.vec_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) cosine from q join embeddings e on q.vec_id <> e.vec_id)
select * from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) rank from p) where rank <= 5""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """J12 (extension): the five nearest vectors of every twentieth one, against all."""
    vectors = table(spark, d, "embeddings")
    return C.cosine_top(vectors.filter("vec_id % 20 = 0"), vectors, 5)


#: Model replies in the shapes that occur.
_UUID = "lpad(cast(o_orderkey as string), 8, '0') || '-0000-4000-8000-000000000000'"
_REPLY = "case o_orderkey % 6 when 0 then 'no json here' when 1 then '{\"type\": \"message\"} then {\"scenario_id\": \"' || " + _UUID + " || '\", \"scenario_title\": \"t\", \"status\": \"pass\", \"justification\": \"j\", \"code_reference\": {\"file\": \"f\", \"function\": null, \"line\": 3}, \"github_links\": [\"a\"], \"implementation_suggestion\": null}' when 2 then '```json' || chr(10) || '{\"scenario_id\": \"' || " + _UUID + " || '\", \"scenario_title\": \"t\", \"status\": \"maybe\", \"justification\": \"j\", \"code_reference\": {},}' || chr(10) || '```' when 3 then '{''scenario_id'': ''x'', ''scenario_title'': ''t'', ''status'': ''pass'', ''justification'': None}' when 4 then '{}' else '{\"scenario_id\": \"' || " + _UUID + " || '\", \"scenario_title\": \"t\", \"status\": \"fail\", \"justification\": \"j\", \"code_reference\": {\"file\": null}, // c' || chr(10) || ' \"github_links\": []}' end"


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.expr(_REPLY).alias("reply"))
    return orders.withColumn("j", D.read(F.col("reply")))


@query("verdict_extract", "select o_orderkey, case when o_orderkey % 6 in (1, 2, 3, 5) then 't' end title, case o_orderkey % 6 when 1 then 'pass' when 2 then 'maybe' when 3 then 'pass' when 5 then 'fail' end status, o_orderkey % 6 in (1, 2, 3, 5) marked from orders")
def verdict_extract(spark: SparkSession, d: str) -> DataFrame:
    """The verdict in a reply, mended if need be."""
    return _verdicts(spark, d).select("o_orderkey", F.get_json_object("j", "$.scenario_title").alias("title"), F.get_json_object("j", "$.status").alias("status"), D.is_marked(F.col("j")).alias("marked"))


@query("verdict_validate", "select o_orderkey, case o_orderkey % 6 when 0 then 'no verdict' when 2 then 'status' when 3 then 'scenario_id' when 4 then 'no verdict' end problem from orders")
def verdict_validate(spark: SparkSession, d: str) -> DataFrame:
    """Why a verdict is refused, if it is."""
    return _verdicts(spark, d).select("o_orderkey", D.problem(D.parse(F.col("j"))).alias("problem"))


@query("verdict_override", "select o_orderkey, case when forced then 'fail' else status end status, case when forced then 'Verification incomplete — GitHub API errors prevented full analysis: e1; e2; e3' when o_orderstatus = 'O' then 's' end suggestion from (select *, case when o_orderkey % 2 = 0 then 'pass' else 'fail' end status, o_custkey % 3 = 0 and o_orderpriority <> '5-LOW' and o_orderkey % 2 = 0 forced from orders)")
def verdict_override(spark: SparkSession, d: str) -> DataFrame:
    """A pass without any successful tool call fails."""
    status = F.when(F.col("o_orderkey") % 2 == 0, "pass").otherwise("fail")
    errors = F.when(F.col("o_custkey") % 3 == 0, F.array(*(F.lit(f"e{k}") for k in range(1, 5)))).otherwise(F.array().cast("array<string>"))
    got = D.overridden(status, F.when(F.col("o_orderstatus") == "O", "s"), errors, F.when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(0))
    return table(spark, d, "orders").select("o_orderkey", got["status"].alias("status"), got["suggestion"].alias("suggestion"))


@query("stored_content", "select doc_id, case when doc_id % 3 = 0 then 1 when doc_id % 3 = 1 then 0 end n_scenarios, case when doc_id % 3 = 2 then length(text) end n_chars from documents")
def stored_content(spark: SparkSession, d: str) -> DataFrame:
    """Stored scenarios as JSON or text by source; broken JSON counts as none."""
    from verdictlake.schemas import SCENARIO

    kind = F.col("doc_id") % 3
    one = F.to_json(F.array(F.struct(F.lit("a").alias("source_ac_clause"), F.lit("f").alias("feature"), F.col("lang").alias("scenario"), F.lit("g").alias("given"), F.lit("w").alias("when"), F.lit("t").alias("then"))))
    docs = table(spark, d, "documents").select("doc_id", F.when(kind == 2, "uploaded").otherwise("generated").alias("kind"), F.when(kind == 0, one).when(kind == 1, "[{broken").otherwise(F.col("text")).alias("content"))
    parsed = F.from_json("content", f"array<{SCENARIO.simpleString()}>")
    valid = F.size(F.filter(F.coalesce(parsed, F.array().cast(f"array<{SCENARIO.simpleString()}>")), lambda s: s["scenario"].isNotNull()))
    return docs.select("doc_id", F.when(F.col("kind") == "generated", valid).alias("n_scenarios"), F.when(F.col("kind") == "uploaded", F.length("content")).cast("bigint").alias("n_chars"))


@query("event_frames", "select event_id, 'data: {\"type\":\"' || event_type || '\",\"value\":' || user_id || '}' || chr(10) || chr(10) frame from events")
def event_frames(spark: SparkSession, d: str) -> DataFrame:
    """K8: events as stream frames."""
    body = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("value")))
    return table(spark, d, "events").select("event_id", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("frame"))


@query("event_payloads", "select event_id, json_extract_string(props, '$.k')::bigint k from events")
def event_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads read with a schema."""
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("events_routed", "select user_id, count(*) n, count(*) filter (event_type in ('purchase', 'signup')) verdicts, arg_max(event_type, event_id) last_type from events group by 1")
def events_routed(spark: SparkSession, d: str) -> DataFrame:
    """What a consumer holds after a stream, by user."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type").isin("purchase", "signup")).alias("verdicts"), F.max_by("event_type", "event_id").alias("last_type"))
