"""Session queries on stand-ins: orders are sessions, lineitems their files, conversations the chat, labels the verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictlake.functions import text as X
from verdictlake.operators import relational as R
from verdictlake.plans.registry import query, table

#: Lineitems of an order in an order that tells them apart.
ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag"]
_LATEST = f"select l_orderkey, arg_max(l_returnflag, row({', '.join(ORDER)})) bdd_status from lineitem group by 1"


@query("session_list_latest_status", f"select o_orderkey session_id, o_custkey user_id, o_orderdate created_at, coalesce(bdd_status, 'none') bdd_status from orders left join ({_LATEST}) on o_orderkey = l_orderkey")
def session_list_latest_status(spark: SparkSession, d: str) -> DataFrame:
    """Every session with its latest file's source, or none."""
    listed = R.session_list(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", F.col("l_returnflag"), ORDER)
    return listed.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), "bdd_status")


@query("session_list_of_user", f"select o_orderkey session_id, o_orderdate created_at, coalesce(bdd_status, 'none') bdd_status from orders left join ({_LATEST}) on o_orderkey = l_orderkey where o_custkey = 7")
def session_list_of_user(spark: SparkSession, d: str) -> DataFrame:
    """One user's sessions, newest first; the files are cut to theirs by a semi join before the maxima."""
    mine = R.owned(table(spark, d, "orders"), "o_custkey", 7)
    files = table(spark, d, "lineitem").join(mine.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    listed = R.session_list(mine, files, "o_orderkey", "l_orderkey", F.col("l_returnflag"), ORDER)
    return listed.select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("created_at"), "bdd_status").orderBy(F.desc("created_at"), "session_id")


@query("session_point_lookup", "select o_orderkey session_id, o_custkey user_id, o_orderdate created_at from orders where o_orderkey = 33")
def session_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """At most one row by primary key."""
    return table(spark, d, "orders").filter(F.col("o_orderkey") == 33).select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"))


@query("latest_message_per_conversation", "select conv_id, max(turn) turn, arg_max(role, turn) role, arg_max(text, turn) text from conversations group by 1")
def latest_message_per_conversation(spark: SparkSession, d: str) -> DataFrame:
    """The newest message of each conversation."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("text"))


@query("session_children_ordered", f"select o_orderkey session_id, row_number() over (partition by o_orderkey order by {', '.join(ORDER)}) pos, l_returnflag source, l_shipdate created_at from orders join lineitem on o_orderkey = l_orderkey")
def session_children_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Each session's files, oldest first."""
    joined = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select("l_orderkey", *ORDER), F.col("o_orderkey") == F.col("l_orderkey"))
    pos = F.row_number().over(Window.partitionBy("o_orderkey").orderBy(*ORDER))
    return joined.select(F.col("o_orderkey").alias("session_id"), pos.cast("bigint").alias("pos"), F.col("l_returnflag").alias("source"), F.col("l_shipdate").alias("created_at"))


@query("children_semi_join", "select l_orderkey session_id, l_returnflag source, count(*) n from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') group by 1, 2")
def children_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Files of the sessions that pass a filter."""
    wanted = table(spark, d, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(wanted, "l_orderkey", "left_semi").groupBy(F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("sessions_without_children", "select o_orderkey session_id from orders where o_orderkey not in (select l_orderkey from lineitem)")
def sessions_without_children(spark: SparkSession, d: str) -> DataFrame:
    """Sessions without a file."""
    return table(spark, d, "orders").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("session_id"))


@query("create_session_if_absent", "select user_id * 7 session_id, event_type from (select user_id, min(event_type) event_type from events group by 1) where user_id * 7 not in (select o_orderkey from orders where o_orderkey % 3 > 0)")
def create_session_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that uploads name and that don't exist yet."""
    wanted = table(spark, d, "events").groupBy((F.col("user_id") * 7).alias("session_id")).agg(F.min("event_type").alias("event_type"))
    return R.create_if_absent(table(spark, d, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("session_id")), wanted, "session_id")


@query("owner_access_code", "select l_orderkey + l_linenumber session_id, l_suppkey user_id, case when o_orderkey is null then 404 when o_custkey <> l_suppkey then 403 else 200 end code from lineitem left join orders on o_orderkey = l_orderkey + l_linenumber")
def owner_access_code(spark: SparkSession, d: str) -> DataFrame:
    """not found, forbidden or allowed, for every asked pair."""
    wanted = table(spark, d, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).alias("session_id"), F.col("l_suppkey").alias("user_id"))
    return R.access_code(table(spark, d, "orders"), wanted, "o_orderkey", "o_custkey")


@query("verdict_summary", "select source, count(*) total, count(*) filter (quality = 1) passed, count(*) filter (quality = 0) failed from labels join documents using (doc_id) group by 1")
def verdict_summary(spark: SparkSession, d: str) -> DataFrame:
    """Totals of stored verdicts by source."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return R.summary(rows, ["source"], F.when(F.col("quality") == 1, "pass").otherwise("fail"))


@query("verdict_run_counts", "select lang, count(*) total, count(*) filter (quality = 1) passed, count(*) filter (quality = 0) failed from documents left join labels using (doc_id) group by 1")
def verdict_run_counts(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2: totals of a run, in which scenarios without a verdict count only in total."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return R.summary(rows, ["lang"], F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail"), F.lit(True))


@query("pass_percent_by_source", "select source, p percent, case p when 100 then 'emerald' when 0 then 'rose' else 'amber' end accent from (select source, floor(100.0 * count(*) filter (quality = 1) / count(*) + 0.5)::bigint p from labels join documents using (doc_id) group by 1)")
def pass_percent_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Rounded pass rate and its bucket."""
    percent = X.pass_percent(F.col("passed"), F.col("total"))
    return verdict_summary(spark, d).select("source", percent.alias("percent"), X.accent(percent).alias("accent"))


@query("progress_percent", "select o_orderkey session_id, case when total = 0 then null else floor(100.0 * done / total + 0.5)::bigint end percent from (select o_orderkey, count(l_orderkey) total, count(*) filter (l_linestatus = 'F') done from orders left join lineitem on o_orderkey = l_orderkey group by 1)")
def progress_percent(spark: SparkSession, d: str) -> DataFrame:
    """A5: how far a run is, null without scenarios. Scenarios are counted in a text, by lines that start one."""
    text = F.concat(F.lit("Feature: f\n"), F.array_join(F.collect_list(F.when(F.col("l_orderkey").isNotNull(), F.lit("  Scenario: s\n    Given g\n"))), ""))
    runs = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select("l_orderkey", "l_linestatus"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(text.alias("bdd"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    total = F.regexp_count("bdd", F.lit(r"(?md)^\s*Scenario[: ]"))
    return runs.select(F.col("o_orderkey").alias("session_id"), F.when(total > 0, X.pass_percent(F.col("done"), total)).alias("percent"))


@query("session_phase", "select o_orderkey session_id, case when o_orderstatus = 'P' then 'error' when o_orderpriority = '1-URGENT' then 'ingesting' when o_orderpriority = '2-HIGH' then 'generating' when o_orderstatus = 'F' then 'ready' when o_totalprice > 1000 then 'loaded' else 'idle' end phase from orders")
def session_phase(spark: SparkSession, d: str) -> DataFrame:
    """what a session is at, by priority of its signs."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), X.phase(F.when(F.col("o_orderstatus") == "P", "boom"), F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH", F.when(F.col("o_orderstatus") == "F", "Feature"), F.when(F.col("o_totalprice") > 1000, "KEY-1")).alias("phase"))


@query("traceability_report", "select r_name clause, n_name scenario, c_custkey verdict_id, c_mktsegment status from region left join nation on r_regionkey = n_regionkey left join customer on n_nationkey = c_nationkey")
def traceability_report(spark: SparkSession, d: str) -> DataFrame:
    """J11 (extension): clause, scenario, verdict."""
    clauses = table(spark, d, "region").select(F.col("r_name").alias("clause"), F.col("r_regionkey").alias("source_ac_clause"))
    scenarios = table(spark, d, "nation").select(F.col("n_regionkey").alias("source_ac_clause"), F.col("n_name").alias("scenario"), F.col("n_nationkey").alias("scenario_title"))
    verdicts = table(spark, d, "customer").select(F.col("c_nationkey").alias("scenario_title"), F.col("c_custkey").alias("verdict_id"), F.col("c_mktsegment").alias("status"))
    return R.traceability(clauses, scenarios, verdicts).select("clause", "scenario", "verdict_id", "status")


@query("failure_clusters", "select event_type cause, count(*) n, min(event_id) first_id from events where value < 20 group by 1")
def failure_clusters(spark: SparkSession, d: str) -> DataFrame:
    """A14 (extension): failures by cause."""
    return table(spark, d, "events").filter(F.col("value") < 20).groupBy(F.col("event_type").alias("cause")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
