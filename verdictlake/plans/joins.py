"""Joins by time and by interval, nearest vectors by an index, writes in place, sketches, and tools as table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.functions import tools
from verdictlake.operators import sketches as S
from verdictlake.operators import temporal as T
from verdictlake.operators import vector_index as V
from verdictlake.plans.registry import query, table
from verdictlake.plans.streams import folder
from verdictlake.sources import keyed


@query("asof_purchases", """
select e.event_id, p.event_id purchase_id, p.value from (from events where event_type <> 'purchase') e
asof left join (select user_id, ts, max(event_id) event_id, arg_max(value, event_id) as value from events where event_type = 'purchase' group by 1, 2) p on e.user_id = p.user_id and e.ts >= p.ts""")
def asof_purchases(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the user's last purchase before it."""
    events = table(spark, d, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    found = T.asof_join(events.filter("event_type <> 'purchase'").select("user_id", "ts", "event_id"), bought, "user_id", "ts")
    return found.select("event_id", F.col("found.event_id").alias("purchase_id"), F.col("found.value").alias("value"))


@query("asof_orders", """
select l_orderkey, l_linenumber, o_orderkey, count(*) copies from (select *, l_partkey % 3 k from lineitem) l
asof left join (select o_custkey % 3 k, o_orderdate t, max(o_orderkey) o_orderkey from orders where o_custkey % 3 > 0 group by 1, 2) o on l.k = o.k and l.l_shipdate >= o.t group by all""")
def asof_orders(spark: SparkSession, d: str) -> DataFrame:
    """Each line with the latest order before its shipping; three keys have all rows, so they are cut by time."""
    lines = table(spark, d, "lineitem").select((F.col("l_partkey") % 3).alias("k"), F.col("l_shipdate").alias("t"), "l_orderkey", "l_linenumber")
    orders = table(spark, d, "orders").filter("o_custkey % 3 > 0").select((F.col("o_custkey") % 3).alias("k"), F.col("o_orderdate").alias("t"), "o_orderkey")
    found = T.asof_join(lines, orders, "k", "t", many=2000)
    return found.groupBy("l_orderkey", "l_linenumber", F.col("found.o_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("copies"))


@query("overlapping_orders", """
with i as (select o_orderkey, o_custkey, o_orderdate s, o_orderdate + to_days((o_orderkey % 90)::int) e from orders)
select a.o_orderkey as one, b.o_orderkey as other from i a join i b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey and a.s < b.e and b.s < a.e and a.s < a.e and b.s < b.e""")
def overlapping_orders(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a customer's orders that are open at the same time; those of no days are never open."""
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", micros.alias("start"), (micros + (F.col("o_orderkey") % 90) * 86_400_000_000).alias("end"))
    pairs = T.interval_join(orders, orders, ["o_custkey"])
    return pairs.select(F.col("left.o_orderkey").alias("one"), F.col("right.o_orderkey").alias("other")).filter("one < other")


@query("events_in_incidents", """
select i.event_id incident, e.event_id from events i join events e on e.ts >= i.ts and e.ts < i.ts + to_seconds(60 * (1 + i.event_id % 240)::int)
where i.event_type = 'error' and i.value > 60 and e.event_type = 'purchase'""")
def events_in_incidents(spark: SparkSession, d: str) -> DataFrame:
    """Purchases while an incident is open: points in intervals, without a key to join by."""
    events = table(spark, d, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    incidents = events.filter("event_type = 'error' and value > 60").select("event_id", F.col("at").alias("start"), (F.col("at") + 60_000_000 * (1 + F.col("event_id") % 240)).alias("end"))
    points = events.filter("event_type = 'purchase'").select("event_id", F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    return T.interval_join(incidents, points, []).select(F.col("left.event_id").alias("incident"), F.col("right.event_id").alias("event_id"))


@query("cosine_index_topk", """
with q as (select vec_id, embedding from embeddings where vec_id % 20 = 0),
p as (select q.vec_id query_id, e.vec_id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) cosine from q join embeddings e on q.vec_id <> e.vec_id)
select * from (select *, row_number() over (partition by query_id order by cosine desc, vec_id) rank from p) where rank <= 5""")
def cosine_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same as cosine_topk by clusters, of which most needn't be read."""
    vectors = table(spark, d, "embeddings")
    return V.search(V.build(vectors), vectors.filter("vec_id % 20 = 0"), 5).drop("seen")


@query("vectors_in_place", """
with w as (select l_orderkey namespace, l_linenumber id, l_partkey part, l_suppkey supp, (l_orderkey % 17 = 3)::int * (l_linenumber % 2) later from lineitem)
select namespace, id, arg_max(part + later * 1000000, row(later, part, supp)) part, arg_max(supp, row(later, part, supp)) supp from w group by 1, 2""")
def vectors_in_place(spark: SparkSession, d: str) -> DataFrame:
    """K6: a keyed table, and a write of some namespaces that touches their buckets only."""
    path = f"{folder(spark)}/vectors"
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("namespace"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    late = (F.col("namespace") % 17 == 3) & (F.col("id") % 2 == 1)
    first = lines.filter(~late).groupBy("namespace", "id").agg(F.max(F.struct("part", "supp")).alias("v")).select("namespace", "id", "v.*")
    keyed.create(first.unionByName(lines.filter(late).select("namespace", "id", F.lit(-1).cast("bigint").alias("part"), "supp").dropDuplicates(["namespace", "id"])), path)
    keyed.write_in_place(lines.filter(late).withColumn("part", F.col("part") + 1_000_000), path)
    return keyed.read(spark, path)


@query("report_by_sets", """
select grouping_id(event_type, day) as level, event_type, day, count(*) total, count(*) filter (value > 50) passed, count(*) filter (not value > 50) failed
from (select *, strftime(ts, '%Y-%m-%d') as day from events) group by grouping sets ((event_type, day), (event_type), (day), ())""")
def report_by_sets(spark: SparkSession, d: str) -> DataFrame:
    """A1, A2: the verdict report by type and day, by each of them, and for all, in one pass."""
    rows = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    found = S.report(rows, [["event_type", "day"], ["event_type"], ["day"], []], F.when(F.col("value") > 50, "pass").otherwise("fail"))
    return found.select("level", "event_type", "day", "total", "passed", "failed")


@query("sketched_users", "select event_type, count(*) n, true close_distinct, true close_median from events group by 1")
def sketched_users(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users and median values by type, merged from daily sketches that were stored; counts are exact, the others within two hundredths."""
    path, events = f"{folder(spark)}/daily", table(spark, d, "events").withColumn("day", F.to_date("ts"))
    S.daily(events, ["event_type", "day"], F.col("user_id"), F.col("value")).write.parquet(path)
    found = S.merged(spark.read.parquet(path), ["event_type"])
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.percentile("value", 0.48).alias("low"), F.percentile("value", 0.52).alias("high"))
    close = F.abs(F.col("distinct") - F.col("users")) <= 0.02 * F.col("users")
    return found.join(exact, "event_type").select("event_type", "n", close.alias("close_distinct"), F.col("amount").between(F.col("low"), F.col("high")).alias("close_median"))


@query("file_hits", r"""
select doc_id, line::int line, text from (select doc_id, unnest(string_split(text, chr(10))) text, generate_subscripts(string_split(text, chr(10)), 1) line from documents)
where contains(lower(text), 'tion the') qualify row_number() over (partition by doc_id order by line) <= 10""")
def file_hits(spark: SparkSession, d: str) -> DataFrame:
    """A tool as a table function, called for each file by a lateral join."""
    tools.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("searched_files")
    return spark.sql("select f.doc_id, s.line, s.text from searched_files f, lateral search_code(f.text, 'Tion THE') s")


@query("folder_listing", """
with f as (select source repo, lang || '/' || doc_id % 7 || '/' || doc_id || '.txt' path from documents)
select repo, split_part(path, '/', 2) || '/' as name, count(*) files from f where starts_with(path, 'en/') group by all
union all select repo, split_part(path, '/', 1) || '/', count(*) from f group by all""")
def folder_listing(spark: SparkSession, d: str) -> DataFrame:
    """Another one over the whole table of files, a repository after the other, in order of path."""
    tools.register(spark)
    table(spark, d, "documents").selectExpr("source repo", "concat(lang, '/', doc_id % 7, '/', doc_id, '.txt') path").createOrReplaceTempView("listed_files")
    call = "select * from list_directory(table(select repo, path from listed_files) partition by (repo) order by (path), '{}')"
    return spark.sql(call.format("/en/")).unionByName(spark.sql(call.format("")))
