"""Queries over streams with state: consumers, token replies, windows and late rows. Each runs its stream to the end of a log and reads back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.plans.registry import query, table
from verdictlake.plans.streams import folder
from verdictlake.streaming import consumer as C
from verdictlake.streaming import log as L
from verdictlake.streaming import windows as W

SEGMENTS = 12


def _frame(**fields: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))), F.lit("\n\n"))


@query("consumer_state", """
with e as (select *, count(*) filter (event_type = 'signup') over (partition by user_id order by event_id) run, json_extract_string(props, '$.k')::int k from events),
l as (select * from e qualify run = max(run) over (partition by user_id)),
v as (select *, event_id || ':' || case when value > 50 then 'pass' else 'fail' end item from l)
select user_id::varchar as key, any_value(run)::bigint run, coalesce(arg_max(event_type, event_id) filter (event_type in ('signup', 'purchase', 'error')) = 'signup', false) streaming,
  count(*) filter (event_type in ('click', 'view'))::bigint n, md5(coalesce(string_agg(item, ',' order by event_id) filter (event_type in ('click', 'view')), '')) verdicts,
  arg_max(k, event_id) filter (event_type = 'purchase') total, arg_max(k // 2, event_id) filter (event_type = 'purchase') passed, arg_max(k - k // 2, event_id) filter (event_type = 'purchase') failed,
  arg_max('e' || k, event_id) filter (event_type = 'error') error from v group by user_id""")
def consumer_state(spark: SparkSession, d: str) -> DataFrame:
    """Each user's verdicts, summary and error after the last start, from frames that are cut in two and spread over micro-batches."""
    root, events = folder(spark), table(spark, d, "events")
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    half = F.floor(k / 2).cast("int")
    frame = (
        F.when(kind == "signup", _frame(type=F.lit("start")))
        .when(kind == "purchase", _frame(type=F.lit("complete"), total=k, passed=half, failed=k - half))
        .when(kind == "error", _frame(type=F.lit("error"), message=F.concat(F.lit("e"), k.cast("string"))))
        .otherwise(_frame(type=F.lit("verdict"), scenario_id=F.col("event_id").cast("string"), status=F.when(F.col("value") > 50, "pass").otherwise("fail")))
    )
    last = events.agg(F.max("event_id")).first()[0] or 0
    at = F.length("frame") / 2
    halves = F.array(F.struct((F.col("event_id") * 2).alias("n"), F.substring("frame", F.lit(1), at.cast("int")).alias("chunk")), F.struct((F.col("event_id") * 2 + 1).alias("n"), F.substring("frame", at.cast("int") + 1, F.length("frame")).alias("chunk")))
    cut = events.select("event_id", F.col("user_id").cast("string").alias("key"), frame.alias("frame")).select("key", F.inline(halves))
    # the second half of some frames comes a batch later
    L.publish(cut.withColumn("segment", F.floor((F.col("n") + 1) * SEGMENTS / (2 * last + 3)).cast("int")), f"{root}/log", 0)
    C.drain(C.keep(C.consume(L.read_log(spark, f"{root}/log", 2, f"{root}/checkpoint")), f"{root}/states", f"{root}/checkpoint"))
    found = C.latest(spark.read.parquet(f"{root}/states"))
    return found.select("key", "run", "streaming", F.size("verdicts").cast("bigint").alias("n"), F.md5(F.array_join("verdicts", ",").cast("binary")).alias("verdicts"), "total", "passed", "failed", "error")


@query("token_replies", "select conv_id || '-' || turn as key, len(string_split(text, ' '))::bigint tokens, md5(text) digest, len(string_split(text, ' '))::int done from conversations where role = 'assistant' and text is not null and conv_id % 7 <> 3")
def token_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies put together of token frames until complete, with progress; the stream stops in the middle and is started again."""
    root = folder(spark)
    replies = table(spark, d, "conversations").filter((F.col("role") == "assistant") & F.col("text").isNotNull())
    # words and their number are worked out once a reply, and chunks are cut in one pass: all is linear in a reply's length
    split = replies.select("conv_id", "turn", F.split("text", " ").alias("words"))  # used twice, so that Spark keeps it a column
    token = lambda w, i: F.concat(_frame(type=F.lit("token"), content=F.concat(F.when(i > 0, " ").otherwise(""), w)), _frame(type=F.lit("progress"), done=i + 1, pages=F.size("words")))
    body = F.concat(_frame(type=F.lit("start")), F.array_join(F.transform("words", token), ""), F.when(F.col("conv_id") % 7 != 3, _frame(type=F.lit("complete"))).otherwise(""))
    whole = split.select(F.concat_ws("-", "conv_id", "turn").alias("key"), body.alias("body"))
    pieces = F.regexp_extract_all("body", F.lit("(?s).{1,100}"), F.lit(0))  # chunks of 100 characters, so that most frames are cut
    chunks = whole.select("key", F.posexplode(pieces).alias("n", "chunk")).withColumn("n", F.col("n").cast("bigint")).withColumn("segment", F.least(F.floor(F.col("n") / 20), F.lit(SEGMENTS)).cast("int"))
    middle = SEGMENTS // 3
    for publication, part in enumerate((F.col("segment") < middle, F.col("segment") >= middle)):
        L.publish(chunks.filter(part), f"{root}/log", publication)
        C.drain(C.keep(C.consume(L.read_log(spark, f"{root}/log", 2, f"{root}/checkpoint")), f"{root}/states", f"{root}/checkpoint"))
    found = C.latest(spark.read.parquet(f"{root}/states")).filter("text is not null")
    return found.select("key", "tokens", F.md5(F.col("text").cast("binary")).alias("digest"), "done")


#: Hours that an event takes to arrive: most come within two, some within a day, a few after days.
_DELAY = "case when event_id % 50 = 0 then 100 when event_id % 7 = 0 then 20 else event_id % 3 end"
#: Days before a segment that the first event is in; a segment holds what arrives in two days.
_SEGMENT = f"floor((epoch(ts) + 3600 * ({_DELAY})) / 172800)::bigint"


def _arriving(spark: SparkSession, d: str, root: str) -> DataFrame:
    """A stream of events in the order in which they arrive, and one event at the end that is later than all windows."""
    events = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    segment = F.floor((F.unix_micros("ts") / 1_000_000 + 3600 * F.expr(_DELAY)) / 172_800)
    rows = events.withColumn("segment", segment.cast("bigint"))
    least = rows.agg(F.min("segment"), F.max("segment"), F.max("ts")).first()
    body = F.to_json(F.struct(*events.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    rows = rows.select(F.lit("").alias("key"), F.col("event_id").alias("n"), body.alias("chunk"), (F.col("segment") - F.lit(least[0] or 0)).alias("segment"))
    L.publish(rows, f"{root}/log", 0)
    end = events.limit(1).select(F.lit("").alias("key"), F.lit(-1).cast("bigint").alias("n"), F.to_json(F.struct(F.lit(-1).cast("bigint").alias("event_id"), (F.lit(least[2]).cast("timestamp") + F.expr("interval 30 days")).alias("ts"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value")), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("chunk"), F.lit(0).alias("segment"))
    L.publish(end, f"{root}/log", 1)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    return L.read_log(spark, f"{root}/log", 1, f"{root}/checkpoint").select(F.from_json("chunk", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("e")).select("e.*")


_MARKED = f"""
with a as (select *, {_SEGMENT} segment from events where ts is not null),
s as (select segment, max(max(ts)) over (order by segment rows between unbounded preceding and 2 preceding) - interval 12 hour mark from a group by segment),
m as (select a.*, time_bucket(interval 6 hour, ts) start, coalesce(time_bucket(interval 6 hour, ts) + interval 6 hour <= mark, false) late from a join s using (segment))
"""


@query("event_windows", _MARKED + "select epoch_us(start) start, event_type, count(*) n, max(value) most from m where not late group by all")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of six hours over events that come out of order, with a watermark of twelve hours."""
    root = folder(spark)
    found = W.tumbling(_arriving(spark, d, root), "ts", "12 hours", "6 hours", "event_type", n=F.count(F.lit(1)), most=F.max("value"))
    C.drain(W.write_final(found, f"{root}/windows", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/windows").filter("event_type <> 'end'").select(F.unix_micros("start").alias("start"), "event_type", "n", "most")


@query("late_events", _MARKED + "select event_id, event_type, user_id from m where late")
def late_events(spark: SparkSession, d: str) -> DataFrame:
    """The events that the windows leave out, to the row."""
    root = folder(spark)
    events = _arriving(spark, d, root)
    C.drain(W.set_apart_late(events, "ts", "12 hours", "6 hours", f"{root}/apart", f"{root}/checkpoint"))
    return W.late_rows(events, f"{root}/apart").select("event_id", "event_type", "user_id")


@query("event_sessions", """
with g as (select *, coalesce(ts > lag(ts) over (partition by user_id order by ts) + interval 4 hour, true) opens from events where ts is not null),
s as (select *, sum(opens::int) over (partition by user_id order by ts, event_id rows unbounded preceding) k from g)
select user_id, epoch_us(min(ts)) start, epoch_us(max(ts) + interval 4 hour) "end", count(*) n from s group by user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user's events with gaps of four hours, over events that come out of order; the watermark waits for all."""
    root = folder(spark)
    found = W.sessions(_arriving(spark, d, root), "ts", "8 days", "4 hours", "user_id", n=F.count(F.lit(1)))
    C.drain(W.write_final(found, f"{root}/sessions", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/sessions").filter("user_id >= 0").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")
