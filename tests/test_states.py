"""Streams with state: restarts in the middle, batches that fail, frames cut anywhere, late rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from verdictlake.streaming import consumer as C
from verdictlake.streaming import log as L
from verdictlake.streaming import windows as W


def frame(**fields):
    return f"data: {json.dumps(fields, ensure_ascii=False)}\n\n"


def cut(rng, key, text):
    """(key, n, chunk) of random lengths."""
    out, at = [], 0
    while at < len(text):
        end = at + rng.randint(1, 40)
        out.append((key, len(out), text[at:end]))
        at = end
    return out


def run(seed, starts=3):
    """A key's frames and what is held after them."""
    rng = random.Random(seed)
    text, held = "", {"run": 0, "verdicts": [], "summary": None, "error": None, "text": None, "tokens": []}
    for _ in range(starts):
        text += frame(type="start")
        held = {"run": held["run"] + 1, "verdicts": [], "summary": None, "error": None, "text": None, "tokens": []}
        for k in range(rng.randint(0, 8)):
            kind = rng.choice(["verdict", "token", "log", "broken", "error", "progress"])
            if kind == "verdict":
                held["verdicts"].append(f"{seed}-{k}:pass")
                text += frame(type="verdict", scenario_id=f"{seed}-{k}", status="pass")
            elif kind == "token":
                held["tokens"].append(f"é{k}\n ")
                text += frame(type="token", content=f"é{k}\n ")
            elif kind == "error":
                held["error"] = f"e{k}"
                text += frame(type="error", message=f"e{k}")
            else:
                text += {"log": frame(type="log", message="data: x"), "broken": "data: {no json\n\n: ping\n\ndata: 3\n\n", "progress": frame(type="progress", done=k, pages=9)}[kind]
        if rng.random() < 0.7:
            text += frame(type="complete", total=3, passed=2, failed=1)
            held["summary"], held["text"] = (3, 2, 1), "".join(held["tokens"]) or None
    return text, held


def states(store):
    return {r.key: {"run": r.run, "verdicts": list(r.verdicts), "summary": None if r.total is None else (r.total, r.passed, r.failed), "error": r.error, "text": r.text} for r in C.latest(store).collect()}


def expected(keys):
    return {k: {x: v for x, v in run(int(k))[1].items() if x != "tokens"} for k in keys}


def rows(keys, segments):
    rng = random.Random(9)
    out = []
    for key in keys:
        chunks = cut(rng, key, run(int(key))[0])
        out += [(*c, c[1] * segments // len(chunks)) for c in chunks]
    rng.shuffle(out)
    return out


SCHEMA = L.FRAME + ", segment int"


def test_frames_come_whole_or_wait():
    assert C.frames('data: {"type": "a"}\n\ndata: {"type"') == ([{"type": "a"}], 'data: {"type"')
    assert C.frames("") == ([], "")
    assert C.frames("data: 1\n\ndata: {}\n\nx\n\n") == ([], "")


@pytest.mark.parametrize("failing", [False, True])
def test_restart_in_the_middle_neither_loses_nor_doubles(spark, tmp_path, failing):
    keys = [str(k) for k in range(12)]
    everything = rows(keys, 6)
    spark.createDataFrame(everything, SCHEMA).createOrReplaceTempView("everything")
    log, store, checkpoint = f"{tmp_path}/log", f"{tmp_path}/store", f"{tmp_path}/checkpoint"
    L.publish(spark.table("everything").filter("segment < 3"), log, 0)
    first = L.read_log(spark, log, 1, checkpoint)
    if failing:  # the second batch fails after its state was worked out, and runs again

        def write(batch, number):
            batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
            if number == 1:
                raise RuntimeError("executor lost")

        query = C.consume(first).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()
        with pytest.raises(Exception, match="executor lost"):
            query.processAllAvailable()
        query.stop()
    else:
        C.drain(C.keep(C.consume(first), store, checkpoint))
    L.publish(spark.table("everything").filter("segment >= 3"), log, 1)
    C.drain(C.keep(C.consume(L.read_log(spark, log, 1, checkpoint)), store, checkpoint))
    assert states(spark.read.parquet(store)) == expected(keys)
    assert spark.read.parquet(store).select("batch").distinct().count() == 6  # one segment a batch, after the restart as well


def test_chunks_that_come_again_change_nothing(spark, tmp_path):
    keys = ["1", "2", "3"]
    once = rows(keys, 2)
    spark.createDataFrame(once + [(*r[:3], 2) for r in once] + once[:5], SCHEMA).createOrReplaceTempView("again")
    L.publish(spark.table("again"), f"{tmp_path}/log", 0)
    C.drain(C.keep(C.consume(L.read_log(spark, f"{tmp_path}/log", 1)), f"{tmp_path}/store", f"{tmp_path}/checkpoint"))
    assert states(spark.read.parquet(f"{tmp_path}/store")) == expected(keys)


def test_log_offsets_replay_and_unfinished_publications_wait(spark, tmp_path):
    L.publish(spark.createDataFrame([("k", n, f"c{n}", n) for n in range(5)], SCHEMA), str(tmp_path), 0)
    (tmp_path / "000001" / "segment=000000000").mkdir(parents=True)
    (tmp_path / "000001" / "segment=000000000" / "part-0").write_text('{"key":"k","n":9,"chunk":"not yet"}\n')
    reader = L.LogReader({"root": str(tmp_path), "batch": "2"})
    assert reader.initialOffset() == {"segment": ""}
    offsets = [{"segment": ""}]
    while (end := reader.latestOffset()) != offsets[-1]:
        reader.partitions(offsets[-1], end)
        offsets.append(end)
    assert len(offsets) == 4
    read = lambda a, b: sorted(r[1] for p in reader.partitions(a, b) for r in reader.read(p))
    assert [read(a, b) for a, b in zip(offsets, offsets[1:], strict=False)] == [[0, 1], [2, 3], [4]]
    assert read(offsets[1], offsets[2]) == [2, 3]  # as often as needed
    (tmp_path / "000001" / "_SUCCESS").touch()
    assert reader.latestOffset()["segment"].startswith("000001")
    again = L.LogReader({"root": str(tmp_path), "batch": "1", "at": offsets[1]["segment"]})
    assert again.latestOffset()["segment"].endswith("segment=000000002")


def test_windows_and_late_rows_are_all_rows(spark, tmp_path):
    rng = random.Random(4)
    times = [(k, 60 * rng.randint(0, 600)) for k in range(400)]
    spark.createDataFrame([(k, t, (t // 7200) if k % 9 else 4) for k, t in times], "id long, t long, segment int").createOrReplaceTempView("timed")
    chunks = spark.table("timed").select(F.lit("").alias("key"), F.col("id").alias("n"), F.to_json(F.struct("id", "t")).alias("chunk"), "segment")
    L.publish(chunks, f"{tmp_path}/log", 0)
    L.publish(spark.createDataFrame([("", -1, '{"id":-1,"t":999999}', 0)], SCHEMA), f"{tmp_path}/log", 1)

    def events():
        one = F.from_json("chunk", "id long, t long")
        return L.read_log(spark, f"{tmp_path}/log", 1).select(one["id"].alias("id"), F.timestamp_seconds(one["t"]).alias("ts"))

    found = W.tumbling(events(), "ts", "30 minutes", "20 minutes", n=F.count(F.lit(1)))
    C.drain(W.write_final(found, f"{tmp_path}/windows", f"{tmp_path}/c1"))
    # stopped and started again: the watermark goes on from what was written
    C.drain(W.set_apart_late(events(), "ts", "30 minutes", "20 minutes", f"{tmp_path}/apart", f"{tmp_path}/c2"))
    late = {r.id for r in W.late_rows(events(), f"{tmp_path}/apart").collect()}
    kept = {r.start.timestamp(): r.n for r in spark.read.parquet(f"{tmp_path}/windows").collect()}
    want = {}
    for k, t in times:
        if k not in late:
            want[float(t // 1200 * 1200)] = want.get(float(t // 1200 * 1200), 0) + 1
    assert late and kept == want
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "EventTimeWatermark" in plan
