"""What a consumer holds: keyed state of runs whose frames arrive in chunks, cut anywhere, over many micro-batches.

Chunks of a key are put together in their order; whole frames (`data: <json>` and a blank line) change the state, a part of one
waits for the rest. A start clears what an earlier run left; verdicts and tokens are appended to lists that aren't rewritten; a
summary, an error or progress replaces the one before. A chunk that comes again (its number isn't above the last one's) changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: A key's state after a batch. run: starts so far; verdicts: `scenario:status` in order; text: tokens, once the run is complete.
STATE = "key string, version long, run long, streaming boolean, verdicts array<string>, total int, passed int, failed int, done int, pages int, error string, logs long, tokens long, text string"
_STATE = tuple(x.split()[0] for x in STATE.split(", "))
_HEAD = "version long, run long, streaming boolean, total int, passed int, failed int, done int, pages int, error string, logs long, tokens long, complete boolean, rest string"
_FIELDS = tuple(x.split()[0] for x in _HEAD.split(", "))
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def frames(text: str) -> tuple[list[dict], str]:
    """Events of whole frames, and the part that is left. What isn't JSON with a type is passed over."""
    *whole, rest = text.split("\n\n")
    found = []
    for frame in whole:
        if frame.startswith("data: "):
            try:
                event = json.loads(frame[6:])
            except ValueError:
                continue
            if isinstance(event, dict) and "type" in event:
                found.append(event)
    return found, rest


class Consumer(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", _HEAD)
        self.verdicts = handle.getListState("verdicts", "item string")
        self.tokens = handle.getListState("tokens", "item string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timers) -> Iterator[Row]:
        got = self.head.get()
        head = dict(zip(_FIELDS, got if got is not None else (-1, 0, False, None, None, None, None, None, None, 0, 0, False, ""), strict=True))
        chunks = sorted({(r["n"], r["chunk"]) for r in rows if r["n"] > head["version"]})
        if not chunks:
            return
        head["version"] = chunks[-1][0]
        events, head["rest"] = frames(head["rest"] + "".join(chunk for _, chunk in chunks))
        new: dict[str, list[tuple[str]]] = {"verdicts": [], "tokens": []}
        cleared = False
        for e in events:
            match e["type"]:
                case "start":
                    head |= {"run": head["run"] + 1, "streaming": True, "total": None, "passed": None, "failed": None, "done": None, "pages": None, "error": None, "logs": 0, "tokens": 0, "complete": False}
                    new, cleared = {"verdicts": [], "tokens": []}, True
                case "verdict":
                    new["verdicts"].append((f"{e.get('scenario_id')}:{e.get('status')}",))
                case "token":
                    new["tokens"].append((str(e.get("content", "")),))
                    head["tokens"] += 1
                case "log":
                    head["logs"] += 1
                case "progress":
                    head |= {k: e.get(k) for k in ("done", "pages")}
                case "complete":
                    head |= {"streaming": False, "complete": True}
                    if "total" in e:
                        head |= {k: e.get(k) for k in ("total", "passed", "failed")}
                case "error":
                    head |= {"streaming": False, "error": str(e.get("message"))}
        for name, state in (("verdicts", self.verdicts), ("tokens", self.tokens)):
            if cleared:
                state.clear()
            if new[name]:
                state.appendList(new[name])
        self.head.update(tuple(head[k] for k in _FIELDS))
        held = [x[0] for x in self.verdicts.get()]
        text = "".join(x[0] for x in self.tokens.get()) if head["complete"] and head["tokens"] else None
        yield Row(**{k: {"key": key[0], "verdicts": held, "text": text}.get(k, head.get(k)) for k in _STATE})

    def close(self) -> None:
        pass


def consume(chunks: DataFrame) -> DataFrame:
    """STATE of each key that a batch has changed, out of a stream of FRAME rows. Output mode update. Rows, as a frame for each key costs more than its work."""
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # lists need it
    return chunks.groupBy("key").transformWithState(Consumer(), STATE, "Update", "None")


def keep(states: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's states under its number, so that a batch that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).start()


def drain(query: StreamingQuery) -> None:
    """Waits until all that is there has been read, and stops."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def latest(kept: DataFrame) -> DataFrame:
    """Each key's last state."""
    columns = [c for c in kept.columns if c not in ("key", "batch")]
    return kept.groupBy("key").agg(F.max_by(F.struct(*columns), "version").alias("s")).select("key", "s.*")
