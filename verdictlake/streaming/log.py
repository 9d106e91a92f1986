"""A log of frames: segments that are published whole and read as a stream, from any offset, as often as needed.

A publication is a folder written in one go; its segments are folders in it, numbered. The offset is the name of the last segment
that was read, so that a batch that is tried again after a failure reads the same segments, and one that was finished is never
read again. Every file of a segment is a task of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from verdictlake.sources.fetch import fetcher
from verdictlake.sources.sinks import exists

#: key: whose frames these are; n: their order within a key; chunk: text, cut anywhere.
FRAME = "key string, n long, chunk string"


def publish(frames: DataFrame, path: str, publication: int, segment: str = "segment") -> None:
    """Writes rows of FRAME and the number of their segment as one publication. Large segments become several files."""
    numbered = frames.select(F.lpad(F.col(segment).cast("string"), 9, "0").alias("segment"), F.to_json(F.struct("key", "n", "chunk")).alias("value"))
    numbered.repartitionByRange("segment", F.xxhash64("value")).write.partitionBy("segment").text(f"{path}/{publication:06d}")


class Segment(InputPartition):
    def __init__(self, place: str):
        self.place = place


class LogReader(DataSourceStreamReader):
    """options: root (the log), batch (segments a micro-batch, all if left out), at (the last segment that a batch was planned up to), fetcher."""

    def __init__(self, options: dict):
        self.options, self.source = options, fetcher(options)
        self.most = int(options.get("batch", "0"))
        self.at = options.get("at", "")

    def _segments(self) -> list[str]:
        """Segments of publications that are whole, in order."""
        found = []
        for publication, folder in self.source.entries(""):
            below = self.source.entries(publication) if folder else []
            if ("_SUCCESS", False) in below:
                found += [f"{publication}/{name}" for name, is_folder in below if is_folder and name.startswith("segment=")]
        return sorted(found)

    def initialOffset(self) -> dict:
        return {"segment": ""}

    def latestOffset(self) -> dict:
        names = self._segments()
        after = [x for x in names if x > self.at]
        return {"segment": (after[: self.most or None] or [self.at])[-1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = max(self.at, end["segment"])
        names = [x for x in self._segments() if start["segment"] < x <= end["segment"]]
        return [Segment(f"{x}/{name}") for x in names for name, folder in self.source.entries(x) if not folder and name.startswith("part-")]

    def read(self, partition: Segment) -> Iterator[tuple]:
        for line in self.source.get(partition.place).splitlines():
            row = json.loads(line)
            yield row.get("key"), row.get("n"), row.get("chunk")

    def commit(self, end: dict) -> None:
        """Nothing to do: segments stay for those who read later."""


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_log"

    def schema(self) -> str:
        return FRAME

    def streamReader(self, schema) -> LogReader:
        return LogReader(dict(self.options))


def position(spark: SparkSession, checkpoint: str) -> str:
    """The last segment that a stream's batches were planned up to, from the offsets in its checkpoint; empty for a new stream."""
    folder = f"{checkpoint}/offsets"
    if not exists(spark, folder):
        return ""
    logs = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").cast("long").alias("batch"), "value")
    last = logs.agg(F.max_by("value", "batch")).first()[0]
    return max((json.loads(line).get("segment", "") for line in (last or "").splitlines() if line.startswith("{")), default="")


def read_log(spark: SparkSession, path: str, batch: int = 0, checkpoint: str | None = None) -> DataFrame:
    """A stream of the log's rows. With a bound on a batch's segments, a stream that is started again needs its checkpoint to know where it is."""
    spark.dataSource.register(LogSource)
    at = position(spark, checkpoint) if checkpoint else ""
    return spark.readStream.format("frame_log").options(root=path.removeprefix("file://"), batch=batch, at=at).load()
