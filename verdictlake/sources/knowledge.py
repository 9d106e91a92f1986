"""Knowledge sources: wiki pages and a project's issues, listed by cursor; filters decide which cursors are fetched.

spark.read.format("wiki").options(user=..., root=...).load().filter("space = 'eng' and day >= '2024-03-01'")
spark.read.format("project").options(user=..., root=...).load().filter("project = 'KAN' and sprint in ('4', '5')")

Both give one row a page or issue, under the user's namespace. What a host can list by (its levels) is a column each: comparisons
of those with constants are taken over by the source, which then lists and fetches only the cursors that they leave, and Spark
doesn't repeat them; all others stay with Spark. A user's pages lie below the user's own folder, and nothing else is read.

Below the fetcher's root: `<user>/<kind>/<level>=<value>/.../part-*`, JSON lines; each such file is what a cursor returns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringStartsWith

from verdictlake.sources.fetch import FetchError, fetcher, with_retry

#: Cursors that a task fetches one after the other.
CURSORS = 8
_s = T.StringType()
WIKI = T.StructType([T.StructField(k, _s) for k in ("namespace", "space", "day", "page_id", "title", "url", "body")])
PROJECT = T.StructType([*(T.StructField(k, _s) for k in ("namespace", "project", "sprint", "key")), T.StructField("labels", T.ArrayType(_s)), T.StructField("value", _s)])
#: What hosts list by, outermost first, and the columns of rows.
KINDS = {"wiki": (("space", "day"), WIKI), "project": (("project", "sprint"), PROJECT)}


def _test(f: Filter) -> tuple[str, Callable[[str], bool]] | None:
    """The column and the test of a comparison with constants; null for all that isn't one."""
    if isinstance(f, Not):
        inner = _test(f.child)
        return inner and (inner[0], lambda v: not inner[1](v))
    if len(getattr(f, "attribute", ())) != 1:
        return None
    tests: dict[type, Callable[[str], bool]] = {
        EqualTo: lambda v: v == f.value,
        EqualNullSafe: lambda v: v == f.value,
        In: lambda v: v in f.value,
        GreaterThan: lambda v: v.encode() > f.value.encode(),
        GreaterThanOrEqual: lambda v: v.encode() >= f.value.encode(),
        LessThan: lambda v: v.encode() < f.value.encode(),
        LessThanOrEqual: lambda v: v.encode() <= f.value.encode(),
        StringStartsWith: lambda v: v.startswith(f.value),
        IsNotNull: lambda v: True,
    }
    return (f.attribute[0], tests[type(f)]) if type(f) in tests and getattr(f, "value", "") is not None else None


class Cursors(InputPartition):
    """Places to fetch, with the values of their levels."""

    def __init__(self, places: list[tuple[str, tuple[str, ...]]]):
        self.places = places


class CursorReader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.options, (self.levels, self.schema) = options, KINDS[kind]
        user = options.get("user", "")
        if not re.fullmatch(r"[\w.@-]+", user) or set(user) == {"."}:
            raise ValueError(f"not a user: {user!r}")
        self.top, self.namespace = f"{user}/{kind}", f"{user}:knowledge"
        self.tests: list[tuple[int, Callable[[str], bool]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            found = _test(f)
            if found and found[0] in self.levels:
                self.tests.append((self.levels.index(found[0]), found[1]))
            else:
                yield f

    def _cursors(self, place: str, values: tuple[str, ...]) -> Iterator[tuple[str, tuple[str, ...]]]:
        depth = len(values)
        for name, folder in fetcher(self.options).entries(place):
            if depth == len(self.levels):
                if not folder and name.startswith("part-"):
                    yield f"{place}/{name}", values
            elif folder and name.startswith(f"{self.levels[depth]}="):
                value = unquote(name.partition("=")[2])
                if all(test(value) for level, test in self.tests if level == depth):
                    yield from self._cursors(f"{place}/{name}", (*values, value))

    def partitions(self) -> Sequence[InputPartition]:
        try:
            places = list(self._cursors(self.top, ()))
        except FetchError as e:
            if e.status != 404:
                raise
            places = []  # a user who has nothing yet
        return [Cursors(places[k : k + CURSORS]) for k in range(0, len(places), CURSORS)] or [Cursors([])]

    def read(self, partition: Cursors) -> Iterator[tuple]:
        source = fetcher(self.options)
        names = self.schema.names
        for place, values in partition.places:
            fixed = {"namespace": self.namespace, **dict(zip(self.levels, values, strict=True))}
            for line in with_retry(lambda p=place: source.get(p)).splitlines():
                row = json.loads(line) | fixed
                yield tuple(row.get(name) for name in names)


class WikiSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wiki"

    def schema(self) -> T.StructType:
        return WIKI

    def reader(self, schema) -> CursorReader:
        return CursorReader(dict(self.options), "wiki")


class ProjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project"

    def schema(self) -> T.StructType:
        return PROJECT

    def reader(self, schema) -> CursorReader:
        return CursorReader(dict(self.options), "project")


def register(spark: SparkSession) -> None:
    """Makes both formats known, and lets Spark hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (WikiSource, ProjectSource):
        spark.dataSource.register(source)


def read(spark: SparkSession, kind: str, root: str, user: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(kind).options(root=root.removeprefix("file://"), user=user, **options).load()


def store(rows: DataFrame, kind: str, root: str, user: str, per_cursor: int = 10_000) -> None:
    """Lays rows out as a host lists them, at most `per_cursor` rows a cursor: the stand-in for a host."""
    levels, _ = KINDS[kind]
    rows.select(*levels, F.to_json(F.struct(*(c for c in rows.columns if c not in levels))).alias("value")).repartitionByRange(*levels).write.option("maxRecordsPerFile", per_cursor).partitionBy(*levels).text(f"{root}/{user}/{kind}")


def sources(rows: DataFrame, kind: str) -> DataFrame:
    """What the table of knowledge sources keeps: one row a page or issue."""
    one = F.col("url") if kind == "wiki" else F.col("key")
    return rows.select("namespace", F.lit(kind).alias("source_type"), one.alias("source"), F.current_timestamp().alias("ingested_at"))
