"""Objects stored under user/folder/path: writes that replace, and deletes, from the tasks that hold the rows."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictlake.functions.text import object_path


class Store(Protocol):
    def put(self, place: str, content: bytes) -> None: ...

    def delete(self, place: str) -> None: ...


class FolderStore:
    """Objects as files below a folder that all executors share; a write replaces the file whole."""

    def __init__(self, root: str):
        self.root = os.path.abspath(root)

    def _path(self, place: str) -> str:
        path = os.path.abspath(os.path.join(self.root, place.lstrip("/")))
        if not path.startswith(self.root + os.sep):
            raise ValueError(f"outside the store: {place!r}")
        return path

    def put(self, place: str, content: bytes) -> None:
        path = self._path(place)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        handle, part = tempfile.mkstemp(dir=os.path.dirname(path))
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        os.replace(part, path)

    def delete(self, place: str) -> None:
        if os.path.exists(path := self._path(place)):
            os.remove(path)


def _each(df: DataFrame, make: Callable[[], Store], act: Callable[[Store, str, bytes | None], None]) -> DataFrame:
    """path and problem of every row; one row's failure is its own. A task that runs again does the same again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = make()
        for pdf in batches:
            problems = []
            for place, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    act(store, place, content)
                    problems.append(None)
                except Exception as e:
                    problems.append(str(e))
            yield pd.DataFrame({"path": pdf["path"], "problem": problems})

    return df.mapInPandas(run, "path string, problem string")


def put_objects(df: DataFrame, make: Callable[[], Store]) -> DataFrame:
    """Stores (user_id, folder, name, content); the result says what went wrong, and writing starts when it is read."""
    rows = df.select(object_path(F.col("user_id"), F.col("folder"), F.col("name")).alias("path"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
    return _each(rows, make, lambda store, place, content: store.put(place, bytes(content)))


def delete_objects(df: DataFrame, make: Callable[[], Store]) -> DataFrame:
    """Deletes (user_id, folder, name); what isn't there is no problem."""
    rows = df.select(object_path(F.col("user_id"), F.col("folder"), F.col("name")).alias("path"), F.lit(None).cast("binary").alias("content"))
    return _each(rows, make, lambda store, place, _: store.delete(place))
