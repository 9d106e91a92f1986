"""Reads that are kept for a while: one cached view for each key, read anew when it is stale."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

STALE_S = 60.0


class Views:
    """Cached DataFrames by key. A read that fails isn't kept and isn't tried again."""

    def __init__(self, stale_s: float = STALE_S, clock: Callable[[], float] = time.monotonic):
        self.stale_s, self.clock = stale_s, clock
        self._kept: dict[str, tuple[float, DataFrame]] = {}

    def read(self, key: str, load: Callable[[], DataFrame]) -> DataFrame:
        """The view of a key; Spark spills it and computes lost parts again."""
        had = self._kept.get(key)
        if had is not None and self.clock() - had[0] < self.stale_s:
            return had[1]
        found = load().cache()
        self.drop(key)
        self._kept[key] = (self.clock(), found)
        return found

    def drop(self, key: str) -> None:
        """Forgets a key, after a write say."""
        if key in self._kept:
            self._kept.pop(key)[1].unpersist()
