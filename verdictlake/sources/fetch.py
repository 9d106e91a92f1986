"""Where fetched things come from: a small interface, retries, and a folder that stands in for a remote host."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from typing import Protocol

ATTEMPTS = 4


class FetchError(Exception):
    """What a host answers with when it refuses; status as in HTTP."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"status {status}")
        self.status = status


class Fetcher(Protocol):
    def get(self, place: str) -> bytes: ...


class Browser(Fetcher, Protocol):
    """A fetcher that can also look around."""

    def entries(self, place: str) -> list[tuple[str, bool]]:
        """Names below a folder, and whether each is one."""

    def search(self, place: str, text: str) -> list[str]:
        """The first files below a place that hold a text."""


def with_retry(call: Callable[[], bytes], sleep: Callable[[float], None] = time.sleep) -> bytes:
    """Up to four attempts while the host says it is busy (429), with pauses of 1, 2 and 4 seconds."""
    for attempt in range(ATTEMPTS):
        try:
            return call()
        except FetchError as e:
            if e.status != 429 or attempt == ATTEMPTS - 1:
                raise
            sleep(2.0**attempt)
    raise AssertionError("not reached")


class FolderFetcher:
    """Places are paths below a folder; what isn't there is a 404."""

    def __init__(self, root: str):
        self.root = os.path.abspath(root)

    def get(self, place: str) -> bytes:
        path = os.path.abspath(os.path.join(self.root, place.lstrip("/")))
        if not path.startswith(self.root + os.sep):
            raise FetchError(403, place)
        try:
            with open(path, "rb") as f:
                return f.read()
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError) as e:
            raise FetchError(404, place) from e

    def entries(self, place: str) -> list[tuple[str, bool]]:
        path = os.path.abspath(os.path.join(self.root, place.lstrip("/")))
        if not (path + os.sep).startswith(self.root + os.sep):
            raise FetchError(403, place)
        try:
            return sorted((e.name, e.is_dir()) for e in os.scandir(path))
        except (FileNotFoundError, NotADirectoryError) as e:
            raise FetchError(404, place) from e

    def search(self, place: str, text: str, most: int = 10) -> list[str]:
        found: list[str] = []
        for name, folder in self.entries(place):
            below = f"{place.rstrip('/')}/{name}"
            if folder:
                found += self.search(below, text, most)
            elif text.lower().encode() in self.get(below).lower():
                found.append(below)
        return found[:most]

    def json(self, place: str):
        return json.loads(self.get(place))


#: Fetchers by name; a deployment registers its own, with its credentials, under a name of its own.
FETCHERS: dict[str, Callable[[dict], Fetcher]] = {"folder": lambda options: FolderFetcher(options["root"])}


def fetcher(options: dict) -> Fetcher:
    name = options.get("fetcher", "folder").lower()
    if name not in FETCHERS:
        raise ValueError(f"unknown fetcher {name!r}; known: {', '.join(sorted(FETCHERS))}")
    return FETCHERS[name](options)
