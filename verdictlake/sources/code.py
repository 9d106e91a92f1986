"""The `code` data source: source files of a repository, in three modes.

spark.read.format("code").options(mode=..., input=..., fetcher="folder", root=...).load()

exact_files reads the files that the input names, a URL a line, and fails if any can't be read. full_repo lists the tree,
takes the first hundred text files within the size limit and skips those that can't be read; a cut tree gives a warning row
first. pull_request reads the changed files' patches, without removed files and files without a patch. Files are dealt to
tasks in groups; planning reads listings only. Below the fetcher's root a repository is `owner/repo/`, with `repo.json`
(default_branch), `tree.json` (tree, truncated), `pulls/<n>/files.json` and `contents/<ref>/<path>`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from pathlib import PurePosixPath

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from verdictlake.functions.text import BINARY_EXTENSIONS, MAX_FILE_BYTES, MAX_REPO_FILES
from verdictlake.schemas import FETCHED_FILE, MODES
from verdictlake.sources.fetch import FetchError, fetcher, with_retry

GROUP = 20
HOST = r"https?://[^/]+"
#: Path and content of the row that warns of a cut tree.
WARNING = "[WARNING] GitHub repository tree was truncated — file list is incomplete"
WARNED = "The GitHub API truncated the repository tree response. Not all files were fetched. Consider using Exact File Paths mode for large repositories."


class Files(InputPartition):
    """Files to fetch: (place below the root, path, url), whether failures are skipped; or rows that are there already."""

    def __init__(self, files: list[tuple[str, str, str]], skip: bool, rows: list[tuple]):
        self.files, self.skip, self.rows = files, skip, rows


class CodeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def _json(self, place: str):
        return json.loads(with_retry(lambda: fetcher(self.options).get(place)))

    def partitions(self) -> Sequence[InputPartition]:
        mode, text = self.options.get("mode", ""), self.options.get("input", "").strip()
        if mode == "exact_files":
            found = []
            for line in filter(None, map(str.strip, text.splitlines())):
                m = re.match(rf"{HOST}/([^/]+)/([^/]+)/blob/([^/]+)/(.+)", line)
                if not m:
                    raise ValueError(f"not a file's URL: {line!r}")
                owner, repo, ref, path = m.groups()
                found.append((f"{owner}/{repo}/contents/{ref}/{path}", path, line))
            return self._groups(found, skip=False)
        if mode == "full_repo":
            m = re.match(rf"({HOST})/([^/]+)/([^/]+?)(?:\.git)?/?$", text)
            if not m:
                raise ValueError(f"not a repository's URL: {text!r}")
            host, owner, repo = m.groups()
            try:
                branch = self._json(f"{owner}/{repo}/repo.json").get("default_branch", "main")
            except FetchError:
                branch = "main"
            tree = self._json(f"{owner}/{repo}/tree.json")
            good = [x["path"] for x in tree.get("tree", []) if x.get("type") == "blob" and PurePosixPath(x.get("path", "")).suffix.lower() not in BINARY_EXTENSIONS and x.get("size", 0) <= MAX_FILE_BYTES][:MAX_REPO_FILES]
            if not good:
                raise ValueError(f"no text files in {owner}/{repo}")
            warned = [Files([], True, [(WARNING, WARNED, None)])] if tree.get("truncated") else []
            return warned + self._groups([(f"{owner}/{repo}/contents/{branch}/{p}", p, f"{host}/{owner}/{repo}/blob/{branch}/{p}") for p in good], skip=True)
        if mode == "pull_request":
            m = re.match(rf"{HOST}/([^/]+)/([^/]+)/pull/(\d+)", text)
            if not m:
                raise ValueError(f"not a pull request's URL: {text!r}")
            owner, repo, number = m.groups()
            files = self._json(f"{owner}/{repo}/pulls/{number}/files.json")[:100]
            rows = [(f["filename"], f["patch"], f.get("blob_url")) for f in files if f.get("status") != "removed" and f.get("patch") is not None]
            if not rows:
                raise ValueError("the pull request has no file with a patch")
            return [Files([], False, rows)]
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")

    @staticmethod
    def _groups(files: list[tuple[str, str, str]], skip: bool) -> list[InputPartition]:
        return [Files(files[k : k + GROUP], skip, []) for k in range(0, len(files), GROUP)] or [Files([], skip, [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        yield from partition.rows
        source = fetcher(self.options)
        for place, path, url in partition.files:
            try:
                content = with_retry(lambda p=place: source.get(p))
            except FetchError:
                if not partition.skip:
                    raise
                continue
            yield path, content.decode("utf-8", "replace"), url


class CodeDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "code"

    def schema(self):
        return FETCHED_FILE

    def reader(self, schema) -> CodeReader:
        return CodeReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(CodeDataSource)
