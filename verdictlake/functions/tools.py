"""The tools that agents call, as table functions of SQL over a table of files."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HITS = 10


@F.udtf(returnType="line int, text string")
class SearchCode:
    """The first lines of one file that hold a text, in any case: `from files f, lateral search_code(f.content, 'text')`."""

    def eval(self, content: str, query: str):
        found = 0
        if content and query:
            wanted = query.lower()
            for number, line in enumerate(content.split("\n"), 1):
                if wanted in line.lower():
                    yield number, line
                    found += 1
                    if found == HITS:
                        return


@F.udtf(returnType="repo string, name string, files long")
class ListDirectory:
    """Names right below a folder and how many files are below each, folders with a slash.

    `from list_directory(table(files) partition by (repo) order by (path), 'folder')`: with rows in order a name's files follow each
    other, so only one name is held.
    """

    def __init__(self) -> None:
        self.repo, self.name, self.files = None, None, 0

    def eval(self, row, folder: str):
        prefix = folder.strip("/") + "/" if folder and folder.strip("/") else ""
        if not row["path"] or not row["path"].startswith(prefix):
            return
        head, slash, _ = row["path"][len(prefix) :].partition("/")
        if head + slash != self.name:
            yield from self.terminate()
            self.repo, self.name, self.files = row["repo"], head + slash, 0
        self.files += 1

    def terminate(self):
        if self.name is not None:
            yield self.repo, self.name, self.files
            self.name = None


def register(spark: SparkSession) -> None:
    """Makes search_code and list_directory known to SQL."""
    spark.udtf.register("search_code", SearchCode)
    spark.udtf.register("list_directory", ListDirectory)
