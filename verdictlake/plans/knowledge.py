"""Queries over knowledge sources: pages and issues that a user's hosts list, by filters that the sources take over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.operators import chunking
from verdictlake.plans.registry import query, table
from verdictlake.plans.streams import folder
from verdictlake.sources import knowledge as K
from verdictlake.sources import tickets


def wiki(spark: SparkSession, d: str, root: str) -> None:
    """Two users' wikis: documents by source and, for want of a date, a day of twenty-eight by id."""
    day = F.concat(F.lit("2024-02-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    pages = table(spark, d, "documents").select(F.col("source").alias("space"), day.alias("day"), F.col("doc_id").cast("string").alias("page_id"), F.concat(F.lit("Page "), "doc_id").alias("title"), F.concat(F.lit("https://wiki.example/"), "doc_id").alias("url"), F.col("text").alias("body"))
    for user, rest in (("ann", 0), ("bob", 1)):
        K.store(pages.filter(F.col("page_id") % 2 == rest), "wiki", root, user)


_WIKI = "from documents where doc_id % 2 = 0 and source in ('src0', 'src2', 'src9') and doc_id % 28 + 1 >= 10"


@query("knowledge_pages", f"select 'ann:knowledge' namespace, doc_id::varchar page_id, source as space, '2024-02-' || (doc_id % 28 + 1) as day, md5(text) digest {_WIKI} and text is not null union all select 'ann:knowledge', doc_id::varchar, source, '2024-02-' || (doc_id % 28 + 1), null {_WIKI} and text is null")
def knowledge_pages(spark: SparkSession, d: str) -> DataFrame:
    """A user's pages of three spaces since a day; other spaces, days and users are never fetched."""
    root = folder(spark)
    wiki(spark, d, root)
    pages = K.read(spark, "wiki", root, "ann").filter(F.col("space").isin("src0", "src2", "src9") & (F.col("day") >= "2024-02-10"))
    return pages.select("namespace", "page_id", "space", "day", F.md5(F.col("body").cast("binary")).alias("digest"))


@query("knowledge_chunks", "select 'bob:knowledge' namespace, 'wiki' source_type, 'https://wiki.example/' || doc_id source, len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> ''))::bigint words from documents where doc_id % 2 = 1 and source = 'src5' and text is not null and len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) between 1 and 450")
def knowledge_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Pages become chunks under the user's namespace; here, pages that are one chunk, with the row that the table of sources gets."""
    root = folder(spark)
    wiki(spark, d, root)
    pages = K.read(spark, "wiki", root, "bob").filter("space = 'src5'")
    chunks = chunking.chunks(pages.select("url", "body"), "url", "body").groupBy("url").agg(F.sum("n_words").alias("words"), F.max("chunk").alias("last"))
    return K.sources(pages, "wiki").join(chunks, F.col("source") == F.col("url")).filter("last = 0 and words between 1 and 450").select("namespace", "source_type", "source", F.col("words").cast("bigint").alias("words"))


_ISSUE = """'{"key":"' || cast(o_orderkey as string) || '","fields":{"summary":"Order ' || cast(o_custkey as string) || '","labels":["' || o_orderstatus || '"],"description":"it is ' || o_orderpriority || '"}}'"""


@query("project_issues", "select o_orderkey::varchar ticket_id, 'Order ' || o_custkey summary, 'it is ' || o_orderpriority description, 'ann:knowledge' namespace, (o_orderkey % 9)::varchar sprint from orders where o_custkey % 4 = 2 and o_orderkey % 9 in (3, 5) and o_orderstatus = 'O'")
def project_issues(spark: SparkSession, d: str) -> DataFrame:
    """A project's issues by sprint, which the source takes over, and by label, which Spark tests."""
    root = folder(spark)
    orders = table(spark, d, "orders")
    issues = orders.select(F.concat(F.lit("P"), (F.col("o_custkey") % 4).cast("string")).alias("project"), (F.col("o_orderkey") % 9).cast("string").alias("sprint"), F.col("o_orderkey").cast("string").alias("key"), F.array("o_orderstatus").alias("labels"), F.expr(_ISSUE).alias("value"))
    K.store(issues, "project", root, "ann")
    found = K.read(spark, "project", root, "ann").filter("project = 'P2' and sprint in ('3', '5') and array_contains(labels, 'O')")
    rows = tickets.tickets(found.select("value", "namespace", "sprint"), "namespace", "sprint")
    return rows.select("ticket_id", "summary", "description", "namespace", "sprint")
