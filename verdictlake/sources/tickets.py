"""Tickets out of a landing zone of issue JSON, mock tickets, uploads, and stored objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.functions import ticket as K
from verdictlake.functions.text import strip, upload_problem

#: The parts of an issue that have a fixed shape; all fields are also kept as JSON by key.
ISSUE = "key string, names map<string,string>, fields struct<summary:string,labels:array<string>,issuelinks:array<struct<outwardIssue:struct<key:string>,inwardIssue:struct<key:string>>>>"


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    """TICKET rows out of issue JSON files, one document a file."""
    return tickets(spark.read.text(path, wholetext=True))


def tickets(raw: DataFrame, *keep: str) -> DataFrame:
    """TICKET rows out of issue JSON in the column `value`, and the columns to keep. Broken documents have no key and are left out.

    Every document is one row: its own fields are looked through where it is, so nothing is shuffled and a document that is stored
    twice gives two tickets.
    """
    issue = F.from_json("value", ISSUE)
    fields = F.from_json(F.get_json_object("value", "$.fields"), "map<string,string>")
    rows = raw.select(*(F.col(c).alias(f"_keep_{c}") for c in keep), issue.alias("i"), F.map_entries(fields).alias("f")).filter("i.key is not null")
    # strings come bare out of the map, documents and lists as JSON, which only Python can walk
    nested = F.transform("f", lambda e: F.when(strip(e["value"]).rlike(r"^[\[{]"), e["value"]))
    rows = rows.withColumn("texts", K.field_texts(nested))
    value = lambda e, k: F.coalesce(F.get("texts", k), e["value"])
    rows = rows.withColumn("each", F.transform("f", lambda e, k: F.struct(e["key"].alias("key"), F.coalesce(F.try_element_at("i.names", e["key"]), e["key"]).alias("label"), value(e, k).alias("value"))))
    description = F.get(F.filter("each", lambda e: e["key"] == "description"), F.lit(0))["value"]
    rows = rows.withColumns({"ac": K.best_of("each"), "description": description})
    return rows.select(
        F.col("i.key").alias("ticket_id"),
        F.coalesce("i.fields.summary", F.lit("")).alias("summary"),
        F.coalesce("description", F.lit("")).alias("description"),
        K.cascade(F.col("ac"), F.col("description"), F.coalesce("i.fields.summary", F.lit(""))).alias("acceptance_criteria"),
        F.coalesce("i.fields.labels", F.array()).alias("labels"),
        F.coalesce(K.linked_keys(F.col("i.fields.issuelinks")), F.array()).alias("linked_issues"),
        *(F.col(f"_keep_{c}").alias(c) for c in keep),
    )


def mock_tickets(ids: DataFrame, column: str = "ticket_id") -> DataFrame:
    """A made-up ticket for every id that starts with MOCK-."""
    one = F.col(column)
    # fixed values: the two sentences
    return ids.filter(one.startswith("MOCK-")).select(one.alias("ticket_id"), F.concat(F.lit("Mock summary for "), one).alias("summary"), F.lit("This is a mock description.").alias("description"), F.lit("Given a mock ticket, When processed, Then it works.").alias("acceptance_criteria"), F.array(F.lit("mock")).alias("labels"), F.array().cast("array<string>").alias("linked_issues"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded feature files: name, content (null if refused) and problem."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("bytes"))
    return files.withColumn("problem", upload_problem(F.col("name"), F.col("bytes"))).select("name", F.when(F.col("problem").isNull(), F.col("bytes").cast("string")).alias("content"), "problem")


def list_objects(spark: SparkSession, root: str, user: str, folder: str) -> DataFrame:
    """Stored objects of a user's folder: path below the root, and length. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{user}/{folder}")
    return found.select(F.concat(F.lit(f"{user}/{folder}/"), F.substring_index("path", f"/{user}/{folder}/", -1)).alias("path"), "length")


def download_objects(spark: SparkSession, root: str, user: str, folder: str) -> DataFrame:
    """The same with contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{user}/{folder}")
    return found.select(F.concat(F.lit(f"{user}/{folder}/"), F.substring_index("path", f"/{user}/{folder}/", -1)).alias("path"), "length", "content")
