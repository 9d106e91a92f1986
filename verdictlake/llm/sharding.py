"""Sharding by extendible hashing, as aggregates and joins only.

A directory over the leading bits of a 60-bit row hash: depth d has a bucket for each value of the first d bits. A bucket
splits on its next bit only while it holds more bytes than the limit, so a row's shard is the bucket of the smallest depth
that doesn't split. Bytes are first summed into cells, finer than most shards, and the directory is made from the cells;
cells that are still too large are cut again, eight bits at a time, and only their rows are read again. Hashes cover the id
and the whole text, so a hot id spreads over shards.

Defined cases: a null text has 0 bytes, a null id hashes as an empty text; an empty table gives no rows; one row that
exceeds the limit alone, or rows that are the same in id and text, can't be split and have fits = false; extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictlake.llm.common import durable, free_name

BITS = 60


def row_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of an MD5 over id and text."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftright(h, BITS - depth)


def _leaves(cells: DataFrame, depth: int, above: int, limit_bytes: int) -> DataFrame:
    """For each cell of a depth, its shallowest ancestor below depth `above` that doesn't split; null while all split."""
    levels = cells.select("cell", "n_bytes", "n_docs", "low", "high", F.explode(F.sequence(F.lit(above), F.lit(depth))).alias("depth"))
    levels = levels.withColumn("bucket", F.expr(f"shiftright(cell, {depth} - depth)"))
    buckets = levels.groupBy("depth", "bucket").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"), F.min("low").alias("low"), F.max("high").alias("high"))
    final = buckets.filter((F.col("shard_bytes") <= limit_bytes) | (F.col("low") == F.col("high")))
    found = levels.select("cell", "depth", "bucket").join(final, ["depth", "bucket"])
    return found.groupBy("cell").agg(F.min(F.struct("depth", "bucket", "shard_bytes", "shard_docs")).alias("leaf"))


def _placed(df: DataFrame, limit_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """What extendible_shards gives, and the row's hash `h`, which alone decides on its shard."""
    rows = durable(df.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("n_bytes"), row_hash(F.col(id_col), F.col(text_col)).alias("h")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, above, placed = min(BITS, max(4, math.ceil(math.log2(max(1, total / limit_bytes))) + 4)), 0, None
    open_rows = rows
    while True:
        cell = _prefix(F.col("h"), depth)
        cells = open_rows.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_docs"), F.min("h").alias("low"), F.max("h").alias("high"))
        leaves = durable(_leaves(cells, depth, above, limit_bytes))
        joined = open_rows.withColumn("cell", cell).join(leaves, "cell", "left")
        done = joined.filter(F.col("leaf").isNotNull()).drop("cell")
        placed = done if placed is None else placed.unionByName(done)
        if depth == BITS:
            break
        rest = joined.filter(F.col("leaf").isNull()).select("doc_id", "n_bytes", "h")
        if rest.isEmpty():
            break
        open_rows, above, depth = durable(rest), depth + 1, min(BITS, depth + 8)
    return placed.select(
        "h",
        "doc_id",
        "n_bytes",
        F.col("leaf.depth").cast("bigint").alias("shard_depth"),
        F.when(F.col("leaf.depth") == 0, F.lit("")).otherwise(F.expr("right(lpad(conv(cast(leaf.bucket as string), 10, 2), 60, '0'), leaf.depth)")).alias("shard"),
        F.col("leaf.shard_docs").alias("shard_docs"),
        F.col("leaf.shard_bytes").alias("shard_bytes"),
        (F.col("leaf.shard_bytes") <= limit_bytes).alias("fits"),
    )


def extendible_shards(df: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, shard_depth, shard (the bucket's bits, '' if one shard holds all), shard_docs, shard_bytes, fits."""
    return _placed(df, limit_bytes, id_col, text_col).drop("h")


def write_shards(df: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the rows to one folder a shard, and gives the name of the folders' column: shard, or another if the table has one of that name.

    A row's shard follows from its own hash, so rows without an id and repeated ones are written as often as they are there.
    """
    name, key = free_name(df, "shard"), free_name(df, "row_hash")
    shards = _placed(df, limit_bytes, id_col, text_col).select(F.col("h").alias(key), F.when(F.col("shard") == "", F.lit("all")).otherwise(F.col("shard")).alias(name)).distinct()
    rows = df.withColumn(key, row_hash(F.col(id_col), F.col(text_col))).join(shards, key).drop(key)
    rows.repartition(name).write.partitionBy(name).mode("overwrite").parquet(path)
    return name


def oracle(limit_bytes: int, max_depth: int = 24) -> str:
    """The same shards in SQL, for tables whose shards need no more than max_depth bits."""
    return f"""
with r as (select doc_id, coalesce(strlen(text), 0)::bigint n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 15))::bigint h from documents),
lv as (select r.h, d.depth, r.h >> (60 - d.depth)::int bucket, r.n_bytes from r, (select unnest(range(0, {max_depth + 1})) depth) d),
b as (select depth, bucket, sum(n_bytes)::bigint shard_bytes, count(*) shard_docs, min(h) lo, max(h) hi from lv group by 1, 2),
f as (select * from b where shard_bytes <= {limit_bytes} or lo = hi),
m as (select r.h, min(f.depth) depth from (select distinct h from r) r join f on f.bucket = r.h >> (60 - f.depth)::int group by 1)
select r.doc_id, r.n_bytes, f.depth::bigint shard_depth,
    case when f.depth = 0 then '' else right(lpad(f.bucket::bit::varchar, 64, '0'), f.depth::int) end shard,
    f.shard_docs::bigint shard_docs, f.shard_bytes, f.shard_bytes <= {limit_bytes} fits
from r join m using (h) join f on f.depth = m.depth and f.bucket = r.h >> (60 - m.depth)::int
"""
