"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII characters that are neither letters (lower case) nor digits; every other code point belongs to a word.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Row keys (some 50 bytes each) that are broadcast at most, once they have been counted.
MAX_BROADCAST_KEYS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only local sessions without it get a folder of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="checkpoint")


def durable(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the folder that all executors share, so that a lost executor costs nothing.

    Spark removes a checkpoint with its DataFrame where spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same in SQL, for a column named text.
ASCII_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"


def release() -> None:
    """Gives freed memory back to the system, which Arrow's allocator and the C library would keep as long as the driver, or a worker that later tasks use again, runs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underlines added until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Texts of ASCII characters only take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def spaced(text: Column) -> Column:
    """The words of a text in lower case, one space between; empty for null and for texts without a word."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD, " "))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of parts; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return _holds_map(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.MapType, T.VariantType))


def row_key(df: DataFrame) -> Column:
    """128 bits from all of a row's columns but those that hold maps; only rows that are equal in these share a key. Ids play no part."""
    columns = [df[f.name] for f in df.schema.fields if not _holds_map(f.dataType)]
    parts = [x for c in columns for x in (F.isnull(c), c)]  # a hash passes over nulls
    return F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(k), *parts)), 16, "0") for k in (1, 2)))


def without_keys(keyed: DataFrame, gone: DataFrame, name: str = "row_key") -> DataFrame:
    """The rows whose key, in the column `name`, isn't among `gone`. Few keys are broadcast and the rows stay in place; many are joined by shuffle."""
    gone = durable(gone.toDF(name).distinct())
    return keyed.join(F.broadcast(gone) if gone.count() <= MAX_BROADCAST_KEYS else gone, name, "left_anti")
