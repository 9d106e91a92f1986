"""Joins by time: each row with the last one before it, and pairs of intervals that overlap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key from which it is cut by time, and the share of all rows from which it is: at most PARTS keys are.
MANY, PARTS = 10_000, 1000


def _below(values: Column, at: Column, most: int) -> Column:
    """How many of an array's sorted values, `most` at most, are below another; by halves, none for a null array."""
    steps = [1 << k for k in range(most.bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(F.get(values, n + step - 1) < at, n + step).otherwise(n))


def _dealt(rows: DataFrame, cut: DataFrame, parts: int) -> DataFrame:
    """Rows (_key, _at) with their _part: how many cut points (_cuts, by _key) are below _at.

    Cut points are looked up in two steps, group and place in it, so that a row meets about the square root of them, however many.
    """
    width = max(1, math.isqrt(parts))
    groups = cut.filter(F.size("_cuts") > 0).select("_key", F.transform(F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / width).cast("int")), lambda g: F.slice("_cuts", g * width + 1, width)).alias("_groups"))
    first = groups.select("_key", F.transform("_groups", lambda g: g[0]).alias("_first"))
    within = groups.select("_key", F.posexplode("_groups").alias("_group", "_within"))
    at = rows.join(F.broadcast(first), "_key", "left").withColumn("_group", _below(F.col("_first"), F.col("_at"), -(-parts // width)) - 1).drop("_first")
    at = at.join(F.broadcast(within), ["_key", "_group"], "left")
    return at.withColumn("_part", F.greatest(F.col("_group"), F.lit(0)) * width + _below(F.col("_within"), F.col("_at"), width)).drop("_group", "_within", "_at")


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, many: int | None = None) -> DataFrame:
    """The left rows, each with a struct `found`: the right row of its key with the greatest time that isn't after its own, or null.

    Both tables have the columns `key` and `time`. Of right rows with the same key and time the greatest (by all columns, in order)
    counts. Both sides are sorted together, once, and the last right row is carried on; no row meets another. A key of more than
    `many` rows is cut by time into parts of about as many, which are sorted apart; what a part starts with is the last right row of
    the parts before it. Null keys and times find nothing.
    """
    found = F.struct(F.col(time), *(F.col(c) for c in right.columns if c not in (key, time)))
    rows = left.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    rows = rows.unionByName(right.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.lit(0).alias("_side"), found.alias("_found")), allowMissingColumns=True)
    lone = F.col("_key").isNull() | F.col("_time").isNull()
    counts = rows.filter(~lone).groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    if many is None:
        many = max(MANY, (counts.agg(F.sum("n")).first()[0] or 0) // PARTS)
    hot = counts.filter(F.col("n") > many)
    parts = hot.agg(F.max(F.ceil(F.col("n") / many))).first()[0]
    order = Window.partitionBy("_key", "_part").orderBy("_time", "_side", "_found")
    carried = F.last("_found", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if parts is None:
        met = rows.filter(~lone).withColumn("_part", F.lit(0)).withColumn("_last", carried)
    else:
        # cut points of each hot key, from sketches of its times; few keys are hot, so these are few
        micros = F.unix_micros(F.col("_time").cast("timestamp")) if dict(left.dtypes)[time].startswith(("timestamp", "date")) else F.col("_time")
        shares = [k / int(parts) for k in range(1, int(parts))]
        cut = rows.filter(~lone).join(F.broadcast(hot.select("_key")), "_key", "left_semi").groupBy("_key").agg(F.array_distinct(F.percentile_approx(micros, shares, 10_000)).alias("_cuts"))
        dealt = _dealt(rows.filter(~lone).withColumn("_at", micros), cut, int(parts))
        ends = dealt.filter("_side = 0").join(F.broadcast(hot.select("_key")), "_key", "left_semi").groupBy("_key", "_part").agg(F.max(F.struct("_time", "_found")).alias("_end"))
        # what each part of a hot key starts with: from its end on, for all parts up to the next one that has a right row
        after = F.lead("_part").over(Window.partitionBy("_key").orderBy("_part"))
        starts = ends.withColumn("_until", F.coalesce(after, F.lit(int(parts) - 1))).filter(F.col("_until") > F.col("_part"))
        starts = starts.select("_key", F.explode(F.sequence(F.col("_part") + 1, "_until")).alias("_part"), F.col("_end._found").alias("_start"))
        met = dealt.withColumn("_last", carried).join(F.broadcast(starts), ["_key", "_part"], "left").withColumn("_last", F.coalesce("_last", "_start"))
    none = rows.filter(lone & (F.col("_side") == 1)).withColumn("_last", F.col("_found"))
    return met.filter("_side = 1").select("_row.*", F.col("_last").alias("found")).unionByName(none.select("_row.*", F.col("_last").alias("found")))


def _leveled(rows: DataFrame, on: list[str], side: str, start: str, end: str) -> DataFrame:
    """Rows with their interval as whole numbers and its level: the least power of two that it fits in."""
    kept = rows.select(*(F.col(c).alias(f"_on{k}") for k, c in enumerate(on)), F.struct(*rows.columns).alias(side), F.col(start).cast("bigint").alias(f"_s{side}"), F.col(end).cast("bigint").alias(f"_e{side}"))
    kept = kept.filter(F.col(f"_s{side}") < F.col(f"_e{side}"))  # no nulls and nothing empty
    return kept.withColumn(f"_l{side}", F.length(F.bin(F.col(f"_e{side}") - F.col(f"_s{side}") - 1)))


def _shift(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def interval_join(left: DataFrame, right: DataFrame, on: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Structs `left` and `right` of all rows, equal in `on`, whose half-open intervals [start, end) of whole numbers overlap.

    Buckets are powers of two. A row is in the one or two buckets that its interval touches at its own level, and at each larger
    level that the other side has; two rows meet at the larger of their levels, so that a long interval isn't spread over many small
    buckets. A pair is reported in the bucket in which its overlap begins, and in no other. Everything is an equality join. Rows
    with a null, or an empty interval, overlap nothing; a point t is [t, t + 1).
    """
    a, b = _leveled(left, on, "left", start, end), _leveled(right, on, "right", start, end)
    levels = {side: sorted(r[0] for r in df.select(f"_l{side}").distinct().collect()) for side, df in (("left", a), ("right", b))}  # 64 at most

    def spread(df: DataFrame, side: str, other: str) -> DataFrame:
        own = F.col(f"_l{side}")
        more = F.filter(F.array(*map(F.lit, levels[other])).cast("array<int>"), lambda x: x > own)
        at = df.withColumn("_level", F.explode(F.concat(F.array(own), more)))
        return at.withColumn("_bucket", F.explode(F.sequence(_shift(F.col(f"_s{side}"), F.col("_level")), _shift(F.col(f"_e{side}") - 1, F.col("_level")))))

    pairs = spread(a, "left", "right").join(spread(b, "right", "left"), [*(f"_on{k}" for k in range(len(on))), "_level", "_bucket"])
    overlap = (F.col("_sleft") < F.col("_eright")) & (F.col("_sright") < F.col("_eleft"))
    once = (F.greatest("_lleft", "_lright") == F.col("_level")) & (_shift(F.greatest("_sleft", "_sright"), F.col("_level")) == F.col("_bucket"))
    return pairs.filter(overlap & once).select("left", "right")
