"""Joins beyond plain equi-joins: as-of, nearest, interval, containment, and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, payload: Sequence[str]) -> DataFrame:
    """Each left row with the ``payload`` of the latest right row of the same keys at or before its time (null if none).

    Both sides are merged by time in one window, so no row is multiplied. Rows of ``right`` with equal keys and
    times must agree on the payload, or the greatest one is taken.
    """
    mark = F.struct(*payload)
    a = left.select(*[F.col(c) for c in left.columns], F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(_type(right, payload)).alias("__p"))
    latest = right.groupBy(*on, right_time).agg(F.max(mark).alias("__p"))
    b = latest.select(*on, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col("__p").cast(_type(right, payload)).alias("__p"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__p", F.last("__p", ignorenulls=True).over(w)).where("__side = 1")
    return found.select(*left.columns, *[F.col(f"__p.{c}").alias(c) for c in payload])


def _type(df: DataFrame, columns: Sequence[str]) -> str:
    return "struct<" + ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in columns) + ">"


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], distance: Column, left_key: Sequence[str], tie: Sequence[Column]) -> DataFrame:
    """The closest right row of the same keys for each left row, ties by ``tie``; left rows without one go."""
    w = Window.partitionBy(*left_key).orderBy(distance.asc(), *tie)
    return left.join(right, list(on)).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def interval_join(points: DataFrame, spans: DataFrame, on: Sequence[str], at: str, begin: str, end: str, bucket: int) -> DataFrame:
    """Pairs with begin <= at < end (epoch seconds) of equal keys.

    Each span is dealt to the buckets of ``bucket`` seconds that it touches, so a hot key is split by time.
    """
    b = F.floor(F.col(at) / bucket)
    p = points.withColumn("__b", b)
    touched = F.sequence(F.floor(F.col(begin) / bucket), F.floor((F.col(end) - 1) / bucket))
    s = spans.where(F.col(end) > F.col(begin)).withColumn("__b", F.explode(touched))
    return p.join(s, [*on, "__b"]).where((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("__b")


#: Left rows of a block that one task joins at a time.
SLICE = 1024


def ranked_pairs(left: DataFrame, key: str, right: DataFrame, block: str, other: str, order: str) -> DataFrame:
    """(key, other, count, place): each left key with every right row of its block, their number, and its place by (order, other), nulls last.

    Right rows are counted and placed within their block, not within each left key, so pairs are only made by the last join, and
    nothing is shuffled that grows with them. A large block is dealt by ``SLICE`` left rows. Keys of several left rows
    have their pairs placed together, as SQL's windows over the key do.
    """
    left, right = left.select(key, block).where(F.col(block).isNotNull()), right.select(block, other, order).where(F.col(block).isNotNull())
    counted = left.withColumn("__n", F.count("*").over(Window.partitionBy(key)))
    within = Window.partitionBy(block)
    placed = right.select(block, other, F.count("*").over(within).alias("count"), F.row_number().over(within.orderBy(order, F.col(other).asc_nulls_last())).cast("long").alias("place"))
    slices = left.groupBy(block).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("__slices"))
    dealt = counted.where("__n = 1").join(slices, block).select(key, block, F.pmod(F.xxhash64(key), F.col("__slices")).cast("int").alias("__slice"))
    spread = placed.join(slices, block).withColumn("__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))).drop("__slices")
    # by a stated number, as few bytes make many pairs and small partitions would be put together
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = dealt.repartition(width, block, "__slice").join(spread.repartition(width, block, "__slice"), [block, "__slice"]).select(key, other, "count", "place")
    whole = Window.partitionBy(key)
    often = counted.where("__n > 1").join(right, block).select(key, other, F.count("*").over(whole).alias("count"), F.row_number().over(whole.orderBy(order, F.col(other).asc_nulls_last())).cast("long").alias("place"))
    return once.unionByName(often)


def reconcile(old: DataFrame, new: DataFrame, on: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Keys with change ``added``, ``removed`` or ``changed`` between two tables; nulls compare as values."""
    a = old.select(*on, F.lit(True).alias("__old"), *[F.col(c).alias(f"__o_{c}") for c in compare])
    b = new.select(*on, F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in compare])
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"__o_{c}").eqNullSafe(F.col(f"__n_{c}"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~same, "changed")
    return a.join(b, list(on), "full_outer").select(*on, change.alias("change")).where("change is not null")


def keyset_page(df: DataFrame, keys: Sequence[str], after: Sequence, size: int) -> DataFrame:
    """The next ``size`` rows after a key, in key order."""
    later = F.lit(False)
    equal = F.lit(True)
    for k, v in zip(keys, after, strict=True):
        later = later | (equal & (F.col(k) > F.lit(v)))
        equal = equal & (F.col(k) == F.lit(v))
    return df.where(later).orderBy(*keys).limit(size)
