"""Window operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the order."""
    return top_by(df, key, 1, *order)


def top_by(df: DataFrame, key: Sequence[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def mid_rank(value: str, key: Sequence[str]) -> Column:
    """((# less) + (# less or equal)) / 2 / n within the key; 1 for a single row."""
    part = Window.partitionBy(*key)
    less = F.rank().over(part.orderBy(value)) - 1
    upto = F.count(value).over(part.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    n = F.count(value).over(part)
    return F.when(n <= 1, F.lit(1.0)).otherwise((less + upto) / 2 / n)


def min_max(value: str, key: Sequence[str]) -> Column:
    """Scaled to 0..1 within the key; 0 where all are equal."""
    w = Window.partitionBy(*key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.0))


def share(value: str, key: Sequence[str]) -> Column:
    """Of the key's sum; 0 where that is 0."""
    total = F.sum(value).over(Window.partitionBy(*key))
    return F.coalesce(F.try_divide(F.col(value), total), F.lit(0.0))


def changes(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before, with ``previous``."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def onset(points: DataFrame, key: Sequence[str], time: str, value: str, floor: float, quiet: int, run: int) -> DataFrame:
    """The first active time (value above ``floor``) with at least ``quiet`` quiet ones before it and ``run`` active
    ones from it on, or active ones to the end of the series."""
    w = Window.partitionBy(*key).orderBy(time)
    active = (F.coalesce(F.col(value), F.lit(0.0)) > floor).cast("int")
    p = points.withColumn("__a", active)
    p = p.withColumns({
        "__before": F.coalesce(F.sum(1 - F.col("__a")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "__ahead": F.min("__a").over(w.rowsBetween(0, run - 1)),
    })
    return p.where((F.col("__a") == 1) & (F.col("__before") >= quiet) & (F.col("__ahead") == 1)).groupBy(*key).agg(F.min(time).alias("onset"))
