"""Merge semantics of tables, as functions from the old and the new rows to the rows that are to stand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_ignore(old: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First observation wins: of the new rows, those of unseen keys, the first by ``order`` each."""
    fresh = new.join(old.select(*key), list(key), "left_anti")
    first = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")
    return old.unionByName(first)


def overwrite_upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of new keys replace old ones whole."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new)


def coalesce_merge(old: DataFrame, new: DataFrame, key: Sequence[str], merged: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """New values where they are not null, else old ones; ``kept`` columns of old rows never change."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, list(key), "full_outer")
    return joined.select(*key, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in merged], *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in kept])


def conditional_upsert(old: DataFrame, new: DataFrame, key: Sequence[str], values: Sequence[str], when: Column) -> DataFrame:
    """A new row replaces the old one of its key only where ``when`` (over ``old.*`` and ``new.*``) holds; null values are values."""
    a, b = old.withColumn("__old", F.lit(True)).alias("old"), new.withColumn("__new", F.lit(True)).alias("new")
    joined = a.join(b, list(key), "full_outer")
    take = F.col("old.__old").isNull() | (F.col("new.__new").isNotNull() & F.coalesce(when, F.lit(False)))
    return joined.select(*key, *[F.when(take, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in values])


def replace_slice(old: DataFrame, new: DataFrame, slice_key: Sequence[str]) -> DataFrame:
    """All old rows of the slices that the new rows are of go."""
    return old.join(new.select(*slice_key).distinct(), list(slice_key), "left_anti").unionByName(new)


def withdraw(old: DataFrame, new: DataFrame, key: Sequence[str], axis: str, axes: Sequence[str]) -> DataFrame:
    """Old rows of the given axes that the new rows no longer claim go; other axes are not touched."""
    claimed = old.where(F.col(axis).isin(*axes)).join(new.select(*key).distinct(), list(key), "left_semi")
    return old.where(~F.col(axis).isin(*axes)).unionByName(claimed)


def tail_prune(old: DataFrame, sizes: DataFrame, doc: str, ordinal: str, size: str) -> DataFrame:
    """Pieces at or beyond a document's present number of pieces go; documents without a size stay."""
    return old.join(sizes, doc, "left").where(F.col(size).isNull() | (F.col(ordinal) < F.col(size))).drop(size)


def orphans(pairs: DataFrame, *users: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct pairs that no user names."""
    out = pairs.select(*key).distinct()
    for u in users:
        out = out.join(u.select(*key), list(key), "left_anti")
    return out
