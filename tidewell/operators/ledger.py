"""Runs and versions: which one is active, which one a note stands for, and what a cell of a run was counted from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def active_singleton(rows: DataFrame, key: str, active: Column, value: str) -> DataFrame:
    """(key, value) of the one active row of each key; the query fails where a key has two. A key without an active row has null."""
    g = rows.groupBy(key).agg(F.count_if(active).alias("__n"), F.max(F.when(active, F.col(value))).alias(value))
    failed = F.raise_error(F.concat(F.lit("more than one active row of "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return g.select(key, F.when(F.col("__n") <= 1, F.col(value)).otherwise(failed).alias(value))


def run_of_note(ledger: DataFrame, wanted: DataFrame, note: str = "note", run: str = "run_id") -> DataFrame:
    """(note, run, reopened) for each wanted note: its first run, opened again, or a new one numbered on from the last.

    New notes are numbered by name, by ranges, so that the same notes get the same runs again.
    """
    first = ledger.groupBy(note).agg(F.min(run).alias(run))
    asked = wanted.select(note).distinct().join(first, note, "left")
    new = positions(asked.where(F.col(run).isNull()).select(note), note).select(note, (F.col("position") + 1).alias("__k"))
    last = ledger.agg(F.coalesce(F.max(run), F.lit(0)).alias("__last"))
    made = new.crossJoin(F.broadcast(last)).select(note, (F.col("__last") + F.col("__k")).alias(run), F.lit(False).alias("reopened"))
    return asked.where(F.col(run).isNotNull()).select(note, run, F.lit(True).alias("reopened")).unionByName(made)


def positions(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with their position in an order of unique values, from 0, and the number of rows.

    Ranges of the order are sorted each in a task of its own, and only their sizes, a number for each, go to the
    driver; so no task has all rows.
    """
    parts = written(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = sorted((r[0], r[1]) for r in parts.groupBy("__part").count().collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    told = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__part int, __offset long"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return parts.join(told, "__part").withColumn("position", F.col("__offset") + place).withColumn("total", F.lit(total).cast("long")).drop("__part", "__offset")


def request_batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``rows`` with a batch from 0: ``size`` rows each, but for the first one, which has the remainder, so that the last is full."""
    pad = (F.lit(size) - F.col("total") % size) % size
    return positions(rows, order).withColumn("batch", F.floor((F.col("position") + pad) / size)).drop("position", "total")


def need_cell(cell: Mapping[str, str | None], extractors: Sequence[str], rollup: str = "all", generic: str = "generic") -> Column:
    """The condition on mentions that a cell (scope, need_key, month, product_ref) was counted from.

    The rollup's cells fold synonyms and count generic aspects alone; an empty month or product is all of them. A run
    without extractors has counted nothing.
    """
    if not extractors:
        return F.lit(False)
    out = (F.col("kind") == "need") & F.col("extractor_version").isin(list(extractors))
    if cell["scope"] == rollup:
        out = out & (F.col("need_key_rollup") == cell["need_key"]) & (F.col("aspect_scope") == generic)
    else:
        out = out & (F.col("category") == cell["scope"]) & (F.col("need_key") == cell["need_key"])
    for axis, column in (("month", "month"), ("product_ref", "product_axis")):
        if cell.get(axis):
            out = out & (F.col(column) == cell[axis])
    return out


def denominators(groups: DataFrame, rows: DataFrame, key: str, complete: Column, sums: Mapping[str, str]) -> DataFrame:
    """Sums over the complete rows of each group: 0 where it has rows but none complete, null where it has none."""
    own = rows.groupBy(key).agg(*[F.coalesce(F.sum(F.when(complete, F.coalesce(F.col(c), F.lit(0)))), F.lit(0)).alias(n) for n, c in sums.items()])
    return groups.select(key).distinct().join(own, key, "left")


def share_reading(creator: Column, consumer: Column, comment: Column, lead: float, thin: float, sparse: float, ratio: float) -> Column:
    """Whose topic it is by the shares of its sources, by the first rule that holds; empty for nobody's. A missing share is 0."""
    a, b, c = (F.coalesce(x, F.lit(0.0)) for x in (creator, consumer, comment))
    return (
        F.when((b >= lead) & (a < thin), "consumer only").when(b - a >= lead, "consumer lead").when(a - b >= lead, "creator lead")
        .when((b > 0) & (a < sparse) & (c > a * ratio), "comment only").otherwise("")
    )


def rating_reading(rate: Column, gap: Column, high: float, material: float) -> Column:
    """Much spoken of or not, and happy or not; an unknown gap is no wide one."""
    wide = F.coalesce(gap > material, F.lit(False))
    happy = rate >= high
    return F.when(wide & happy, "gap, happy").when(wide, "gap, unhappy").when(happy, "saturated").otherwise("quiet, unhappy")


def holdout_verdict(rows: DataFrame, group: str, top: int, material: float) -> DataFrame:
    """(group, verdict) of topics (topic, rate_diff, seen_rank, holdout_rank): levels first, then the order of the top ones; thin where none is ranked on both sides."""
    both = F.col("seen_rank").isNotNull() & F.col("holdout_rank").isNotNull()
    ranked = lambda c: F.slice(F.transform(F.array_sort(F.collect_list(F.when(both, F.struct(c, "topic")))), lambda x: x["topic"]), 1, top)
    g = rows.groupBy(group).agg(F.count_if(both).alias("n"), F.max(F.when(both, F.abs("rate_diff"))).alias("most"), ranked("seen_rank").alias("seen"), ranked("holdout_rank").alias("held"))
    told = F.when(F.col("n") == 0, "thin").when(F.col("most") <= material, "reproduced").when(F.col("seen") == F.col("held"), "rank only").otherwise("broken")
    return g.select(group, told.alias("verdict"))
