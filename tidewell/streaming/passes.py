"""Incremental work in passes: what a pass has written counts once the pass is committed, and a pass run again overwrites its own part.

A store is a folder of tables with a part for each pass, and a marker for each committed pass. So a crash between
write and commit costs one pass, the next run repeats it under the same number, and nothing counts twice. Cursors,
waiting items and run marks are tables of the store like any other. Passes of one store run one after another.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import positions

DONE, WAITING, DEAD = "done", "waiting", "dead"


class Passes:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def last(self) -> int:
        """The last committed pass, -1 before the first."""
        path, files = self._path("_passes")
        return max((int(f.getPath().getName()) for f in files.listStatus(path)), default=-1) if files.exists(path) else -1

    def commit(self, number: int) -> None:
        """Makes pass ``number`` count. It fails if another run has committed it meanwhile."""
        path, files = self._path(f"_passes/{number}")
        files.create(path, False).close()

    def write(self, name: str, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/pass={number}")

    def of(self, name: str, number: int, schema: T.StructType) -> DataFrame:
        """What pass ``number`` wrote, no row if nothing."""
        if not self.exists(f"{name}/pass={number}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/pass={number}")

    def all(self, name: str, schema: T.StructType) -> DataFrame:
        """What all committed passes wrote, with ``pass``."""
        full = T.StructType([*schema.fields, T.StructField("pass", T.IntegerType())])
        if not self.exists(name):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(f"{self.folder}/{name}").where(F.col("pass") <= self.last())

    def delete(self, name: str) -> None:
        path, files = self._path(name)
        files.delete(path, True)


def instant(value: datetime | str, kind: T.DataType) -> Column:
    """A literal of a column's type, read as the session reads a string."""
    return F.lit(str(value)).cast(kind)


# --- cursors ------------------------------------------------------------------------------------------------------


def beyond(rows: DataFrame, cursor: Sequence | None, at: str, key: str) -> Column:
    """Rows after the cursor (at as a string, key); those without an instant or a key are never reached."""
    known = F.col(at).isNotNull() & F.col(key).isNotNull()
    if cursor is None:
        return known
    when, which = instant(cursor[0], rows.schema[at].dataType), F.lit(cursor[1])
    return known & ((F.col(at) > when) | ((F.col(at) == when) & (F.col(key) > which)))


def next_batch(rows: DataFrame, at: str, key: str, cursor: Sequence | None, size: int) -> DataFrame:
    """The first ``size`` rows after the cursor in the order of (at, key), whose pairs are unique.

    Rows are counted by the hour first, so that only the hours which the batch needs are put in order, by ranges; no
    task gets the backlog, whatever ``size`` is.
    """
    later = rows.where(beyond(rows, cursor, at, key))
    hours = later.groupBy(F.date_trunc("hour", F.col(at)).alias("hour")).count()
    total = F.sum("count").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    end = hours.withColumn("total", total).where(F.col("total") >= size).agg(F.min("hour").cast("string")).first()[0]
    near = later if end is None else later.where(F.date_trunc("hour", F.col(at)) <= instant(end, T.TimestampType()))
    order = F.struct(at, key)
    placed = positions(near.withColumn("__order", order), "__order")
    return placed.where(F.col("position") < size).drop("__order", "position", "total")


# --- attempts -----------------------------------------------------------------------------------------------------


def isolated(rows: DataFrame, work: Callable[[dict], None], error: str = "error") -> DataFrame:
    """``rows`` with the error of Python ``work`` on each, null where it ends well: its type and first line, 300 characters at most.

    One bad row costs one row. Where columns can tell (``try_cast``, ``try_to_timestamp``, ``from_json``), use them instead.
    """
    import pandas as pd

    names = rows.columns

    def tried(row: dict) -> str | None:
        try:
            work(row)
        except Exception as e:  # noqa: BLE001 - that is the point
            return f"{type(e).__name__}: {(str(e).strip().splitlines() or [''])[0]}"[:300]
        return None

    def run(parts):
        for part in parts:
            found = [tried(dict(zip(names, r, strict=True))) for r in part[names].itertuples(index=False, name=None)]
            yield part.assign(**{error: pd.Series(found, index=part.index, dtype="object")})

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(error, T.StringType())]))


def attempted(waiting: DataFrame, fresh: DataFrame, attempt: Callable[[DataFrame], Column | DataFrame], final: Callable[[Column], Column], allowed: int) -> DataFrame:
    """The rows of both with attempt, error and state, each tried once.

    ``attempt`` gives the error of each row, null where it ends well, as a column or as rows with ``error``; it sees
    the attempt's number. A row whose error is final, or that has been tried ``allowed`` times, is dead; another one waits.
    """
    both = waiting.withColumn("attempt", F.col("attempt") + 1).unionByName(fresh.withColumn("attempt", F.lit(1)))
    tried = attempt(both)
    told = tried if isinstance(tried, DataFrame) else both.withColumn("error", tried)
    over = F.coalesce(final(F.col("error")), F.lit(False)) | (F.col("attempt") >= allowed)
    return told.withColumn("error", F.col("error").cast("string")).withColumn("state", F.when(F.col("error").isNull(), DONE).when(over, DEAD).otherwise(WAITING))


def _tried(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("attempt", T.IntegerType()), T.StructField("error", T.StringType()), T.StructField("state", T.StringType())])


def _waiting(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("attempt", T.IntegerType()), T.StructField("since", T.IntegerType())])


def run_pass(store: Passes, source: DataFrame, at: str, key: str, size: int, attempt, final=lambda e: F.lit(False), allowed: int = 3, before_commit: Callable[[], None] = lambda: None) -> dict[str, int]:
    """One pass over at most ``size`` items of ``source``: those that wait, the longest first, then those after the cursor.

    It writes ``tried`` (the items with attempt, error and state), ``waiting`` (all that wait after it) and ``cursor``,
    and commits them together. The cursor goes over items that failed: the waiting table remembers them. A waiting
    item that the source no longer has is never tried again. Returns the number of items by state.
    """
    number = store.last() + 1
    schema = source.schema
    cursor_kind = T.StructType([schema[at], schema[key]])
    cursor = store.of("cursor", number - 1, cursor_kind).select(F.col(at).cast("string"), key).first()
    left = store.of("waiting", number - 1, _waiting(T.StructType([schema[key]])))
    held = left.join(source.select(key), key, "left_semi")
    n = held.count()
    again = held
    if n > size:
        again = positions(held.withColumn("__order", F.struct("since", key)), "__order").where(F.col("position") < size).drop("__order", "position", "total")
    batch = next_batch(source, at, key, tuple(cursor) if cursor else None, size - n) if n < size else source.limit(0)
    retried = source.join(again.select(key, "attempt", "since"), key).select(*source.columns, "attempt", "since")
    tried = attempted(retried.drop("since"), batch, attempt, final, allowed)
    store.write("tried", number, tried.select(*source.columns, "attempt", "error", "state"))
    told = store.of("tried", number, _tried(schema))
    new = told.where(F.col("state") == WAITING).join(again.select(key, "since"), key, "left").select(key, "attempt", F.coalesce("since", F.lit(number)).alias("since"))
    store.write("waiting", number, held.join(told.select(key), key, "left_anti").select(key, "attempt", "since").unionByName(new))
    top = told.where(F.col("attempt") == 1).agg(F.max(F.struct(at, key)).alias("c")).select("c.*").where(F.col(at).isNotNull())
    old = store.of("cursor", number - 1, cursor_kind)
    store.write("cursor", number, old.unionByName(top).agg(F.max(F.struct(at, key)).alias("c")).select("c.*").where(F.col(at).isNotNull()))
    before_commit()
    store.commit(number)
    return {r[0]: r[1] for r in told.groupBy("state").count().collect()}


def tried_stream(stream: DataFrame, store: Passes, attempt, checkpoint: str, final=lambda e: F.lit(False), allowed: int = 3, before_commit: Callable[[int], None] = lambda number: None):
    """Starts a query that tries each arriving row, and again the ones that wait, batch by batch; see ``run_pass`` for the tables.

    The waiting table holds whole rows here, as a stream is read once. A batch that the engine runs again after a
    crash has the same number, so it overwrites its part, or is skipped if it was committed. ``drained`` tries what
    still waits when the input has ended.
    """
    schema = stream.schema

    def run(batch: DataFrame, number: int) -> None:
        if number > store.last():
            _whole_pass(store, batch, schema, number, attempt, final, allowed, lambda: before_commit(number))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _whole_pass(store, batch, schema, number, attempt, final, allowed, before_commit) -> None:
    held = store.of("waiting", number - 1, _waiting(schema))
    tried = attempted(held.drop("since"), batch, attempt, final, allowed)
    store.write("tried", number, tried.select(*schema.names, "attempt", "error", "state"))
    left = store.of("tried", number, _tried(schema)).where(F.col("state") == WAITING)
    store.write("waiting", number, left.select(*schema.names, "attempt", (F.lit(number) - F.col("attempt") + 1).alias("since")))
    before_commit()
    store.commit(number)


def drained(store: Passes, schema: T.StructType, attempt, final=lambda e: F.lit(False), allowed: int = 3) -> None:
    """Further passes without new rows until nothing waits: ``allowed`` at most."""
    nothing = store.spark.createDataFrame([], schema)
    while store.of("waiting", number := store.last(), _waiting(schema)).limit(1).count():
        _whole_pass(store, nothing, schema, number + 1, attempt, final, allowed, lambda: None)


# --- re-fetching, first observations --------------------------------------------------------------------------------


def to_fetch(listed: DataFrame, known: DataFrame, key: str, published: str, now: datetime, days: int) -> DataFrame:
    """Which listed items a pass fetches: (key, recent). Those published within ``days`` every time, others once ever.

    An item without an instant counts as an old one: it is fetched once, not every day. One that is listed twice is
    recent if any of its instants is; one without a key is left out. ``known`` has the keys fetched before, in any number of rows.
    """
    recent = F.coalesce(F.col(published) >= instant(now, listed.schema[published].dataType) - F.make_dt_interval(F.lit(days)), F.lit(False))
    items = listed.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(recent).alias("recent"))
    old = items.where(~F.col("recent")).join(known.select(key).distinct(), key, "left_anti")
    return items.where("recent").unionByName(old)


def fetch_pass(store: Passes, listed: DataFrame, key: str, published: str, now: datetime, days: int) -> int:
    """A pass that writes ``fetched`` (key, recent); what earlier passes fetched is known. Returns the number of the pass."""
    number = store.last() + 1
    schema = T.StructType([listed.schema[key], T.StructField("recent", T.BooleanType())])
    store.write("fetched", number, to_fetch(listed, store.all("fetched", schema), key, published, now, days))
    store.commit(number)
    return number


def observe_pass(store: Passes, rows: DataFrame, key: Sequence[str], seen: str, cutoff: datetime, before_commit: Callable[[], None] = lambda: None) -> int:
    """Appends to ``observed`` the first row of each key not observed yet, of those seen up to ``cutoff``. Returns how many.

    Rows of earlier passes are frozen: what the source says of their keys later changes nothing. Of rows seen at one
    instant the least one counts; a null in a key is a value; rows without an instant are not seen.
    """
    number = store.last() + 1
    old = store.all("observed", rows.schema).select(*key)
    within = rows.where(F.col(seen) <= instant(cutoff, rows.schema[seen].dataType))
    rest = [c for c in rows.columns if c not in key]
    first = within.groupBy(*key).agg(F.min(F.struct(seen, *[c for c in rest if c != seen])).alias("__first")).select(*key, "__first.*").select(*rows.columns)
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key]
    fresh = first.alias("n").join(old.alias("o"), [c for c in same], "left_anti")
    store.write("observed", number, fresh)
    before_commit()
    store.commit(number)
    return store.of("observed", number, rows.schema).count()


# --- slices rewritten by runs -------------------------------------------------------------------------------------

_SLICE = T.StructType([T.StructField("slice", T.StringType())])
_MARKS = T.StructType([T.StructField("run", T.IntegerType()), T.StructField("event", T.StringType()), *_SLICE.fields])


def stale_slices(store: Passes) -> DataFrame:
    """(slice, run): slices that a run began to rewrite and did not end, and that no later run has rewritten."""
    marks = store.all("marks", _MARKS).groupBy("slice", "run").agg(F.max(F.col("event") == "rewritten").alias("ended"))
    newest = marks.groupBy("slice").agg(F.max(F.struct("run", "ended")).alias("m"))
    return newest.where(~F.col("m.ended")).select("slice", F.col("m.run").alias("run"))


def rewrite_slices(store: Passes, table: str, rows: DataFrame, by: str, wanted: DataFrame, midway: Callable[[], None] = lambda: None) -> list[str]:
    """Rewrites the slices (values of ``by``) named in ``wanted`` (slice), and the stale ones; returns these, which the caller is to report.

    The slices are marked before the first is touched and again after the last is written, in passes of their own.
    So whatever ends a run, the next one knows which slices may be half there. Slices are folders of ``table``, with
    the run that wrote them; one without rows is removed. A null slice is none. What the driver lists is the stale
    slices, and those without rows: as many as one dead run had.
    """
    number = store.last() + 1
    stale = stale_slices(store)
    names = wanted.where(F.col("slice").isNotNull()).select(F.col("slice").cast("string")).unionByName(stale.select("slice")).distinct()
    found = [r[0] for r in stale.select("slice").orderBy("slice").collect()]
    mark = lambda event: names_now.select(F.lit(number).alias("run"), F.lit(event).alias("event"), "slice")
    store.write("slices", number, names)
    names_now = store.of("slices", number, _SLICE)
    store.write("marks", number, mark("rewriting"))
    store.commit(number)
    some = rows.withColumn("slice", F.col(by).cast("string")).join(names_now, "slice", "left_semi").withColumn("run", F.lit(number))
    some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(f"{store.folder}/{table}")
    midway()
    for (name,) in names_now.join(rows.select(F.col(by).cast("string").alias("slice")), "slice", "left_anti").collect():
        store.delete(f"{table}/slice={name}")
    store.write("marks", number + 1, mark("rewritten"))
    store.commit(number + 1)
    return found
