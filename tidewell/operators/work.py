"""Work queues, caches and their health as table operators, and what a card or a comparison of routes says."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import scaled_round
from ..streaming.passes import Passes, instant
from .ledger import positions

ACTIVE = ("queued", "running")


def enqueued(jobs: DataFrame, wanted: DataFrame, depth: int, per_target: int, order: str = "place") -> DataFrame:
    """``wanted`` (kind, target, place) with outcome: enqueued, duplicate, per_target or capped.

    In the order of ``place`` (unique): a job that is active in ``jobs`` (kind, target, state), or wanted earlier, is a duplicate; a
    target may have ``per_target`` active jobs; the queue may hold ``depth`` active jobs in all, and what is beyond is capped.
    Targets are counted before the queue is, so one that its own limit stops takes no place in the queue.
    """
    now = jobs.where(F.col("state").isin(*ACTIVE))
    held = now.groupBy("target").agg(F.count("*").alias("__held"))
    there = now.select("kind", "target").distinct().withColumn("__there", F.lit(True))
    again = F.row_number().over(Window.partitionBy("kind", "target").orderBy(order)) > 1
    w = wanted.withColumn("__again", again).join(there, ["kind", "target"], "left").join(held, "target", "left")
    duplicate = F.col("__again") | F.col("__there").isNotNull()
    before = F.count_if(~duplicate).over(Window.partitionBy("target").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    w = w.withColumns({"__dup": duplicate, "__before": before})
    over = F.coalesce("__held", F.lit(0)) + F.coalesce("__before", F.lit(0)) >= per_target
    w = w.withColumn("outcome", F.when(F.col("__dup"), "duplicate").when(over, "per_target"))
    free = F.greatest(F.lit(depth) - now.count(), F.lit(0))
    placed = positions(w.where("outcome is null").select("kind", "target", order), order)
    kept = placed.select("kind", "target", order, F.when(F.col("position") < free, "enqueued").otherwise("capped").alias("outcome"))
    return w.where("outcome is not null").select("kind", "target", order, "outcome").unionByName(kept)


def claim_pass(store: Passes, jobs: DataFrame, limit: int, now: datetime) -> int:
    """A pass that claims the first ``limit`` queued jobs (identifier, scheduled_at, ...) that are due and that no pass has claimed; returns how many.

    Of two runs that claim at once one commits its pass first; the other one fails at its commit and has claimed nothing.
    """
    number = store.last() + 1
    schema = T.StructType([jobs.schema["identifier"]])
    due = jobs.where(F.col("scheduled_at") <= instant(now, jobs.schema["scheduled_at"].dataType)).join(store.all("claimed", schema).select("identifier"), "identifier", "left_anti")
    first = positions(due.withColumn("__order", F.struct("scheduled_at", "identifier")), "__order").where(F.col("position") < limit)
    store.write("claimed", number, first.select("identifier"))
    store.commit(number)
    return store.of("claimed", number, schema).count()


def cached_or_fetch(asked: DataFrame, artifacts: DataFrame, key: Sequence[str], now: datetime) -> DataFrame:
    """``asked`` (key) with artifact and fetch: the latest artifact (key, identifier, fetched_at, fresh_until) counts, if it is fresh after ``now``.

    One without a limit keeps that of the latest before it that has one; where there is none, it is not fresh. One without an
    instant is later than those with one, as a descending order of the source's database has it.
    """
    order = F.struct(F.isnull("fetched_at").alias("undated"), "fetched_at", F.isnull("identifier").alias("unnamed"), "identifier")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    latest = artifacts.groupBy(*key).agg(last("identifier").alias("__identifier"), last("fresh_until").alias("__until"))
    fresh = F.coalesce(F.col("__until") > instant(now, artifacts.schema["fresh_until"].dataType), F.lit(False))
    return asked.join(latest, list(key), "left").select(*asked.columns, F.when(fresh, F.col("__identifier")).alias("artifact"), (~fresh).alias("fetch"))


def queue_status(in_flight: Column, ok: Column, failures: Column, blocked: Column, requests: Column) -> Column:
    """The state of an hour of a queue, by the first that holds."""
    return (
        F.when(in_flight > 0, "running").when((ok > 0) & (failures > 0), "partial").when(ok > 0, "ok").when((failures > 0) & (failures == blocked), "blocked").when(failures > 0, "failed")
        .when(requests > 0, "cancelled").otherwise("running")
    )


def run_status(runs: DataFrame, sources: DataFrame, run: str = "run_id") -> DataFrame:
    """``runs`` with status: a partial one all of whose sources (run, outcome), of which there are some, were skipped has yielded."""
    of = sources.groupBy(run).agg(F.count_if(~F.col("outcome").eqNullSafe(F.lit("skipped"))).alias("__other"))
    return runs.join(of, run, "left").withColumn("status", F.when((F.col("status") == "partial") & (F.col("__other") == 0), "yielded").otherwise(F.col("status"))).drop("__other")


def coverage(stored: DataFrame, corpus: DataFrame, source: str, at: str) -> DataFrame:
    """(source, stored, corpus, note): whether a store covers the corpus, for each source that the store has; null where it does.

    Fewer rows are missing, more are left over; equal numbers with other last instants are not the same set.
    """
    s = stored.groupBy(source).agg(F.count("*").alias("stored"), F.max(at).alias("__s"))
    c = corpus.groupBy(source).agg(F.count("*").alias("corpus"), F.max(at).alias("__c"))
    met = s.join(c, source, "left").withColumn("corpus", F.coalesce("corpus", F.lit(0)))
    gone = F.when(F.col("stored") < F.col("corpus"), F.concat((F.col("corpus") - F.col("stored")).cast("string"), F.lit(" missing"))).when(F.col("stored") > F.col("corpus"), F.concat((F.col("stored") - F.col("corpus")).cast("string"), F.lit(" left over")))
    late = F.when(~F.col("__s").eqNullSafe(F.col("__c")), "changed since")
    return met.select(source, "stored", "corpus", F.nullif(F.concat_ws("; ", gone, late), F.lit("")).alias("note"))


def visible_patterns(patterns: DataFrame, category: str, generic: str = "generic") -> DataFrame:
    """The patterns (scope, aspect, neutral, ...) that hold for a category: its own, and generic ones but for those whose (aspect, neutral) it has itself."""
    own, general = patterns.where(F.col("scope") == category), patterns.where(F.col("scope") == generic)
    a, o = general.alias("a"), own.select("aspect", "neutral").distinct().alias("o")
    return own.unionByName(a.join(o, (F.col("a.aspect") == F.col("o.aspect")) & F.col("a.neutral").eqNullSafe(F.col("o.neutral")), "left_anti"))


class IncomparableWindow(RuntimeError):
    """A window can't be applied to both routes."""


def route_comparison(one: DataFrame, other: DataFrame, key: Sequence[str], item: str, place: str, at: str, since: str | None = None) -> DataFrame:
    """(key, item, place, side) of two listings: ``both`` in the order of the first, else ``first`` or ``second`` alone.

    ``since`` narrows both or neither: an item without an instant would be a difference of the window, not of the routes, so it is refused.
    """
    arms = []
    for name, arm in (("first", one), ("second", other)):
        if since is not None:
            if arm.where(F.col(at).isNull()).limit(1).count():
                raise IncomparableWindow(f"the {name} listing has items without an instant, so {since} can't be applied to it")
            arm = arm.where(F.to_date(at) >= F.lit(since).cast("date"))
        arms.append(arm.groupBy(*key, item).agg(F.min(place).alias(f"__{name}")))
    met = arms[0].join(arms[1], [*key, item], "full_outer")
    side = F.when(F.col("__first").isNull(), "second").when(F.col("__second").isNull(), "first").otherwise("both")
    return met.select(*key, item, F.coalesce("__first", "__second").alias("place"), side.alias("side"))


# --- cards --------------------------------------------------------------------------------------------------------


def card_rules(gap: Column, comment: Column, video: Column, share: Column, wide: float, unjudged: Sequence[str], rising: Sequence[str], steady: Sequence[str], high: float) -> Column:
    """The card type of a cell by the first rule that holds, null for none: a product gap, verified growth, the risk of a fad, saturation. A missing gap is 0."""
    g = F.coalesce(gap, F.lit(0.0))
    in_ = lambda c, names: F.coalesce(c.isin(*names), F.lit(False))
    up = in_(comment, rising) | in_(video, rising)
    return (
        F.when((g >= wide) & (F.coalesce(comment, F.lit("")) != "") & ~in_(comment, unjudged), "product_gap").when(up & (F.abs(g) < wide), "verified_growth").when(up, "fad_risk")
        .when(in_(comment, steady) & in_(video, steady) & (F.coalesce(share, F.lit(0.0)) >= high), "saturated")
    )


def card_strength(kind: Column, gap: Column, *scores: Column) -> Column:
    """What set the type is its strength: of a gap its width, of the others the first score there is."""
    return scaled_round(F.when(kind == "product_gap", F.abs(F.coalesce(gap, F.lit(0.0)))).otherwise(F.coalesce(*scores, F.lit(0.0))), 2)


def card_limits(sides: Mapping[str, tuple[Column, Column]], used: Column, generic: Column, always: str) -> Column:
    """What a card must say against itself: each side's reason for holding back and single source (name: (reason, single)), generic words that its quotes were found by, and what always holds."""
    out = []
    for name, (reason, single) in sides.items():
        out += [F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit(f"{name}: on hold, "), reason)), F.when(F.coalesce(single, F.lit(False)), F.lit(f"{name}: one source alone"))]
    common = F.array_sort(F.array_intersect(F.coalesce(used, F.array().cast("array<string>")), F.coalesce(generic, F.array().cast("array<string>"))))
    out.append(F.when(F.size(common) > 0, F.concat(F.lit("found by generic words: "), F.array_join(common, ", "))))
    return F.array_compact(F.array(*out, F.lit(always)))
