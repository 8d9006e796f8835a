"""Rules over whole tables: trust in months, calendar windows, counterfactual variants, confirmed answers, identity, gates and re-match plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- months and windows -------------------------------------------------------------------------------------------


def trusted_months(rows: DataFrame, month: str, key: Sequence[str], trusted: Column, counts: Mapping[str, Column]) -> DataFrame:
    """(month, key, counts) of months all of whose rows can be trusted; a month with any other row has null counts for every key, not 0.

    How much of an untrusted month is missing is not known, and that holds for the month, not for one key of it.
    """
    known = rows.groupBy(month).agg(F.min(F.coalesce(trusted, F.lit(False)).cast("int")).alias("__all"))
    cells = rows.groupBy(month, *key).agg(*[F.count_if(F.coalesce(c, F.lit(False)) & F.coalesce(trusted, F.lit(False))).alias(n) for n, c in counts.items()])
    return cells.join(known, month).select(month, *key, *[F.when(F.col("__all") == 1, F.col(n)).alias(n) for n in counts])


def quarter_index(quarter: Column) -> Column:
    """Quarters ``1997Q3`` as numbers that follow each other."""
    return F.left(quarter, F.lit(4)).cast("int") * 4 + F.right(quarter, F.lit(1)).cast("int") - 1


def window_shares(counts: DataFrame, last: Column | int, topic: str = "topic", quarter: str = "quarter", n: str = "n", width: int = 4) -> DataFrame:
    """(topic, prior, recent, delta): shares of all topics' counts, in hundredths, in the ``width`` quarters before ``last`` and the ``width`` before these.

    Quarters are counted by the calendar: one without rows is in its window, as 0. The last quarter goes on and is in none.
    """
    back = (last if isinstance(last, Column) else F.lit(last)) - quarter_index(F.col(quarter))
    g = counts.groupBy(topic).agg(F.sum(F.when(back.between(width + 1, 2 * width), F.col(n))).alias("__p"), F.sum(F.when(back.between(1, width), F.col(n))).alias("__r"))
    every = Window.partitionBy()
    share = lambda c: 100 * F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), F.sum(c).over(every)), F.lit(0.0))
    s = g.select(topic, share(F.col("__p")).alias("prior"), share(F.col("__r")).alias("recent"))
    return s.withColumn("delta", F.col("recent") - F.col("prior"))


def panel_sensitivity(counts: DataFrame, least: int, material: float) -> DataFrame:
    """How a choice of panel changes what is said: ``counts`` are (topic, quarter, product, every), the counts of one part of the panel and of all of it.

    Rounded differences are of the unrounded numbers. A topic is judged (``sample_ok``) if more than half of the part's
    quarters have ``least`` counts or more; ``flipped`` if the two then move in opposite directions and one of them by ``material``.
    """
    own = counts.where("product > 0")
    last = own.agg(F.max(quarter_index(F.col("quarter"))).alias("l"), F.count_distinct("quarter").alias("quarters")).first()
    part = window_shares(own.select("topic", "quarter", F.col("product").alias("n")), last["l"] or 0).select("topic", F.col("delta").alias("a"))
    whole = window_shares(counts.select("topic", "quarter", F.col("every").alias("n")), last["l"] or 0).select("topic", F.col("delta").alias("b"))
    enough = counts.groupBy("topic").agg(F.count_if(F.col("product") >= least).alias("quarters_ok_product"), F.count_if(F.col("every") >= least).alias("quarters_ok_all"))
    met = enough.join(part, "topic", "left").join(whole, "topic", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("a", "b")})
    ok = 2 * F.col("quarters_ok_product") > last["quarters"]
    a, b = F.round("a", 2), F.round("b", 2)
    return met.select(
        "topic", "quarters_ok_product", "quarters_ok_all", a.alias("delta_product_pp"), b.alias("delta_all_pp"), F.round(F.col("b") - F.col("a"), 2).alias("difference_pp"), ok.alias("sample_ok"),
        (ok & (a * b < 0) & (F.greatest(F.abs(a), F.abs(b)) >= material)).alias("flipped"),
    )


# --- counterfactuals ------------------------------------------------------------------------------------------------


def variants(rows: DataFrame, dropped: Mapping[str, Column]) -> DataFrame:
    """``rows`` once as ``base`` and once for each variant, without those that it drops: a variant is one more key of the same jobs."""
    names = F.array(F.lit("base"), *[F.when(~F.coalesce(d, F.lit(False)), F.lit(n)) for n, d in dropped.items()])
    return rows.withColumn("variant", F.explode(F.array_compact(names)))


def verdict_changes(verdicts: DataFrame, cell: Sequence[str], by: Sequence[str], none: str = "thin") -> DataFrame:
    """(variant, by, judged, flipped, lost): cells of the base with a verdict, those that a variant gives another one, those that it gives none.

    ``verdicts`` are (variant, cell, verdict). A sample that has become too small is no other verdict, so it is counted apart.
    """
    told = verdicts.where(F.col("verdict") != none)
    base = told.where("variant = 'base'").select(*cell, F.col("verdict").alias("__was"))
    names = verdicts.where("variant <> 'base'").select("variant").distinct()
    asked = base.crossJoin(F.broadcast(names))  # a handful of variants
    now = told.select("variant", *cell, F.col("verdict").alias("__now"))
    met = asked.join(now, ["variant", *cell], "left")
    return met.groupBy("variant", *by).agg(F.count("*").alias("judged"), F.count_if(F.col("__now") != F.col("__was")).alias("flipped"), F.count_if(F.col("__now").isNull()).alias("lost"))


# --- confirmed answers, onsets, identity --------------------------------------------------------------------------


def confirmed_polarity(rows: DataFrame, group: str, name: str, confirmed: DataFrame, neutral: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """``rows`` with polarity: what a person has confirmed for (topic_group, topic_name), else by hints in the name: neutral ones first, then negative ones, else positive."""
    said = F.trim(F.coalesce(F.col(name), F.lit("")))
    has = lambda hints: F.exists(F.array(*map(F.lit, hints)).cast("array<string>"), lambda h: said.contains(h))
    table = confirmed.groupBy(F.col("topic_group").alias("__g"), F.col("topic_name").alias("__n")).agg(F.min("polarity").alias("__p"))
    met = rows.join(table, (F.col(group) == F.col("__g")) & (said == F.col("__n")), "left")
    return met.withColumn("polarity", F.coalesce("__p", F.when(has(neutral), "neutral").when(has(negative), "negative").otherwise("positive"))).drop("__g", "__n", "__p")


def combined_onset(onsets: DataFrame, key: Sequence[str], source: str, onset: str) -> DataFrame:
    """(key, onset, answered): of each source the earliest of its series' onsets, of the sources the latest; the sources that had one, in order.

    The series of one source spell one thing in several ways; the sources are second opinions, of which the weaker bound counts.
    """
    own = onsets.groupBy(*key, source).agg(F.min(onset).alias("__o"))
    return own.groupBy(*key).agg(F.max("__o").alias("onset"), F.array_sort(F.collect_list(F.when(F.col("__o").isNotNull(), F.col(source)))).alias("answered"))


LEVELS = ("line", "listing", "variant")


def identity_relation(a: Column, b: Column) -> Column:
    """How two products relate; structs of (level, source, product_id, variant_key, variant_keys, attributes), attributes a map.

    Attributes that both have and that differ make them distinct, whatever their keys say. Without one source's own key
    they are unresolved: containment is no equality, and nothing is one across sites. An input without a level, a source or a
    key, or a variant without its option, is ``invalid``.
    """
    bad = lambda x: ~F.coalesce(x["level"].isin(*LEVELS), F.lit(False)) | (F.coalesce(x["source"], F.lit("")) == "") | (F.coalesce(x["product_id"], F.lit("")) == "") | ((x["level"] == "variant") & (F.coalesce(x["variant_key"], F.lit("")) == ""))
    of = lambda x: F.coalesce(x["attributes"], F.create_map().cast("map<string,string>"))
    differ = F.exists(F.map_values(F.map_zip_with(of(a), of(b), lambda k, x, y: F.coalesce(x != y, F.lit(False)))), lambda d: d)
    listing, variant = F.when(a["level"] == "listing", a).otherwise(b), F.when(a["level"] == "listing", b).otherwise(a)
    holds = (listing["level"] == "listing") & (variant["level"] == "variant") & F.coalesce(F.array_contains(listing["variant_keys"], variant["variant_key"]), F.lit(False))
    return (
        F.when(bad(a) | bad(b), "invalid").when(differ, "distinct").when((a["source"] != b["source"]) | (a["product_id"] != b["product_id"]), "unresolved")
        .when((a["level"] == b["level"]) & (a["level"] == "variant"), F.when(a["variant_key"] == b["variant_key"], "same_variant").otherwise("distinct"))
        .when(a["level"] == b["level"], F.concat(F.lit("same_"), a["level"])).when(holds, "listing_contains_variant").otherwise("unresolved")
    )


# --- gates and plans --------------------------------------------------------------------------------------------------


class GateClosed(RuntimeError):
    """The reason why a chain may not run."""


def live_gate(snapshots: DataFrame, lineage: str, part: str) -> int:
    """The id of the one active snapshot (snapshot_id, active, lineage, text_parts), if it is of the live lineage and its texts have a part; else GateClosed with the reason."""
    found = snapshots.where("active").orderBy("snapshot_id").limit(2).collect()
    if not found:
        raise GateClosed("no active snapshot: there is nothing to read")
    if len(found) > 1:
        raise GateClosed("more than one active snapshot")
    row = found[0]
    if row["lineage"] != lineage:
        raise GateClosed(f"the active snapshot {row['snapshot_id']} is of lineage {row['lineage']!r}, not {lineage!r}: an archive is read, never made anew")
    if part not in (row["text_parts"] or []):
        raise GateClosed(f"the texts of snapshot {row['snapshot_id']} have no {part!r}")
    return row["snapshot_id"]


def rematch(units: DataFrame, key: str, stored: DataFrame, stamp: str) -> DataFrame:
    """The units that a pass has to match: all of them if any stored one was matched under another ``stamp`` (of the dictionary and the matcher), else those not stored.

    ``stored`` are (key, stamp). One plan for both cases, decided by the data: units of another stamp are not done, and if there is any, none is.
    """
    done = stored.where(F.col("stamp") == stamp).select(key)
    old = stored.where(~F.col("stamp").eqNullSafe(F.lit(stamp))).agg((F.count("*") > 0).alias("__changed"))
    return units.join(done.distinct().withColumn("__done", F.lit(True)), key, "left").crossJoin(F.broadcast(old)).where(F.col("__changed") | F.col("__done").isNull()).drop("__done", "__changed")


def meets(metric: Column, threshold: str) -> Column:
    """Whether a metric, rounded half to even to the threshold's places, reaches it."""
    places = len(threshold.partition(".")[2])
    return F.bround(metric.cast(f"decimal(30,{places + 12})"), places) >= F.lit(threshold).cast(f"decimal(30,{places})")


def present(spark: SparkSession, path: str) -> bool:
    """Whether a table's folder or file is there; an arm over a missing one is left out."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def union_present(spark: SparkSession, paths: Mapping[str, str], schema: str) -> DataFrame:
    """The rows of all tables that exist, with ``arm``, in one schema; columns that a table lacks are null."""
    out = spark.createDataFrame([], f"{schema}, arm string")
    for arm, path in paths.items():
        if present(spark, path):
            out = out.unionByName(spark.read.schema(schema).parquet(path).withColumn("arm", F.lit(arm)))
    return out
