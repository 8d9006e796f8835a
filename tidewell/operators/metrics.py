"""Aggregations of needs, wishes, rankings, prices, launches, comparisons and evaluations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def need_metrics(mentions: DataFrame, axes: Sequence[Sequence[str]], marks: Sequence[str]) -> DataFrame:
    """Counts of mentions (scope, need_key, polarity 'neg' or 'pos', strength, ref and the axis columns) over each axis.

    An axis is a list of columns besides scope and need_key; ``marks`` names every axis column, '' where it is not
    part of the row's axis. All axes come from one pass over GROUPING SETS.
    """
    sets = ", ".join("(" + ", ".join(["scope", "need_key", *axis]) + ")" for axis in axes)
    keys = ", ".join(["scope", "need_key", *marks])
    columns = ", ".join(f"IF(grouping({m}) = 1, '', CAST({m} AS STRING)) AS {m}" for m in marks)
    return mentions.sparkSession.sql(
        f"SELECT scope, need_key, {columns}, count_if(polarity = 'neg') AS neg, count_if(polarity = 'pos') AS pos, avg(IF(polarity = 'neg', strength, NULL)) AS strength_mean, "
        f"count(DISTINCT IF(polarity = 'neg', ref, NULL)) AS neg_refs, count_if(polarity = 'neg' AND strength >= 0.06) AS strong FROM {{m}} GROUP BY {keys} GROUPING SETS ({sets})",
        m=mentions,
    ).withColumns({"unresolved": ratio(F.col("neg"), F.col("neg") + F.col("pos")), "strong_share": ratio(F.col("strong"), F.col("neg"))})


def denominators(items: DataFrame, key: Sequence[str], rating: str, low_at: float, complete_below: int) -> DataFrame:
    """Low ratings of each key, and whether all of them were collected: fewer than a cap, or a row above the low ones was reached."""
    low = F.count_if(F.col(rating) <= low_at)
    return items.groupBy(*key).agg(low.alias("low"), F.count("*").alias("n"), ((low < complete_below) | F.bool_or(F.col(rating) > low_at + 1)).alias("complete"))


def consensus(value: str) -> Column:
    """The single distinct value of a group, else null."""
    return F.when(F.count_distinct(value) == 1, F.max(value))


def rank_daily(snapshots: DataFrame, board: Sequence[str], product: str, at: str, day: Column, rank: str, price: str) -> DataFrame:
    """Per board, product and day: how many of the board's captures had the product, its mean, best and worst rank, and most frequent price (the lowest of several)."""
    s = snapshots.withColumn("day", day)
    captures = s.groupBy(*board, "day").agg(F.count_distinct(at).alias("captures"))
    own = s.groupBy(*board, product, "day").agg(F.count_distinct(at).alias("seen"), F.avg(rank).alias("mean_rank"), F.min(rank).alias("best"), F.max(rank).alias("worst"), F.mode(price, True).alias("price"))
    return own.join(captures, [*board, "day"]).withColumn("presence", ratio(F.col("seen"), F.col("captures")))


def launch_interval(claims: DataFrame, product: str, axis: str, lower: str, upper: str) -> DataFrame:
    """Bounds from claims of several axes: each axis gives its least lower bound, of which the greatest counts; the least upper bound of all."""
    per_axis = claims.groupBy(product, axis).agg(F.min(lower).alias("__l"), F.min(upper).alias("__u"), F.count("*").alias("__n"))
    return per_axis.groupBy(product).agg(F.max("__l").alias("lower"), F.min("__u").alias("upper"), F.count("*").alias("axes"), F.sum("__n").alias("claims"), F.min_by(axis, F.struct("__u", axis)).alias("upper_axis"))


def launch_verdict(lower: Column, upper: Column, reference: Column) -> Column:
    """How far a launch lies before a reference day: ordered windows of 3, 6 and 12 months on its bounds."""
    since = lambda months: F.add_months(reference, -months)
    return (
        F.when(lower.isNull() & upper.isNull(), "unknown").when(lower > upper, "conflict").when(lower >= since(3), "new").when(lower >= since(6), "recent").when(upper < since(12), "established")
        .when(lower.isNull(), "not_after").otherwise("within_year")
    )


def confusion(pairs: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Support, predictions, hits, precision and recall of each label, within ``by``."""
    both = pairs.select(*by, F.explode(F.array_distinct(F.array(gold, predicted))).alias("label"), gold, predicted)
    counts = both.groupBy(*by, "label").agg(F.count_if(F.col(gold) == F.col("label")).alias("support"), F.count_if(F.col(predicted) == F.col("label")).alias("predicted"), F.count_if((F.col(gold) == F.col("label")) & (F.col(predicted) == F.col("label"))).alias("hit"))
    return counts.withColumns({"precision": ratio(F.col("hit"), F.col("predicted")), "recall": ratio(F.col("hit"), F.col("support"))})


def positive_rate(choices: DataFrame, product: str, option: str, at: str, share: str, positive: Column) -> DataFrame:
    """Share of positive choices of each product, from the newest row of each option."""
    newest = choices.groupBy(product, option).agg(F.max_by(F.struct(share, positive.alias("__p")), F.struct(at, share)).alias("r")).select(product, F.col(f"r.{share}").alias("__s"), F.col("r.__p").alias("__p"))
    return newest.groupBy(product).agg(ratio(F.sum(F.when(F.col("__p"), F.col("__s")).otherwise(0)), F.sum("__s")).alias("positive_rate"))


def standardised(arm: DataFrame, weights: DataFrame, stratum: str, hits: str, total: str) -> DataFrame:
    """Direct standardisation: the arm's rates in each stratum, weighted by another population's mix."""
    w = weights.withColumn("__w", F.col(total) / F.sum(total).over(Window.partitionBy())).select(stratum, "__w")
    return arm.join(F.broadcast(w), stratum).agg(F.sum(F.col("__w") * ratio(F.col(hits), F.col(total))).alias("rate"))


def lift(tokens: DataFrame, doc: str, token: str, topical: str, least_df: int, least_lift: float) -> DataFrame:
    """Tokens whose document share in the topical part is ``least_lift`` times that in the rest or more, with one document added to the latter."""
    sizes = tokens.groupBy(topical).agg(F.count_distinct(doc).alias("n"))
    pivot = sizes.agg(F.max(F.when(F.col(topical), F.col("n"))).alias("__t"), F.max(F.when(~F.col(topical), F.col("n"))).alias("__c"))
    df = tokens.select(doc, token, topical).distinct().groupBy(token).agg(F.count_if(topical).alias("df"), F.count_if(~F.col(topical)).alias("control"))
    value = (F.col("df") / F.col("__t")) / (F.greatest(F.col("control"), F.lit(1)) / F.col("__c"))
    return df.crossJoin(F.broadcast(pivot)).select(token, "df", "control", value.alias("lift")).where((F.col("df") >= least_df) & (F.col("lift") >= least_lift))
