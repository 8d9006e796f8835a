"""Quarterly topic trends: a dense grid, its metrics, verdicts and evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W


def dense_grid(rows: DataFrame, columns: DataFrame, cells: DataFrame, on: Sequence[str], fill: Mapping[str, object]) -> DataFrame:
    """Every row with every column value, cells joined, absent ones filled. Both axes are distinct values of a dictionary and a calendar."""
    grid = rows.crossJoin(columns).join(cells, list(on), "left")
    return grid.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def entropy(counts: DataFrame, key: Sequence[str], count: str = "n") -> DataFrame:
    """Normalised Shannon entropy (0 for a single part) and the number of parts of each key."""
    total = F.sum(count).over(Window.partitionBy(*key))
    p = counts.where(F.col(count) > 0).withColumn("__p", F.col(count) / total)
    h = F.sum(-F.col("__p") * F.ln("__p"))
    n = F.count("*")
    return p.groupBy(*key).agg(F.when(n <= 1, F.lit(0.0)).otherwise(h / F.ln(n.cast("double"))).alias("entropy"), n.alias("parts"))


def quarter_metrics(counts: DataFrame, panel: DataFrame, channels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of a dense grid ``counts`` (topic, quarter, mentions, raw), or of one for each value of ``by`` (in all three tables).

    ``panel`` has (quarter, channels_total), ``channels`` (topic, quarter, channel, n). Adds composition, its median
    over all quarters (zeros too), trailing quarters above that, breadth, entropy, diffusion and unique_ratio.
    """
    base = W.share("mentions", [*by, "quarter"])
    grid = counts.withColumn("composition", base)
    median = grid.groupBy(*by, "topic").agg(F.median("composition").alias("baseline"))
    e = entropy(channels, [*by, "topic", "quarter"])
    trailing = Window.partitionBy(*by, "topic").orderBy("quarter").rowsBetween(-3, 0)
    out = grid.join(median, [*by, "topic"]).join(e, [*by, "topic", "quarter"], "left").join(panel, [*by, "quarter"], "left")
    breadth = F.coalesce(F.try_divide(F.coalesce("parts", F.lit(0)).cast("double"), F.col("channels_total").cast("double")), F.lit(0.0))
    return out.select(
        *by, "topic", "quarter", "mentions", "composition", "baseline", F.sum((F.col("composition") > F.col("baseline")).cast("int")).over(trailing).alias("above"), F.count("*").over(trailing).alias("window"),
        F.coalesce("entropy", F.lit(0.0)).alias("entropy"), breadth.alias("breadth"), (breadth * 0.5 + F.coalesce("entropy", F.lit(0.0)) * 0.5).alias("diffusion"),
        F.coalesce(F.try_divide(F.col("mentions").cast("double"), F.col("raw").cast("double")), F.lit(1.0)).alias("unique_ratio"), F.coalesce("parts", F.lit(0)).alias("channels"),
    )


def evidence_strength(doc_rank: Column, channel_ratio: Column, unique_ratio: Column) -> Column:
    """Weighted to 100 and rounded to one place."""
    return F.round(43.75 * doc_rank + 31.25 * F.least(F.lit(1.0), channel_ratio) + 25.0 * F.least(F.lit(1.0), unique_ratio), 1)


def judged(metrics: DataFrame, tau: float = 0.35, floor: float = 50.0, new_below: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """Evidence strength and an ordered verdict for each cell of ``quarter_metrics``, of each value of ``by``.

    thin: strength below the floor; new: the three quarters before all lie below ``new_below``; persistent: the whole
    window above the baseline; rising and falling: the share moved by ``tau`` of itself; peak: the greatest share of
    the topic; else steady.
    """
    by_topic = Window.partitionBy(*by, "topic").orderBy("quarter")
    m = metrics.withColumn("strength", evidence_strength(W.mid_rank("mentions", [*by, "quarter"]), F.col("breadth"), F.col("unique_ratio")))
    before = by_topic.rowsBetween(-3, -1)
    m = m.withColumns({
        "previous": F.lag("composition").over(by_topic), "quiet": (F.max("composition").over(before) < new_below) & (F.count("*").over(before) > 0), "peak": F.max("composition").over(Window.partitionBy(*by, "topic")),
    })
    move = F.try_divide(F.col("composition") - F.col("previous"), F.col("previous"))
    verdict = (
        F.when(F.col("strength") < floor, "thin").when(F.coalesce("quiet", F.lit(False)), "new").when((F.col("above") == F.col("window")) & (F.col("window") == 4), "persistent")
        .when(move >= tau, "rising").when(move <= -tau, "falling").when(F.col("composition") == F.col("peak"), "peak").otherwise("steady")
    )
    return m.withColumn("verdict", verdict).drop("quiet", "peak", "previous")


# Quarters looked back at and ahead, and what each verdict expects of what follows.
LOOKBACK = HORIZON = 4
EXPECTED = {"rising": "rise_held", "new": "rise_held", "falling": "fall_held", "peak": "peak_gone"}


def backtest(counts: DataFrame, panel: DataFrame, channels: DataFrame) -> DataFrame:
    """What the verdicts of past quarters were worth: a row for each directional verdict that could have been given.

    Tables are as for ``quarter_metrics``. For each cutoff with LOOKBACK quarters before it and HORIZON after, all
    metrics are made anew of the quarters up to it, with the cutoff as one more key of the same jobs, so that no
    baseline sees what came later, and the quarter before it, the target, is judged. The verdict is then held against
    shares of the whole period, in hundredths: the mean of LOOKBACK quarters up to the target (before_pp), the same
    without the target (before_excl_pp), and the mean of HORIZON quarters after the cutoff (after_pp). ``hit`` asks of a
    rise that the later mean is above the one before, of a fall that it is below, of a peak that it is below the
    target's own share at the cutoff; ``hit_level`` asks the same of before_excl_pp.
    """
    quarters = counts.select("quarter").distinct()
    place = F.row_number().over(Window.orderBy("quarter")) - 1
    calendar = quarters.select("quarter", place.alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    target = F.lag("quarter").over(Window.orderBy("quarter"))
    cuts = calendar.withColumn("target", target).where((F.col("i") >= LOOKBACK) & (F.col("i") + HORIZON < F.col("n"))).select(F.col("quarter").alias("cutoff"), "target")
    upto = lambda df: df.join(F.broadcast(cuts), F.col("quarter") <= F.col("cutoff")).drop("target")
    then = judged(quarter_metrics(upto(counts), upto(panel), upto(channels), ["cutoff"]), by=["cutoff"])
    said = then.join(F.broadcast(cuts), "cutoff").where((F.col("quarter") == F.col("target")) & F.col("verdict").isin(*EXPECTED))
    said = said.select("cutoff", "target", "topic", "verdict", (100 * F.col("composition")).alias("at_cutoff"))
    met = said.join(backtest_means(counts), ["target", "topic"])
    rise, fall, peak = ((F.col("expected") == x) for x in ("rise_held", "fall_held", "peak_gone"))
    table = F.create_map(*[F.lit(x) for pair in EXPECTED.items() for x in pair])
    met = met.withColumn("expected", table[F.col("verdict")])
    hit = lambda base: F.when(rise, F.col("after") > base).when(fall, F.col("after") < base).otherwise(F.col("after") < F.col("at_cutoff"))
    rounded = [F.round(c, 2).alias(f"{c}_pp") for c in ("before", "before_excl", "after", "at_cutoff")]
    return met.select("target", "topic", "verdict", *rounded, "expected", F.when(F.col("after") > F.col("before"), "rose").otherwise("fell").alias("actual"), hit(F.col("before")).alias("hit"), hit(F.col("before_excl")).alias("hit_level"))


def backtest_means(counts: DataFrame) -> DataFrame:
    """(target, topic, before, before_excl, after), in hundredths, of every target that has the quarters for it."""
    of_topic = Window.partitionBy("topic").orderBy("quarter")
    mean = lambda a, b: 100 * F.avg("composition").over(of_topic.rowsBetween(a, b))
    whole = counts.withColumn("composition", W.share("mentions", ["quarter"]))
    told = whole.select("topic", F.col("quarter").alias("target"), F.row_number().over(of_topic).alias("__i"), F.count("*").over(Window.partitionBy("topic")).alias("__n"), mean(1 - LOOKBACK, 0).alias("before"), mean(-LOOKBACK, -1).alias("before_excl"), mean(2, 1 + HORIZON).alias("after"))
    # the cutoff is the quarter after the target
    return told.where((F.col("__i") >= LOOKBACK) & (F.col("__i") + 1 + HORIZON <= F.col("__n"))).drop("__i", "__n")


def backtest_base_rate(counts: DataFrame) -> DataFrame:
    """One row (cells, base_rate, base_level_rate): how often the later mean lies above the one before whatever was said, in hundredths."""
    some = backtest_means(counts).where((F.col("before") != 0) | (F.col("after") != 0))
    share = lambda when: F.coalesce(F.round(100.0 * F.try_divide(F.count_if(when), F.count("*")), 2), F.lit(0.0))
    return some.agg(F.count("*").alias("cells"), share(F.col("after") > F.col("before")).alias("base_rate"), share(F.col("after") > F.col("before_excl")).alias("base_level_rate"))
