"""Entity resolution: an acceptance rule of names in column expressions, mutual best matches between sites, clusters."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .graph import connected


@dataclass(frozen=True)
class AcceptRule:
    """Words that decide whether two normal names are one product."""

    stop: frozenset[str] = frozenset()  # generic words, which are no evidence
    discriminators: frozenset[str] = frozenset()  # words that tell products apart where only one side has them
    forms: tuple[str, ...] = ()  # formulations; the last one found in a name is its form
    form_map: tuple[tuple[str, str], ...] = ()  # a form and the one it counts as


def literal(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)]).cast("array<string>")


def described(rule: AcceptRule, name: Column) -> Column:
    """What the rule looks at of a normal name: words, significant ones, bigrams of the glued name, numbers and form."""
    words = F.filter(F.split(name, " "), lambda w: w != "")
    tokens = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) | w.rlike("^[0-9]$")))
    glued = F.replace(name, F.lit(" "))
    grams = F.when(F.length(glued) >= 2, F.transform(F.sequence(F.lit(1), F.length(glued) - 1), lambda i: F.substring(glued, i, 2))).otherwise(F.array().cast("array<string>"))
    forms = "|".join(map(re.escape, sorted(rule.forms, key=lambda f: (-len(f), f)))) or "(?!)"
    last = F.try_element_at(F.regexp_extract_all(glued, F.lit(forms), 0), F.lit(-1))
    mapped = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in rule.form_map for x in pair]), last), last) if rule.form_map else last
    return F.struct(
        tokens.alias("tokens"), F.array_except(tokens, literal(rule.stop)).alias("significant"), F.array_distinct(grams).alias("grams"),
        F.array_distinct(F.filter(words, lambda w: w.rlike(r"^[\d.]+$"))).alias("numbers"), F.coalesce(mapped, F.lit("")).alias("form"), glued.alias("glued"),
    )


def accepts(rule: AcceptRule, a: Column, b: Column) -> Column:
    """Equal form, no differing discriminator or number, and Jaccard of significant words >= .5, bigram Dice >= .7, or two shared words with Dice >= .6.

    A struct (accepted, jaccard, dice, shared_tok, shared_sig) of two described names.
    """
    both = lambda c: F.size(F.array_intersect(a[c], b[c]))
    sig, union = both("significant"), F.size(F.array_union(a["significant"], b["significant"]))
    jaccard = F.when(union > 0, sig / union).otherwise(0.0)
    size = F.size(a["grams"]) + F.size(b["grams"])
    dice = F.when(F.least(F.size(a["grams"]), F.size(b["grams"])) > 0, F.bround(2 * both("grams") / size, 3)).otherwise(0.0)
    # a discriminator that both names have by characters does not differ
    one_sided = lambda d: F.array_contains(a["significant"], d) != F.array_contains(b["significant"], d)
    differing = F.exists(literal(rule.discriminators), lambda d: one_sided(d) & (a["glued"].contains(d) != b["glued"].contains(d)))
    numbers = F.array_sort(a["numbers"]) != F.array_sort(b["numbers"])
    near = ((jaccard >= 0.5) & (sig >= 1)) | (dice >= 0.7) | ((sig >= 2) & (dice >= 0.6))
    ok = (a["form"] == b["form"]) & ~differing & ~numbers & near
    return F.struct(ok.alias("accepted"), jaccard.alias("jaccard"), dice.alias("dice"), both("tokens").alias("shared_tok"), sig.alias("shared_sig"))


def candidate_pairs(names: DataFrame, *, least_words: float = 0.5, least_dice: float = 0.6) -> DataFrame:
    """(block, m, n), m and n of different names of a block of which a rule may accept the pair; ``names`` are (block, name, d).

    A pair of Jaccard .5 shares one of the first words of both names, in an order of rising frequency, and one of
    Dice .6 one of their first bigrams. So pairs come of equal words and bigrams, never of a whole block.
    """
    shares = {"significant": least_words, "grams": least_dice / (2 - least_dice)}
    parts = [names.select("block", "name", F.lit(k).alias("kind"), F.explode(f"d.{k}").alias("e"), F.ceil(F.size(f"d.{k}") * (1 - share) + 1e-9).alias("first")) for k, share in shares.items()]
    # n - ceil(share n) + 1 leading elements, which is at most that ceil
    rows = parts[0].unionByName(parts[1]).withColumn("first", F.greatest("first", F.lit(1)))
    counted = rows.join(rows.groupBy("block", "kind", "e").agg(F.count("*").alias("c")), ["block", "kind", "e"])
    place = F.row_number().over(Window.partitionBy("block", "name", "kind").orderBy("c", "e"))
    lead = counted.withColumn("place", place).where("place <= first + 1").select("block", "name", "kind", "e")
    pairs = lead.select("block", "kind", "e", F.col("name").alias("m")).join(lead.select("block", "kind", "e", F.col("name").alias("n")), ["block", "kind", "e"]).where("m != n")
    return pairs.select("block", "m", "n").distinct()


#: Items of a name that meet those of another at a time.
CELL = 1024


def pair_decisions(items: DataFrame, block: str, key: str, name: str, rule: AcceptRule) -> DataFrame:
    """(a, b, accepted, jaccard, dice), a < b: every pair of a block's items. Decided once for each pair of different names."""
    items = items.select(F.col(block).alias("block"), F.col(key).alias("key"), F.coalesce(name, F.lit("")).alias("name"))
    names = items.select("block", "name").distinct().withColumn("d", described(rule, F.col("name")))
    m, n = (names.select("block", F.col("name").alias(x), F.col("d").alias(f"d{x}")) for x in "mn")
    pairs = m.join(n, "block").select("block", "m", "n", accepts(rule, F.col("dm"), F.col("dn")).alias("d"))
    # pairs of items come of the last join alone, in cells of at most CELL items of each name on either side; the left ones meet their decision there
    cell = F.floor((F.row_number().over(Window.partitionBy("block", "name").orderBy("key")) - 1) / CELL)
    dealt = items.where(F.col("block").isNotNull() & F.col("key").isNotNull()).withColumn("cell", cell)
    cells = dealt.groupBy("block", "name", "cell").agg(F.collect_list("key").alias("keys"), F.min("key").alias("least"), F.max("key").alias("most"))
    a, b = (cells.select("block", F.col("name").alias(x), F.col("keys").alias(k), F.col(bound).alias(bound)) for x, k, bound in (("m", "a", "least"), ("n", "b", "most")))
    width = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = a.join(pairs, ["block", "m"]).repartition(width, "block", "n"), b.repartition(width, "block", "n")
    met = left.join(right, ["block", "n"]).where("least < most").select("a", "b", "d")
    return met.select(F.explode("a").alias("a"), "b", "d").select("a", F.explode("b").alias("b"), "d").where("a < b").select("a", "b", "d.accepted", "d.jaccard", "d.dice")


def mutual_best(items: DataFrame, key: str, block: Sequence[str], value: str) -> DataFrame:
    """(a, b, d), a < b: items of a block that are each other's closest by a whole number ``value``, d apart; ties go to the smaller key.

    What is null is the farthest. No pairs of a block: an item's closest is among the least keys of its own value, of the
    next value below and of the next above. A key with several values in a block meets the least keys of each value there.
    """
    block = list(block)
    own = items.select(*block, F.col(key).alias("k"), F.col(value).alias("v")).dropna(subset=[*block, "k"]).distinct()

    def least(rows: DataFrame, by: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by).orderBy("k"))
        return rows.withColumn("place", place).where("place <= 2").groupBy(*by).agg(F.min("k").alias("one"), F.when(F.count("*") > 1, F.max("k")).alias("two"))

    other = lambda g: F.when(g["one"] != F.col("k"), g["one"]).otherwise(g["two"])
    near = lambda g: F.when(other(g).isNotNull(), F.struct(F.abs(F.col("v") - g["v"]).alias("d"), other(g).alias("b")))
    along = Window.partitionBy(*block).orderBy("v")
    groups = least(own.where("v is not null"), [*block, "v"]).select(*block, "v", F.struct("v", "one", "two").alias("g"))
    placed = groups.withColumns({"below": F.lag("g").over(along), "above": F.lead("g").over(along)})
    keyed = own.join(own.groupBy(*block, "k").agg(F.count("v").alias("values")), [*block, "k"])
    once = keyed.where("values <= 1").join(placed, [*block, "v"], "left").select(*block, "k", F.least(*[near(F.col(c)) for c in ("g", "below", "above")]).alias("m"))
    often = keyed.where("values > 1").join(groups.withColumnRenamed("v", "at"), block, "left").groupBy(*block, "k").agg(F.min(near(F.col("g"))).alias("m"))
    # without a number on either side the least other key of the block
    any_ = least(own.select(*block, "k").distinct(), block).withColumn("g", F.struct("one", "two"))
    found = once.unionByName(often).join(any_.select(*block, "g"), block)
    best = found.select(F.col("k").alias("a"), F.col("m").isNull().alias("far"), F.col("m.d").alias("d"), F.coalesce("m.b", other(F.col("g"))).alias("b")).where("b is not null")
    best = best.groupBy("a").agg(F.min(F.struct("far", "d", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.d").alias("d"))
    back = best.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return best.join(back, ["a", "b"]).where("a < b").select("a", "b", "d")


def best_matches(items: DataFrame, block: str, site: str, name: str, rule: AcceptRule) -> DataFrame:
    """(block, site, name, other_site, other_name, shared_tok, shared_sig, dice, mutual): each name's best match on each other site.

    Among the accepted names of a site the one with more shared significant words, then higher Dice, then the
    lesser name is best. Items of one site and name (bundles, sizes) are one. ``mutual`` tells that each is the
    other's best.
    """
    items = items.select(F.col(block).alias("block"), F.col(site).alias("site"), F.coalesce(name, F.lit("")).alias("name")).where("block is not null and site is not null and name != ''").distinct()
    names = items.select("block", "name").distinct().withColumn("d", described(rule, F.col("name")))
    m, n = (names.select("block", F.col("name").alias(x), F.col("d").alias(f"d{x}")) for x in "mn")
    near = candidate_pairs(names).where("m < n").join(m, ["block", "m"]).join(n, ["block", "n"]).select("block", "m", "n", accepts(rule, F.col("dm"), F.col("dn")).alias("x")).where("x.accepted")
    same = names.select("block", F.col("name").alias("m"), F.col("name").alias("n"), accepts(rule, F.col("d"), F.col("d")).alias("x")).where("x.accepted")
    pairs = near.unionByName(near.select("block", F.col("n").alias("m"), F.col("m").alias("n"), "x")).unionByName(same)
    a, b = items.select("block", "site", F.col("name").alias("m")), items.select("block", F.col("site").alias("other_site"), F.col("name").alias("n"))
    met = pairs.join(a, ["block", "m"]).join(b, ["block", "n"]).where("site != other_site")
    first = F.min(F.struct((-F.col("x.shared_sig")).alias("s"), (-F.col("x.dice")).alias("d"), F.col("n"), F.col("x.shared_tok").alias("t"))).alias("f")
    best = met.groupBy("block", "site", F.col("m").alias("name"), "other_site").agg(first)
    best = best.select("block", "site", "name", "other_site", F.col("f.n").alias("other_name"), F.col("f.t").alias("shared_tok"), (-F.col("f.s")).alias("shared_sig"), (-F.col("f.d")).alias("dice"))
    back = best.select("block", F.col("other_site").alias("site"), F.col("other_name").alias("name"), F.col("site").alias("other_site"), F.col("name").alias("other_name"), F.lit(True).alias("mutual"))
    return best.join(back, ["block", "site", "name", "other_site", "other_name"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(False)))


def clusters(items: DataFrame, block: str, key: str, site: str, name: str, rule: AcceptRule) -> DataFrame:
    """(block, key, site, cluster, sites, score): the items that mutual best matches between sites join, over any number of them.

    A cluster is named by its least key; ``sites`` is how many it spans, ``score`` the highest Dice of an item's own
    mutual matches (null without any). Items without a block, a site or a name are clusters of their own.
    """
    best = written(best_matches(items, block, site, name, rule).where("mutual"), "matches")
    node = lambda s, n: F.struct("block", F.col(s).alias("site"), F.col(n).alias("name"))
    roots = connected(best.select(node("site", "name").alias("a"), node("other_site", "other_name").alias("b")))
    own = items.select(F.col(block).alias("block"), F.col(key).alias("key"), F.col(site).alias("site"), F.coalesce(name, F.lit("")).alias("name"))
    score = best.groupBy("block", "site", "name").agg(F.max("dice").alias("score"))
    placed = own.join(roots.select("node.*", "root"), ["block", "site", "name"], "left").join(score, ["block", "site", "name"], "left")
    whole = F.col("block").isNotNull() & F.col("site").isNotNull() & (F.col("name") != "")
    placed = placed.withColumn("root", F.when(whole, F.coalesce("root", F.struct("block", "site", "name")))).withColumn("alone", F.when(~whole, F.col("key")))
    least = placed.groupBy("root", "alone").agg(F.min("key").alias("cluster"), F.count_distinct("site").alias("sites"))
    out = placed.join(least, placed["root"].eqNullSafe(least["root"]) & placed["alone"].eqNullSafe(least["alone"]))
    return out.select(F.col("block").alias(block), F.col("key").alias(key), F.col("site").alias(site), "cluster", "sites", "score")
