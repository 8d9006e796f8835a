"""Launch claims: what registrations, vendor boards, reviews and titles say of the day a product came out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

# Axes, directions and strengths; the least length of a line's key; bracketed parts of a title.
REGISTRATION, BOARD, REVIEW, TITLE = "mfds", "vendor_board", "old_review", "vendor_title_tag"
NOT_BEFORE, NOT_AFTER = "not_before", "not_after"
EXACT, PARTIAL = "exact", "partial"
LEAST_LINE = 4
BRACKETED = r"\[[^\]]*\]|\([^)]*\)|【[^】]*】"
GRAM = 3


def grams(text: Column, size: Column | int = GRAM) -> Column:
    """The distinct substrings of a size; of a shorter text the text itself, of an empty one none."""
    n, size = F.length(text), F.lit(size)
    return F.when(n > size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, size)))).when(n > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, text: str, names: DataFrame, name: str, block: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows, one of each side, where the text contains the name (and both are of one ``block``); empty names are in none.

    No nested loop: a pair meets at one gram of the name, the one that the fewest texts of the block have. Texts are
    names and titles, not documents (those take ``dictionary_hits``). Names shorter than a gram meet substrings of their
    length; texts are cut to the sizes that any name has, in one plan for all.
    """
    side = lambda df, mark: df.select(*block, *[F.col(c).alias(f"{mark}{c}") for c in df.columns])
    whole = lambda df, mark, out: F.struct(*[F.col(f"{mark}{c}").alias(c) for c in df.columns]).alias(out)
    said, own = F.col(f"__t_{text}"), F.col(f"__n_{name}")
    size = F.least(F.length(own), F.lit(GRAM))
    n = side(names, "__n_").where(size > 0)
    mine = n.withColumn("__g", F.explode(grams(own, size)))
    sizes = n.agg(F.collect_set(size).alias("__sizes"))
    of_sizes = F.flatten(F.transform("__sizes", lambda k: F.when(F.length(said) >= k, grams(said, k)).otherwise(F.array().cast("array<string>"))))
    theirs = side(texts, "__t_").crossJoin(F.broadcast(sizes)).withColumn("__g", F.explode(of_sizes)).drop("__sizes")
    count = theirs.groupBy(*block, "__g").agg(F.count("*").alias("__c"))
    met = mine.join(count, [*block, "__g"], "left").withColumn("__c", F.coalesce("__c", F.lit(0)))
    # a name with a gram that no text has is in none; equal rows of names count one by one
    rare = met.groupBy(*n.columns).agg(F.min(F.struct("__c", "__g")).alias("__m"), F.count_distinct("__g").alias("__k"), F.count("*").alias("__rows")).where("__m.__c > 0")
    rare = rare.select(*n.columns, F.col("__m.__g").alias("__g"), F.explode(F.sequence(F.lit(1), (F.col("__rows") / F.col("__k")).cast("int"))).alias("__copy"))
    return theirs.join(rare, [*block, "__g"]).where(said.contains(own)).select(whole(texts, "__t_", "text"), whole(names, "__n_", "name"))


def registration_claims(refs: DataFrame, registrations: DataFrame, brands: DataFrame) -> DataFrame:
    """(product_ref, axis, direction, claimed_on, source_ref, strength): not before the day of a registration of the product's line.

    ``refs`` are (product_ref, brand, line), ``brands`` (brand, key), ``registrations`` (report_seq, item_key, entp_key,
    report_date). A registration is of a brand if its filer's key or a part of its item's is one of the brand's keys; its line
    is the item without these. Equal lines are exact, one inside the other partial; lines of fewer than four characters say nothing.
    """
    keys = brands.where(F.length("key") > 0).select("brand", "key").distinct()
    # what several joins read is written, so that keys are made once and the plan stays small
    r = written(registrations.select("report_seq", "item_key", "entp_key", "report_date"), "registrations")
    named = contained(r, "item_key", keys, "key").select("text.report_seq", "name.brand")
    filed = r.join(keys, F.col("entp_key") == F.col("key")).select("report_seq", "brand")
    spelled = keys.groupBy("brand").agg(F.collect_set("key").alias("keys"))
    first = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    item = F.aggregate(F.array_sort("keys", first), F.col("item_key"), lambda s, k: F.replace(s, k, F.lit("")))
    lines = named.unionByName(filed).distinct().join(r, "report_seq").join(spelled, "brand").select("brand", "report_seq", "report_date", item.alias("registered")).where(F.length("registered") >= LEAST_LINE)
    lines = written(lines, "lines")
    own = written(refs.where(F.length("line") >= LEAST_LINE).select("brand", "product_ref", "line"), "lines")
    inside = contained(lines, "registered", own, "line", ["brand"]).select("name.product_ref", "text.report_seq", "text.report_date", F.when(F.col("text.registered") == F.col("name.line"), EXACT).otherwise(PARTIAL).alias("strength"))
    around = contained(own, "line", lines, "registered", ["brand"]).where(F.col("text.line") != F.col("name.registered")).select("text.product_ref", "name.report_seq", "name.report_date", F.lit(PARTIAL).alias("strength"))
    both = inside.unionByName(around)
    return both.select("product_ref", F.lit(REGISTRATION).alias("axis"), F.lit(NOT_BEFORE).alias("direction"), F.col("report_date").alias("claimed_on"), F.col("report_seq").cast("string").alias("source_ref"), "strength")


def title_tag(title: Column, tags: Sequence[str]) -> Column:
    """The tag that a title's first bracketed part with any carries, the first by the order of ``tags``; null without one. Latin tags are whole words, in any case."""
    pattern = {t: (rf"(?i)\b\Q{t}\E\b" if t.isascii() else rf"\Q{t}\E") for t in tags}
    segments = F.regexp_extract_all(title, F.lit(BRACKETED), 0)
    found = F.transform(segments, lambda s: F.coalesce(*[F.when(s.rlike(p), F.lit(t)) for t, p in pattern.items()], F.lit(None).cast("string")))
    return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(1))


def site_claims(members: DataFrame, seen: DataFrame, axis: str, day: str, note: Column | None = None, least: bool = True) -> DataFrame:
    """The upper bounds of an axis: not after the first ``day`` of each listing (source, product_key) that is a member of a product.

    ``members`` are (source, product_key, product_ref, primary): the listing that a product was named by is the product, others were linked to it.
    """
    told = seen if note is None else seen.withColumn("note", note).where("note is not null")
    first = told.where(F.col(day).isNotNull()).groupBy("source", "product_key").agg(F.min(day).alias("claimed_on"), *([F.min("note").alias("note")] if note is not None else []))
    out = first.join(members.select("source", "product_key", "product_ref", "primary"), ["source", "product_key"])
    extra = F.col("note") if note is not None else F.lit(None).cast("string")
    return out.select(
        "product_ref", F.lit(axis).alias("axis"), F.lit(NOT_AFTER).alias("direction"), "claimed_on", F.concat_ws(":", "source", "product_key").alias("source_ref"),
        F.when(F.col("primary"), EXACT).otherwise(PARTIAL).alias("strength"), extra.alias("note"),
    )


def claims(refs: DataFrame, members: DataFrame, registrations: DataFrame, brands: DataFrame, boards: DataFrame, reviews: DataFrame, titles: DataFrame, tags: Sequence[str]) -> DataFrame:
    """All claims of a run. A product that no listing is a member of has none, so what a re-link vacated is withdrawn.

    ``boards`` are (source, product_key, captured_on), ``reviews`` (..., written_on), ``titles`` (..., title, first_seen_on, captured_on): of a listing's titles the last captured counts.
    """
    live = refs.join(members.select("product_ref").distinct(), "product_ref", "left_semi")
    now = titles.groupBy("source", "product_key").agg(F.max(F.struct("captured_on", "title", "first_seen_on")).alias("t")).select("source", "product_key", "t.*")
    parts = [
        registration_claims(live, registrations, brands).withColumn("note", F.lit(None).cast("string")),
        site_claims(members, boards, BOARD, "captured_on"),
        site_claims(members, reviews, REVIEW, "written_on"),
        site_claims(members, now, TITLE, "first_seen_on", title_tag(F.col("title"), tags)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def claim_bounds(found: DataFrame) -> DataFrame:
    """(product_ref, axis, lower, upper) of claims that bound a launch; titles' are kept for people and bound nothing."""
    b = found.where(F.col("axis") != TITLE)
    return b.select("product_ref", "axis", F.when(F.col("direction") == NOT_BEFORE, F.col("claimed_on")).alias("lower"), F.when(F.col("direction") == NOT_AFTER, F.col("claimed_on")).alias("upper"), "strength")
