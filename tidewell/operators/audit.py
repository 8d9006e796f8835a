"""What the keys of an ingredient dictionary really catch: names by key, forbidden ones, and lists that were never split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .launch import contained

# From so many blanks or characters on, a name is a list in one lump.
LUMP_BLANKS, LUMP_CHARS = 5, 120


def closed(text: Column) -> Column:
    """Small letters without blanks: names differ in spacing alone."""
    return F.lower(F.replace(text, F.lit(" "), F.lit("")))


def lump(name: Column, blanks: int = LUMP_BLANKS, chars: int = LUMP_CHARS) -> Column:
    return (F.length(name) - F.length(F.replace(name, F.lit(" "), F.lit(""))) >= blanks) | (F.length(name) >= chars)


def caught(names: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, name): which distinct names of ``names`` (product, name) contain which key's terms (key, term), blanks and case folded."""
    n = names.where("name is not null").select("name").distinct().select("name", closed(F.col("name")).alias("closed"))
    t = terms.where(F.length(closed(F.col("term"))) > 0).select("key", closed(F.col("term")).alias("closed")).distinct()
    return contained(n, "closed", t, "closed").select("name.key", "text.name").distinct()


def audit(names: DataFrame, terms: DataFrame, top: int = 5) -> DataFrame:
    """(key, rows, products, names): how many rows and products a key catches, and its ``top`` names with their counts (ties by name). A key that catches none has zeros."""
    hit = names.join(caught(names, terms), "name")
    total = hit.groupBy("key").agg(F.count("*").alias("rows"), F.count_distinct("product").alias("products"))
    count = hit.groupBy("key", "name").agg(F.count("*").alias("n"))
    best = count.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "name"))).where(F.col("k") <= top)
    listed = best.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name", "n"))), lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias("names"))
    out = terms.select("key").distinct().join(total, "key", "left").join(listed, "key", "left")
    return out.select("key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rows", "products")], F.coalesce("names", F.array().cast("array<struct<name:string,n:bigint>>")).alias("names"))


def denied(names: DataFrame, terms: DataFrame, forbidden: DataFrame, blanks: int = LUMP_BLANKS, chars: int = LUMP_CHARS) -> DataFrame:
    """(key, bad, product): forbidden names (key or null for all keys, bad) among what a key catches.

    Where a proper name has it, it is said of the key, and product is null. Where only lists in one lump have it, nothing says
    that the key caught it, so it is said of each product with such a list.
    """
    hit = caught(names, terms).withColumn("lump", lump(F.col("name"), blanks, chars))
    f = forbidden.where(F.length(closed(F.col("bad"))) > 0).select("bad", F.col("key").alias("of"), closed(F.col("bad")).alias("closed"))
    met = contained(hit.select("key", "name", "lump", closed(F.col("name")).alias("closed")), "closed", f, "closed").select("text.key", "text.name", "text.lump", "name.bad", "name.of").where(F.col("of").isNull() | (F.col("of") == F.col("key")))
    proper = met.where("not lump").select("key", "bad").distinct()
    lumps = met.where("lump").join(proper, ["key", "bad"], "left_anti").join(names, "name").select("key", "bad", F.col("product").cast("string").alias("product")).distinct()
    return proper.select("key", "bad", F.lit(None).cast("string").alias("product")).unionByName(lumps)
