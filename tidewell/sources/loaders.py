"""Dictionaries and labelled sets loaded from CSV as versioned rows, and small tables written as CSV or markdown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The tiers of a stop list.
TIERS = {"stop": "stop", "cooc_required": "near"}
BOM = "\ufeff"


def brand_surfaces(brands: DataFrame, stop: DataFrame, dropped: DataFrame) -> DataFrame:
    """(kind, canonical, surface, tier, source, note, place) of a brand lexicon: each row's surface, then its aliases but for dropped ones.

    ``brands`` are (canonical, surface, aliases with ``|`` between, sources, place), ``stop`` (brand, tier, reason), ``dropped``
    (brand, alias, decision). Surfaces come before all aliases, so where an alias repeats a surface the surface is the first.
    """
    tiers = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    listed = stop.groupBy("brand").agg(F.min(F.struct("tier", "reason")).alias("s")).select(F.col("brand").alias("canonical"), F.coalesce(tiers[F.col("s.tier")], F.lit("link")).alias("tier"), F.col("s.reason").alias("note"))
    b = brands.join(listed, "canonical", "left").withColumn("tier", F.coalesce("tier", F.lit("link")))
    own = b.select("canonical", "surface", "tier", "sources", "note", F.struct(F.lit(0).alias("k"), F.col("place").alias("p"), F.lit(0).alias("i")).alias("place"))
    a = b.select("canonical", "tier", "sources", "note", "place", F.posexplode(F.split(F.coalesce("aliases", F.lit("")), r"\|")).alias("i", "surface")).where("surface <> ''")
    a = a.join(dropped.where("decision = 'drop'").select(F.col("brand").alias("canonical"), F.col("alias").alias("surface")).distinct(), ["canonical", "surface"], "left_anti")
    return own.unionByName(a.select("canonical", "surface", "tier", "sources", "note", F.struct(F.lit(1).alias("k"), F.col("place").alias("p"), F.col("i").alias("i")).alias("place"))).select(F.lit("brand").alias("kind"), "canonical", "surface", "tier", F.nullif("sources", F.lit("")).alias("source"), "note", "place")


def fan_out_surfaces(rows: DataFrame, kind: str, canonical: str, spellings: str, place: str) -> DataFrame:
    """(kind, canonical, surface, place) of rows whose spellings stand in one column with ``|`` between; empty ones are none."""
    s = rows.select(F.col(canonical).alias("canonical"), F.col(place).alias("p"), F.posexplode(F.split(F.coalesce(spellings, F.lit("")), r"\|")).alias("i", "surface")).where("surface <> ''")
    return s.select(F.lit(kind).alias("kind"), "canonical", "surface", F.struct(F.col("p"), F.col("i")).alias("place"))


def load_versioned(stored: DataFrame, rows: DataFrame, version: int, key: Sequence[str], place: str) -> DataFrame:
    """``stored`` with ``rows`` under a version: of a key's rows the first by ``place``, and none where the version has the key already, so a load run again adds nothing."""
    told = rows.withColumn("version", F.lit(version)).join(stored.where(F.col("version") == version).select(*key), list(key), "left_anti")
    first = told.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(place))).where("__n = 1")
    return stored.unionByName(first.select(*stored.columns))


def labelled_rows(rows: DataFrame, task: str, ref: str, split: str, gold: str, text: str, extra: Sequence[str] = ()) -> DataFrame:
    """(task, ref, split, gold, text, extra) of a labelled set of any shape: what else it has goes to a map, empty values left out."""
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in extra]
    told = F.map_from_entries(F.filter(F.array(*pairs), lambda p: F.coalesce(p["value"], F.lit("")) != "")) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(F.lit(task).alias("task"), F.col(ref).cast("string").alias("ref"), F.col(split).alias("split"), F.col(gold).cast("string").alias("gold"), F.col(text).alias("text"), told.alias("extra"))


# --- outputs --------------------------------------------------------------------------------------------------------


def csv_lines(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(line) of each row as CSV: a field with a comma, a quote or a line break is quoted, null is empty."""
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    field = [F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in plain]
    return rows.select(F.concat_ws(",", *field).alias("line"))


def csv_text(rows: DataFrame, columns: Sequence[str], most: int = 10_000) -> str:
    """The CSV file of a small table, with the mark that tells a spreadsheet its encoding. A table of more than ``most`` rows is refused: write it with ``rows.write.csv``."""
    lines = [r[0] for r in csv_lines(rows, columns).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"more than {most} rows for one file")
    return BOM + "\n".join([",".join(columns), *lines])


def markdown_text(rows: DataFrame, columns: Sequence[str], most: int = 1_000) -> str:
    """The same as a markdown table."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    found = rows.select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows for one table")
    return "\n".join("| " + " | ".join(line) + " |" for line in [list(columns), ["-"] * len(columns), *[[cell(v) for v in r] for r in found]])


def file_name(screen: str, scope: str | None, ending: str, now: datetime, prefix: str = "needs") -> str:
    """A download's name, by screen, scope and minute."""
    return ".".join([prefix, screen, *([scope] if scope else []), now.strftime("%Y%m%d-%H%M"), ending])


# --- what is kept of a payload's owner ----------------------------------------------------------------------------


def kept_metadata(rows: DataFrame, meta: str, allowed: Mapping[str, str]) -> DataFrame:
    """``rows`` with the allowed keys of a JSON column alone, as columns of the given types; one that is absent or of another type is null. No other key, so no author's, is kept."""
    v = F.try_parse_json(F.col(meta))
    return rows.select(*[c for c in rows.columns if c != meta], *[F.try_variant_get(v, f"$.{k}", kind).alias(k) for k, kind in allowed.items()])
