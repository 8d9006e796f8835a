"""Names of a large dictionary in texts, by an Aho-Corasick automaton.

One automaton reads a text once, whatever the number of names. Its hits, all of them, are then held against the
boundaries, and of those that stand the leftmost and longest are taken, as by one pattern that tries longer names
first. A dictionary larger than ``LIMIT`` bytes goes in parts, one bounded broadcast each, whose hits meet in an
array column before names are taken.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import written

LIMIT = 32 << 20
LEFT, RIGHT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_FOUND = "array<struct<start:int,stop:int,kind:string,canonical:string,strict:boolean>>"
_PLACES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("canonical", pa.string()), ("strict", pa.bool_())]))


def folded(text: str) -> str:
    """Small letters, character by character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


@functools.lru_cache(maxsize=2)
def _automaton(token: str, names: tuple[tuple[str, str, str, bool], ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for name, *told in names:
        out.add_word(name, (len(name), *told))
    out.make_automaton()
    return out


def entries(surfaces: DataFrame) -> DataFrame:
    """(name, kind, canonical, strict) of the names to look for, of ``surfaces`` (surface, canonical, kind, tier, and maybe place).

    A name is its surface in small letters; of its entries the one of the least place counts (without that column the
    least of all). Entities with any entry of tier ``stop`` are never found, those with one of tier ``near`` are strict.
    Null and empty surfaces go; a null tier is a plain one.
    """
    place = [F.col("place")] if "place" in surfaces.columns else []
    s = surfaces.where(F.length("surface") > 0)
    tiers = s.groupBy("canonical").agg(F.max(F.col("tier") == "stop").alias("stop"), F.max(F.col("tier") == "near").alias("strict"))
    s = s.withColumn("name", F.lower("surface"))
    first = s.groupBy("name").agg(F.min(F.struct(*place, "canonical", "kind", "surface")).alias("e")).select("name", "e.*")
    known = first.join(tiers, first["canonical"].eqNullSafe(tiers["canonical"])).where(~F.coalesce(F.col("stop"), F.lit(False)))
    return known.select("name", "kind", first["canonical"], F.coalesce("strict", F.lit(False)).alias("strict"))


def dictionary_hits(rows: DataFrame, text: str, surfaces: DataFrame, product_words: str, left: str = LEFT, right: str = RIGHT, window: int = 25, limit: int = LIMIT) -> DataFrame:
    """``rows`` with hits: an array of (kind, canonical, surface, start, stop, near) of the names in ``text``, in order, whatever the letters' case.

    Of names that overlap the leftmost stands, of those that start together the longest that its boundaries (patterns
    without width before and after it) let stand. ``near`` tells that a product's word stands within ``window``
    characters; a strict entity's name stands only there. Null and empty texts have no hits; texts of any length are
    read whole; every column of ``rows`` is returned.
    """
    spark = rows.sparkSession
    known = written(entries(surfaces), "dictionary")
    size = known.agg(F.sum(F.octet_length("name") + F.coalesce(F.octet_length("canonical"), F.lit(0)) + 32)).first()[0] or 0
    passes = max(1, -(-size // limit))
    out = rows.withColumn("hits", F.array().cast(_FOUND))
    for p in range(passes):
        part = known.where(F.pmod(F.xxhash64("name"), F.lit(passes)) == p).select("name", "kind", "canonical", "strict").collect()
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, tuple(tuple(r) for r in part)))
        out = out.mapInArrow(_finder(held, rows.columns.index(text), left, right, p == passes - 1), T.StructType(out.schema.fields))
        if p < passes - 1:
            out = written(out, "dictionary-hits")

    def told(h: Column) -> Column:
        start = F.greatest(h["start"] - window, F.lit(0))
        near = F.substring(F.col(text), start + 1, h["stop"] + window - start).rlike(product_words)
        said = F.substring(F.col(text), h["start"] + 1, h["stop"] - h["start"])
        return F.struct(h["kind"].alias("kind"), h["canonical"].alias("canonical"), said.alias("surface"), h["start"].alias("start"), h["stop"].alias("stop"), near.alias("near"), h["strict"].alias("strict"))

    named = F.filter(F.transform("hits", told), lambda h: h["near"] | ~h["strict"])
    return out.withColumn("hits", F.transform(named, lambda h: F.struct(*[h[c].alias(c) for c in ("kind", "canonical", "surface", "start", "stop", "near")])))


def _finder(held, at: int, left: str, right: str, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        automaton, before, after = _automaton(*held.value), regex.compile(left), regex.compile(right)
        for batch in batches:
            found = []
            for text, hits in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                hits = [tuple(h.values()) for h in hits]
                if text and len(automaton):
                    for end, (n, *entry) in automaton.iter(folded(text)):
                        if before.match(text, end + 1 - n) and after.match(text, end + 1):
                            hits.append((end + 1 - n, end + 1, *entry))
                found.append([dict(zip(("start", "stop", "kind", "canonical", "strict"), h, strict=True)) for h in (taken(hits) if last else hits)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _PLACES)], names=batch.schema.names)

    return run


def taken(hits: list[tuple]) -> list[tuple]:
    """The leftmost of (start, stop, ...), and the longest of those that start together, without overlap."""
    out, end = [], 0
    for hit in sorted(hits, key=lambda h: (h[0], -h[1])):
        if hit[0] >= end:
            out.append(hit)
            end = hit[1]
    return out
