"""Connected components of a link table: forests of its parts, then alternating large-star and small-star steps while parts are more than one."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, written

#: Links that one task makes a forest of at most.
PART = 200_000


def _counted(links: DataFrame) -> tuple[DataFrame, int, object]:
    """The links as a written table, their number, and a sum of their hashes, counted while they are written."""
    seen = Observation()
    out = written(links.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "links")
    return out, seen.get["n"], seen.get["h"]


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: links each node's larger neighbours to its least one. Small star: links its smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("m"))
    joined = both.join(least.hint("merge"), both["u"] == least["node"])
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def forest(pairs: Iterable[tuple]) -> list[tuple]:
    """(node, least node of its component) for every node of some links that is not that least one."""
    up: dict = {}

    def root(x):
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for u, v in pairs:
        up.setdefault(u, u)
        up.setdefault(v, v)
        a, b = root(u), root(v)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, r) for x in up if (r := root(x)) != x]


def forests(links: DataFrame, parts: int) -> DataFrame:
    """The links dealt into parts, each as stars around the least node of each of its components: as many components, and no more links."""
    kind = links.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def pairs() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = batch.schema.types
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        found = forest(pairs())
        for a in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[a : a + 10_000], strict=True), kinds, strict=True)], names=["u", "v"])

    return links.select("u", "v").repartition(parts).mapInArrow(run, f"u {kind}, v {kind}")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the least node reachable. Links of a node to itself give nothing.

    Parts of at most PART links become forests in tasks of their own. Where one part holds all links, that is the result.
    Otherwise stars are joined, round by round, each written to the shared folder, until the links fit one part or do
    not change. Counts per key are combined before they are shuffled, and a node with very many links is a skewed join
    key that adaptive execution splits.
    """
    edges, n, _ = _counted(links.select("u", "v").where("u is not null and v is not null and u != v"))
    seen = None
    while True:
        parts = max(1, -(-n // PART))
        before, (edges, n, _) = edges, _counted(forests(edges, parts))
        discard(before)
        if parts == 1:
            break
        before, (edges, n, h) = edges, _counted(_step(_step(edges, True), False))
        discard(before)
        if (n, h) == seen:
            break
        seen = n, h
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
