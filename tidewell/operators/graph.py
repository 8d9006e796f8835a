"""Graphs: connected components and layers of any size, and feedback edges of small tables of pipeline steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node that it is connected with.

    Each round links every node to the least one among its neighbours' links; rounds grow with the logarithm of the
    longest chain, and each is written to the shared folder.
    """
    links = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # a node and all its neighbours are linked to the least of them
        step = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = written(step.where("a > b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now


def layers(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, layer): the longest path from a node without incoming edges, of any length. Raises on a cycle.

    Each round takes off the edges from nodes that no edge is left to. A node's layer is the last round in which an edge
    to it went, so rounds are as many as layers, and what is left without such a node has a cycle.
    """
    every = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "layer-edges")
    left, ended, layer = every, [every.select(F.col("a").alias("node"), F.lit(0).alias("layer"))], 0
    while True:
        first = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        marked = written(left.join(first.withColumn("gone", F.lit(True)), "a", "left").select("a", "b", F.coalesce("gone", F.lit(False)).alias("gone")), "layer-edges")
        rest, gone = marked.agg(F.count("*"), F.count_if("gone")).first()
        if not rest:
            break
        if not gone:
            raise ValueError("the edges have a cycle")
        layer += 1
        ended.append(marked.where("gone").select(F.col("b").alias("node"), F.lit(layer).alias("layer")))
        left = marked.where("not gone").drop("gone")
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out.groupBy("node").agg(F.max("layer").alias("layer"))


def feedback_table(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, feedback) of a small graph's edges: those that close a cycle in a depth-first walk in the order of names."""
    rows = sorted({(r[0], r[1]) for r in edges.select(a, b).distinct().collect()})
    back = feedback_edges(rows)
    kinds = [edges.schema[c].dataType.simpleString() for c in (a, b)]
    return edges.sparkSession.createDataFrame([(*e, e in back) for e in rows], f"{a} {kinds[0]}, {b} {kinds[1]}, feedback boolean")


def feedback_edges(edges: list[tuple[str, str]]) -> set[tuple[str, str]]:
    """Edges that close a cycle in a depth-first walk taken in the order of names."""
    after: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        after.setdefault(a, []).append(b)
    state: dict[str, int] = {}
    back: set[tuple[str, str]] = set()
    for root in sorted(after):
        if root in state:
            continue
        state[root] = 1
        walk = [(root, iter(after.get(root, ())))]
        while walk:
            node, rest = walk[-1]
            for nxt in rest:
                if state.get(nxt) == 1:
                    back.add((node, nxt))
                elif nxt not in state:
                    state[nxt] = 1
                    walk.append((nxt, iter(after.get(nxt, ()))))
                    break
            else:
                state[node] = 2
                walk.pop()
    return back
