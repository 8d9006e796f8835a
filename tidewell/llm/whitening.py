"""Embedding whitening by TSQR: exact sums, a QR factor for each partition, a tree of merges, and the SVD of the last factor.

An entry c becomes the whole number ``floor(1024 c) + 100000``, so sums are exact and rows are centred without error:
``n x - S`` is a whole number. Each task reduces its centred rows to one upper triangle R, at most d rows whatever the
number of rows; triangles meet ``FAN`` at a time, in tasks of their own, until one is left. Its right singular vectors
are the components, and its singular values scale them. No covariance is formed on the way, so small components keep
their digits.

The vectors are read three times (sums, triangles, projections). What reaches the driver is bounded by the width d of
a vector alone: d sums, and d x d numbers of the last triangle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, table, written

SCALE, SHIFT = 1024, 100_000
#: Entries beyond this are no numbers for this operator: doubles above it have no exact neighbours as longs.
LARGEST = 2.0**52
FAN = 8
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # (d, k): unit eigenvectors, the largest first
    scales: np.ndarray  # (k,): roots of their eigenvalues
    explained: np.ndarray  # (k,): eigenvalue over the trace


def whole_rows(column, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x) of the rows of a list column that count, by width: not null, with finite entries alone, of ``width`` entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    lengths, first = np.diff(offsets), offsets[:-1]
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries are nan
    for d in np.unique(lengths).tolist() if width is None else [width]:
        at = np.flatnonzero(lengths == d) if d else []
        for a in range(0, len(at), ROWS):
            some = at[a : a + ROWS]
            with np.errstate(all="ignore"):
                x = np.floor(values[first[some][:, None] + np.arange(d)] * SCALE)
                good = (np.abs(x) <= LARGEST).all(axis=1)  # false of nan
            yield some[good], x[good].astype(np.int64) + SHIFT


def exact_sum(x: np.ndarray) -> list[int]:
    """Sums of columns, in halves so that none overflows."""
    high = x >> 32
    return [(int(a) << 32) + int(b) for a, b in zip(high.sum(axis=0), (x - (high << 32)).sum(axis=0), strict=True)]


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n x - S``, exact: 64-bit numbers where they hold it, else Python's."""
    if len(x) and n * int(np.abs(x).max()) + max(map(abs, sums)) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def deviations(c: np.ndarray) -> list[int | None]:
    """Sums of squares of rows of ``n x - S``; null where a long can't hold one."""
    if c.dtype == object or len(c) and c.shape[1] * int(np.abs(c).max()) ** 2 >= 1 << 62:
        return [s if s < 1 << 63 else None for s in (c.astype(object) ** 2).sum(axis=1).tolist()]
    return (c * c).sum(axis=1).tolist()


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def totals(vectors: DataFrame, column: str) -> tuple[int, tuple[int, ...]]:
    """The number of vectors of the most common width (of equal ones the larger), and their sums; (0, ()) without any."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in whole_rows(batch.column(0)):
                if len(x):
                    own = held.setdefault(x.shape[1], [0, [0] * x.shape[1]])
                    own[0] += len(x)
                    own[1] = [a + b for a, b in zip(own[1], exact_sum(x), strict=True)]
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([[str(s) for s in sums] for _, sums in held.values()], pa.list_(pa.string()))],
                names=["width", "n", "sums"],
            )

    parts = written(vectors.select(column).mapInArrow(partial, "width int, n long, sums array<string>"), "vector-sums")
    # width 0 has no entry to sum and never gets here
    top = parts.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if top is None:
        discard(parts)
        return 0, ()
    own = parts.where(F.col("width") == top["width"]).select(F.posexplode("sums").alias("i", "s"))
    sums = own.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    discard(parts)
    return int(top["n"]), tuple(int(r["s"]) for r in sorted(sums))


def last_triangle(vectors: DataFrame, column: str, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """R of the centred vectors ``x - S/n`` of all partitions, merged by a tree."""
    d = len(sums)

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, seen = np.zeros((0, d)), False
        for batch in batches:
            for _, x in whole_rows(batch.column(1), d):
                if len(x):
                    r, seen, part = triangle(np.vstack([r, centred(x, n, sums).astype(np.float64) / n])), True, batch.column(0)[0].as_py()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["place", "r"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        r = triangle(np.vstack([np.frombuffer(b).reshape(-1, d) for b in group["r"]]))
        return pd.DataFrame({"place": [int(group["place"].iloc[0]) // FAN], "r": [r.tobytes()]})

    parts = written(vectors.select(F.spark_partition_id().cast("long").alias("part"), column).mapInArrow(leaf, "place long, r binary"), "vector-triangles")
    top = parts.agg(F.max("place")).first()[0]
    level = parts
    while top > 0:
        level = level.groupBy(F.floor(F.col("place") / FAN).alias("g")).applyInPandas(merge, "place long, r binary")
        top //= FAN
    (row,) = level.collect()
    discard(parts)
    return np.frombuffer(row["r"]).reshape(-1, d)


def fitted(vectors: DataFrame, column: str = "embedding", k: int = 8) -> Whitening:
    """The whitening of at most ``k`` components. One whose variance is zero to double precision is left out: it has no scale."""
    n, sums = totals(vectors, column)
    if not n:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    _, s, vt = np.linalg.svd(last_triangle(vectors, column, n, sums), full_matrices=False)
    kept = min(k, int((s > s[0] * len(sums) * np.finfo(float).eps).sum()))
    v = vt[:kept].T
    if kept:
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(kept)])
    return Whitening(n, sums, v, s[:kept] / np.sqrt(n), s[:kept] ** 2 / max((s**2).sum(), np.finfo(float).tiny))


def whitened(vectors: DataFrame, key: str, column: str, model: Whitening) -> DataFrame:
    """(key, deviation, w) of each vector that counts; w has a number for each component."""
    held, d = vectors.sparkSession.sparkContext.broadcast(model), len(model.sums)
    plain = vectors.select(F.col(key).alias("vec_id"), F.col(column).alias("__v"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            for at, x in whole_rows(batch.column(1), d):
                c = centred(x, m.n, m.sums)
                w = (c.astype(np.float64) / m.n) @ m.components / m.scales
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(deviations(c), pa.int64()), lists], names=["vec_id", "deviation", "w"])

    return plain.mapInArrow(project, f"vec_id {plain.schema['vec_id'].dataType.simpleString()}, deviation long, w array<double>")


def whitening(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 8) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each vector that counts and each component.

    Null vectors go, and so do those with a null, infinite or NaN entry, or one beyond 2^52 / 1024. The vectors are
    those of the most common width (of equally common ones the larger); others, empty ones too, are no points of that
    space and go. Repeated rows and null or repeated keys count row by row. A deviation beyond what a long holds is
    null. Components without variance have no whitened values: equal vectors, or a single one, give no rows, as an
    empty table does. Equal eigenvalues leave their components free, so only their order by the SVD tells them apart.
    The sign makes the largest entry of a component positive. Columns besides the two named are ignored.
    """
    model = fitted(vectors, column, k)
    table_ = written(whitened(vectors, key, column, model), "whitened")
    kept = len(model.scales)
    error = 0.0
    if kept:
        pairs = [(i, j) for i in range(kept) for j in range(i, kept)]
        # covar_pop keeps running means, so products are of centred numbers
        found = table_.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    rows = table_.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    told = F.element_at(F.array(*[F.lit(float(e)) for e in model.explained] or [F.lit(0.0)]), F.col("at") + 1)
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", told.alias("explained"), F.lit(float(error)).alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))
