"""A row query built from plain parts, as an HTTP front end would pass them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def predicate(column: str, op: str, value) -> Column:
    """``eq neq gt gte lt lte in like ilike is`` on one column; ``is`` takes null, true or false."""
    c = F.col(column)
    if op == "in":
        return c.isin(*value)
    if op == "is":
        return c.isNull() if value is None else c.eqNullSafe(F.lit(bool(value)))
    if op in ("like", "ilike"):
        return c.like(value) if op == "like" else c.ilike(value)
    table = {"eq": c == F.lit(value), "neq": c != F.lit(value), "gt": c > F.lit(value), "gte": c >= F.lit(value), "lt": c < F.lit(value), "lte": c <= F.lit(value)}
    if op not in table:
        raise ValueError(f"unknown operator {op!r}")
    return table[op]


def select_rows(df: DataFrame, columns: Sequence[str], filters: Sequence[tuple] = (), order: Sequence[tuple[str, str]] = (), limit: int | None = None, offset: int = 0, allow_empty: Sequence[str] = ()) -> DataFrame:
    """Columns, filters, order (nulls last), limit and offset. An empty string is no filter but for columns in ``allow_empty``."""
    for column, op, value in filters:
        if value == "" and column not in allow_empty:
            continue
        df = df.where(predicate(column, op, value))
    if order:
        df = df.orderBy(*[F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in order])
    if offset:
        df = df.offset(offset)
    return (df if limit is None else df.limit(limit)).select(*columns)


def page_rows(df: DataFrame, columns: Sequence[str], filters: Sequence[tuple], order: Sequence[tuple[str, str]], limit: int, offset: int = 0) -> DataFrame:
    """One page of ``select_rows``, with next_offset: where the next page begins, null on the last one. The order must be of unique rows, so that pages neither overlap nor leave gaps."""
    here = select_rows(df, columns, filters, order, limit, offset)
    more = select_rows(df, columns, filters, order, 1, offset + limit).agg((F.count("*") > 0).alias("__more"))
    return here.crossJoin(F.broadcast(more)).select(*columns, F.when(F.col("__more"), F.lit(offset + limit)).cast("long").alias("next_offset"))
