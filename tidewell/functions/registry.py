"""Plug-in surface: protocols of the rule and model stages, and a registry of their implementations by task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Linker(Protocol):
    def link(self, units: DataFrame) -> DataFrame: ...

    def match_products(self, products: DataFrame) -> DataFrame: ...


class Extractor(Protocol):
    def candidates(self, units: DataFrame) -> DataFrame: ...


class Polarity(Protocol):
    version: str

    def classify_many(self, texts: pd.Series) -> pd.Series: ...


class Predictor(Protocol):
    def __call__(self, texts: pd.Series) -> pd.Series: ...


@dataclass(frozen=True)
class Implementation:
    task: str
    name: str
    build: Callable[[], Predictor]
    paid: bool = False


_known: dict[tuple[str, str], Implementation] = {}


def register(task: str, name: str, build: Callable[[], Predictor], paid: bool = False) -> None:
    """``build`` makes the predictor, once on each worker; a name may be registered once."""
    if (task, name) in _known:
        raise ValueError(f"{name!r} is registered for {task!r} already")
    _known[task, name] = Implementation(task, name, build, paid)


def implementation(task: str, name: str) -> Implementation:
    if (task, name) not in _known:
        raise KeyError(f"no {name!r} for {task!r}; there are {sorted(n for t, n in _known if t == task)}")
    return _known[task, name]


def implementations(task: str) -> list[str]:
    return sorted(n for t, n in _known if t == task)


def batch_function(build: Callable[[], Predictor], kind: T.DataType | None = None):
    """A column function over batches: the predictor is made once per task, and must answer in order and in full."""

    @F.pandas_udf(kind or T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = build()
        for batch in batches:
            out = predict(batch)
            if len(out) != len(batch):
                raise ValueError(f"{len(out)} answers to {len(batch)} texts")
            yield pd.Series(list(out))

    return run


def evaluated(task: str, name: str, rows: DataFrame, text: str, gold: str, by: list[str] | None = None) -> DataFrame:
    """(implementation, by, label, support, predicted, hit, precision, recall) of an implementation on labelled rows. Null texts are empty ones."""
    from ..operators.metrics import confusion

    said = batch_function(implementation(task, name).build)(F.coalesce(F.col(text), F.lit("")))
    pairs = rows.select(*(by or []), F.col(gold).alias("gold"), said.alias("said"))
    return confusion(pairs, "gold", "said", by or []).withColumn("implementation", F.lit(name))
