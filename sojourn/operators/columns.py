"""Projection helpers: tolerant selects, one function over many columns, tags."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_any(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Keep those of ``names`` that exist, in the order asked for."""
    return df.select(*[n for n in names if n in df.columns])


def select_all(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Keep exactly ``names``; a missing one is an error."""
    return df.select(*names)


def across(names: Iterable[str], fn: Callable[[str], Column], name: str = "{}") -> list[Column]:
    """``fn`` applied to each column, for use in ``select`` or ``agg``."""
    return [fn(n).alias(name.format(n)) for n in names]


def add_missing(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add each column only if the table does not have it yet."""
    return df.withColumns({n: e for n, e in exprs.items() if n not in df.columns})


def tag(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({n: F.lit(v) for n, v in constants.items()})
