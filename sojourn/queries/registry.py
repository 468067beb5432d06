"""Registered queries and, beside each, the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIGITS = 6


def query(sql: str | None = None, prelude: str | None = None):
    """Register a function under its own name; ``sql`` reads the prelude's tables."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = f"{prelude}\n{sql}" if prelude else sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column, so that results compare across engines."""
    return df.select(*[
        (F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes
    ])
