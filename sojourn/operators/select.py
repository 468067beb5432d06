"""One row per key under an explicit order, and next-row differences.

A row is chosen with ``min`` over a struct whose leading fields are the order,
so every task reduces its rows to one per key before anything is shuffled. A key
that owns a large part of the table therefore costs one row per task, not one
oversized group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def ascending(df: DataFrame, name: str) -> list[Column]:
    """Sort fields for ascending order, NULLs last."""
    return [F.col(name).isNull(), F.col(name)]


def descending(df: DataFrame, name: str) -> list[Column]:
    """Sort fields for descending order, NULLs last (dates and numbers)."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return [F.col(name).isNull(), -F.unix_date(F.col(name))]
    if isinstance(kind, T.NumericType):
        return [F.col(name).isNull(), -F.col(name)]
    raise TypeError(f"descending order needs a date or number, not {kind.simpleString()}")


def order_key(df: DataFrame, order) -> Column:
    """Struct that sorts as ``order``: names, or ``-name`` for descending."""
    fields = []
    for item in order:
        parts = descending(df, item[1:]) if item.startswith("-") else ascending(df, item)
        fields += parts
    return F.struct(*[f.alias(f"o{i}") for i, f in enumerate(fields)])


def first_per_key(df: DataFrame, keys, order, payload=None) -> DataFrame:
    """First row per key in the given total order.

    Each key is reduced map-side; ``order`` must not leave ties between rows
    whose payload differs, or the choice between them falls to payload order.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    payload = [c for c in (payload or df.columns) if c not in keys]
    best = F.min(F.struct(order_key(df, order).alias("o"), F.struct(*payload).alias("p"))).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.p.{c}").alias(c) for c in payload])


def gap_to_next(df: DataFrame, key: str, date: str, name: str = "gap_days") -> DataFrame:
    """Days from each row to the next one of the same key.

    Meant for tables already reduced to a few rows per key (pairs, stays, days).
    """
    w = Window.partitionBy(key).orderBy(F.col(date).asc_nulls_last())
    return df.withColumn(name, F.date_diff(F.lead(date).over(w), F.col(date)))
