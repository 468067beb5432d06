"""Id sets and row appends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(*frames: DataFrame, seq: str | None = None) -> DataFrame:
    """Union-all by name; a column missing from one input is NULL there.

    Columns that share a name must share a type: Spark would widen int and
    string to a common type, which hides mistakes. ``seq`` adds the input's
    position, so "the first input wins" can be stated later as an order.
    """
    seen: dict[str, str] = {}
    for frame in frames:
        for name, kind in frame.dtypes:
            if seen.setdefault(name, kind) != kind:
                raise TypeError(f"column {name} is {seen[name]} in one input and {kind} in another")
    if seq:
        frames = tuple(f.withColumn(seq, F.lit(i)) for i, f in enumerate(frames))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ids(df: DataFrame, key: str = "subject_id") -> DataFrame:
    return df.select(key).distinct()


def any_of(*id_sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), id_sets).distinct()


def keep(df: DataFrame, id_set: DataFrame, key: str = "subject_id") -> DataFrame:
    return df.join(id_set, key, "left_semi")


def drop(df: DataFrame, id_set: DataFrame, key: str = "subject_id") -> DataFrame:
    """Rows whose key is not in the set. A NULL key is in no set, so it stays."""
    return df.join(id_set, key, "left_anti")


def null_safe_join(left: DataFrame, right: DataFrame, on, nullable=(), how: str = "inner") -> DataFrame:
    """Join on columns where NULL equals NULL for those listed in ``nullable``."""
    right = right.select(*[F.col(c).alias(f"__r_{c}" if c in on else c) for c in right.columns])
    condition = reduce(
        lambda a, b: a & b,
        [
            F.col(c).eqNullSafe(F.col(f"__r_{c}")) if c in nullable else F.col(c) == F.col(f"__r_{c}")
            for c in on
        ],
    )
    return left.join(right, condition, how).drop(*[f"__r_{c}" for c in on])
