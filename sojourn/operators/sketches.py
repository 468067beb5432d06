"""Mergeable sketches: distinct counts and quantiles of a stated error, in bounded memory.

A sketch table has one row per group with the sketch as a binary column. It is built in
one aggregate (each task keeps one sketch per group), can be written, appended to and
read back, and any set of its rows can be united later without the data: distinct
persons of a quarter from sketches per day, quantiles of a table from sketches per part. The
exact forms stay in ``stats.profile.counts`` and ``operators.quantiles``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR = 0.01
RANK_ERROR = 0.01


# --- distinct counts ---------------------------------------------------------------

def log_size(error: float = ERROR) -> int:
    """Smallest exponent whose united sketches have the relative standard error."""
    return min(21, max(4, math.ceil(2 * math.log2(1.04 / error))))


def relative_error(lg: int) -> float:
    return 1.04 / math.sqrt(1 << lg)


def distinct_sketches(df: DataFrame, by, key: str, error: float = ERROR) -> DataFrame:
    """(by…, n_rows, sketch): distinct non-NULL keys per group. A group of NULL keys has an empty sketch."""
    kind = df.schema[key].dataType.simpleString()
    value = F.col(key) if kind in ("int", "bigint", "string", "binary") else F.col(key).cast("string")
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.hll_sketch_agg(value, log_size(error)).alias("sketch"))


def united(sketches: DataFrame, by=()) -> DataFrame:
    """Sketches of coarser groups; ``by`` are columns or expressions over the finer ones."""
    return sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimates(sketches: DataFrame, name: str = "n_ids") -> DataFrame:
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")


# --- quantiles ---------------------------------------------------------------------

def kll_size(rank_error: float = RANK_ERROR) -> int:
    """Sketch parameter whose quantiles are off by at most this share of the ranks, 99 times in 100."""
    return min(65_535, max(8, math.ceil((2.296 / rank_error) ** (1 / 0.9723))))


def quantile_sketches(df: DataFrame, by, value: str = "value", rank_error: float = RANK_ERROR) -> DataFrame:
    """(by…, sketch) over the non-NULL values; a group without any has no row."""
    known = df.where(F.col(value).isNotNull()).withColumn("__x", F.col(value).cast("double"))
    return known.groupBy(*by).agg(F.kll_sketch_agg_double("__x", F.lit(kll_size(rank_error))).alias("sketch"))


def merged(sketches: DataFrame, by=()) -> DataFrame:
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, by, probs: dict[str, float]) -> DataFrame:
    """One row per group with a column for each named probability, and the number of values."""
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()]
    return sketches.select(*by, F.kll_sketch_get_n_double("sketch").alias("n"), *quantiles)
