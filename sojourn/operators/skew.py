"""Joins from a large event table to a one-row-per-key table when one key may own
a large share of the events.

A heavy key owns more than one row in ``HEAVY_SHARE``, so there are at most as many
heavy keys whatever the table size, and a key below that is lighter than a partition of
a shuffle that suits the table. They are found by sketching the key column, merged in
two steps, with enough counters that no key above the share is missed. Events of a
heavy key are spread over one salt per ``ROWS_PER_SALT`` events, and only that key's row
on the other side is repeated. All other keys use salt 0. A key whose count is
overestimated still joins correctly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 10_000
# A sketch of c counters is off by at most 3.5 / c of the rows, here under one share.
COUNTERS = 4 * HEAVY_SHARE
ROWS_PER_SALT = 500_000
SKETCH_GROUPS = 256


def hot_keys(events: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Keys with more than ``rows_per_salt`` rows and one row in ``HEAVY_SHARE``, and their
    salt counts."""
    groups = events.select(key, F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"))
    sketches = groups.groupBy("g").agg(F.expr(f"approx_top_k_accumulate({key}, {COUNTERS}) AS s"), F.count("*").alias("n"))
    # Grouped by a constant: merging no sketches at all then gives no row.
    merged = sketches.groupBy(F.lit(0).alias("one")).agg(
        F.expr(f"approx_top_k_combine(s, {COUNTERS}) AS s"), F.sum("n").alias("n")
    )
    found = F.expr(f"filter(approx_top_k_estimate(s, {COUNTERS}), t -> t.count * {HEAVY_SHARE}L > n)")
    top = merged.select(F.explode(found).alias("t"))
    salts = F.ceil(F.col("t.count") / F.lit(rows_per_salt)).cast("int")
    return top.select(F.col("t.item").alias(key), salts.alias("salts")).filter("salts > 1")


def keyed_join(
    events: DataFrame,
    lookup: DataFrame,
    key: str,
    salt_by,
    how: str = "inner",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join events to a table that has one row per key, splitting heavy keys.

    ``salt_by`` names columns that tell a key's events apart. The salt is a hash of
    them and the number of the input partition, which also spreads exact copies; a
    recomputed task assigns the same salts. Filter events before the join: a filter
    above it does not move below the salt. ``how`` is inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    hot = F.broadcast(hot_keys(events, key) if hot is None else hot)
    salt = F.pmod(F.xxhash64(*salt_by, F.spark_partition_id()), F.col("salts"))
    left = events.join(hot, key, "left").withColumn("__salt", F.coalesce(salt, F.lit(0)).cast("int")).drop("salts")
    spread = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))
    right = lookup.join(hot, key, "left").withColumn("__salt", spread).drop("salts")
    return left.join(right, [key, "__salt"], how).drop("__salt")
