"""Connected components of a link table, by alternating stars.

Each round hangs every neighbour of a node on the smallest one it knows. Rounds are
few (logarithmic in practice), each is two aggregates and joins over the links, and links
are written to shared storage between rounds, so a lost executor costs one round at
most. Nothing but a row count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators.work import mark, release, settle


def _signature(links: DataFrame):
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node with a link; ``links`` has u and v, of one ordered type.

    The label is the smallest node of the component. Links of a node to itself and
    repeated links change nothing; an empty table gives an empty one.
    """
    spark = links.sparkSession
    tidy = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before, links = mark(), settle(tidy)
    seen = _signature(links)
    while seen[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")
        )
        after = mark()
        links = settle(small.select("e.u", "e.v").where("u <> v").distinct())
        release(spark, before, after)
        before = after
        now = _signature(links)
        if now == seen:
            break
        seen = now
    tops = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops)
