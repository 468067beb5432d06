"""Exact linear-interpolation quantiles (type 7) from collapsed value counts.

``F.percentile`` keeps every distinct value of a group in one task. Here values are
first collapsed to counts, ranks come from blocked running totals, and picking the
two neighbouring order statistics is an ordinary aggregate, so no group has to fit
in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn.operators.running import BLOCKS, running_totals


def collapse(df: DataFrame, by, value: str = "value") -> DataFrame:
    """Distinct non-NULL values per group with their row counts."""
    return (
        df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    )


def exact_quantiles(
    counts: DataFrame, by, probs: dict[str, float], value: str = "value", blocks: int | None = BLOCKS
) -> DataFrame:
    """One row per group with a column for each named probability.

    For a handful of groups (variables, strata). With many small groups
    ``F.percentile`` in an ordinary aggregate is the better choice. Pass
    ``blocks=None`` when the number of distinct values is bounded, as for days.
    """
    by = list(by)
    ranked = running_totals(counts, value, {"upto": "n"}, by=by, blocks=blocks)
    if not blocks:
        ranked = ranked.withColumn("size", F.sum("n").over(Window.partitionBy(*by)))
    else:
        sizes = counts.groupBy(*by).agg(F.sum("n").alias("size"))
        ranked = ranked.join(sizes, by) if by else ranked.withColumn("size", sizes.scalar())
    aggs, outs = [], []
    for name, p in probs.items():
        h = (F.col("size") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
            aggs.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"__{name}_{side}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"__{name}_f"))
        lo, hi, f = (F.col(f"__{name}_{s}") for s in ("lo", "hi", "f"))
        outs.append((lo + f * (hi - lo)).alias(name))
    return ranked.groupBy(*by).agg(*aggs).select(*by, *outs)


def quantile(df: DataFrame, column: str, p: float, blocks: int | None = BLOCKS) -> DataFrame:
    """One-row, one-column table with a quantile; use ``.scalar()`` to refer to it."""
    counts = collapse(df.select(F.col(column).alias("value")), [])
    return exact_quantiles(counts, [], {"q": p}, blocks=blocks)
