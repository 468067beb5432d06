"""Log-rank comparison of groups.

Groups are columns of a per-time table, so a time at which a group has no row still
sees that group's risk set, and the whole test is one running sum and one aggregate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions.numbers import chi2_sf
from sojourn.operators.running import choose_blocks, running_totals


def _per_time(df: DataFrame, group: str, levels, blocks: int | None) -> DataFrame:
    known = df.filter(F.col("time").isNotNull() & F.col("event").isNotNull() & F.col(group).isin(*levels))
    aggs = []
    for i, level in enumerate(levels):
        here = F.col(group) == level
        aggs += [F.count_if(here).alias(f"c{i}"), F.count_if(here & (F.col("event") == 1)).alias(f"d{i}")]
    counted, blocks = choose_blocks(known.groupBy("time").agg(*aggs), blocks)
    per_time = running_totals(
        counted, "time",
        {f"n{i}": f"c{i}" for i in range(len(levels))}, descending=True, blocks=blocks,
    )
    return per_time.withColumns({
        "d": sum((F.col(f"d{i}") for i in range(len(levels))), F.lit(0)),
        "n": sum((F.col(f"n{i}") for i in range(len(levels))), F.lit(0)),
    })


def _variance(i: int, j: int):
    n, d = F.col("n").cast("double"), F.col("d").cast("double")
    share = F.lit(1.0 if i == j else 0.0) - F.col(f"n{j}") / n
    return F.coalesce(F.sum(F.when(n > 1, d * (n - d) / (n - 1) * F.col(f"n{i}") / n * share)), F.lit(0.0))


def logrank_table(df: DataFrame, group: str, levels, blocks: int | None = None) -> DataFrame:
    """Persons, observed and expected events per group; ``n`` is NULL for a group without
    persons. Rows outside the listed levels are not part of the test."""
    levels = list(levels)
    times = _per_time(df, group, levels, blocks)
    aggs = []
    for i in range(len(levels)):
        aggs += [
            F.coalesce(F.sum(f"d{i}"), F.lit(0)).alias(f"o{i}"),
            F.coalesce(F.sum(F.col("d") * F.col(f"n{i}") / F.col("n")), F.lit(0.0)).alias(f"e{i}"),
            _variance(i, i).alias(f"v{i}"),
        ]
        aggs.append(F.nullif(F.sum(f"c{i}"), F.lit(0)).alias(f"p{i}"))
    rows = F.array(*[
        F.struct(F.lit(level).alias(group), F.col(f"p{i}").alias("n"), F.col(f"o{i}").alias("observed"), F.col(f"e{i}").alias("expected"),
                 F.col(f"v{i}").alias("variance"))
        for i, level in enumerate(levels)
    ])
    return times.agg(*aggs).select(F.inline(rows))


def logrank_test(df: DataFrame, group: str, levels, blocks: int | None = None) -> DataFrame:
    """Chi-square, degrees of freedom and p.

    Two groups stay one lazy plan. For more, the k x k variance is collected and
    inverted; its size depends on the number of groups only.
    """
    levels = list(levels)
    if len(levels) == 2:
        table = _per_time(df, group, levels, blocks).agg(
            (F.sum("d0") - F.sum(F.col("d") * F.col("n0") / F.col("n"))).alias("diff"), _variance(0, 0).alias("v")
        )
        stat = F.when(F.col("v") > 0, F.col("diff") * F.col("diff") / F.col("v"))
        out = table.select(stat.alias("chisq"), F.lit(1).alias("df"))
        return out.withColumn("p", chi2_sf("chisq", "df"))
    k = len(levels) - 1
    aggs = [(F.sum(f"d{i}") - F.sum(F.col("d") * F.col(f"n{i}") / F.col("n"))).alias(f"u{i}") for i in range(k)]
    aggs += [_variance(i, j).alias(f"v{i}_{j}") for i in range(k) for j in range(i, k)]
    row = _per_time(df, group, levels, blocks).agg(*aggs).first()
    u = np.array([row[f"u{i}"] or 0.0 for i in range(k)])
    v = np.array([[row[f"v{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    stat = float(u @ np.linalg.pinv(v) @ u)
    out = df.sparkSession.createDataFrame([(stat, k)], "chisq double, df int")
    return out.withColumn("p", chi2_sf("chisq", "df"))
