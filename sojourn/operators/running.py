"""Running totals over an ordered, already-collapsed table.

Three forms. With a bounded order column (days within a horizon) a plain window per
group is right: it sees at most one row per day. A handful of groups without such a
bound is cut into blocks at its own quantiles. Any table is cut into blocks by a range
partitioning over (group, order), one block for about ``WINDOW_ROWS`` rows. In the block
forms totals are taken per block, and only block totals are accumulated in one place.
``choose_blocks`` counts the rows and picks between the plain and the range form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators.work import settle

BLOCKS = 256
#: Rows that one window of the plain form may hold, and about as many as a range block holds.
WINDOW_ROWS = 100_000
#: Value of ``blocks`` that asks for the range form.
RANGE = -1


def _over(expr: str, by, order: str, descending: bool, frame: str = "CURRENT ROW"):
    groups = f"PARTITION BY {', '.join(by)} " if by else ""
    way = "DESC" if descending else "ASC"
    return F.expr(f"sum({expr}) OVER ({groups}ORDER BY {order} {way} ROWS BETWEEN UNBOUNDED PRECEDING AND {frame})")


def running_totals(
    df: DataFrame,
    order: str,
    totals: dict[str, str],
    by=(),
    descending: bool = False,
    blocks: int | None = None,
) -> DataFrame:
    """Add inclusive running sums, one per entry of ``totals`` (name: SQL expression).

    ``df`` has one row per (by, order). ``blocks`` selects the block form, which is for
    a handful of groups (variables, strata): it joins per-group bounds and block totals,
    at most ``blocks`` values per group, which Spark broadcasts if their size allows.
    ``RANGE`` selects the range form, for any number of rows and groups.
    """
    by = list(by)
    if blocks == RANGE:
        return _range_totals(df, order, totals, by, descending)
    if not blocks:
        return df.withColumns({name: _over(expr, by, order, descending) for name, expr in totals.items()})

    groups = by or ["__all"]
    if not by:
        df = df.withColumn("__all", F.lit(0))
    df = df.withColumns({f"__v_{name}": F.expr(expr) for name, expr in totals.items()})
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = df.groupBy(*groups).agg(F.percentile_approx(order, cuts, 10 * blocks).alias("__bounds"))
    placed = df.join(bounds, groups).withColumn(
        "__block", F.expr(f"size(filter(__bounds, b -> b < {order}))")
    ).drop("__bounds")
    per_block = placed.groupBy(*groups, "__block").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in totals])
    starts = per_block.select(
        *groups, "__block",
        *[F.coalesce(_over(f"__t_{n}", groups, "__block", descending, "1 PRECEDING"), F.lit(0)).alias(f"__s_{n}") for n in totals],
    )
    out = placed.withColumns({f"__w_{n}": _over(f"__v_{n}", [*groups, "__block"], order, descending) for n in totals})
    out = out.join(starts, [*groups, "__block"])
    keep = [c for c in df.columns if not c.startswith("__")]
    return out.select(*keep, *[F.expr(f"__s_{n} + __w_{n}").alias(n) for n in totals])


def choose_blocks(df: DataFrame, blocks: int | None = None) -> tuple[DataFrame, int]:
    """The table, written once, and the form for it: 0 (plain) up to ``WINDOW_ROWS`` rows, else
    ``RANGE``. A form that is asked for stays."""
    if blocks is not None:
        return df, blocks
    df = settle(df)
    return df, form_of(df.count())


def form_of(rows: int) -> int:
    return RANGE if rows > WINDOW_ROWS else 0


def in_ranges(df: DataFrame, keys, block: str = "__block", parts: int | None = None) -> DataFrame:
    """``df``, written with the number of its range over ``keys``. Equal keys share a range; higher keys
    have higher numbers. Without ``parts`` a range holds about ``WINDOW_ROWS`` rows."""
    if parts is None:
        df = settle(df)
        parts = max(1, -(-df.count() // WINDOW_ROWS))
    return settle(df.repartitionByRange(parts, *keys).withColumn(block, F.spark_partition_id()))


def _range_totals(df: DataFrame, order: str, totals: dict[str, str], by: list[str], descending: bool) -> DataFrame:
    values = df.withColumns({f"__v_{name}": F.expr(expr) for name, expr in totals.items()})
    placed = in_ranges(values, [*by, order])
    per_block = placed.groupBy(*by, "__block").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in totals])
    starts = per_block.select(
        *[F.col(c).alias(f"__by_{c}") for c in by], F.col("__block").alias("__at"),
        *[F.coalesce(_over(f"__t_{n}", by, "__block", descending, "1 PRECEDING"), F.lit(0)).alias(f"__s_{n}") for n in totals],
    )
    out = placed.withColumns({f"__w_{n}": _over(f"__v_{n}", [*by, "__block"], order, descending) for n in totals})
    same = F.col("__block") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    keep = [c for c in df.columns if not c.startswith("__")]
    return out.join(starts, same).select(*keep, *[F.expr(f"__s_{n} + __w_{n}").alias(n) for n in totals])
