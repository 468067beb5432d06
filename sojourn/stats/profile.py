"""Looking at a table: columns, counts, missing rates, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn.operators.columns import across
from sojourn.operators.quantiles import collapse, exact_quantiles


def glimpse(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, missing count and lowest value."""
    aggs, rows = [], []
    for i, (name, kind) in enumerate(df.dtypes):
        aggs += [F.count_if(F.col(name).isNull()).alias(f"m{i}"), F.min(F.col(name)).cast("string").alias(f"e{i}")]
        rows.append(f"{i + 1}, '{name}', '{kind}', m{i}, e{i}")
    return df.agg(*aggs).select(
        F.expr(f"stack({len(rows)}, {', '.join(rows)}) AS (position, column_name, type, n_missing, lowest)")
    )


def counts(df: DataFrame, key: str) -> DataFrame:
    """Rows and distinct keys."""
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_ids"))


def group_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))


def missing_rates(df: DataFrame, names) -> DataFrame:
    """Percentage of NULLs per column."""
    return df.agg(*across(names, lambda c: F.avg(F.col(c).isNull().cast("int")) * 100, "{}_na_pct"))


def long_values(df: DataFrame, names, by=(), kind: str = "double") -> DataFrame:
    """(by…, variable, value) rows, one per column listed."""
    cast = df.select(*by, *[F.col(c).cast(kind).alias(c) for c in names])
    return cast.unpivot(list(by), list(names), "variable", "value")


def numeric_summary(df: DataFrame, names) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count of each numeric column."""
    long = long_values(df, names)
    plain = long.groupBy("variable").agg(
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
    )
    spread = exact_quantiles(collapse(long, ["variable"]), ["variable"], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return plain.join(F.broadcast(spread), "variable", "left")


def level_summary(df: DataFrame, names, top: int = 6) -> DataFrame:
    """Row counts of each column's ``top`` most frequent levels, the rest under (Other).

    A single level beyond ``top`` is shown itself. NULLs are no level; they are counted
    apart, under (NULL), if there are any.
    """
    counts = long_values(df, names, kind="string").groupBy("variable", "value").agg(F.count("*").alias("n"))
    levels = counts.filter(F.col("value").isNotNull())
    # Spark keeps the first rows of each variable in every task before they meet.
    by_count = Window.partitionBy("variable").orderBy(F.desc("n"), "value")
    best = levels.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= top + 1)
    sizes = levels.groupBy("variable").agg(F.count("*").alias("n_levels"), F.sum("n").alias("total"))
    best = best.join(F.broadcast(sizes), "variable").filter((F.col("rank") <= top) | (F.col("n_levels") <= top + 1))
    shown = best.select("variable", F.col("value").alias("level"), "n")
    listed = best.filter(F.col("n_levels") > top + 1).groupBy("variable").agg((F.first("total") - F.sum("n")).alias("n"))
    rest = listed.select("variable", F.lit("(Other)").alias("level"), "n")
    missing = counts.filter(F.col("value").isNull()).select("variable", F.lit("(NULL)").alias("level"), "n")
    return shown.unionByName(rest).unionByName(missing)


def complete_cases(df: DataFrame, names) -> DataFrame:
    """Rows without NULL in any of the columns."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names]))
