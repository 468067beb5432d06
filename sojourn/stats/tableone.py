"""Descriptive comparison of two groups ("Table 1").

Continuous variables are handled in long form: one collapse to (variable, value)
counts feeds quantiles and rank sums, one grouped aggregate feeds moments.
Categorical variables need a single (variable, level) count with one column per
group. Tests and differences are then arithmetic over those small tables.

The assembled tables (``comparison``, ``display``) read the persons once: ``tally`` counts
every value and level of every variable, per group and over all, and all cells, moments, ranks
and tests come from that table. Its counts add up, so the overall column costs no pass of its own.
"""

from __future__ import annotations

import math
import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn.functions.numbers import chi2_sf, f_sf
from sojourn.operators.quantiles import exact_quantiles
from sojourn.operators.running import BLOCKS, running_totals
from sojourn.operators.sketches import quantile_sketches, sketched_quantiles
from sojourn.operators.work import settle
from sojourn.stats.profile import long_values

# Fisher's test runs in tasks: executors need numpy and pandas, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OVERALL = "Overall"
TAIL_BLOCK = 4096
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _grouped(df: DataFrame, group: str | None) -> DataFrame:
    if group is None:
        return df.withColumn("__g", F.lit(OVERALL))
    return df.filter(F.col(group).isNotNull()).withColumn("__g", F.col(group))


def _sum_of(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


# --- continuous ---------------------------------------------------------------

def _value_counts(df: DataFrame, names, group: str | None) -> DataFrame:
    long = long_values(_grouped(df, group), names, ["__g"])
    return long.filter(F.col("value").isNotNull()).groupBy("variable", "__g", "value").agg(F.count("*").alias("n"))


def moments(df: DataFrame, names, group: str | None = None) -> DataFrame:
    """Rows, missing, mean and sample standard deviation per variable and group."""
    long = long_values(_grouped(df, group), names, ["__g"])
    return long.groupBy("variable", F.col("__g").alias("grp")).agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def continuous(df: DataFrame, names, group: str | None = None, rank_error: float | None = None) -> DataFrame:
    """Moments plus median and quartiles: exact ones, or with ``rank_error`` from quantile
    sketches, one of bounded size per variable and group in each task."""
    if rank_error is None:
        counts = _value_counts(df, names, group).withColumnRenamed("__g", "grp")
        spread = exact_quantiles(counts, ["variable", "grp"], QUARTILES)
    else:
        long = long_values(_grouped(df, group), names, ["__g"]).withColumnRenamed("__g", "grp")
        sketched = quantile_sketches(long, ["variable", "grp"], rank_error=rank_error)
        spread = sketched_quantiles(sketched, ["variable", "grp"], QUARTILES).drop("n")
    return moments(df, names, group).join(F.broadcast(spread), ["variable", "grp"], "left")


def _moments_wide(df: DataFrame, names, group: str, groups) -> DataFrame:
    long = long_values(_grouped(df, group), names, ["__g"])
    aggs = []
    for i, g in enumerate(groups):
        value = F.when(F.col("__g") == g, F.col("value"))
        aggs += [F.count(value).alias(f"n{i}"), F.avg(value).alias(f"m{i}"), F.var_samp(value).alias(f"v{i}")]
    return long.groupBy("variable").agg(*aggs)


def smd_continuous(df: DataFrame, names, group: str, groups, wide: DataFrame | None = None) -> DataFrame:
    """|difference in means| over the root of the averaged variances."""
    wide = _moments_wide(df, names, group, groups) if wide is None else wide
    pooled = (F.col("v0") + F.col("v1")) / 2
    smd = F.when(pooled > 0, F.abs(F.col("m0") - F.col("m1")) / F.sqrt(pooled))
    return wide.select("variable", smd.alias("smd"))


def anova(df: DataFrame, names, group: str, groups, wide: DataFrame | None = None) -> DataFrame:
    """Equal-variance one-way analysis of variance."""
    wide = _moments_wide(df, names, group, groups) if wide is None else wide.filter(F.col("variable").isin(*names))
    ks = range(len(groups))
    n = _sum_of([F.col(f"n{i}") for i in ks])
    grand = _sum_of([F.coalesce(F.col(f"n{i}") * F.col(f"m{i}"), F.lit(0.0)) for i in ks]) / F.nullif(n, F.lit(0))
    between = _sum_of([
        F.coalesce(F.col(f"n{i}") * (F.col(f"m{i}") - grand) * (F.col(f"m{i}") - grand), F.lit(0.0)) for i in ks
    ])
    within = _sum_of([F.coalesce((F.col(f"n{i}") - 1) * F.col(f"v{i}"), F.lit(0.0)) for i in ks])
    full = reduce(lambda a, b: a & b, [F.col(f"n{i}") > 0 for i in ks])
    df1 = len(groups) - 1
    out = wide.select("variable", full.alias("full"), n.alias("n"), between.alias("b"), within.alias("w")).withColumn(
        "df2", F.col("n") - len(groups)
    )
    stat = F.when(F.col("full") & (F.col("df2") > 0) & (F.col("w") > 0), (F.col("b") / df1) / (F.col("w") / F.col("df2")))
    out = out.select("variable", F.lit("anova").alias("test"), stat.alias("statistic"), F.lit(df1).alias("df1"), "df2")
    return out.withColumn("p", f_sf("statistic", "df1", "df2"))


def kruskal(df: DataFrame, names, group: str, groups, values: DataFrame | None = None) -> DataFrame:
    """Kruskal-Wallis on mid-ranks with tie correction.

    Values are collapsed first, so ranks are running totals over distinct values. ``values``
    may hold them already, as (variable, value, n0, n1, …).
    """
    ks = range(len(groups))
    if values is None:
        long = long_values(_grouped(df, group), names, ["__g"]).filter(F.col("value").isNotNull())
        values = long.groupBy("variable", "value").agg(*[F.count_if(F.col("__g") == g).alias(f"n{i}") for i, g in enumerate(groups)])
    by_value = values.withColumn("n", _sum_of([F.col(f"n{i}") for i in ks]))
    ranked = running_totals(by_value, "value", {"upto": "n"}, by=["variable"], blocks=BLOCKS)
    n = F.col("n").cast("double")
    mid = F.col("upto") - (n - 1) / 2
    sums = ranked.groupBy("variable").agg(
        *[F.sum(F.col(f"n{i}") * mid).alias(f"r{i}") for i in ks],
        *[F.sum(f"n{i}").cast("double").alias(f"c{i}") for i in ks],
        F.sum(n * n * n - n).alias("ties"),
    ).withColumn("total", _sum_of([F.col(f"c{i}") for i in ks]))
    total = F.col("total")
    centre = (total + 1) / 2
    spread = _sum_of([
        F.when(F.col(f"c{i}") > 0, F.col(f"c{i}") * F.pow(F.col(f"r{i}") / F.col(f"c{i}") - centre, F.lit(2.0))).otherwise(0.0)
        for i in ks
    ])
    correction = 1 - F.col("ties") / F.nullif(total * total * total - total, F.lit(0.0))
    present = _sum_of([(F.col(f"c{i}") > 0).cast("int") for i in ks])
    stat = F.when((correction > 0) & (present > 1), 12 * spread / (total * (total + 1)) / correction)
    out = sums.select("variable", F.lit("kruskal").alias("test"), stat.alias("statistic"), (present - 1).alias("df1"))
    return out.withColumn("p", chi2_sf("statistic", "df1"))


# --- categorical --------------------------------------------------------------

def level_counts(df: DataFrame, names, group: str | None, groups) -> DataFrame:
    """One row per (variable, level) with a count column ``n0, n1, …`` per group; a level
    absent from a group counts 0."""
    long = long_values(_grouped(df, group), names, ["__g"], kind="string").filter(F.col("value").isNotNull())
    return long.groupBy("variable", F.col("value").alias("level")).agg(
        *[F.count_if(F.col("__g") == g).alias(f"n{i}") for i, g in enumerate(groups)]
    )


def _cells(df: DataFrame, names, group: str | None, groups, cells: DataFrame | None) -> DataFrame:
    """Level counts, or those of ``names`` among counts already made."""
    return level_counts(df, names, group, groups) if cells is None else cells.filter(F.col("variable").isin(*names))


def _with_totals(levels: DataFrame, k: int) -> DataFrame:
    """Attach each variable's group totals; one row per variable, so broadcast."""
    totals = levels.groupBy("variable").agg(
        *[F.sum(f"n{i}").cast("double").alias(f"t{i}") for i in range(k)], F.count("*").alias("n_levels")
    )
    return levels.join(F.broadcast(totals), "variable")


def categorical(df: DataFrame, names, group: str | None = None, groups=(OVERALL,), cells: DataFrame | None = None) -> DataFrame:
    """Count and column percentage per variable, level and group."""
    levels = _with_totals(_cells(df, names, group, groups, cells), len(groups))
    each = F.array(*[
        F.struct(
            F.lit(g).alias("grp"), F.col(f"n{i}").alias("n"),
            (F.col(f"n{i}") * 100.0 / F.nullif(F.col(f"t{i}"), F.lit(0.0))).alias("pct"),
        )
        for i, g in enumerate(groups)
    ])
    return levels.select("variable", "level", F.inline(each))


def chi_square(df: DataFrame, names, group: str, groups, cells: DataFrame | None = None) -> DataFrame:
    """Pearson chi-square, with Yates' correction for 2 x 2 tables only."""
    ks = range(len(groups))
    cells = _with_totals(_cells(df, names, group, groups, cells), len(groups))
    row = _sum_of([F.col(f"n{i}") for i in ks])
    grand = _sum_of([F.col(f"t{i}") for i in ks])
    two_by_two = F.col("n_levels") == 2 if len(groups) == 2 else F.lit(False)
    parts = []
    for i in ks:
        expected = row * F.col(f"t{i}") / grand
        off = F.abs(F.col(f"n{i}") - expected)
        off = F.when(two_by_two, off - F.least(F.lit(0.5), off)).otherwise(off)
        parts.append(F.when(expected > 0, off * off / expected))
    full = reduce(lambda a, b: a & b, [F.col(f"t{i}") > 0 for i in ks])
    out = cells.groupBy("variable").agg(
        F.sum(F.when(full, _sum_of(parts))).alias("statistic"),
        ((F.count("*") - 1) * (len(groups) - 1)).cast("int").alias("df1"),
    ).select("variable", F.lit("chisq").alias("test"), F.when(F.col("df1") > 0, F.col("statistic")).alias("statistic"), "df1")
    return out.withColumn("p", chi2_sf("statistic", "df1"))


def _log_factorial_rest(k: int) -> float:
    """log k! less k log k - k."""
    if k < 16:
        return math.lgamma(k + 1) - (k * math.log(k) - k if k else 0.0)
    return 0.5 * math.log(2 * math.pi * k) + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / k**2) / k**2) / k**2) / k


def fisher_p(x: int, r: int, c: int, n: int) -> float:
    """Two-sided exact p of a 2 x 2 table with first cell ``x``, first row ``r``, first
    column ``c`` and size ``n``: the hypergeometric probabilities not above the observed
    one, with a relative tolerance of 1e-7 for ties.

    A probability is a sum of deviances of the cells from their expectations, so large
    counts do not cancel. The bounds of both tails come from bisection, as
    probabilities fall on each side of the mode; each tail is added by the ratio of
    neighbours until what is left cannot change the sum.
    """
    fixed = sum(map(_log_factorial_rest, (r, n - r, c, n - c))) - _log_factorial_rest(n)

    def log_p(k: int) -> float:
        cells = (k, r - k, c - k, n - r - c + k)
        off = (cells[0] * cells[3] - cells[1] * cells[2]) / n
        out = fixed
        for cell, gap in zip(cells, (off, -off, -off, off)):
            t = -gap / cell if cell else 0.0
            out -= _log_factorial_rest(cell) + (cell * (t - math.log1p(t)) if cell else -gap)
        return out

    low, high = max(0, r + c - n), min(r, c)
    mode = min(max((r + 1) * (c + 1) // (n + 2), low), high)
    bar = log_p(x) + math.log1p(1e-7)
    if log_p(mode) <= bar:
        return 1.0

    def tail(end: int, step: int) -> float:
        """Probability from the first value at or below the bar to the end of the support."""
        inside, outside = mode, end + step
        while abs(outside - inside) > 1:
            middle = (inside + outside) // 2
            inside, outside = (inside, middle) if log_p(middle) <= bar else (middle, outside)
        if outside == end + step:
            return 0.0
        term = total = math.exp(log_p(outside))
        k = outside
        while k != end and term > 0:
            at = k + step * np.arange(min(TAIL_BLOCK, abs(end - k)), dtype="float64")
            if step > 0:
                ratio = (r - at) * (c - at) / ((at + 1) * (n - r - c + at + 1))
            else:
                ratio = at * (n - r - c + at) / ((r - at + 1) * (c - at + 1))
            terms = term * np.cumprod(ratio)
            total += float(terms.sum())
            term, k = float(terms[-1]), k + step * len(at)
            if total + term * ratio[-1] / (1 - ratio[-1]) == total:
                break
        return total

    return min(1.0, tail(low, -1) + tail(high, 1))


def fisher(df: DataFrame, names, group: str, groups, cells: DataFrame | None = None) -> DataFrame:
    """Two-sided Fisher exact test for the variables whose table is 2 x 2; see ``fisher_p``.

    Counting is Spark's; the test itself sees one row per variable.
    """
    cells = _cells(df, names, group, groups, cells)
    table = cells.groupBy("variable").agg(
        F.count("*").alias("n_levels"), F.sum("n0").alias("c"), F.sum(F.col("n0") + F.col("n1")).alias("n"),
        F.min_by(F.col("n0"), F.col("level")).alias("x"), F.min_by(F.col("n0") + F.col("n1"), F.col("level")).alias("r"),
    ).filter("n_levels = 2")

    @F.pandas_udf("double")
    def p_values(x: pd.Series, r: pd.Series, c: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([fisher_p(*map(int, row)) for row in zip(x, r, c, n)], dtype="float64")

    return table.select(
        "variable", F.lit("fisher").alias("test"), F.lit(None).cast("double").alias("statistic"),
        F.lit(None).cast("int").alias("df1"), p_values("x", "r", "c", "n").alias("p"),
    )


def smd_categorical(df: DataFrame, names, group: str, groups, cells: DataFrame | None = None) -> DataFrame:
    """Multi-level standardised difference (Mahalanobis distance of the two level
    distributions under their averaged multinomial covariance).

    The covariance is diagonal plus rank two, so its inverse needs only six sums over
    the levels (one level dropped) and a 2 x 2 determinant.
    """
    cells = _with_totals(_cells(df, names, group, groups, cells), 2)
    p1 = F.col("n0") / F.nullif(F.col("t0"), F.lit(0.0))
    p2 = F.col("n1") / F.nullif(F.col("t1"), F.lit(0.0))
    cells = cells.select("variable", "level", "n_levels", p1.alias("p1"), p2.alias("p2"))
    dropped = cells.groupBy("variable").agg(F.max("level").alias("last"))
    kept = cells.join(F.broadcast(dropped), "variable").filter(F.col("level") < F.col("last"))
    a, b = F.col("p1"), F.col("p2")
    w = F.nullif((a + b) / 2, F.lit(0.0))
    s = kept.groupBy("variable").agg(
        F.sum((a - b) * (a - b) / w).alias("dd"),
        F.sum((a - b) * a / w).alias("d1"), F.sum((a - b) * b / w).alias("d2"),
        F.sum(a * a / w).alias("c11"), F.sum(a * b / w).alias("c12"), F.sum(b * b / w).alias("c22"),
    )
    e11, e22, e12 = 2 - F.col("c11"), 2 - F.col("c22"), -F.col("c12")
    det = e11 * e22 - e12 * e12
    quad = (e22 * F.col("d1") * F.col("d1") - 2 * e12 * F.col("d1") * F.col("d2") + e11 * F.col("d2") * F.col("d2")) / F.nullif(det, F.lit(0.0))
    return s.select("variable", F.sqrt(F.greatest(F.col("dd") + quad, F.lit(0.0))).alias("smd"))


# --- one pass over the persons ---------------------------------------------------

SIZE = "n"


def tally(df: DataFrame, continuous_vars, categorical_vars, group: str | None, groups) -> DataFrame:
    """(variable, number, level, n0, n1, …, n_known, n_all), written out: rows per value of each
    continuous variable and level of each categorical one, NULLs included, and under ``SIZE``
    all rows. ``n_known`` counts rows with a group, ``n_all`` all rows."""
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    entries = [F.struct(F.lit(SIZE).alias("variable"), number.alias("number"), F.lit("").alias("level"))]
    entries += [F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("number"), text.alias("level")) for v in continuous_vars]
    entries += [F.struct(F.lit(v).alias("variable"), number.alias("number"), F.col(v).cast("string").alias("level")) for v in categorical_vars]
    own = F.col(group) if group else text
    long = df.select(own.alias("__g"), F.inline(F.array(*entries)))
    shown = groups if group else ()
    return settle(long.groupBy("variable", "number", "level").agg(
        *[F.count_if(F.col("__g") == g).alias(f"n{i}") for i, g in enumerate(shown)],
        F.count_if(F.col("__g").isNotNull()).alias("n_known"), F.count("*").alias("n_all"),
    ))


def _tallied_levels(tallied: DataFrame, names, k: int) -> DataFrame:
    """``level_counts`` of the tally."""
    here = F.col("variable").isin(*names) & F.col("level").isNotNull() & (F.col("n_known") > 0)
    return tallied.filter(here).select("variable", "level", *[f"n{i}" for i in range(k)])


def _by_group(tallied: DataFrame, names, labels: dict[str, str]) -> DataFrame:
    """(variable, number, level, grp, n) of the named variables; ``labels`` maps count columns to groups."""
    each = F.array(*[F.struct(F.lit(label).alias("grp"), F.col(c).alias("n")) for c, label in labels.items()])
    return tallied.filter(F.col("variable").isin(*names)).select("variable", "number", "level", F.inline(each)).filter("n > 0")


def _tallied_moments(counts: DataFrame) -> DataFrame:
    """Values, missing, mean and sample variance per (variable, grp) from (variable, grp, number, n)."""
    keys, known = ["variable", "grp"], F.col("number").isNotNull()
    first = counts.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_values"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_missing"),
        (F.sum(F.col("n") * F.col("number")) / F.sum(F.when(known, F.col("n")))).alias("mean"),
    )
    off = F.col("number") - F.col("mean")
    spread = counts.filter(known).join(F.broadcast(first.select(*keys, "mean")), keys).groupBy(*keys).agg(F.sum(F.col("n") * off * off).alias("off"))
    return first.join(F.broadcast(spread), keys, "left").select(
        *keys, F.col("n_values").alias("n"), "n_missing", "mean", (F.col("off") / F.nullif(F.col("n_values") - 1, F.lit(0))).alias("var")
    )


def _tallied_wide(tallied: DataFrame, names, groups) -> DataFrame:
    """``_moments_wide`` of the tally."""
    per_group = _tallied_moments(_by_group(tallied, names, {f"n{i}": str(i) for i in range(len(groups))}))
    aggs = []
    for i in range(len(groups)):
        here = F.col("grp") == str(i)
        aggs += [F.coalesce(F.max(F.when(here, F.col("n"))), F.lit(0)).alias(f"n{i}"), F.max(F.when(here, F.col("mean"))).alias(f"m{i}"), F.max(F.when(here, F.col("var"))).alias(f"v{i}")]
    return per_group.groupBy("variable").agg(*aggs)


def _tallied_continuous(tallied: DataFrame, names, labels: dict[str, str]) -> DataFrame:
    """Moments, median and quartiles per (variable, grp)."""
    counts = _by_group(tallied, names, labels)
    values = counts.filter(F.col("number").isNotNull()).select("variable", "grp", F.col("number").alias("value"), "n")
    return _tallied_moments(counts).withColumn("sd", F.sqrt("var")).join(
        F.broadcast(exact_quantiles(values, ["variable", "grp"], QUARTILES)), ["variable", "grp"], "left"
    )


# --- assembled ----------------------------------------------------------------

def comparison(df: DataFrame, continuous_vars, categorical_vars, nonnormal, exact, group: str, groups,
               tallied: DataFrame | None = None) -> DataFrame:
    """Test, p and standardised difference for every variable, from one tally of the persons.

    Normal variables use analysis of variance, nonnormal ones Kruskal-Wallis; exact ones
    Fisher's test where the table is 2 x 2 and chi-square otherwise.
    """
    normal = [v for v in continuous_vars if v not in nonnormal]
    ranked = [v for v in continuous_vars if v in nonnormal]
    tallied = tally(df, continuous_vars, categorical_vars, group, groups) if tallied is None else tallied
    cells = _tallied_levels(tallied, categorical_vars, len(groups)) if categorical_vars else None
    wide = settle(_tallied_wide(tallied, continuous_vars, groups)) if continuous_vars else None
    tests = []
    keep = ["variable", "test", "statistic", "df1", "p"]
    if normal:
        tests.append(anova(df, normal, group, groups, wide).select(keep))
    if ranked:
        values = tallied.filter(F.col("variable").isin(*ranked) & F.col("number").isNotNull() & (F.col("n_known") > 0))
        values = values.select("variable", F.col("number").alias("value"), *[f"n{i}" for i in range(len(groups))])
        tests.append(kruskal(df, ranked, group, groups, values).select(keep))
    if categorical_vars:
        chi = chi_square(df, categorical_vars, group, groups, cells).select(keep)
        exact_here = [v for v in categorical_vars if v in exact]
        if exact_here and len(groups) == 2:
            by_exact = fisher(df, exact_here, group, groups, cells).select(keep)
            chi = chi.join(F.broadcast(by_exact), "variable", "left_anti").unionByName(by_exact)
        tests.append(chi)
    out = reduce(lambda a, b: a.unionByName(b), tests)
    if len(groups) != 2:
        return out.withColumn("smd", F.lit(None).cast("double"))
    smds = []
    if continuous_vars:
        smds.append(smd_continuous(df, list(continuous_vars), group, groups, wide))
    if categorical_vars:
        smds.append(smd_categorical(df, list(categorical_vars), group, groups, cells))
    return out.join(F.broadcast(reduce(lambda a, b: a.unionByName(b), smds)), "variable", "left")


def spread_literals(rows, key: str, *names: str):
    """A function that adds columns looked up by ``key`` among a few fixed rows."""
    def add(df: DataFrame) -> DataFrame:
        for at, name in enumerate(names, 1):
            chosen = reduce(lambda a, row: a.when(F.col(key) == row[0], row[at]), rows[1:], F.when(F.col(key) == rows[0][0], rows[0][at]))
            df = df.withColumn(name, chosen)
        return df

    return add


def display(df: DataFrame, continuous_vars, categorical_vars, nonnormal, exact, group: str | None, groups,
            digits: int = 2, pct_digits: int = 1, p_digits: int = 3, overall: bool = False,
            levels: dict | None = None) -> DataFrame:
    """The printed table: one row per variable or level, a text column per group, then
    p, test and standardised difference. ``overall`` adds an all-persons column.

    ``levels`` gives the level order of some variables; their other levels follow in
    text order, as all levels of other variables do. ``position`` and ``level_position``
    order the rows, and the tests stand on a variable's first row. ``label`` names what
    the cells show.
    """
    levels = levels or {}

    def number(c: str, places: int) -> Column:
        return F.when(F.col(c).isNull(), "NA").otherwise(F.format_string(f"%.{places}f", F.col(c)))

    mean, sd, median, q1, q3 = (number(c, digits) for c in ("mean", "sd", "median", "q1", "q3"))
    normal_text = F.concat(mean, F.lit(" ("), sd, F.lit(")"))
    median_text = F.concat(median, F.lit(" ["), q1, F.lit(", "), q3, F.lit("]"))
    nonnormal = list(nonnormal)
    text = F.when(F.col("variable").isin(nonnormal), median_text).otherwise(normal_text) if nonnormal else normal_text
    text = F.when(F.col("n") == 0, F.lit("NA")).otherwise(text)
    level_text = F.concat(F.col("n").cast("string"), F.lit(" ("), number("pct", pct_digits), F.lit(")"))

    tallied = tally(df, continuous_vars, categorical_vars, group, groups)
    labels = {f"n{i}": g for i, g in enumerate(groups)} if group else {}
    if overall or not group:
        labels = {"n_all": OVERALL, **labels}
    shown = list(labels.values())
    rows = [_by_group(tallied, [SIZE], labels).select("variable", "level", "grp", F.col("n").cast("string").alias("cell"))]
    if continuous_vars:
        found = _tallied_continuous(tallied, list(continuous_vars), labels)
        rows.append(found.select("variable", F.lit("").alias("level"), "grp", text.alias("cell")))
    if categorical_vars:
        for c, label in labels.items():
            # a level unknown to every group has a row in the overall column only
            levels_here = tallied.filter(F.col("variable").isin(*categorical_vars) & F.col("level").isNotNull())
            levels_here = levels_here if c == "n_all" else levels_here.filter("n_known > 0")
            counted = levels_here.select("variable", "level", F.col(c).alias("n0"))
            rows.append(categorical(df, list(categorical_vars), None, (label,), counted).select("variable", "level", "grp", level_text.alias("cell")))
    cells = reduce(lambda a, b: a.unionByName(b), rows)
    wide = cells.groupBy("variable", "level").agg(*[F.max(F.when(F.col("grp") == g, F.col("cell"))).alias(g) for g in shown])
    kinds = {"n": "n"}
    kinds.update({v: f"{v} (median [IQR])" if v in nonnormal else f"{v} (mean (SD))" for v in continuous_vars})
    kinds.update({v: f"{v} (%)" for v in categorical_vars})
    places = spread_literals([(v, i, label) for i, (v, label) in enumerate(kinds.items())], "variable", "position", "label")
    given = F.lit(None).cast("int")
    for v, listed in levels.items():
        for i, level in enumerate(listed):
            given = F.when((F.col("variable") == v) & (F.col("level") == level), i).otherwise(given)
    in_order = Window.partitionBy("variable").orderBy(F.col("__given").asc_nulls_last(), "level")
    wide = places(wide).withColumn("__given", given).withColumn(
        "level_position", (F.row_number().over(in_order) - 1).cast("int")
    ).drop("__given")
    if not group:
        return wide
    stats = comparison(df, continuous_vars, categorical_vars, nonnormal, exact, group, groups, tallied)
    least = "<0." + "0" * (p_digits - 1) + "1"
    stats = stats.select(
        "variable",
        *[F.when(F.col(c) < 10.0 ** -p_digits, least).otherwise(number(c, p_digits)).alias(c) for c in ("p", "smd")],
        F.when(F.col("test") == "kruskal", "nonnorm").when(F.col("test") == "fisher", "exact").otherwise("").alias("test"),
    )
    stats = stats.withColumn("level_position", F.lit(0))
    return wide.join(F.broadcast(stats), ["variable", "level_position"], "left")
