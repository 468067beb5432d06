"""Rows of a forest plot: every level with its count and hazard ratio, references included."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions.numbers import round_even, signif
from sojourn.stats.cox import CoxFit, Factor, _name
from sojourn.stats.profile import complete_cases


def forest(fit: CoxFit, df: DataFrame) -> DataFrame:
    """One row per numeric term and per factor level of the model's complete cases."""
    frame = complete_cases(df, ["time", "event", *[_name(t) for t in fit.terms]])
    names, aggs = [], []
    for term in fit.terms:
        if isinstance(term, Factor):
            frame = frame.filter(F.col(term.name).isin(*term.levels))
            for level in term.levels:
                names.append((term.name, level, f"{term.name}{level}", level == term.levels[0]))
                aggs.append(F.count_if(F.col(term.name) == level))
        else:
            names.append((term, "", term, False))
            aggs.append(F.count("*"))
    counts = frame.agg(*[a.alias(f"n{i}") for i, a in enumerate(aggs)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(v).alias("variable"), F.lit(level).alias("level"),
                 F.lit(term).alias("term"), F.lit(ref).alias("reference"), F.col(f"n{i}").alias("n"))
        for i, (v, level, term, ref) in enumerate(names)
    ])
    shown = counts.select(F.inline(rows))
    hazard = fit.tidy().select("term", "estimate", "conf_low", "conf_high", "p_value")
    out = shown.join(F.broadcast(hazard), "term", "left")
    return out.withColumn("estimate", F.when(F.col("reference"), 1.0).otherwise(F.col("estimate")))


def forest_footer(fit: CoxFit, concordance: DataFrame) -> DataFrame:
    """Events, global p (likelihood ratio), AIC and concordance."""
    return fit.glance().select("events", F.col("lr_p").alias("global_p"), "aic").withColumn(
        "concordance", concordance.select("concordance").scalar()
    )


def presentation(df: DataFrame, round_to: dict[str, int], significant: dict[str, int]) -> DataFrame:
    """Round for printing: fixed decimals (half to even) and significant digits."""
    exprs = {c: round_even(c, d) for c, d in round_to.items()}
    exprs.update({c: signif(c, d) for c, d in significant.items()})
    return reduce(lambda a, kv: a.withColumn(*kv), exprs.items(), df)
