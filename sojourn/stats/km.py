"""Kaplan-Meier curves and what is read off them.

Follow-up time is in whole days, so after one ``groupBy(time)`` a curve is a table
of at most one row per day of the horizon, however many persons there are. Finer times
are counted first, and beyond a stated number the running sums go by range blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions.logic import recode
from sojourn.operators.running import choose_blocks, running_totals

Z95 = 1.959963984540054


def event_counts(df: DataFrame, strata=()) -> DataFrame:
    """Persons leaving follow-up and events per time (and stratum)."""
    known = df
    for c in ("time", "event", *strata):
        known = known.filter(F.col(c).isNotNull())
    return known.groupBy(*strata, "time").agg(
        F.count("*").alias("n_leave"), F.sum(F.col("event").cast("long")).alias("n_event")
    )


def kaplan_meier(df: DataFrame, strata=(), z: float = Z95, blocks: int | None = None) -> DataFrame:
    """Survival with Greenwood standard error and log-scale confidence limits, cumulative
    incidence, and cumulative hazard both as -log S and as the Nelson-Aalen sum."""
    strata = list(strata)
    counted, blocks = choose_blocks(event_counts(df, strata), blocks)
    at_risk = running_totals(counted, "time", {"n_risk": "n_leave"}, by=strata, descending=True, blocks=blocks)
    run = running_totals(at_risk, "time", {
        "__log_s": "CASE WHEN n_event < n_risk THEN log1p(-n_event / n_risk) ELSE 0D END",
        "__ended": "CASE WHEN n_event < n_risk THEN 0 ELSE 1 END",
        "__var": "CASE WHEN n_event < n_risk THEN n_event / (cast(n_risk AS double) * (n_risk - n_event)) ELSE 0D END",
        "hazard_na": "n_event / n_risk",
    }, by=strata, blocks=blocks)
    log_s, spread = F.col("__log_s"), z * F.sqrt("__var")
    alive = F.col("__ended") == 0
    surv = F.when(alive, F.exp(log_s)).otherwise(0.0)
    return run.select(
        *strata, "time", "n_risk", "n_event", (F.col("n_leave") - F.col("n_event")).alias("n_censor"),
        surv.alias("surv"),
        F.when(alive, F.exp(log_s) * F.sqrt("__var")).alias("std_err"),
        F.when(alive, F.exp(log_s - spread)).alias("lower"),
        F.when(alive, F.least(F.lit(1.0), F.exp(log_s + spread))).alias("upper"),
        (1.0 - surv).alias("risk"),
        F.when(alive, -log_s).otherwise(float("inf")).alias("hazard"),
        F.col("hazard_na"),
    )


def landmarks(curve: DataFrame, times, strata=(), extend: bool = False) -> DataFrame:
    """Survival and risk at fixed times: the last value at or before each.

    Times past the end of follow-up are dropped unless ``extend`` carries the last
    value on.
    """
    aggs = [F.max("time").alias("__last")]
    for i, t in enumerate(times):
        upto = F.when(F.col("time") <= t, F.col("time"))
        aggs += [
            F.coalesce(F.max_by("surv", upto), F.lit(1.0)).alias(f"s{i}"),
            F.coalesce(F.sum(F.when(F.col("time") >= t, F.col("n_event") + F.col("n_censor"))), F.lit(0)).alias(f"n{i}"),
        ]
    points = F.array(*[
        F.struct(F.lit(t).alias("time"), F.col(f"n{i}").alias("n_risk"), F.col(f"s{i}").alias("surv"))
        for i, t in enumerate(times)
    ])
    out = curve.groupBy(*strata).agg(*aggs).select(*strata, "__last", F.inline(points))
    if not extend:
        out = out.filter(F.col("time") <= F.col("__last"))
    return out.drop("__last").withColumn("risk", 1.0 - F.col("surv"))


def landmark_labels(points: DataFrame, labels: dict) -> DataFrame:
    """Display label and percentage for each landmark."""
    return points.select(
        "time",
        recode("time", labels).alias("label"),
        (F.col("risk") * 100).alias("risk_pct"),
        F.format_string("%.1f%%", F.col("risk") * 100).alias("risk_text"),
    )


def risk_table(df: DataFrame, breaks, strata=()) -> DataFrame:
    """Number still at risk at each break time."""
    aggs = [F.coalesce(F.sum(F.when(F.col("time") >= b, F.col("n_leave"))), F.lit(0)).alias(f"n{i}") for i, b in enumerate(breaks)]
    points = F.array(*[F.struct(F.lit(b).alias("time"), F.col(f"n{i}").alias("n_risk")) for i, b in enumerate(breaks)])
    return event_counts(df, strata).groupBy(*strata).agg(*aggs).select(*strata, F.inline(points))
