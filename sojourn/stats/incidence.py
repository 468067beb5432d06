"""Cumulative incidence with competing events, by the estimator of Aalen and Johansen.

One minus a Kaplan-Meier curve that censors competing events overstates a risk: it takes
those who died as if they could still have the event. Here a cause's incidence grows, at
each time, by the chance to be free of every event so far times the share of those at
risk who have that cause. Like the curves, it is a table per distinct time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.operators.running import choose_blocks, running_totals


def cumulative_incidence(df: DataFrame, causes=(1, 2), strata=(), blocks: int | None = None) -> DataFrame:
    """(strata…, time, cause, n_risk, n_event, incidence, surv): one row per time and cause.

    ``event`` is 0 for censored persons, else a cause; causes not listed end follow-up as events of
    their own. ``surv`` is the chance to be free of all of them. Rows with NULLs are left out.
    """
    strata, causes = list(strata), list(causes)
    known = df
    for c in ("time", "event", *strata):
        known = known.filter(F.col(c).isNotNull())
    counts = known.groupBy(*strata, "time").agg(
        F.count("*").alias("n_leave"), F.count_if(F.col("event") != 0).alias("n_any"),
        *[F.count_if(F.col("event") == c).alias(f"d{i}") for i, c in enumerate(causes)],
    )
    counts, blocks = choose_blocks(counts, blocks)
    at_risk = running_totals(counts, "time", {"n_risk": "n_leave"}, by=strata, descending=True, blocks=blocks)
    # The time at which all leave by events ends the curve; just before it every factor is positive.
    own = "CASE WHEN n_any < n_risk THEN log1p(-n_any / n_risk) ELSE 0D END"
    run = running_totals(at_risk, "time", {"log_s": own, "ended": "CASE WHEN n_any < n_risk THEN 0 ELSE 1 END"}, by=strata, blocks=blocks)
    run = run.withColumn("before", F.expr(f"exp(log_s - ({own}))"))
    run = running_totals(run, "time", {f"i{i}": f"before * d{i} / n_risk" for i in range(len(causes))}, by=strata, blocks=blocks)
    each = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(f"d{i}").alias("n_event"), F.col(f"i{i}").alias("incidence")) for i, c in enumerate(causes)])
    surv = F.when(F.col("ended") == 0, F.exp("log_s")).otherwise(0.0)
    return run.withColumn("surv", surv).select(*strata, "time", "n_risk", "surv", F.inline(each)).select(
        *strata, "time", "cause", "n_risk", "n_event", "incidence", "surv"
    )
