"""Test of proportional hazards: score test for a trend of each coefficient with a
transform of time (one minus the survival just before the event time); and the residuals
behind it, a row per event and coefficient."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.functions.numbers import chi2_sf
from sojourn.operators.running import running_totals
from sojourn.stats.cox import CoxFit, _invert, _matrix, _total, _vector, per_time


def _transform(counts: DataFrame, blocks: int | None) -> DataFrame:
    """(time, g) with g = 1 - S(time-), the left-continuous survival curve."""
    by_time = counts.groupBy("time").agg(
        F.sum("n").alias("leave"), F.sum(F.when(F.col("event") == 1, F.col("n")).otherwise(0)).alias("d")
    )
    risk = running_totals(by_time, "time", {"n_risk": "leave"}, descending=True, blocks=blocks)
    own = "CASE WHEN d < n_risk THEN log1p(-d / n_risk) ELSE 0D END"
    run = running_totals(risk, "time", {"log_s": own}, blocks=blocks)
    # The last time can end the curve; just before it every factor is positive.
    return run.select("time", F.expr(f"1D - exp(log_s - {own})").alias("g"))


def ph_test(fit: CoxFit, blocks: int | None = None) -> DataFrame:
    """Chi-square, degrees of freedom and p per term, and GLOBAL."""
    p, blocks = len(fit.beta), fit.blocks if blocks is None else blocks
    at = per_time(fit.counts, fit.predictor(), fit.centred(), blocks=blocks)
    at = at.join(_transform(fit.counts, blocks), "time")
    row = at.agg(*_total(p), *_total(p, "g", "g_"), *_total(p, "g * g", "gg_")).first()
    u, b, c = _vector(row, p, "g_"), _matrix(row, p, "g_"), _matrix(row, p, "gg_")
    u = u - b @ _invert(_matrix(row, p)) @ _vector(row, p)
    schur = c - b @ _invert(_matrix(row, p)) @ b
    terms = list(dict.fromkeys(fit.owners))
    rows = []
    for term in terms:
        at_term = [i for i, o in enumerate(fit.owners) if o == term]
        part = u[at_term]
        rows.append((len(rows), term, float(part @ np.linalg.pinv(schur[np.ix_(at_term, at_term)]) @ part), len(at_term)))
    rows.append((len(rows), "GLOBAL", float(u @ np.linalg.pinv(schur) @ u), p))
    out = fit.spark.createDataFrame(rows, "position int, term string, chisq double, df int")
    return out.withColumn("p", chi2_sf("chisq", "df"))


def schoenfeld_residuals(fit: CoxFit, blocks: int | None = None) -> DataFrame:
    """(time, n, term, residual, scaled): what an event's covariate exceeds its mean over those at
    risk by, for ``n`` events with equal time and covariates, and each coefficient.

    The mean comes from the per-time sums, averaged over the steps of tied events, so a
    coefficient's residuals sum to its score, zero at the estimate. ``scaled`` multiplies an event's
    residuals by the covariance matrix and the number of events and adds the coefficient:
    its trend in time is that of the coefficient.
    """
    p, blocks = len(fit.beta), fit.blocks if blocks is None else blocks
    centred = fit.centred()
    events = fit.counts.where("event = 1").selectExpr("time AS event_time", "n", *[f"{c} AS z{i}" for i, c in enumerate(centred)])
    sums = events.groupBy("event_time").agg(F.sum("n").alias("d"), *[F.sum(F.col("n") * F.col(f"z{i}")).alias(f"sx{i}") for i in range(p)])
    at = per_time(fit.counts, fit.predictor(), centred, blocks=blocks).select("time", *[f"u{i}" for i in range(p)])
    means = sums.join(at, F.col("event_time") == F.col("time")).select("time", *[((F.col(f"sx{i}") - F.col(f"u{i}")) / F.col("d")).alias(f"m{i}") for i in range(p)])
    rows = events.join(means, F.col("event_time") == F.col("time"))
    rows = rows.select("time", "n", *[(F.col(f"z{i}") - F.col(f"m{i}")).alias(f"r{i}") for i in range(p)])
    each = []
    for i, name in enumerate(fit.names):
        scaled = F.lit(float(fit.beta[i]))
        for j in range(p):
            scaled = scaled + F.lit(float(fit.events * fit.vcov[i, j])) * F.col(f"r{j}")
        each.append(F.struct(F.lit(name).alias("term"), F.col(f"r{i}").alias("residual"), scaled.alias("scaled")))
    return rows.select("time", "n", F.inline(F.array(*each)))
