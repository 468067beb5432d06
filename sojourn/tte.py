"""Time to event: event or censoring date, administrative horizon, follow-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.config import StudyConfig
from sojourn.functions.dates import days_between, years_after
from sojourn.functions.logic import row_max, row_min
from sojourn.operators.quantiles import exact_quantiles


def time_to_event(persons: DataFrame, cfg: StudyConfig, censor_at: str | None = None, competing: int = 0) -> DataFrame:
    """Add ``start`` (index discharge), ``end`` (event, else study end) and ``event``.

    ``censor_at`` names a date column, such as the day of death, after which no event can be
    seen; it ends follow-up with the event ``competing`` (0: censored). A first event on that
    day counts.
    """
    first, last = F.col("first_after_discharge"), F.lit(cfg.study_end)
    seen, other = first.isNotNull(), F.lit(0)
    if censor_at is not None:
        stop = F.col(censor_at)
        last = F.least(F.coalesce(stop, last), last)
        seen = F.coalesce(first <= last, F.lit(False))
        other = F.when(stop <= F.lit(cfg.study_end), competing).otherwise(0)
    out = persons.withColumns({
        "start": F.col("index_discharge"),
        "end": F.when(seen, first).otherwise(last),
        "event": F.when(seen, 1).otherwise(other).cast("int"),
    })
    return out.withColumn("diff_days_raw", days_between("start", "end"))


def apply_horizon(tte: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Cut follow-up at ``horizon_years`` after the start, or the study end if sooner.
    An event on the cutoff day still counts; time is never negative."""
    cutoff = row_min(years_after("start", cfg.horizon_years), F.lit(cfg.study_end))
    out = tte.withColumn("cutoff", cutoff)
    event = F.when((F.col("event") > 0) & (F.col("end") <= F.col("cutoff")), F.col("event")).otherwise(0)
    out = out.withColumns({"event": event, "end": row_min("end", "cutoff")})
    return out.withColumn("time", row_max(F.lit(0), days_between("start", "end")))


def followup_summary(tte: DataFrame) -> DataFrame:
    """Persons, events, and median and quartiles of follow-up time."""
    by_time = tte.groupBy(F.col("time").alias("value")).agg(F.count("*").alias("n"), F.sum("event").alias("events"))
    spread = exact_quantiles(by_time, [], {"iqr_l": 0.25, "median_days": 0.5, "iqr_u": 0.75}, blocks=None)
    return by_time.agg(F.sum("n").alias("n"), F.sum("events").alias("events")).select(
        "*", *[spread.select(c).scalar().alias(c) for c in ("median_days", "iqr_l", "iqr_u")]
    )
