"""Later events of the index diagnosis: counts, dates, stays, pairs and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.cohort import Measure, discharge, in_period, inpatient, same_diagnosis
from sojourn.config import StudyConfig
from sojourn.functions.logic import any_true, if_else
from sojourn.operators.columns import tag
from sojourn.operators.select import gap_to_next
from sojourn.operators.sets import append


def _same_stay(cfg: StudyConfig):
    return inpatient(cfg) & in_period(cfg) & same_diagnosis(cfg)


def _same_day(cfg: StudyConfig) -> dict:
    return {"d_same": any_true(_same_stay(cfg))}


def same_dx_count(cfg: StudyConfig) -> Measure:
    """Distinct same-diagnosis admission days on or after the index, itself included."""
    hit = F.col("d_same") & (F.col("start_dt") >= F.col("first_admit"))
    return Measure(_same_day(cfg), {"same_dx_days": F.count_if(hit)})


def first_event(cfg: StudyConfig, after: str = "admission") -> Measure:
    """Date of the first same-diagnosis stay strictly after the index admission or
    the index discharge."""
    origin, name = {
        "admission": ("first_admit", "first_readmit_dt"),
        "discharge": ("index_discharge", "first_after_discharge"),
    }[after]
    hit = F.col("d_same") & (F.col("start_dt") > F.col(origin))
    return Measure(_same_day(cfg), {name: F.min(F.when(hit, F.col("start_dt")))}, needs_stay=after == "discharge")


def last_event(cfg: StudyConfig) -> Measure:
    """Last same-diagnosis admission after the index, with that day's earliest discharge."""
    day = {**_same_day(cfg), "d_same_discharge": F.min(F.when(_same_stay(cfg), discharge(cfg)))}
    when = F.when(F.col("d_same") & (F.col("start_dt") > F.col("first_admit")), F.col("start_dt"))
    return Measure(day, {
        "last_readmit_dt": F.max(when),
        "last_readmit_discharge": F.max_by("d_same_discharge", when),
    })


def with_label(summary: DataFrame) -> DataFrame:
    """Readmission label: two or more same-diagnosis admission days. A person without
    any counts as one."""
    days = F.greatest(F.coalesce(F.col("same_dx_days"), F.lit(0)), F.lit(1))
    return summary.withColumns({
        "n_same_dx": days,
        "readmit_flag": (days >= 2).cast("int"),
    })


def with_first_readmit(persons: DataFrame) -> DataFrame:
    """Blank the first later stay for persons not labelled as readmitted."""
    return persons.withColumn("first_readmit_dt", if_else(F.col("readmit_flag") == 1, F.col("first_readmit_dt"), F.lit(None)))


def split_groups(persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of readmitted and of other persons."""
    return (
        persons.filter("readmit_flag = 1").select("subject_id"),
        persons.filter("readmit_flag = 0").select("subject_id"),
    )


def same_dx_stays(linked: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Inpatient claims after the index collapsed to stays (person, admission,
    discharge), keeping stays with the index diagnosis on any claim."""
    later = linked.filter(inpatient(cfg) & in_period(cfg) & (F.col("start_dt") > F.col("first_admit")))
    return (
        later.withColumn("discharge_dt", discharge(cfg))
        .groupBy("subject_id", "start_dt", "discharge_dt")
        .agg(any_true(same_diagnosis(cfg)).alias("same_dx"))
        .filter("same_dx")
        .drop("same_dx")
    )


def event_pairs(persons: DataFrame) -> DataFrame:
    """Two rows per readmitted person: the index stay and the last readmission."""
    readmitted = persons.filter("readmit_flag = 1")
    index = readmitted.select("subject_id", F.col("first_admit").alias("start_dt"), "discharge_dt")
    last = readmitted.filter(F.col("last_readmit_dt").isNotNull()).select(
        "subject_id", F.col("last_readmit_dt").alias("start_dt"), F.col("last_readmit_discharge").alias("discharge_dt")
    )
    return append(tag(index, kind="index"), tag(last, kind="last"))


def paired_gap(pairs: DataFrame) -> DataFrame:
    """Days from the index admission to the paired admission, one row per person."""
    return gap_to_next(pairs, "subject_id", "start_dt").filter(F.col("gap_days").isNotNull()).select("subject_id", "gap_days")


def gap_to_end(persons: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Days from the index admission to the study end, for persons not readmitted."""
    return persons.filter("readmit_flag = 0").select(
        "subject_id", F.date_diff(F.lit(cfg.study_end), "first_admit").alias("gap_days")
    )


def with_gap(persons: DataFrame, cfg: StudyConfig, which: str = "last") -> DataFrame:
    """Gap to the first or last readmission, or to the study end, on the person row.

    Equals joining ``paired_gap`` and ``gap_to_end`` back, without the join.
    """
    later = F.col("last_readmit_dt" if which == "last" else "first_readmit_dt")
    end = F.when(F.col("readmit_flag") == 1, later).otherwise(F.lit(cfg.study_end))
    return persons.withColumn("gap_days", F.date_diff(end, "first_admit"))
