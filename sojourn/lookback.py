"""Utilisation and comorbidity in the days before the index event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.cohort import Measure, in_lookback, inpatient
from sojourn.config import StudyConfig
from sojourn.functions.logic import any_true, in_list, matches, yes_no
from sojourn.operators.codebook import CodeBook


def lookback(linked: DataFrame, cfg: StudyConfig, days: int | None = None) -> DataFrame:
    """Claims in ``[index - days, index)``."""
    return linked.filter(in_lookback(cfg, days))


def lookback_counts(cfg: StudyConfig) -> Measure:
    """Claims in the look-back that are not inpatient, that arrived as emergencies, and
    that are inpatient for another primary diagnosis. NULL without any history."""
    seen = in_lookback(cfg)
    other_cause = inpatient(cfg) & (F.col("dx1") != F.col("index_code"))
    day = {
        "d_history": F.count_if(seen),
        "d_other": F.count_if(seen & ~inpatient(cfg)),
        "d_emergency": F.count_if(seen & in_list("path_type", cfg.emergency_paths)),
        "d_inpatient": F.count_if(seen & other_cause),
    }
    has = F.col("d_history") > 0
    return Measure(day, {
        "prior_other_n": F.sum(F.when(has, F.col("d_other"))),
        "prior_emergency_n": F.sum(F.when(has, F.col("d_emergency"))),
        "prior_inpatient_n": F.sum(F.when(has, F.col("d_inpatient"))),
    })


def comorbidity(cfg: StudyConfig) -> Measure:
    """One flag per comorbidity: any look-back claim with a matching diagnosis."""
    seen = in_lookback(cfg)
    return Measure(
        {f"d_{name}": any_true(seen & matches(["dx1", "dx2"], p)) for name, p in cfg.comorbidities.items()},
        {name: any_true(f"d_{name}") for name in cfg.comorbidities},
    )


def comorbidity_by_codes(cfg: StudyConfig, book: CodeBook, bits: str = "code_bits") -> Measure:
    """``comorbidity`` for claims that carry the bits of a code book over their diagnoses."""
    seen = in_lookback(cfg)
    return Measure(
        {f"d_{name}": any_true(seen & book.has(F.col(bits), name)) for name in cfg.comorbidities},
        {name: any_true(f"d_{name}") for name in cfg.comorbidities},
    )


def label_flags(persons: DataFrame, names) -> DataFrame:
    """Turn flags into Yes/No; a person without history has none of them."""
    return persons.withColumns({n: yes_no(F.coalesce(F.col(n), F.lit(False))) for n in names})
