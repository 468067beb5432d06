"""Study parameters. Everything a study fixes up front lives here, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# --- Fixed values -----------------------------------------------------------
# Code patterns and category codes below are part of the study definition and
# must keep these exact values for results to agree.

HEART = "^I(2[0-9]|3[0-9]|4[0-9]|5[0-1])"
CEREBRO = "^I6[0-9]"

PHENOTYPES = {"heart": HEART, "cerebro": CEREBRO}

COMORBIDITIES = {
    "hx_hf": "^I50",
    "hx_ihd": "^I2[0-5]",
    "hx_af": "^I48",
    "hx_htn": "^I1[0-5]",
    "hx_dm": "^E1[0-4]",
    "hx_dlp": "^E78",
    "hx_ckd": "^N18",
    "hx_copd": "^J4[0-7]",
    "hx_stroke": "^I6[0-9]",
    "hx_cancer": r"^C\d{2}",
}

INPATIENT_FORM = "02"
DEATH_CHECK_FORMS = ("02", "07", "12")
EMERGENCY_PATHS = (11, 21, 31)
SEX_LABELS = {1: "M", 2: "F"}
GROUPS = ("nonreadmit", "readmit")
LANDMARK_DAYS = (30, 90, 365, 730, 1095)
LANDMARK_LABELS = {30: "30d", 90: "90d", 365: "1y", 730: "2y", 1094: "3y", 1095: "3y"}

# Table 1 variables, in display order.
CONTINUOUS = ("age_index", "los", "diff_days", "prior_other_n", "prior_emergency_n", "prior_inpatient_n")
CATEGORICAL = (
    "sex_f", "er_flag", "path_type_f", "result_type_f",
    "index_year_f", "index_cat", "death_flag", "index_dx_group_f",
)
NONNORMAL = ("los", "diff_days", "prior_other_n", "prior_emergency_n", "prior_inpatient_n")
LEVELS = {"sex_f": ("M", "F"), "index_dx_group_f": ("heart", "cerebro"), "er_flag": ("No", "Yes"), "death_flag": ("No", "Yes")}
EXACT = ("sex_f", "er_flag", "death_flag", "index_dx_group_f")
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class StudyConfig:
    """One study over one event table.

    ``order`` names the columns that make a claim's position unique; every
    "first claim" rule uses them as its tie-break, because a distributed table
    has no row order of its own. ``id_filter`` is the error rate of a Bloom filter of
    indexed ids that claims pass before they are shuffled to their person; None goes without.
    """

    obs_start: date = date(2006, 1, 1)
    study_end: date = date(2019, 12, 31)
    lookback_days: int = 180
    horizon_years: int = 3
    inpatient_form: str = INPATIENT_FORM
    death_forms: tuple = DEATH_CHECK_FORMS
    emergency_paths: tuple = EMERGENCY_PATHS
    phenotypes: dict = field(default_factory=lambda: dict(PHENOTYPES))
    comorbidities: dict = field(default_factory=lambda: dict(COMORBIDITIES))
    match: str = "exact"
    death_scope: str = "any"
    long_stay_days: int = 5
    landmarks: tuple = LANDMARK_DAYS
    id_filter: float | None = None
    order: tuple = ("source_seq", "dx1", "dx2", "form_cd", "path_type", "los", "result_type")

    @property
    def horizon_days(self) -> int:
        """Upper bound on follow-up days, hence on the number of distinct times."""
        return 366 * self.horizon_years
