"""Person-level derived variables for tables and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.config import GROUPS, SEX_LABELS, StudyConfig
from sojourn.functions.logic import cut, if_else, in_list, label_by_pattern, recode, yes_no
from sojourn.operators.columns import add_missing
from sojourn.operators.quantiles import collapse, exact_quantiles, quantile


def person_features(persons: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Group and category labels, and days from the index claim's discharge to the
    first readmission (which can be zero or negative: the later stay is counted from
    the admission)."""
    readmitted = F.col("readmit_flag") == 1
    return persons.withColumns({
        "group": if_else(readmitted, F.lit(GROUPS[1]), F.lit(GROUPS[0])),
        "sex_f": recode("sex", SEX_LABELS),
        "index_dx_group_f": label_by_pattern("index_code", cfg.phenotypes),
        "path_type_f": F.col("path_type").cast("string"),
        "er_flag": yes_no(in_list("path_type", cfg.emergency_paths)),
        "result_type_f": F.col("result_type").cast("string"),
        "index_year_f": F.year("first_admit").cast("string"),
        "index_cat": F.substring("index_code", 1, 3),
        "death_flag": yes_no(F.col("death_yyyymm").isNotNull()),
        "diff_days": F.when(readmitted, F.date_diff("first_readmit_dt", "discharge_dt").cast("double")),
    })


def scaled(persons: DataFrame) -> DataFrame:
    """Age per ten years and outpatient visits per five (no history counts as none).
    Columns already present are left alone."""
    return add_missing(
        persons,
        age10=F.col("age_index") / 10,
        outpt5=F.coalesce(F.col("prior_other_n"), F.lit(0)) / 5,
    )


def long_stay(cfg: StudyConfig) -> Column:
    """Long or short stay, NULL when the length is unknown."""
    days = cfg.long_stay_days
    return if_else(F.col("los") >= days, F.lit(f">={days}d"), F.lit(f"<{days}d"))


def los_bins(persons: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Length of stay as quartile (right-closed), as long/short, and as top quartile.

    Quartiles are scalar subqueries over the same table, so nothing is collected.
    """
    counts = collapse(persons.select(F.col("los").alias("value")), [])
    probs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.75, "q4": 1.0}
    breaks = exact_quantiles(counts, [], probs, blocks=None).select(F.array(*probs)).scalar()
    los = F.col("los")
    out = persons.withColumn("__breaks", breaks)
    at = [F.element_at("__breaks", i + 1) for i in range(5)]
    return out.withColumns({
        "los_q": cut(los, at, ["Q1", "Q2", "Q3", "Q4"]),
        "los5": long_stay(cfg),
        "los_q4": if_else(los >= at[3], F.lit("Q4 (High)"), F.lit("Q1-3 (Low)")),
    }).drop("__breaks")


def top_quartile(persons: DataFrame, column: str):
    """Condition: value at or above the table's own third quartile."""
    return F.col(column) >= quantile(persons, column, 0.75).scalar()
