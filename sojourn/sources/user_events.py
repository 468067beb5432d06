"""A second binding: website events, to which the same study operators apply.

A user's first error is the index event, the next error the outcome, everything in the
week before it the look-back.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.config import StudyConfig

CONFIG = StudyConfig(
    obs_start=date(2024, 1, 8),
    study_end=date(2024, 1, 30),
    lookback_days=7,
    inpatient_form="error",
    death_forms=("error",),
    emergency_paths=(1,),
    phenotypes={"error": "^error$"},
    comorbidities={"hx_purchase": "^purchase$", "hx_error": "^error$"},
    landmarks=(1, 3, 7, 14),
    order=("event_id",),
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("subject_id"),
        F.col("ts").cast("date").alias("start_dt"),
        F.col("event_type").alias("form_cd"),
        F.col("event_type").alias("dx1"),
        F.lit(None).cast("string").alias("dx2"),
        (F.col("value") >= 50).cast("int").alias("path_type"),
        F.lit(0).alias("result_type"),
        F.lit(0).alias("los"),
        "event_id",
    )


def users(table: DataFrame) -> DataFrame:
    return table.select("subject_id").distinct().select(
        "subject_id", F.lit("2000").alias("birth_yyyy"), F.lit(None).cast("string").alias("death_yyyymm"), F.lit(1).alias("sex")
    )
