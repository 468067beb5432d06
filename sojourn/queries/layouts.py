"""The same results by other means: claims stored by person, an id filter, sketches, a code book."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sojourn import cohort, lookback
from sojourn.config import COMORBIDITIES
from sojourn.operators import sketches
from sojourn.operators.codebook import code_book, with_code_bits
from sojourn.operators.idfilter import ERROR
from sojourn.operators.quantiles import collapse, exact_quantiles
from sojourn.operators.work import scratch_path, settle
from sojourn.plans import study
from sojourn.queries.cohorts import SURVIVAL_COLUMNS, SURVIVAL_SQL
from sojourn.queries.reference_sql import CLAIMS, COHORT, HX, r
from sojourn.queries.registry import query, rounded
from sojourn.sources.binding import CONFIG, claims, persons
from sojourn.sources.person_store import read_by_person, write_by_person
from sojourn.stats.profile import long_values


def stored_claims(spark, sf_dir, **layout):
    path = scratch_path(spark)
    write_by_person(claims(spark, sf_dir), path, **layout)
    return read_by_person(spark, path)


@query(prelude=COHORT, sql="SELECT subject_id, first_admit, index_code FROM idx")
def index_event_in_store(spark, sf_dir):
    """The index event of every person, found in the buckets of stored claims."""
    people = persons(spark, sf_dir)
    found = stored_claims(spark, sf_dir).per_person(lambda part: cohort.index_event(part, people, CONFIG))
    return found.select("subject_id", "first_admit", "index_code")


@query(prelude=COHORT, sql=SURVIVAL_SQL)
def survival_table_in_store(spark, sf_dir):
    """A whole study over claims stored by person: no claim is shuffled."""
    return rounded(study.survival_table(stored_claims(spark, sf_dir), persons(spark, sf_dir), CONFIG).select(*SURVIVAL_COLUMNS))


@query(prelude=COHORT, sql=SURVIVAL_SQL)
def survival_table_filtered(spark, sf_dir):
    """A whole study that shuffles only claims which pass a Bloom filter of indexed ids."""
    cfg = replace(CONFIG, id_filter=ERROR)
    return rounded(study.survival_table(claims(spark, sf_dir), persons(spark, sf_dir), cfg).select(*SURVIVAL_COLUMNS))


@query(prelude=CLAIMS, sql="""
SELECT CAST(year(start_dt) AS INT) AS yr, form_cd, count(*) AS n_rows, count(DISTINCT subject_id) AS n_ids, true AS within FROM claims GROUP BY 1, 2""")
def persons_by_year_sketched(spark, sf_dir):
    """Distinct persons per year and form from stored sketches per month, beside the exact
    count; ``within`` says whether the estimate lies within four standard errors."""
    events = claims(spark, sf_dir)
    monthly = sketches.distinct_sketches(events, [F.year("start_dt").alias("yr"), F.month("start_dt").alias("mon"), "form_cd"], "subject_id")
    yearly = sketches.distinct_estimates(sketches.united(settle(monthly), ["yr", "form_cd"]), "estimate")
    exact = events.groupBy(F.year("start_dt").alias("yr"), "form_cd").agg(F.count_distinct("subject_id").alias("n_ids"))
    error = 4 * sketches.relative_error(sketches.log_size())
    near = F.abs(F.col("estimate") - F.col("n_ids")) <= F.greatest(F.lit(1.0), error * F.col("n_ids"))
    return exact.join(yearly, ["yr", "form_cd"]).select("yr", "form_cd", "n_rows", "n_ids", near.alias("within"))


_QUANTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


@query(prelude=CLAIMS, sql=f"""
SELECT variable, form_cd, {r('quantile_cont(value, 0.25)', 'q1')}, {r('quantile_cont(value, 0.5)', 'median')}, {r('quantile_cont(value, 0.75)', 'q3')}, true AS within
FROM (SELECT form_cd, unnest(['los', 'k3', 'k5']) AS variable, unnest([los::DOUBLE, k3::DOUBLE, k5::DOUBLE]) AS value FROM claims) WHERE value IS NOT NULL GROUP BY 1, 2""")
def quantiles_sketched(spark, sf_dir):
    """Quartiles per variable and form from merged sketches per year, beside the exact ones;
    ``within`` says whether every sketched quartile's rank is as near as stated (doubled)."""
    values = long_values(claims(spark, sf_dir).withColumn("yr", F.year("start_dt")), ["los", "k3", "k5"], ["yr", "form_cd"])
    values = settle(values.filter(F.col("value").isNotNull()))
    yearly = settle(sketches.quantile_sketches(values, ["yr", "variable", "form_cd"]))
    found = sketches.sketched_quantiles(sketches.merged(yearly, ["variable", "form_cd"]), ["variable", "form_cd"], _QUANTILES)
    exact = exact_quantiles(collapse(values, ["variable", "form_cd"]), ["variable", "form_cd"], _QUANTILES)
    ranks = values.join(F.broadcast(found.withColumnsRenamed({q: f"s_{q}" for q in _QUANTILES})), ["variable", "form_cd"]).groupBy("variable", "form_cd").agg(
        *[F.avg((F.col("value") < F.col(f"s_{q}")).cast("int")).alias(f"below_{q}") for q in _QUANTILES],
        *[F.avg((F.col("value") <= F.col(f"s_{q}")).cast("int")).alias(f"upto_{q}") for q in _QUANTILES],
    )
    slack, near = 2 * sketches.RANK_ERROR, F.lit(True)
    for q, p in _QUANTILES.items():
        near = near & (F.col(f"below_{q}") <= p + slack) & (F.col(f"upto_{q}") >= p - slack)
    return rounded(exact.join(ranks, ["variable", "form_cd"]).select("variable", "form_cd", *_QUANTILES, near.alias("within")))


@query(prelude=COHORT, sql=f"SELECT subject_id, {', '.join(HX)} FROM tbl")
def comorbidity_flags_by_codes(spark, sf_dir):
    """Comorbidity flags from a book of the distinct diagnosis codes."""
    events, columns = claims(spark, sf_dir), ["dx1", "dx2"]
    book = code_book(events, columns, CONFIG.comorbidities)
    measures = [lookback.comorbidity_by_codes(CONFIG, book), *cohort.exclusion_measures(CONFIG)]
    people = cohort.included(study.flagged_persons(with_code_bits(events, columns, book), persons(spark, sf_dir), CONFIG, measures))
    return lookback.label_flags(people, CONFIG.comorbidities).select("subject_id", *COMORBIDITIES)
