"""Cohort construction, outcomes and look-back, each operator on its own and combined."""

from __future__ import annotations

from pyspark.sql import functions as F

from sojourn import cohort, features, lookback, outcome, tte
from sojourn.config import COMORBIDITIES
from sojourn.operators.skew import hot_keys, keyed_join
from sojourn.operators.work import settle
from sojourn.plans import study
from sojourn.queries.reference_sql import CLAIMS, COHORT, END, HX, KEYS, PHENOTYPE, START, r
from sojourn.queries.registry import query, rounded
from sojourn.sources.binding import CONFIG, claims, persons


def _index(spark, sf_dir):
    events = claims(spark, sf_dir)
    return events, cohort.index_event(events, persons(spark, sf_dir), CONFIG)


def _measured(spark, sf_dir, *measures, keep=True, events=None):
    """Index persons with the given measures; with ``keep`` only included persons."""
    wanted = [*measures, *(cohort.exclusion_measures(CONFIG) if keep else [])]
    events = claims(spark, sf_dir) if events is None else events
    people = study.flagged_persons(events, persons(spark, sf_dir), CONFIG, wanted)
    return cohort.included(people) if keep else people


def _labelled(spark, sf_dir, *measures):
    return outcome.with_label(_measured(spark, sf_dir, outcome.same_dx_count(CONFIG), *measures))


def _with_last(spark, sf_dir):
    """Labelled persons with their last readmission, written once: pairs read them twice."""
    people = _labelled(spark, sf_dir, outcome.last_event(CONFIG))
    return settle(people.select("subject_id", "readmit_flag", "first_admit", "discharge_dt", "last_readmit_dt", "last_readmit_discharge"))


def people_table(spark, sf_dir):
    return study.person_table(claims(spark, sf_dir), persons(spark, sf_dir), CONFIG)


def analysis(spark, sf_dir):
    return study.analysis_table(claims(spark, sf_dir), persons(spark, sf_dir), CONFIG)


@query(prelude=CLAIMS, sql=f"SELECT DISTINCT subject_id FROM claims WHERE form_cd = '02' AND {PHENOTYPE}")
def qualifying_patients(spark, sf_dir):
    return cohort.qualifying_ids(claims(spark, sf_dir), CONFIG)


@query(prelude=CLAIMS, sql=f"""
SELECT CAST(year(start_dt) AS INT) AS yr, form_cd, count(*) AS n, count(DISTINCT subject_id) AS n_persons FROM claims
WHERE start_dt BETWEEN {START} AND {END} AND subject_id IN (SELECT subject_id FROM claims WHERE form_cd = '02' AND {PHENOTYPE}) GROUP BY 1, 2""")
def claims_in_study_window(spark, sf_dir):
    """All study-period claims of qualifying persons, counted by year and form."""
    events = claims(spark, sf_dir)
    kept = cohort.claims_of(cohort.within_period(events, CONFIG), cohort.qualifying_ids(events, CONFIG), CONFIG)
    return kept.groupBy(F.year("start_dt").alias("yr"), "form_cd").agg(
        F.count("*").alias("n"), F.count_distinct("subject_id").alias("n_persons")
    )


@query(prelude=COHORT, sql="SELECT subject_id, first_admit, index_code FROM idx")
def index_event(spark, sf_dir):
    return _index(spark, sf_dir)[1].select("subject_id", "first_admit", "index_code")


@query(prelude=COHORT, sql="SELECT subject_id, first_admit, index_discharge, index_code FROM idx")
def index_stay(spark, sf_dir):
    """Index stay: earliest discharge among the inpatient claims of the index day."""
    return cohort.index_stay(*_index(spark, sf_dir), CONFIG).select("subject_id", "first_admit", "index_discharge", "index_code")


@query(prelude=COHORT, sql="SELECT subject_id, first_admit, form_cd, dx1, dx2, path_type, result_type, los, discharge_dt FROM idx")
def index_rows(spark, sf_dir):
    """The index claim itself, one per person."""
    return _index(spark, sf_dir)[1].select(
        "subject_id", "first_admit", "form_cd", "dx1", "dx2", "path_type", "result_type", "los", "discharge_dt"
    )


@query(prelude=COHORT, sql="SELECT subject_id FROM washout_ids")
def washout_ids(spark, sf_dir):
    return _measured(spark, sf_dir, cohort.washout(CONFIG), keep=False).filter("washout").select("subject_id")


@query(prelude=CLAIMS, sql=f"SELECT {KEYS}, start_dt, CASE WHEN form_cd = '02' THEN start_dt + los END AS discharge_dt FROM claims")
def discharge_dates(spark, sf_dir):
    return cohort.with_discharge(claims(spark, sf_dir), CONFIG).select(*CONFIG.order, "start_dt", "discharge_dt")


@query(prelude=COHORT, sql="SELECT subject_id FROM death_ids")
def death_in_stay_ids(spark, sf_dir):
    return _measured(spark, sf_dir, cohort.death_in_stay(CONFIG), keep=False).filter("death_in_stay").select("subject_id")


@query(prelude=COHORT, sql="SELECT subject_id FROM unclear_ids")
def unclear_discharge_ids(spark, sf_dir):
    return _measured(spark, sf_dir, cohort.unclear_discharge(CONFIG), keep=False).filter("unclear_discharge").select("subject_id")


@query(prelude=COHORT, sql="SELECT subject_id, age_index, age_index IS NULL OR age_index < 0 AS invalid_age FROM idx")
def age_at_index(spark, sf_dir):
    return _index(spark, sf_dir)[1].select("subject_id", "age_index", cohort.invalid_age().alias("invalid_age"))


@query(prelude=COHORT, sql="SELECT subject_id, first_admit, age_index FROM incl")
def included_persons(spark, sf_dir):
    """Index persons after all exclusions; the flags are on the persons, so no id set is joined."""
    flagged = _measured(spark, sf_dir, *cohort.exclusion_measures(CONFIG), keep=False)
    return cohort.included(flagged).select("subject_id", "first_admit", "age_index")


@query(prelude=COHORT, sql=f"""
, q AS (SELECT c.*, start_dt BETWEEN {START} AND {END} AS in_p FROM claims c
        WHERE subject_id IN (SELECT subject_id FROM claims WHERE form_cd = '02' AND {PHENOTYPE})),
f AS (SELECT i.subject_id, count(*) AS n,
        CAST(i.subject_id IN (SELECT subject_id FROM washout_ids) AS INT) AS w, CAST(i.subject_id IN (SELECT subject_id FROM death_ids) AS INT) AS d,
        CAST(i.subject_id IN (SELECT subject_id FROM unclear_ids) AS INT) AS u, CAST(i.subject_id IN (SELECT subject_id FROM invalid_ids) AS INT) AS a
      FROM idx i JOIN claims c ON c.subject_id = i.subject_id AND c.start_dt BETWEEN {START} AND {END} GROUP BY i.subject_id)
SELECT 0 AS seq, 'qualified' AS step, count(DISTINCT subject_id) AS n_persons, count(*) AS n_claims FROM q
UNION ALL SELECT 1, 'in_period', count(DISTINCT subject_id), count(*) FROM q WHERE in_p
UNION ALL SELECT 2, 'indexed', count(*), CAST(sum(n) AS BIGINT) FROM f
UNION ALL SELECT 3, 'washout', count(*), CAST(sum(n) AS BIGINT) FROM f WHERE w = 0
UNION ALL SELECT 4, 'death_in_stay', count(*), CAST(sum(n) AS BIGINT) FROM f WHERE w + d = 0
UNION ALL SELECT 5, 'unclear_discharge', count(*), CAST(sum(n) AS BIGINT) FROM f WHERE w + d + u = 0
UNION ALL SELECT 6, 'invalid_age', count(*), CAST(sum(n) AS BIGINT) FROM f WHERE w + d + u + a = 0""")
def attrition(spark, sf_dir):
    """Persons and claims left after every step of the selection."""
    flagged = _measured(spark, sf_dir, *cohort.exclusion_measures(CONFIG), keep=False)
    return cohort.attrition(claims(spark, sf_dir), persons(spark, sf_dir), flagged, CONFIG)


@query(prelude=COHORT, sql=f"""
SELECT c.subject_id, c.start_dt, c.form_cd, c.dx1, i.age_index, {KEYS} FROM claims c JOIN incl i ON i.subject_id = c.subject_id
WHERE c.start_dt BETWEEN {START} AND {END}""")
def cohort_claims(spark, sf_dir):
    """Every study-period claim of the included persons, with age at index."""
    events = claims(spark, sf_dir)
    hot = hot_keys(events, "subject_id")
    flagged = study.flagged_persons(events, persons(spark, sf_dir), CONFIG, cohort.exclusion_measures(CONFIG), hot)
    return cohort.cohort_claims(events, cohort.included(flagged), CONFIG, hot).select(
        "subject_id", "start_dt", "form_cd", "dx1", "age_index", *CONFIG.order
    )


@query(prelude=COHORT, sql="SELECT subject_id, same_dx_days, n_same_dx, readmit_flag FROM (SELECT * REPLACE (coalesce(same_dx_days, 0) AS same_dx_days) FROM people)")
def readmission_label(spark, sf_dir):
    return _labelled(spark, sf_dir).select("subject_id", "same_dx_days", "n_same_dx", "readmit_flag")


@query(prelude=COHORT, sql=f"""
SELECT CASE WHEN p.readmit_flag = 1 THEN 'readmit' ELSE 'nonreadmit' END AS grp, count(*) AS n_claims, count(DISTINCT c.subject_id) AS n_persons
FROM claims c JOIN people p ON p.subject_id = c.subject_id WHERE c.start_dt BETWEEN {START} AND {END} GROUP BY 1""")
def group_split(spark, sf_dir):
    """The claims of each outcome group, counted."""
    events = claims(spark, sf_dir)
    hot = hot_keys(events, "subject_id")
    wanted = [outcome.same_dx_count(CONFIG), *cohort.exclusion_measures(CONFIG)]
    people = outcome.with_label(cohort.included(study.flagged_persons(events, persons(spark, sf_dir), CONFIG, wanted, hot)))
    tagged = people.select("subject_id", F.when(F.col("readmit_flag") == 1, "readmit").otherwise("nonreadmit").alias("grp"))
    rows = keyed_join(cohort.within_period(events, CONFIG), tagged, "subject_id", salt_by=CONFIG.order, hot=hot)
    return rows.groupBy("grp").agg(F.count("*").alias("n_claims"), F.count_distinct("subject_id").alias("n_persons"))


@query(prelude=COHORT, sql=f"""
SELECT subject_id, start_dt, start_dt + los AS discharge_dt FROM linked
WHERE form_cd = '02' AND start_dt > first_admit AND start_dt BETWEEN {START} AND {END}
GROUP BY 1, 2, 3 HAVING coalesce(bool_or(dx1 = index_code OR dx2 = index_code), false)""")
def same_dx_stays(spark, sf_dir):
    """Later stays with the index diagnosis on any claim, for every indexed person."""
    events, index = _index(spark, sf_dir)
    stays = cohort.within_period(events, CONFIG).filter(cohort.inpatient(CONFIG))
    return outcome.same_dx_stays(cohort.link(stays, index, CONFIG), CONFIG)


@query(prelude=COHORT, sql="SELECT subject_id, last_readmit_dt, last_readmit_discharge FROM people WHERE last_readmit_dt IS NOT NULL")
def last_readmission(spark, sf_dir):
    out = _measured(spark, sf_dir, outcome.last_event(CONFIG))
    return out.filter("last_readmit_dt IS NOT NULL").select("subject_id", "last_readmit_dt", "last_readmit_discharge")


@query(prelude=COHORT, sql="SELECT subject_id, readmit_flag, first_readmit_dt FROM people")
def first_readmission(spark, sf_dir):
    """First later stay, counted from the admission, for readmitted persons."""
    out = outcome.with_first_readmit(_labelled(spark, sf_dir, outcome.first_event(CONFIG, "admission")))
    return out.select("subject_id", "readmit_flag", "first_readmit_dt")


@query(prelude=COHORT, sql="SELECT subject_id, index_discharge, first_after_discharge FROM people")
def first_readmission_after_discharge(spark, sf_dir):
    return _measured(spark, sf_dir, outcome.first_event(CONFIG, "discharge")).select(
        "subject_id", "index_discharge", "first_after_discharge"
    )


@query(prelude=COHORT, sql="""
SELECT subject_id, first_admit AS start_dt, discharge_dt, 'index' AS kind FROM people WHERE readmit_flag = 1
UNION ALL SELECT subject_id, last_readmit_dt, last_readmit_discharge, 'last' FROM people WHERE readmit_flag = 1""")
def event_pairs(spark, sf_dir):
    return outcome.event_pairs(_with_last(spark, sf_dir))


@query(prelude=COHORT, sql=f"""
SELECT subject_id, CAST(date_diff('day', first_admit, CASE WHEN readmit_flag = 1 THEN last_readmit_dt ELSE {END} END) AS INT) AS gap_days FROM people""")
def gaps_to_event_or_end(spark, sf_dir):
    """Gap to the paired readmission, or to the study end, built from pairs."""
    people = _with_last(spark, sf_dir)
    return outcome.paired_gap(outcome.event_pairs(people)).unionByName(outcome.gap_to_end(people, CONFIG))


@query(prelude=COHORT, sql="SELECT subject_id, prior_other_n, prior_emergency_n, prior_inpatient_n FROM people")
def lookback_counts(spark, sf_dir):
    return _measured(spark, sf_dir, lookback.lookback_counts(CONFIG)).select(
        "subject_id", "prior_other_n", "prior_emergency_n", "prior_inpatient_n"
    )


@query(prelude=COHORT, sql=f"SELECT subject_id, {', '.join(HX)} FROM tbl")
def comorbidity_flags(spark, sf_dir):
    people = lookback.label_flags(_measured(spark, sf_dir, lookback.comorbidity(CONFIG)), CONFIG.comorbidities)
    return people.select("subject_id", *COMORBIDITIES)


@query(prelude=COHORT, sql=f"""
SELECT CAST(date_diff('day', start_dt, first_admit) AS INT) AS days_before, form_cd, count(*) AS n, count(DISTINCT subject_id) AS n_persons
FROM linked WHERE start_dt < first_admit AND start_dt >= first_admit - 180 AND start_dt >= {START} GROUP BY 1, 2""")
def lookback_claims(spark, sf_dir):
    """Look-back claims by distance to the index, for every indexed person."""
    events, index = _index(spark, sf_dir)
    rows = lookback.lookback(cohort.link(cohort.within_period(events, CONFIG), index, CONFIG), CONFIG)
    return rows.groupBy(F.date_diff("first_admit", "start_dt").alias("days_before"), "form_cd").agg(
        F.count("*").alias("n"), F.count_distinct("subject_id").alias("n_persons")
    )


_person_columns = (
    "subject_id, first_admit, index_code, index_discharge, discharge_dt, form_cd, dx1, dx2, path_type, result_type, los, age_index, sex,"
    " death_yyyymm, readmit_flag, n_same_dx, first_readmit_dt, prior_other_n, prior_emergency_n, prior_inpatient_n"
)


@query(prelude=COHORT, sql=f"""
SELECT {_person_columns}, CAST(date_diff('day', first_admit, CASE WHEN readmit_flag = 1 THEN last_readmit_dt ELSE {END} END) AS INT) AS gap_days FROM people""")
def person_analysis_table(spark, sf_dir):
    """One row per included person: label, gap and look-back, from two passes over claims."""
    return people_table(spark, sf_dir).select(*_person_columns.split(", "), "gap_days")


@query(prelude=COHORT, sql=f"""
SELECT subject_id, grp AS "group", sex_f, index_dx_group_f, path_type_f, er_flag, result_type_f, index_year_f, index_cat, death_flag, diff_days FROM tbl""")
def person_features(spark, sf_dir):
    people = outcome.with_first_readmit(_labelled(spark, sf_dir, outcome.first_event(CONFIG, "admission")))
    return features.person_features(people, CONFIG).select(
        "subject_id", "group", "sex_f", "index_dx_group_f", "path_type_f", "er_flag", "result_type_f", "index_year_f",
        "index_cat", "death_flag", "diff_days",
    )


@query(prelude=COHORT, sql=f"""
, q AS (SELECT quantile_cont(los::DOUBLE, 0.25) AS q1, quantile_cont(los::DOUBLE, 0.5) AS q2, quantile_cont(los::DOUBLE, 0.75) AS q3 FROM tbl)
SELECT subject_id, {r('age10', 'age10')}, {r('outpt5', 'outpt5')},
       CASE WHEN los <= q1 THEN 'Q1' WHEN los <= q2 THEN 'Q2' WHEN los <= q3 THEN 'Q3' ELSE 'Q4' END AS los_q,
       CASE WHEN los >= 5 THEN '>=5d' ELSE '<5d' END AS los5, CASE WHEN los >= q3 THEN 'Q4 (High)' ELSE 'Q1-3 (Low)' END AS los_q4
FROM tbl, q""")
def covariates(spark, sf_dir):
    """Scaled and binned covariates."""
    people = settle(features.scaled(_measured(spark, sf_dir, lookback.lookback_counts(CONFIG))))
    return rounded(features.los_bins(people, CONFIG).select("subject_id", "age10", "outpt5", "los_q", "los5", "los_q4"))


@query(prelude=COHORT, sql="""SELECT subject_id, "start", end_raw AS "end", CAST(event_raw AS INT) AS event, CAST(date_diff('day', "start", end_raw) AS INT) AS diff_days_raw FROM tte""")
def time_to_event(spark, sf_dir):
    """Event or censoring date before the horizon is applied."""
    people = _measured(spark, sf_dir, outcome.first_event(CONFIG, "discharge"))
    return tte.time_to_event(people, CONFIG).select("subject_id", "start", "end", "event", "diff_days_raw")


def horizon_table(spark, sf_dir, *measures):
    # Written once: index, stay, heavy persons and link would each join order lines to orders.
    events = settle(claims(spark, sf_dir))
    people = _measured(spark, sf_dir, outcome.first_event(CONFIG, "discharge"), *measures, events=events)
    return tte.apply_horizon(tte.time_to_event(people, CONFIG), CONFIG)


@query(prelude=COHORT, sql="""SELECT subject_id, "start", "end", "time", event, cutoff, diff_days_raw FROM surv""")
def horizon(spark, sf_dir):
    return horizon_table(spark, sf_dir).select("subject_id", "start", "end", "time", "event", "cutoff", "diff_days_raw")


@query(prelude=COHORT, sql=f"""
SELECT count(*) AS n, CAST(sum(event) AS BIGINT) AS events, {r('quantile_cont("time"::DOUBLE, 0.5)', 'median_days')},
       {r('quantile_cont("time"::DOUBLE, 0.25)', 'iqr_l')}, {r('quantile_cont("time"::DOUBLE, 0.75)', 'iqr_u')} FROM surv""")
def followup_summary(spark, sf_dir):
    return rounded(tte.followup_summary(settle(horizon_table(spark, sf_dir).select("time", "event"))))


SURVIVAL_COLUMNS = ["subject_id", "start", "end", "time", "event", "cutoff", "age_index", "age10", "sex_f", "los", "outpt5", "index_dx_group_f", *HX]


SURVIVAL_SQL = f"""
SELECT * REPLACE ({r('age10', 'age10')}, {r('outpt5', 'outpt5')}) FROM (SELECT {', '.join(f'"{c}"' for c in SURVIVAL_COLUMNS)} FROM surv)"""


@query(prelude=COHORT, sql=SURVIVAL_SQL)
def survival_table(spark, sf_dir):
    """Follow-up with covariates, one row per included person."""
    return rounded(study.survival_table(claims(spark, sf_dir), persons(spark, sf_dir), CONFIG).select(*SURVIVAL_COLUMNS))
