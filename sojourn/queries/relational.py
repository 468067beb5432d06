"""Sources, projections, joins, aggregates and scalar rules over the whole claims table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sojourn import cohort
from sojourn.functions import dates, logic, numbers
from sojourn.operators import columns, quantiles, select, sets, work
from sojourn.queries.reference_sql import CLAIMS, COHORT, END, KEYS, PHENOTYPE, START, r
from sojourn.queries.registry import query, rounded
from sojourn.sources import tables
from sojourn.sources.binding import CONFIG, claims, persons
from sojourn.stats import profile

# --- sources ------------------------------------------------------------------


@query(prelude=CLAIMS, sql="SELECT CAST(subject_id AS VARCHAR) AS subject_id, birth_yyyy, death_yyyymm, sex FROM person")
def person_files(spark, sf_dir):
    """Persons written as one birth file and two eligibility files, then read and merged."""
    people = persons(spark, sf_dir)
    folder = work.scratch_path(spark)
    birth = people.select(*[F.col(new).alias(old) for old, new in tables.BIRTH_NAMES.items()])
    sex = people.select(*[F.col(new).alias(old) for old, new in tables.ELIGIBILITY_NAMES.items()])
    tables.write_table(birth, f"{folder}/birth")
    # The second file repeats every person with the other sex; the first file wins.
    tables.write_table(sex.filter("SEX = 1"), f"{folder}/first")
    tables.write_table(sex.filter("SEX = 2").unionByName(sex.filter("SEX = 1").withColumn("SEX", F.lit(2))), f"{folder}/second")
    return tables.load_persons(spark, f"{folder}/birth", [f"{folder}/first", f"{folder}/second"]).select(
        "subject_id", "birth_yyyy", "death_yyyymm", "sex"
    )


@query(prelude=CLAIMS, sql="""
SELECT CAST(CASE WHEN start_dt < DATE '1999-01-01' THEN 0 ELSE 1 END AS INT) AS source_seq, form_cd, start_dt, count(*) AS n,
       count(dx2) AS n_dx2, CAST(sum(los) AS BIGINT) AS days
FROM claims GROUP BY 1, 2, 3""")
def claim_files(spark, sf_dir):
    """Claims written as two files, read back with a fixed schema, and counted."""
    names = {v: k for k, v in tables.CLAIM_NAMES.items()}
    events = claims(spark, sf_dir).withColumn("start_text", F.date_format("start_dt", "yyyyMMdd"))
    raw = events.select("start_dt", *[F.col(c).alias(names[c]) for c in names if c in events.columns])
    folder = work.scratch_path(spark)
    early = F.col("start_dt") < F.lit(date(1999, 1, 1))
    tables.write_table(raw.filter(early).drop("start_dt"), f"{folder}/early")
    tables.write_table(raw.filter(~early).drop("start_dt"), f"{folder}/late")
    read = tables.load_claims(spark, [f"{folder}/early", f"{folder}/late"])
    return read.groupBy("source_seq", "form_cd", "start_dt").agg(
        F.count("*").alias("n"), F.count("dx2").alias("n_dx2"), F.sum("los").alias("days")
    )


@query(prelude=CLAIMS, sql="""
SELECT CAST(s AS INT) AS source_seq, count(*) AS n, count(dx2) AS n_dx2 FROM (
  SELECT 0 AS s, dx2 FROM claims WHERE start_dt < DATE '1999-01-01'
  UNION ALL SELECT 1, NULL FROM claims WHERE start_dt >= DATE '1999-01-01') GROUP BY 1""")
def append_sources(spark, sf_dir):
    """Two sources appended by name; one lacks the secondary diagnosis."""
    events = claims(spark, sf_dir)
    early = F.col("start_dt") < F.lit(date(1999, 1, 1))
    both = sets.append(events.filter(early), events.filter(~early).drop("dx2"), seq="source_seq")
    return both.groupBy("source_seq").agg(F.count("*").alias("n"), F.count("dx2").alias("n_dx2"))


CLAIM_TYPES = {
    "subject_id": "bigint", "start_dt": "date", "form_cd": "string", "dx1": "string", "dx2": "string", "path_type": "int",
    "result_type": "int", "los": "int", "k1": "bigint", "k2": "int", "k3": "bigint", "k4": "bigint", "k5": "double",
}


@query(prelude=CLAIMS, sql=" UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{kind}' AS type, count(*) - count({c}) AS n_missing, CAST(min({c}) AS VARCHAR) AS lowest FROM claims"
    for i, (c, kind) in enumerate(CLAIM_TYPES.items(), 1)))
def claims_glimpse(spark, sf_dir):
    return profile.glimpse(claims(spark, sf_dir))


@query(prelude=CLAIMS, sql="SELECT count(*) AS n_rows, count(DISTINCT subject_id) AS n_ids FROM claims")
def claims_counts(spark, sf_dir):
    return profile.counts(claims(spark, sf_dir), "subject_id")


NUMERIC = [c for c, kind in CLAIM_TYPES.items() if kind not in ("string", "date")]

_numeric = " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, min({c})::DOUBLE AS min, {r(f'avg({c})', 'mean')}, max({c})::DOUBLE AS max,
       count(*) - count({c}) AS n_missing, {r(f'quantile_cont({c}::DOUBLE, 0.25)', 'q1')},
       {r(f'quantile_cont({c}::DOUBLE, 0.5)', 'median')}, {r(f'quantile_cont({c}::DOUBLE, 0.75)', 'q3')} FROM claims"""
    for c in NUMERIC
)


@query(prelude=CLAIMS, sql=_numeric)
def claims_numeric_summary(spark, sf_dir):
    return rounded(profile.numeric_summary(claims(spark, sf_dir), NUMERIC))


_levels = """, lv AS (
SELECT 'dx1' AS variable, dx1 AS value, count(*) AS n FROM claims GROUP BY 2
UNION ALL SELECT 'dx2', dx2, count(*) FROM claims GROUP BY 2
UNION ALL SELECT 'form_cd', form_cd, count(*) FROM claims GROUP BY 2
), pl AS (
SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, value ASC) AS place,
       count(*) OVER (PARTITION BY variable) AS n_levels FROM lv WHERE value IS NOT NULL)
SELECT variable, CASE WHEN n_levels > 7 AND place > 6 THEN '(Other)' ELSE value END AS level,
       CAST(sum(n) AS BIGINT) AS n FROM pl GROUP BY 1, 2
UNION ALL SELECT variable, '(NULL)', n FROM lv WHERE value IS NULL"""


@query(prelude=CLAIMS, sql=_levels)
def claims_level_summary(spark, sf_dir):
    return profile.level_summary(claims(spark, sf_dir), ["dx1", "dx2", "form_cd"])


# --- projections and filters --------------------------------------------------


@query(prelude=CLAIMS, sql=f"""
SELECT subject_id, start_dt AS admitted, dx1 AS code, los, {KEYS}
FROM claims WHERE form_cd IN ('02') AND start_dt BETWEEN {START} AND {END} AND {PHENOTYPE} AND los >= 5 AND dx2 IS NOT NULL""")
def long_qualifying_stays(spark, sf_dir):
    """Projection with renames under a conjunction of range, list, pattern and null tests."""
    events = claims(spark, sf_dir).filter(
        logic.in_list("form_cd", ["02"]) & cohort.in_period(CONFIG) & cohort.qualifies(CONFIG)
        & (F.col("los") >= 5) & F.col("dx2").isNotNull()
    )
    out = events.select("subject_id", F.col("start_dt").alias("admitted"), "dx1", "los", "dx2", *CONFIG.order)
    return out.withColumnRenamed("dx1", "code").drop("dx2")


@query(prelude=CLAIMS, sql="""
SELECT CASE WHEN dx2 = 'I20' OR los > 7 THEN 'yes' WHEN NOT (dx2 = 'I20' OR los > 7) THEN 'no' ELSE 'unknown' END AS either,
       CASE WHEN dx2 = 'I20' AND los > 7 THEN 'yes' WHEN NOT (dx2 = 'I20' AND los > 7) THEN 'no' ELSE 'unknown' END AS both_hold,
       coalesce(dx2 IN ('E11', 'I10'), false) AS listed, count(*) AS n
FROM claims GROUP BY ALL""")
def three_valued_logic(spark, sf_dir):
    """OR and AND with unknowns, and list membership that is never unknown."""
    a, b = F.col("dx2") == "I20", F.col("los") > 7
    shown = {n: F.when(c, "yes").when(~c, "no").otherwise("unknown") for n, c in {"either": a | b, "both_hold": a & b}.items()}
    out = claims(spark, sf_dir).withColumns({**shown, "listed": logic.in_list("dx2", ["E11", "I10"])})
    return out.groupBy("either", "both_hold", "listed").agg(F.count("*").alias("n"))


@query(prelude=CLAIMS, sql=f"""
SELECT {r('avg(los)', 'los_mean')}, {r('avg(path_type)', 'path_type_mean')}, {r('avg(k5)', 'k5_mean')},
       {r('avg(CAST(dx2 IS NULL AS INT)) * 100', 'dx2_na_pct')}, {r('avg(CAST(los IS NULL AS INT)) * 100', 'los_na_pct')},
       min('claims') AS source, CAST(max(2) AS INT) AS batch FROM claims""")
def across_columns(spark, sf_dir):
    """One function over many columns, constants as tags, and columns added if missing."""
    events = columns.select_any(claims(spark, sf_dir), ["los", "path_type", "k5", "dx2", "not_there"])
    events = columns.add_missing(columns.tag(events, source="claims"), source=F.lit("other"), batch=F.lit(2))
    return rounded(events.agg(
        *columns.across(["los", "path_type", "k5"], F.avg, "{}_mean"),
        *columns.across(["dx2", "los"], lambda c: F.avg(F.col(c).isNull().cast("int")) * 100, "{}_na_pct"),
        F.min("source").alias("source"), F.max("batch").alias("batch"),
    ))


# --- scalar functions ---------------------------------------------------------


@query(prelude=CLAIMS, sql=f"""
SELECT {KEYS}, start_dt AS parsed, CAST(year(start_dt) AS INT) AS yr, CAST(date_trunc('month', start_dt) AS DATE) AS month_start,
       start_dt + los AS plus_los, start_dt - 180 AS minus_180, CAST(start_dt + INTERVAL 3 YEAR AS DATE) AS plus_3y,
       CAST(date_diff('day', start_dt, DATE '2001-12-31') AS INT) AS to_end, CAST(NULL AS DATE) AS bad_day,
       CAST(date_trunc('month', start_dt) AS DATE) AS ym_parsed
FROM claims""")
def date_functions(spark, sf_dir):
    """Parsing, truncation and arithmetic on every claim's date."""
    text = F.date_format("start_dt", "yyyyMMdd")
    return claims(spark, sf_dir).select(
        *CONFIG.order,
        dates.ymd(text).alias("parsed"),
        F.year("start_dt").alias("yr"),
        dates.month_start("start_dt").alias("month_start"),
        F.date_add("start_dt", F.col("los")).alias("plus_los"),
        F.date_sub("start_dt", 180).alias("minus_180"),
        dates.years_after("start_dt", 3).alias("plus_3y"),
        dates.days_between("start_dt", F.lit(CONFIG.study_end)).alias("to_end"),
        dates.ymd(F.concat(F.date_format("start_dt", "yyyy"), F.lit("1301"))).alias("bad_day"),
        dates.ym(F.date_format("start_dt", "yyyyMM")).alias("ym_parsed"),
    )


@query(prelude=CLAIMS, sql=f"""
SELECT {KEYS}, CASE WHEN los >= 5 THEN '>=5d' WHEN los < 5 THEN '<5d' END AS los5,
       CASE WHEN regexp_matches(dx1, '^I(2[0-9]|3[0-9]|4[0-9]|5[0-1])') THEN 'heart' WHEN regexp_matches(dx1, '^I6[0-9]') THEN 'cerebro' ELSE 'other' END AS dx_group,
       coalesce(dx2, 'none') AS dx2_filled, coalesce(los, 0) AS los_filled,
       CASE WHEN los IS NULL THEN NULL ELSE least(los, 7) END AS low, CASE WHEN los IS NULL THEN NULL ELSE greatest(0, los - 7) END AS high,
       substr(dx1, 1, 2) AS chapter, CASE path_type WHEN 11 THEN 'A' WHEN 12 THEN 'B' END AS path_label,
       CASE WHEN dx2 IS NOT NULL THEN 'Yes' ELSE 'No' END AS has_dx2,
       CASE WHEN los <= 3 THEN 'Q1' WHEN los <= 7 THEN 'Q2' WHEN los <= 11 THEN 'Q3' WHEN los <= 14 THEN 'Q4' END AS los_bin
FROM claims""")
def conditional_functions(spark, sf_dir):
    """Choices, fills, row-wise extremes and recodes with their NULL rules."""
    los = F.col("los")
    return claims(spark, sf_dir).select(
        *CONFIG.order,
        logic.if_else(los >= 5, F.lit(">=5d"), F.lit("<5d")).alias("los5"),
        logic.label_by_pattern("dx1", CONFIG.phenotypes).alias("dx_group"),
        F.coalesce("dx2", F.lit("none")).alias("dx2_filled"),
        F.coalesce(los, F.lit(0)).alias("los_filled"),
        logic.row_min(los, F.lit(7)).alias("low"),
        logic.row_max(F.lit(0), los - 7).alias("high"),
        F.substring("dx1", 1, 2).alias("chapter"),
        logic.recode("path_type", {11: "A", 12: "B"}).alias("path_label"),
        logic.yes_no(F.col("dx2").isNotNull()).alias("has_dx2"),
        logic.cut("los", [0, 3, 7, 11, 14], ["Q1", "Q2", "Q3", "Q4"]).alias("los_bin"),
    )


@query(prelude=CLAIMS, sql=f"""
SELECT {KEYS}, round_even(k5 / 8, 2) AS eighths, {r('k5 / 10', 'per_ten')}, {r('ln(k5)', 'log_value')},
       {r("round(((k3 + 1) / 7.0::DOUBLE) * pow(10::DOUBLE, 2 - floor(log10((k3 + 1) / 7.0::DOUBLE)))) / pow(10::DOUBLE, 2 - floor(log10((k3 + 1) / 7.0::DOUBLE)))", 'three_digits')},
       printf('%.1f%%', k5 / 2) AS pct_text, dx1 || '/' || coalesce(dx2, '-') AS codes
FROM claims""")
def number_functions(spark, sf_dir):
    """Rounding half to even, significant digits, logarithm, scaling and text."""
    return rounded(claims(spark, sf_dir).select(
        *CONFIG.order,
        numbers.round_even(F.col("k5") / 8, 2).alias("eighths"),
        (F.col("k5") / 10).alias("per_ten"),
        F.ln("k5").alias("log_value"),
        numbers.signif((F.col("k3") + 1) / F.lit(7.0), 3).alias("three_digits"),
        F.format_string("%.1f%%", F.col("k5") / 2).alias("pct_text"),
        F.concat("dx1", F.lit("/"), F.coalesce("dx2", F.lit("-"))).alias("codes"),
    ))


@query(prelude=CLAIMS, sql="""
SELECT DISTINCT dx2, CAST(CASE dx2 WHEN 'E11' THEN 1 WHEN 'I10' THEN 2 WHEN 'Z99' THEN 3 END AS INT) AS place
FROM claims WHERE dx2 IN ('E11', 'I10', 'Z99')""")
def levels_present(spark, sf_dir):
    """Levels of a factor that occur, with their place in the level list."""
    order = {"E11": 1, "I10": 2, "Z99": 3}
    return claims(spark, sf_dir).filter(F.col("dx2").isin(*order)).select("dx2").distinct().withColumn("place", logic.recode("dx2", order))


# --- joins and sets -----------------------------------------------------------


@query(prelude=CLAIMS, sql="SELECT sex, form_cd, count(*) AS n, count(death_yyyymm) AS n_died FROM claims JOIN person USING (subject_id) GROUP BY 1, 2")
def claims_with_persons(spark, sf_dir):
    """Claims merged with their person's attributes."""
    events = cohort.build_events(claims(spark, sf_dir), persons(spark, sf_dir), CONFIG)
    return events.groupBy("sex", "form_cd").agg(F.count("*").alias("n"), F.count("death_yyyymm").alias("n_died"))


@query(prelude=COHORT, sql="SELECT p.subject_id, p.sex, i.first_admit, i.index_code FROM person p LEFT JOIN idx i ON i.subject_id = p.subject_id")
def persons_with_index(spark, sf_dir):
    """Left join: persons without an index event stay, with NULLs."""
    people = persons(spark, sf_dir)
    index = cohort.index_event(claims(spark, sf_dir), people, CONFIG).select("subject_id", "first_admit", "index_code")
    return people.select("subject_id", "sex").join(index, "subject_id", "left")


@query(prelude=COHORT, sql="SELECT subject_id FROM person WHERE subject_id NOT IN (SELECT subject_id FROM idx)")
def persons_without_index(spark, sf_dir):
    """Anti join on an id set."""
    people = persons(spark, sf_dir)
    return sets.drop(people, sets.ids(cohort.index_event(claims(spark, sf_dir), people, CONFIG))).select("subject_id")


@query(prelude=CLAIMS, sql="SELECT subject_id FROM claims WHERE dx2 = 'C34' UNION SELECT subject_id FROM claims WHERE los IS NULL")
def id_set_union(spark, sf_dir):
    events = claims(spark, sf_dir)
    return sets.any_of(events.filter("dx2 = 'C34'").select("subject_id"), events.filter("los IS NULL").select("subject_id"))


@query(prelude=CLAIMS, sql="""
, a AS (SELECT DISTINCT subject_id, start_dt, start_dt + los AS discharge_dt FROM claims WHERE form_cd = '02'),
b AS (SELECT subject_id, start_dt, start_dt + los AS discharge_dt, dx1 FROM claims WHERE form_cd = '02')
SELECT a.subject_id, a.start_dt, a.discharge_dt, count(*) AS n, min(b.dx1) AS dx1 FROM a JOIN b
  ON a.subject_id = b.subject_id AND a.start_dt = b.start_dt AND a.discharge_dt IS NOT DISTINCT FROM b.discharge_dt GROUP BY 1, 2, 3""")
def nullable_key_join(spark, sf_dir):
    """Stays joined back to their claims on (person, admission, discharge), where an
    unknown discharge matches an unknown discharge."""
    stays = cohort.with_discharge(claims(spark, sf_dir), CONFIG).filter(cohort.inpatient(CONFIG))
    on = ["subject_id", "start_dt", "discharge_dt"]
    by_stay = stays.groupBy(*on).agg(F.count("*").alias("n"), F.min("dx1").alias("dx1"))
    return sets.null_safe_join(stays.select(*on).distinct(), by_stay, on, nullable=["discharge_dt"])


_grp = lambda c: f"(CASE WHEN regexp_matches({c}, '^I(2[0-9]|3[0-9]|4[0-9]|5[0-1])') THEN 'heart' WHEN regexp_matches({c}, '^I6[0-9]') THEN 'cerebro' END)"


@query(prelude=COHORT, sql=f"""
SELECT count(*) FILTER (dx1 = index_code OR dx2 = index_code) AS exact,
       count(*) FILTER (substr(dx1, 1, 3) = substr(index_code, 1, 3) OR substr(dx2, 1, 3) = substr(index_code, 1, 3)) AS prefix3,
       count(*) FILTER ({_grp('dx1')} = {_grp('index_code')} OR {_grp('dx2')} = {_grp('index_code')}) AS "group" FROM linked""")
def code_match_modes(spark, sf_dir):
    """Claims that share the index diagnosis under each matching rule."""
    events, people = claims(spark, sf_dir), persons(spark, sf_dir)
    linked = cohort.link(events, cohort.index_event(events, people, CONFIG), CONFIG)
    return linked.agg(*[
        F.count_if(logic.code_match(["dx1", "dx2"], "index_code", mode, CONFIG.phenotypes)).alias(mode)
        for mode in ("exact", "prefix3", "group")
    ])


# --- aggregates and first rows ------------------------------------------------


@query(prelude=CLAIMS, sql="SELECT form_cd, count(*) AS n FROM claims GROUP BY 1")
def claims_by_form(spark, sf_dir):
    return profile.group_counts(claims(spark, sf_dir), "form_cd")


@query(prelude=CLAIMS, sql="""
SELECT subject_id, start_dt, start_dt + CASE WHEN form_cd = '02' THEN los END AS discharge_dt,
       coalesce(bool_or(dx1 = 'I20' OR dx2 = 'I20'), false) AS any_angina, count(*) FILTER (form_cd <> '02') AS n_other,
       count(DISTINCT dx1) AS n_codes, CAST(max(los) AS INT) AS longest
FROM claims GROUP BY 1, 2, 3""")
def stays_by_key(spark, sf_dir):
    """Claims grouped by person, admission and (possibly unknown) discharge."""
    events = cohort.with_discharge(claims(spark, sf_dir), CONFIG)
    return events.groupBy("subject_id", "start_dt", "discharge_dt").agg(
        logic.any_true((F.col("dx1") == "I20") | (F.col("dx2") == "I20")).alias("any_angina"),
        F.count_if(F.col("form_cd") != "02").alias("n_other"),
        F.count_distinct("dx1").alias("n_codes"),
        F.max("los").alias("longest"),
    )


@query(prelude=CLAIMS, sql=f"""
SELECT form_cd, {r('quantile_cont(los::DOUBLE, 0.25)', 'q1')}, {r('quantile_cont(los::DOUBLE, 0.5)', 'median')},
       {r('quantile_cont(los::DOUBLE, 0.9)', 'p90')} FROM claims GROUP BY 1""")
def los_quantiles_by_form(spark, sf_dir):
    """Exact quantiles from collapsed counts, per group."""
    counts = quantiles.collapse(claims(spark, sf_dir).select("form_cd", F.col("los").alias("value")), ["form_cd"])
    return rounded(quantiles.exact_quantiles(counts, ["form_cd"], {"q1": 0.25, "median": 0.5, "p90": 0.9}))


@query(prelude=CLAIMS, sql=f"""
SELECT {r('avg(CAST(dx2 IS NULL AS INT)) * 100', 'dx2_na_pct')}, {r('avg(CAST(los IS NULL AS INT)) * 100', 'los_na_pct')} FROM claims""")
def missing_rates(spark, sf_dir):
    return rounded(profile.missing_rates(claims(spark, sf_dir), ["dx2", "los"]))


@query(prelude=CLAIMS, sql=f"""
SELECT subject_id, start_dt, dx1, los FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY start_dt, {KEYS}) AS rn FROM claims) WHERE rn = 1""")
def first_claim(spark, sf_dir):
    return select.first_per_key(claims(spark, sf_dir), "subject_id", ["start_dt", *CONFIG.order], ["start_dt", "dx1", "los"])


@query(prelude=CLAIMS, sql=f"""
SELECT subject_id, start_dt, dx1, los FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY start_dt DESC, los ASC NULLS LAST, {KEYS}) AS rn FROM claims) WHERE rn = 1""")
def last_claim(spark, sf_dir):
    return select.first_per_key(claims(spark, sf_dir), "subject_id", ["-start_dt", "los", *CONFIG.order], ["start_dt", "dx1", "los"])


@query(prelude=CLAIMS, sql="""
SELECT subject_id, start_dt, CAST(date_diff('day', start_dt, lead(start_dt) OVER (PARTITION BY subject_id ORDER BY start_dt)) AS INT) AS gap_days
FROM (SELECT DISTINCT subject_id, start_dt FROM claims WHERE form_cd = '02')""")
def gaps_between_admissions(spark, sf_dir):
    """Days to the person's next distinct admission day."""
    days = claims(spark, sf_dir).filter(cohort.inpatient(CONFIG)).select("subject_id", "start_dt").distinct()
    return select.gap_to_next(days, "subject_id", "start_dt")


@query(prelude=CLAIMS, sql="""
SELECT 0 AS source_seq, count(*) FILTER (form_cd <> '03') AS n_rows, count(*) FILTER (form_cd = '03') AS n_bad, count(*) FILTER (form_cd = '03') AS n_quarantined FROM claims""")
def malformed_rows(spark, sf_dir):
    """Claims written as CSV with one field of every third-form claim broken: rows read, lines left
    out, and lines in the quarantine."""
    events = claims(spark, sf_dir)
    raw = events.select(
        F.col("subject_id").cast("string").alias("RN_INDI"), F.date_format("start_dt", "yyyyMMdd").alias("MDCARE_STRT_DT"), F.col("form_cd").alias("FORM_CD"),
        F.when(F.col("form_cd") == "03", F.lit("x7")).otherwise(F.col("los").cast("string")).alias("VSHSP_DD_CNT"),
    )
    path = work.scratch_path(spark)
    tables.write_table(raw, path)
    report = tables.file_report(spark, path, tables.CLAIM_SCHEMA).groupBy("source_seq").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bad").alias("n_bad"))
    left_out = tables.quarantine(spark, path, tables.CLAIM_SCHEMA).groupBy("source_seq").agg(F.count("*").alias("n_quarantined"))
    return report.join(left_out, "source_seq", "left").na.fill(0, ["n_quarantined"])
