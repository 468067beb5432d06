"""Table 1 over the included persons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sojourn import features
from sojourn.config import CATEGORICAL, CONTINUOUS, EXACT, GROUPS, LEVELS, NONNORMAL
from sojourn.operators.work import scratch_path, settle
from sojourn.queries.cohorts import analysis, people_table
from sojourn.queries.reference_sql import COHORT, END, chi2_sf, f_sf, r
from sojourn.queries.registry import query, rounded
from sojourn.sources.binding import CONFIG
from sojourn.sources.tables import write_table
from sojourn.stats import profile, tableone


def subjects(spark, sf_dir, *names):
    """The variables of the table, written once: every test below reads it again."""
    people = features.person_features(people_table(spark, sf_dir), CONFIG)
    return settle(people.select(*(names or ("subject_id", "group", *CONTINUOUS, *CATEGORICAL))))


_long = ", long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, grp, {c}::DOUBLE AS value FROM tbl" for c in CONTINUOUS) + ")"
_levels = ", lev AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, grp, CAST({c} AS VARCHAR) AS level FROM tbl WHERE {c} IS NOT NULL" for c in CATEGORICAL
) + """), cell AS (
SELECT variable, level, count(*) FILTER (grp = 'nonreadmit') AS n0, count(*) FILTER (grp = 'readmit') AS n1 FROM lev GROUP BY 1, 2
), cells AS (
SELECT *, sum(n0) OVER (PARTITION BY variable)::DOUBLE AS t0, sum(n1) OVER (PARTITION BY variable)::DOUBLE AS t1,
       count(*) OVER (PARTITION BY variable) AS n_levels FROM cell)"""

_moments = f"""count(value) AS n, count(*) - count(value) AS n_missing, {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'sd')},
       min(value) AS min, max(value) AS max, {r('quantile_cont(value, 0.25)', 'q1')}, {r('quantile_cont(value, 0.5)', 'median')},
       {r('quantile_cont(value, 0.75)', 'q3')}"""


@query(prelude=COHORT, sql=f"{_long} SELECT variable, grp, {_moments} FROM long GROUP BY 1, 2")
def table1_continuous(spark, sf_dir):
    """Mean, SD, median and quartiles by group."""
    return rounded(tableone.continuous(subjects(spark, sf_dir, "group", *CONTINUOUS), CONTINUOUS, "group"))


@query(prelude=COHORT, sql=f"{_long} SELECT variable, 'Overall' AS grp, {_moments} FROM long GROUP BY 1")
def table1_continuous_overall(spark, sf_dir):
    return rounded(tableone.continuous(subjects(spark, sf_dir, *CONTINUOUS), CONTINUOUS))


@query(prelude=COHORT, sql=f"""{_levels}
SELECT variable, level, 'nonreadmit' AS grp, n0 AS n, {r('n0 * 100.0::DOUBLE / nullif(t0, 0)', 'pct')} FROM cells
UNION ALL SELECT variable, level, 'readmit', n1, {r('n1 * 100.0::DOUBLE / nullif(t1, 0)', 'pct')} FROM cells""")
def table1_categorical(spark, sf_dir):
    """Counts and column percentages by group, with zero cells."""
    return rounded(tableone.categorical(subjects(spark, sf_dir, "group", *CATEGORICAL), CATEGORICAL, "group", GROUPS))


@query(prelude=COHORT, sql=f"""{_levels}
SELECT variable, level, 'Overall' AS grp, n0 + n1 AS n, {r('(n0 + n1) * 100.0::DOUBLE / (t0 + t1)', 'pct')} FROM cells""")
def table1_categorical_overall(spark, sf_dir):
    return rounded(tableone.categorical(subjects(spark, sf_dir, *CATEGORICAL), CATEGORICAL))


@query(prelude=COHORT, sql="SELECT grp AS \"group\", count(*) AS n FROM tbl GROUP BY 1")
def group_sizes(spark, sf_dir):
    return profile.group_counts(subjects(spark, sf_dir, "group"), "group")


@query(prelude=COHORT, sql=f"""SELECT {r('avg(CAST(age_index IS NULL AS INT)) * 100', 'age_index_na_pct')},
       {r('avg(CAST(los IS NULL AS INT)) * 100', 'los_na_pct')}, {r('avg(CAST(diff_days IS NULL AS INT)) * 100', 'diff_days_na_pct')} FROM tbl""")
def subject_missing_rates(spark, sf_dir):
    names = ["age_index", "los", "diff_days"]
    return rounded(profile.missing_rates(subjects(spark, sf_dir, *names), names))


_anova = f"""{_long}, g AS (SELECT variable, grp, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM long WHERE variable = 'age_index' GROUP BY 1, 2),
gm AS (SELECT variable, sum(n * m) / sum(n) AS gm FROM g GROUP BY 1),
s AS (SELECT g.variable, sum(n * (m - gm) * (m - gm)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))) AS statistic,
      CAST(count(*) - 1 AS INT) AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2 FROM g JOIN gm ON g.variable = gm.variable GROUP BY 1)"""


@query(prelude=COHORT, sql=f"{_anova} SELECT variable, 'anova' AS test, {r('statistic', 'statistic')}, df1, df2, {r(f_sf('statistic', 'df1', 'df2'), 'p')} FROM s")
def table1_anova(spark, sf_dir):
    return rounded(tableone.anova(subjects(spark, sf_dir, "group", "age_index"), ["age_index"], "group", GROUPS))


_kruskal = f"""{_long}, ranked AS (
SELECT variable, grp, value, rank() OVER (PARTITION BY variable ORDER BY value) + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0::DOUBLE AS rk
FROM long WHERE value IS NOT NULL AND variable <> 'age_index'),
ties AS (SELECT variable, sum(t * t * t - t) AS ties, sum(t) AS n FROM (SELECT variable, value, count(*)::DOUBLE AS t FROM ranked GROUP BY 1, 2) GROUP BY 1),
gr AS (SELECT variable, grp, sum(rk) AS rs, count(*) AS c FROM ranked GROUP BY 1, 2),
k AS (SELECT gr.variable, CAST(count(*) - 1 AS INT) AS df1, CASE WHEN count(*) > 1 THEN
      (12 / (any_value(n) * (any_value(n) + 1)) * sum(rs * rs / c) - 3 * (any_value(n) + 1)) / (1 - any_value(ties) / (any_value(n) ** 3 - any_value(n))) END AS statistic
      FROM gr JOIN ties ON ties.variable = gr.variable GROUP BY 1)"""


@query(prelude=COHORT, sql=f"{_kruskal} SELECT variable, 'kruskal' AS test, {r('statistic', 'statistic')}, df1, {r(chi2_sf('statistic', 'df1'), 'p')} FROM k")
def table1_kruskal(spark, sf_dir):
    return rounded(tableone.kruskal(subjects(spark, sf_dir, "group", *NONNORMAL), NONNORMAL, "group", GROUPS))


_chi = f"""{_levels}, x AS (
SELECT variable, n_levels, unnest([n0, n1]) AS o, unnest([(n0 + n1) * t0 / (t0 + t1), (n0 + n1) * t1 / (t0 + t1)]) AS e FROM cells),
chi AS (SELECT variable, CAST(any_value(n_levels) - 1 AS INT) AS df1,
        sum(CASE WHEN e > 0 THEN (abs(o - e) - CASE WHEN n_levels = 2 THEN least(0.5, abs(o - e)) ELSE 0 END) ** 2 / e END) AS statistic FROM x GROUP BY 1)"""


@query(prelude=COHORT, sql=f"{_chi} SELECT variable, 'chisq' AS test, {r('statistic', 'statistic')}, df1, {r(chi2_sf('statistic', 'df1'), 'p')} FROM chi")
def table1_chi_square(spark, sf_dir):
    return rounded(tableone.chi_square(subjects(spark, sf_dir, "group", *CATEGORICAL), CATEGORICAL, "group", GROUPS))


_fisher = f"""{_levels}, f AS (SELECT variable, arg_min(n0, level) AS a, arg_min(n0 + n1, level) AS rr, any_value(t0) AS c0, any_value(t0 + t1) AS n
       FROM cells WHERE n_levels = 2 AND variable IN ('sex_f', 'er_flag', 'death_flag', 'index_dx_group_f') GROUP BY 1),
pts AS (SELECT variable, a, rr, c0, n, unnest(range(CAST(greatest(0, rr + c0 - n) AS BIGINT), CAST(least(rr, c0) AS BIGINT) + 1)) AS i FROM f),
lp AS (SELECT variable, a, i, lgamma(rr + 1) + lgamma(n - rr + 1) + lgamma(c0 + 1) + lgamma(n - c0 + 1) - lgamma(n + 1)
       - lgamma(i + 1) - lgamma(rr - i + 1) - lgamma(c0 - i + 1) - lgamma(n - rr - c0 + i + 1) AS l FROM pts),
fisher AS (SELECT p.variable, least(1.0::DOUBLE, sum(CASE WHEN p.l <= o.l + 1e-7 THEN exp(p.l) ELSE 0 END)) AS p
       FROM lp p JOIN lp o ON o.variable = p.variable AND o.i = o.a GROUP BY 1)"""


@query(prelude=COHORT, sql=f"{_fisher} SELECT variable, 'fisher' AS test, {r('p', 'p')} FROM fisher")
def table1_fisher(spark, sf_dir):
    return rounded(tableone.fisher(subjects(spark, sf_dir, "group", *EXACT), EXACT, "group", GROUPS).select("variable", "test", "p"))


_smd_cont = f"""{_long}, m AS (SELECT variable, avg(value) FILTER (grp = 'nonreadmit') AS m0, avg(value) FILTER (grp = 'readmit') AS m1,
       var_samp(value) FILTER (grp = 'nonreadmit') AS v0, var_samp(value) FILTER (grp = 'readmit') AS v1 FROM long GROUP BY 1),
smd_cont AS (SELECT variable, CASE WHEN v0 + v1 > 0 THEN abs(m0 - m1) / sqrt((v0 + v1) / 2) END AS smd FROM m)"""

_smd_cat = f"""{_levels}, pr AS (SELECT *, n0 / t0 AS p1, n1 / t1 AS p2, max(level) OVER (PARTITION BY variable) AS last FROM cells),
six AS (SELECT variable, sum((p1 - p2) ** 2 / ((p1 + p2) / 2)) AS dd, sum((p1 - p2) * p1 / ((p1 + p2) / 2)) AS d1, sum((p1 - p2) * p2 / ((p1 + p2) / 2)) AS d2,
       sum(p1 * p1 / ((p1 + p2) / 2)) AS c11, sum(p1 * p2 / ((p1 + p2) / 2)) AS c12, sum(p2 * p2 / ((p1 + p2) / 2)) AS c22 FROM pr WHERE level < last GROUP BY 1),
smd_cat AS (SELECT variable, sqrt(greatest(0, dd + ((2 - c22) * d1 * d1 + 2 * c12 * d1 * d2 + (2 - c11) * d2 * d2) / ((2 - c11) * (2 - c22) - c12 * c12))) AS smd FROM six)"""


@query(prelude=COHORT, sql=f"{_smd_cont} SELECT variable, {r('smd', 'smd')} FROM smd_cont")
def table1_smd_continuous(spark, sf_dir):
    return rounded(tableone.smd_continuous(subjects(spark, sf_dir, "group", *CONTINUOUS), CONTINUOUS, "group", GROUPS))


@query(prelude=COHORT, sql=f"{_smd_cat} SELECT variable, {r('smd', 'smd')} FROM smd_cat")
def table1_smd_categorical(spark, sf_dir):
    return rounded(tableone.smd_categorical(subjects(spark, sf_dir, "group", *CATEGORICAL), CATEGORICAL, "group", GROUPS))


def _rest(sql: str) -> str:
    """The steps of a query after its shared long or level tables."""
    for shared in (_long, _levels):
        sql = sql.replace(shared, "", 1)
    return sql


_all_tests = (
    _anova + _rest(_kruskal) + _chi + _rest(_fisher) + _rest(_smd_cont) + _rest(_smd_cat)
    + f""", tests AS (
SELECT variable, 'anova' AS test, statistic, {f_sf('statistic', 'df1', 'df2')} AS p, df1 FROM s
UNION ALL SELECT variable, 'kruskal', statistic, {chi2_sf('statistic', 'df1')}, df1 FROM k
UNION ALL SELECT variable, 'chisq', statistic, {chi2_sf('statistic', 'df1')}, df1 FROM chi WHERE variable NOT IN (SELECT variable FROM fisher)
UNION ALL SELECT variable, 'fisher', NULL, p, NULL FROM fisher
), smds AS (SELECT * FROM smd_cont UNION ALL SELECT * FROM smd_cat)"""
)


@query(prelude=COHORT, sql=f"{_all_tests} SELECT t.variable, test, {r('statistic', 'statistic')}, df1, {r('p', 'p')}, {r('smd', 'smd')} FROM tests t LEFT JOIN smds ON smds.variable = t.variable")
def table1_comparison(spark, sf_dir):
    """Every variable's test, p and standardised difference."""
    return rounded(tableone.comparison(subjects(spark, sf_dir), CONTINUOUS, CATEGORICAL, NONNORMAL, EXACT, "group", GROUPS))


def _cells(where: str, label: str) -> str:
    cont = reduce(lambda a, b: f"{a} UNION ALL {b}", [
        f"""SELECT '{c}' AS variable, '' AS level, '{label}' AS g, CASE WHEN count({c}) = 0 THEN 'NA' ELSE """
        + (f"printf('%.2f [%.2f, %.2f]', quantile_cont({c}::DOUBLE, 0.5), quantile_cont({c}::DOUBLE, 0.25), quantile_cont({c}::DOUBLE, 0.75))"
           if c in NONNORMAL else f"printf('%.2f (%.2f)', avg({c}), stddev_samp({c}))")
        + f" END AS cell FROM tbl WHERE {where}"
        for c in CONTINUOUS
    ])
    return f"SELECT 'n' AS variable, '' AS level, '{label}' AS g, CAST(count(*) AS VARCHAR) AS cell FROM tbl WHERE {where} UNION ALL {cont}"


_position = "CAST(CASE variable " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(["n", *CONTINUOUS, *CATEGORICAL])) + " END AS INT) AS position"


_label = "CASE variable WHEN 'n' THEN 'n' " + " ".join(
    f"WHEN '{v}' THEN '{v} ({'%' if v in CATEGORICAL else 'median [IQR]' if v in NONNORMAL else 'mean (SD)'})'" for v in (*CONTINUOUS, *CATEGORICAL)
) + " END AS label"
_given = "CASE " + " ".join(f"WHEN variable = '{v}' AND level = '{x}' THEN {i}" for v, listed in LEVELS.items() for i, x in enumerate(listed)) + " END"
_level_position = f"CAST(row_number() OVER (PARTITION BY variable ORDER BY {_given} ASC NULLS LAST, level) - 1 AS INT) AS level_position"


@query(prelude=COHORT, sql=f"""{_levels}, shown AS ({_cells('true', 'Overall')}
UNION ALL SELECT variable, level, 'Overall', printf('%d (%.1f)', n0 + n1, (n0 + n1) * 100.0::DOUBLE / (t0 + t1)) FROM cells)
SELECT variable, level, cell AS "Overall", {_position}, {_label}, {_level_position} FROM shown""")
def table1_overall_display(spark, sf_dir):
    """The printed table for all persons together."""
    people = subjects(spark, sf_dir)
    return tableone.display(people, CONTINUOUS, CATEGORICAL, NONNORMAL, EXACT, None, GROUPS, levels=LEVELS)


_text = lambda c: f"CASE WHEN {c} IS NULL THEN 'NA' WHEN {c} < 0.001 THEN '<0.001' ELSE printf('%.3f', {c}) END"


_display = f"""{_all_tests}, shown AS ({_cells("grp = 'nonreadmit'", 'nonreadmit')} UNION ALL {_cells("grp = 'readmit'", 'readmit')}
UNION ALL SELECT variable, level, 'nonreadmit', printf('%d (%.1f)', n0, n0 * 100.0::DOUBLE / t0) FROM cells
UNION ALL SELECT variable, level, 'readmit', printf('%d (%.1f)', n1, n1 * 100.0::DOUBLE / t1) FROM cells),
flat AS (SELECT variable, level, max(cell) FILTER (g = 'nonreadmit') AS nonreadmit, max(cell) FILTER (g = 'readmit') AS readmit FROM shown GROUP BY 1, 2),
wide AS (SELECT *, {_position}, {_label}, {_level_position} FROM flat),
printed AS (SELECT w.variable, w.level, nonreadmit, readmit, w.position, w.label, w.level_position,
       CASE WHEN level_position = 0 AND w.variable <> 'n' THEN {_text('p')} END AS p,
       CASE WHEN level_position = 0 THEN CASE test WHEN 'kruskal' THEN 'nonnorm' WHEN 'fisher' THEN 'exact' WHEN 'anova' THEN '' WHEN 'chisq' THEN '' END END AS test,
       CASE WHEN level_position = 0 AND w.variable <> 'n' THEN {_text('smd')} END AS smd
FROM wide w LEFT JOIN tests t ON t.variable = w.variable LEFT JOIN smds ON smds.variable = w.variable)"""


@query(prelude=COHORT, sql=f"{_display} SELECT * FROM printed")
def table1_display(spark, sf_dir):
    """The printed comparison table."""
    return tableone.display(subjects(spark, sf_dir), CONTINUOUS, CATEGORICAL, NONNORMAL, EXACT, "group", GROUPS, levels=LEVELS)


@query(prelude=COHORT, sql=f"""{_display}
SELECT CAST(row_number() OVER (ORDER BY position, level_position) AS INT) AS row_no, label, level, nonreadmit, readmit,
       coalesce(p, '') AS p, coalesce(test, '') AS test, coalesce(smd, '') AS smd FROM printed""")
def table1_file(spark, sf_dir):
    """The printed table with row labels, written as CSV in display order and read back;
    a file has blank cells where there is nothing to print."""
    shown = table1_display(spark, sf_dir)
    in_order = Window.orderBy("position", "level_position")  # one row per printed line
    lines = shown.select(F.row_number().over(in_order).alias("row_no"), "label", "level", "nonreadmit", "readmit", "p", "test", "smd")
    path = scratch_path(spark)
    write_table(lines, path, "csv")
    return spark.read.schema(lines.schema).csv(path, header=True, enforceSchema=False).na.fill("")


@query(prelude=COHORT, sql="SELECT count(*) AS n_rows, count(DISTINCT subject_id) AS n_ids FROM tbl")
def subject_counts(spark, sf_dir):
    return profile.counts(analysis(spark, sf_dir), "subject_id")


SUMMARISED = ("age_index", "los", "n_same_dx", "gap_days", "prior_other_n", "prior_emergency_n", "prior_inpatient_n")
LISTED = ("index_code", "index_dx_group_f", "form_cd", "dx2", "sex_f", "er_flag", "path_type_f", "result_type_f", "index_year_f", "death_flag", "group")
_gap = "date_diff('day', first_admit, CASE WHEN readmit_flag = 1 THEN last_readmit_dt ELSE " + END + " END)"
_summary_of = {"gap_days": _gap, "group": "grp"}
_numbers = " UNION ALL ".join(
    f"SELECT '{c}' AS variable, ({_summary_of.get(c, c)})::DOUBLE AS value FROM tbl" for c in SUMMARISED
)
_listed = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({_summary_of.get(c, c)} AS VARCHAR) AS value FROM tbl" for c in LISTED)


@query(prelude=COHORT, sql=f""", nv AS ({_numbers})
SELECT variable, min(value) AS min, {r('avg(value)', 'mean')}, max(value) AS max, count(*) - count(value) AS n_missing,
       {r('quantile_cont(value, 0.25)', 'q1')}, {r('quantile_cont(value, 0.5)', 'median')}, {r('quantile_cont(value, 0.75)', 'q3')} FROM nv GROUP BY 1""")
def analysis_summary(spark, sf_dir):
    """Numeric columns of the whole analysis table."""
    return rounded(profile.numeric_summary(_analysis_features(spark, sf_dir, *SUMMARISED), SUMMARISED))


@query(prelude=COHORT, sql=f""", lv AS (SELECT variable, value, count(*) AS n FROM ({_listed}) GROUP BY 1, 2), pl AS (
SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, value ASC) AS place,
       count(*) OVER (PARTITION BY variable) AS n_levels FROM lv WHERE value IS NOT NULL)
SELECT variable, CASE WHEN n_levels > 7 AND place > 6 THEN '(Other)' ELSE value END AS level, CAST(sum(n) AS BIGINT) AS n FROM pl GROUP BY 1, 2
UNION ALL SELECT variable, '(NULL)', n FROM lv WHERE value IS NULL""")
def analysis_level_summary(spark, sf_dir):
    """Levels of the text and factor columns of the whole analysis table."""
    return profile.level_summary(_analysis_features(spark, sf_dir, *LISTED), LISTED)


def _analysis_features(spark, sf_dir, *names):
    """Columns of the analysis table, written once, as a summary reads them more than once."""
    return settle(analysis(spark, sf_dir).select(*names))
