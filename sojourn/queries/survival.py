"""Kaplan-Meier, log-rank, Cox models and what is read off them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sojourn import features, lookback, tte
from sojourn.config import COMORBIDITIES, LANDMARK_DAYS, LANDMARK_LABELS
from sojourn.functions.dates import ym
from sojourn.operators.work import settle
from sojourn.plans import study
from sojourn.queries.cohorts import horizon_table
from sojourn.queries.reference_sql import COHORT, END, chi2_sf, cox_steps, hazard_columns, ldl, r, solve
from sojourn.queries.registry import query, rounded
from sojourn.sources.binding import CONFIG, claims, persons
from sojourn.stats import concordance, cox, forest, incidence, km, logrank, zph

SEX = cox.Factor("sex_f", ("M", "F"))
HX = [cox.Factor(name, ("No", "Yes")) for name in COMORBIDITIES]
HTN = cox.Factor("hx_htn", ("No", "Yes"))
MAIN = ["age10", SEX, "los", HTN]
STAYS = ("<5d", ">=5d")


def followup(spark, sf_dir):
    """Time and event per person with the length-of-stay split."""
    return horizon_table(spark, sf_dir).withColumn("los5", features.long_stay(CONFIG))


def model_table(spark, sf_dir):
    """Time, event and covariates, written once: models read it on every step."""
    people = study.survival_table(claims(spark, sf_dir), persons(spark, sf_dir), CONFIG)
    return settle(people.select("subject_id", "time", "event", "age10", "sex_f", "los", *COMORBIDITIES))


def _km(by: str = "") -> str:
    part, cols = (f"PARTITION BY {by}", f"{by}, ") if by else ("", "")
    return f""", kc AS (SELECT {cols}"time", count(*) AS c, CAST(sum(event) AS BIGINT) AS d FROM surv GROUP BY {cols}"time"),
kr AS (SELECT *, CAST(sum(c) OVER ({part} ORDER BY "time" DESC) AS BIGINT) AS n FROM kc),
km AS (SELECT {cols}"time", n AS n_risk, d AS n_event, c - d AS n_censor,
       CASE WHEN max(CAST(d = n AS INT)) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w) END AS surv,
       sum(CASE WHEN d < n THEN d / (n * (n - d)) ELSE 0 END) OVER w AS gw, sum(d / n) OVER w AS na
       FROM kr WINDOW w AS ({part} ORDER BY "time"))"""


_curve = f"""n_risk, n_event, n_censor, {r('surv', 'surv')}, {r('surv * sqrt(gw)', 'std_err')}, {r('exp(ln(surv) - 1.959963984540054 * sqrt(gw))', 'lower')},
       {r('least(1.0::DOUBLE, exp(ln(surv) + 1.959963984540054 * sqrt(gw)))', 'upper')}, {r('1 - surv', 'risk')}, {r('-ln(surv)', 'hazard')}, {r('na', 'hazard_na')}"""


@query(prelude=COHORT, sql=f"{_km()} SELECT \"time\", {_curve} FROM km")
def km_overall(spark, sf_dir):
    """Survival, standard error, limits, cumulative incidence and cumulative hazards."""
    return rounded(km.kaplan_meier(followup(spark, sf_dir)))


@query(prelude=COHORT, sql=f"{_km('los5')} SELECT los5, \"time\", {_curve} FROM km")
def km_by_length_of_stay(spark, sf_dir):
    return rounded(km.kaplan_meier(followup(spark, sf_dir), ["los5"]))


def _landmarks(times, extend: bool) -> str:
    keep = "" if extend else 'WHERE t <= (SELECT max("time") FROM km)'
    return f"""{_km()}, pts AS (SELECT unnest([{', '.join(map(str, times))}]) AS t), marks AS (
SELECT CAST(t AS INT) AS "time", (SELECT count(*) FROM surv WHERE "time" >= t) AS n_risk,
       coalesce((SELECT arg_max(surv, "time") FROM km WHERE "time" <= t), 1.0::DOUBLE) AS s FROM pts {keep})"""


@query(prelude=COHORT, sql=f"{_landmarks(LANDMARK_DAYS, False)} SELECT \"time\", n_risk, {r('s', 'surv')}, {r('1 - s', 'risk')} FROM marks")
def km_landmarks(spark, sf_dir):
    """Readmission-free share and cumulative risk at the landmark days."""
    return rounded(km.landmarks(km.kaplan_meier(followup(spark, sf_dir)), LANDMARK_DAYS))


@query(prelude=COHORT, sql=f"{_landmarks(LANDMARK_DAYS, False)} SELECT \"time\", round_even(s, 3) AS surv, round_even(1 - s, 3) AS risk FROM marks")
def km_landmarks_report(spark, sf_dir):
    """The landmark days as reported, at three decimals."""
    points = km.landmarks(km.kaplan_meier(followup(spark, sf_dir)), LANDMARK_DAYS)
    return forest.presentation(points.select("time", "surv", "risk"), {"surv": 3, "risk": 3}, {})


EXTENDED = (30, 90, 365, 730, 1094, 2000)


@query(prelude=COHORT, sql=f"{_landmarks(EXTENDED, True)} SELECT \"time\", n_risk, {r('s', 'surv')}, {r('1 - s', 'risk')} FROM marks")
def km_landmarks_extended(spark, sf_dir):
    """Landmarks past the last follow-up carry its value on."""
    return rounded(km.landmarks(km.kaplan_meier(followup(spark, sf_dir)), EXTENDED, extend=True))


@query(prelude=COHORT, sql=f"""{_landmarks(LANDMARK_DAYS, False)}
SELECT "time", CASE "time" WHEN 30 THEN '30d' WHEN 90 THEN '90d' WHEN 365 THEN '1y' WHEN 730 THEN '2y' ELSE '3y' END AS label,
       {r('(1 - s) * 100', 'risk_pct')}, printf('%.1f%%', (1 - s) * 100) AS risk_text FROM marks""")
def landmark_labels(spark, sf_dir):
    points = km.landmarks(km.kaplan_meier(followup(spark, sf_dir)), LANDMARK_DAYS)
    return rounded(km.landmark_labels(points, LANDMARK_LABELS))


_breaks = "(SELECT CAST(unnest([0, 365, 730, 1095]) AS INT) AS t)"


@query(prelude=COHORT, sql=f"SELECT los5, t AS \"time\", count(*) FILTER (\"time\" >= t) AS n_risk FROM surv, {_breaks} GROUP BY 1, 2")
def risk_table(spark, sf_dir):
    """Number at risk each year, by length of stay."""
    return km.risk_table(followup(spark, sf_dir), [0, 365, 730, 1095], ["los5"])


def _logrank(by: str, levels) -> str:
    listed = ", ".join(f"'{v}'" for v in levels)
    return f""", lt AS (SELECT DISTINCT "time" AS t FROM surv WHERE event = 1),
lg AS (SELECT t, gname, (SELECT count(*) FROM surv WHERE "time" >= t AND {by} = gname) AS ng, (SELECT count(*) FROM surv WHERE "time" >= t) AS n,
       (SELECT count(*) FROM surv WHERE "time" = t AND event = 1 AND {by} = gname) AS dg, (SELECT count(*) FROM surv WHERE "time" = t AND event = 1) AS d
       FROM lt, (SELECT unnest([{listed}]) AS gname)),
lr AS (SELECT gname, sum(dg) AS o, sum(d * ng / n) AS e, sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * ng / n * (1 - ng / n) ELSE 0 END) AS v FROM lg GROUP BY 1)"""


@query(prelude=COHORT, sql=f"""{_logrank('los5', STAYS)}
SELECT {r('(o - e) ** 2 / v', 'chisq')}, 1 AS df, {r(chi2_sf('(o - e) ** 2 / v', '1'), 'p')} FROM lr WHERE gname = '<5d'""")
def logrank_by_length_of_stay(spark, sf_dir):
    return rounded(logrank.logrank_test(followup(spark, sf_dir), "los5", STAYS))


YEARS = tuple(str(y) for y in range(1996, 2002))


@query(prelude=COHORT, sql=f"""{_logrank('index_year_f', YEARS)}
SELECT gname AS index_year_f, CAST(o AS BIGINT) AS observed, {r('e', 'expected')}, {r('v', 'variance')},
       (SELECT count(*) FROM surv WHERE index_year_f = gname) AS n FROM lr WHERE gname IN (SELECT index_year_f FROM surv)""")
def logrank_table_by_year(spark, sf_dir):
    """Observed and expected events by index year."""
    people = followup(spark, sf_dir).withColumn("index_year_f", F.year("first_admit").cast("string"))
    return rounded(logrank.logrank_table(people, "index_year_f", YEARS).filter("n IS NOT NULL"))


# --- Cox ----------------------------------------------------------------------

_X = {"age10": "age10", "los": "los", "sex_f": "CASE sex_f WHEN 'F' THEN 1 WHEN 'M' THEN 0 END"}
_X.update({name: f"CASE {name} WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END" for name in COMORBIDITIES})


def _sweep(names) -> str:
    """Newton's method for one covariate, all variables in one recursion."""
    rows = " UNION ALL ".join(f"SELECT '{n}' AS var, \"time\", event, ({_X[n]})::DOUBLE AS x FROM surv" for n in names)
    return f""", s AS ({rows}), mu AS (SELECT var, avg(x) AS m FROM s GROUP BY 1),
g AS (SELECT s.var, "time", event, x - m AS x, count(*)::DOUBLE AS n FROM s JOIN mu ON mu.var = s.var WHERE x IS NOT NULL GROUP BY ALL),
ft AS (SELECT var, "time" AS t, CAST(sum(n) AS INT) AS d, sum(n * x) AS sx FROM g WHERE event = 1 GROUP BY 1, 2),
pf AS (SELECT var, t, d, sx, unnest(range(d))::DOUBLE / d AS f FROM ft),
it(i, var, b, ll, u, v) AS (SELECT 0, var, 0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM mu UNION ALL
SELECT i + 1, var, b + u / v, ll, u, v FROM (
  SELECT i, var, b, sum(b * sx / d - ln(s0 - f * d0)) AS ll, sum(sx / d - (s1 - f * d1) / (s0 - f * d0)) AS u,
         sum((s2 - f * d2) / (s0 - f * d0) - ((s1 - f * d1) / (s0 - f * d0)) ** 2) AS v
  FROM (SELECT i, it.var, b, t, d, sx, f, sum(n * exp(b * x)) AS s0, sum(n * x * exp(b * x)) AS s1, sum(n * x * x * exp(b * x)) AS s2,
          sum(CASE WHEN g."time" = t AND event = 1 THEN n * exp(b * x) ELSE 0 END) AS d0,
          sum(CASE WHEN g."time" = t AND event = 1 THEN n * x * exp(b * x) ELSE 0 END) AS d1,
          sum(CASE WHEN g."time" = t AND event = 1 THEN n * x * x * exp(b * x) ELSE 0 END) AS d2
        FROM it JOIN pf ON pf.var = it.var JOIN g ON g.var = pf.var AND g."time" >= pf.t GROUP BY ALL)
  GROUP BY i, var, b) WHERE i < 21),
steps AS (SELECT i - 1 AS i, var, lag(b) OVER (PARTITION BY var ORDER BY i) AS b, ll, u, v, lag(ll) OVER (PARTITION BY var ORDER BY i) AS before FROM it),
stops AS (SELECT var, min(i) AS at FROM steps WHERE i >= 1 AND abs(1 - before / ll) <= 1e-9 GROUP BY 1),
uni AS (SELECT z.var, z.b, 1 / sqrt(z.v) AS se, 2 * (z.ll - a.ll) AS lr, a.u * a.u / a.v AS score,
        NOT (abs(z.u / z.v) > 1e-9 AND abs(z.u / z.v) > sqrt(1e-9) * abs(z.b)) AS finite
        FROM stops JOIN steps z ON z.var = stops.var AND z.i = stops.at JOIN steps a ON a.var = z.var AND a.i = 0)"""


# Under separation the information is close to zero and known to fewer digits.
_uni_columns = f"var, {hazard_columns('b', 'se', 3)}, {r('lr', 'lr_chisq', 3)}, {r('score', 'score_chisq', 3)}, finite"


@query(prelude=COHORT, sql=f"{_sweep(COMORBIDITIES)} SELECT {_uni_columns} FROM uni")
def cox_univariate_comorbidities(spark, sf_dir):
    """One model per comorbidity, all fitted together."""
    return rounded(cox.cox_sweep(model_table(spark, sf_dir), HX), 3)


@query(prelude=COHORT, sql=f"{_sweep(['age10', 'sex_f', 'los', *COMORBIDITIES])} SELECT {_uni_columns} FROM uni")
def cox_univariate_all(spark, sf_dir):
    """Age, sex and length of stay as well."""
    return rounded(cox.cox_sweep(model_table(spark, sf_dir), ["age10", SEX, "los", *HX]), 3)


def _signif(p: str, name: str) -> str:
    place = f"2 - floor(log10(greatest({p}, 1e-300::DOUBLE)))"
    return r(f"CASE WHEN {p} > 0 THEN round({p} * pow(10::DOUBLE, {place})) / pow(10::DOUBLE, {place}) ELSE {p} END", name)


def _report(names) -> str:
    return f"""{_sweep(names)}, q AS (SELECT var, exp(b) AS hr, exp(b - 1.959963984540054 * se) AS lo,
       exp(b + 1.959963984540054 * se) AS hi, {chi2_sf('(b / se) ** 2', '1')} AS p FROM uni)
SELECT var, round_even(hr, 2) AS estimate, round_even(lo, 2) AS conf_low, round_even(hi, 2) AS conf_high, {_signif('p', 'p_value')} FROM q"""


HAZARD_DIGITS = {"estimate": 2, "conf_low": 2, "conf_high": 2}


def _reported(fits):
    shown = forest.presentation(fits.select("var", "estimate", "conf_low", "conf_high", "p_value"), HAZARD_DIGITS, {"p_value": 3})
    return rounded(shown).orderBy("p_value", "var")


@query(prelude=COHORT, sql=_report(["age10", "sex_f", "los", *COMORBIDITIES]))
def cox_univariate_report(spark, sf_dir):
    """The sweep as reported: rounded and sorted by p."""
    return _reported(cox.cox_sweep(model_table(spark, sf_dir), ["age10", SEX, "los", *HX]))


@query(prelude=COHORT, sql=_report(COMORBIDITIES))
def cox_comorbidity_report(spark, sf_dir):
    """The comorbidity sweep as reported."""
    return _reported(cox.cox_sweep(model_table(spark, sf_dir), HX))


@query(prelude=COHORT, sql=f"""{_sweep(['los'])} SELECT var AS term, {r('ll', 'loglik_null')}, {r('u * u / v', 'score_chisq')} FROM steps WHERE i = 0""")
def cox_score_test(spark, sf_dir):
    """Score test at zero for length of stay, as one lazy plan."""
    return rounded(cox.null_tests(followup(spark, sf_dir), ["los"]))


_names = ["age10", "sex_fF", "los", "hx_htnYes"]
_main = cox_steps([_X["age10"], _X["sex_f"], _X["los"], _X["hx_htn"]])


@query(prelude=COHORT, sql=_main + " " + " UNION ALL ".join(
    f"SELECT '{n}' AS term, {hazard_columns(f'b{k}', f'sqrt(w{k}_{k})')} FROM fit" for k, n in enumerate(_names)))
def cox_main(spark, sf_dir):
    """Age, sex, length of stay and hypertension together."""
    return rounded(cox.cox_fit(model_table(spark, sf_dir), MAIN).tidy())


@query(prelude=COHORT, sql=_main + " " + " UNION ALL ".join(f"""
SELECT '{n}' AS term, round_even(exp(b{k}), 2) AS estimate, {r(f'sqrt(w{k}_{k})', 'std_error')}, {r(f'b{k} / sqrt(w{k}_{k})', 'statistic')},
       {_signif(f"({chi2_sf(f'(b{k} / sqrt(w{k}_{k})) ** 2', '1')})", 'p_value')},
       round_even(exp(b{k} - 1.959963984540054 * sqrt(w{k}_{k})), 2) AS conf_low, round_even(exp(b{k} + 1.959963984540054 * sqrt(w{k}_{k})), 2) AS conf_high FROM fit"""
    for k, n in enumerate(_names)))
def cox_main_report(spark, sf_dir):
    """The main model as reported: hazard ratios at two decimals, p at three digits."""
    return rounded(forest.presentation(cox.cox_fit(model_table(spark, sf_dir), MAIN).tidy(), HAZARD_DIGITS, {"p_value": 3}))


_quad = lambda a, m: " + ".join(f"{a}{i} * {a}{j} * {m}{min(i, j)}_{max(i, j)}" for i in range(4) for j in range(4))
_score = "(SELECT " + " + ".join(f"u{i} * h{i}" for i in range(4)) + " FROM fit0)"

_pairs = """, cs AS (SELECT s."time", s.event, CAST({eta} AS DOUBLE) AS score FROM s, {sources}),
cp AS (SELECT a.rid AS ra, b.rid AS rb, CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS k
  FROM (SELECT *, row_number() OVER () AS rid FROM cs) a JOIN (SELECT *, row_number() OVER () AS rid FROM cs) b
    ON a.event = 1 AND (b."time" > a."time" OR (b."time" = a."time" AND b.event = 0))),
cr AS (SELECT rid, sum(k) AS c, count(*) AS m FROM (SELECT ra AS rid, k FROM cp UNION ALL SELECT rb, k FROM cp) GROUP BY 1),
cc AS (SELECT sum(k) / count(*) AS c, count(*) AS pairs FROM cp),
conc AS (SELECT any_value(cc.c) AS concordance, sqrt(sum((cr.c - cc.c * cr.m) ** 2)) / any_value(pairs) AS std_error, any_value(pairs) AS pairs FROM cr, cc)"""


_perf = f"""{_main}{_pairs.format(eta=' + '.join(f'b{k} * x{k}' for k in range(4)), sources='fit')},
perf AS (SELECT (SELECT count(*) FROM s) AS n, (SELECT CAST(sum(event) AS BIGINT) FROM s) AS events, (SELECT ll FROM fit0) AS ll0, ll AS ll1,
         2 * (ll - (SELECT ll FROM fit0)) AS lr, {_quad('b', 'v')} AS wald, {_score} AS score, (SELECT concordance FROM conc) AS c, (SELECT std_error FROM conc) AS c_se FROM fit)"""


@query(prelude=COHORT, sql=f"""{_perf}
SELECT n, events, {r('ll0', 'loglik_null')}, {r('ll1', 'loglik_final')}, {r('lr', 'lr_chisq')}, 4 AS lr_df, {r('wald', 'wald_chisq')}, 4 AS wald_df,
       {r('score', 'score_chisq')}, 4 AS score_df, {r('-2 * ll1 + 8', 'aic')}, {r('-2 * ll1 + ln(n) * 4', 'bic')},
       {r(chi2_sf('lr', '4'), 'lr_p')}, {r(chi2_sf('wald', '4'), 'wald_p')}, {r(chi2_sf('score', '4'), 'score_p')},
       {r('c', 'concordance')}, {r('c_se', 'concordance_se')} FROM perf""")
def cox_main_performance(spark, sf_dir):
    """Sizes, likelihoods, the three tests, AIC, BIC and concordance of the main model."""
    fit = cox.cox_fit(model_table(spark, sf_dir), MAIN)
    shown = concordance.model_concordance(fit)
    return rounded(fit.glance().drop("converged").withColumns({
        "concordance": shown.select("concordance").scalar(), "concordance_se": shown.select("std_error").scalar(),
    }))


_three = ("concordance", "concordance_se", "loglik_null", "loglik_final", "lr_chisq", "wald_chisq", "score_chisq", "aic", "bic")
MAIN_NAME = "age, sex, length of stay and hypertension"


@query(prelude=COHORT, sql=f"""{_perf}
SELECT '{MAIN_NAME}' AS model, n, events, round_even(c, 3) AS concordance, round_even(c_se, 3) AS concordance_se, round_even(ll0, 3) AS loglik_null,
       round_even(ll1, 3) AS loglik_final, round_even(lr, 3) AS lr_chisq, 4 AS lr_df, round_even(wald, 3) AS wald_chisq, 4 AS wald_df,
       round_even(score, 3) AS score_chisq, 4 AS score_df, round_even(-2 * ll1 + 8, 3) AS aic, round_even(-2 * ll1 + ln(n) * 4, 3) AS bic,
       {_signif(f"({chi2_sf('lr', '4')})", 'lr_p')}, {_signif(f"({chi2_sf('wald', '4')})", 'wald_p')}, {_signif(f"({chi2_sf('score', '4')})", 'score_p')} FROM perf""")
def cox_main_performance_report(spark, sf_dir):
    """The performance row as reported: named, three decimals, p at three digits."""
    row = forest.presentation(cox_main_performance(spark, sf_dir), {c: 3 for c in _three}, {f"{t}_p": 3 for t in ("lr", "wald", "score")})
    return rounded(row.withColumn("model", F.lit(MAIN_NAME)))


@query(prelude=COHORT, sql=f""", s AS (SELECT "time", event, los FROM surv WHERE los IS NOT NULL){_pairs.format(eta='los', sources='(SELECT 1)')}
SELECT {r('concordance', 'concordance')}, {r('std_error', 'std_error')}, pairs FROM conc""")
def concordance_of_length_of_stay(spark, sf_dir):
    """Concordance of a raw score, with many ties."""
    return rounded(concordance.concordance(followup(spark, sf_dir), "los"))


_tri = [(i, j) for i in range(4) for j in range(i, 4)]
_gsum = lambda g, tag: ", ".join(
    [f"sum({g} * (sx{k} / d - a1_{k} / a0)) AS {tag}u{k}" for k in range(4)]
    + [f"sum({g} * (a2_{i}_{j} / a0 - a1_{i} * a1_{j} / (a0 * a0))) AS {tag}v{i}_{j}" for i, j in _tri]
)
_gb = lambda i, j: f"gv{min(i, j)}_{max(i, j)}"
_zph = f"""{_main}, kc AS (SELECT "time", count(*) AS c, sum(event) AS d FROM s GROUP BY 1),
kr AS (SELECT "time", d, sum(c) OVER (ORDER BY "time" DESC) AS n FROM kc),
kt AS (SELECT "time", 1 - coalesce(exp(sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER (ORDER BY "time" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS gt FROM kr),
z0 AS (SELECT {_gsum('gt', 'g')}, {_gsum('gt * gt', 'q')} FROM pieces JOIN kt ON kt."time" = pieces.t),
z1 AS (SELECT z0.*, {', '.join(f"qv{i}_{j} - (" + ' + '.join(f"{_gb(i, a)} * w{a}_{b} * {_gb(b, j)}" for a in range(4) for b in range(4)) + f") AS e{i}_{j}" for i, j in _tri)} FROM z0, fit),
z2 AS (SELECT *, {', '.join(ldl(4, 'e', 'zc'))}, {', '.join(solve(4, 'zc', [f'gu{k}' for k in range(4)], 'zh'))} FROM z1),
ph AS ({' UNION ALL '.join(f"SELECT {k} AS position, '{n}' AS term, gu{k} * gu{k} / e{k}_{k} AS chisq, 1 AS df FROM z2" for k, n in enumerate(['age10', 'sex_f', 'los', 'hx_htn']))}
UNION ALL SELECT 4, 'GLOBAL', {' + '.join(f'gu{k} * zh{k}' for k in range(4))}, 4 FROM z2)"""


@query(prelude=COHORT, sql=f"{_zph} SELECT position, term, {r('chisq', 'chisq')}, df, {r(chi2_sf('chisq', 'df'), 'p')} FROM ph")
def cox_main_ph_test(spark, sf_dir):
    """Proportional-hazards test of the main model, per term and globally."""
    return rounded(zph.ph_test(cox.cox_fit(model_table(spark, sf_dir), MAIN)))


_mean = f"xm AS (SELECT t, {', '.join(f'avg(a1_{k} / a0) AS c{k}' for k in range(4))} FROM pieces GROUP BY 1)"
_residual = [f"(x{k} - m{k} - c{k})" for k in range(4)]
_scaled = [f"b{k} + (SELECT sum(d) FROM ft) * (" + " + ".join(f"w{min(k, j)}_{max(k, j)} * {_residual[j]}" for j in range(4)) + ")" for k in range(4)]


@query(prelude=COHORT, sql=f"{_main}, {_mean} " + " UNION ALL ".join(
    f"""SELECT "time", CAST(n AS BIGINT) AS n, '{name}' AS term, {r(_residual[k], 'residual')}, {r(_scaled[k], 'scaled', 4)} FROM g JOIN xm ON g."time" = xm.t, fit WHERE event = 1"""
    for k, name in enumerate(["age10", "sex_fF", "los", "hx_htnYes"])
))
def cox_main_residuals(spark, sf_dir):
    """Schoenfeld residuals of the main model, plain and scaled, per event and coefficient."""
    found = zph.schoenfeld_residuals(cox.cox_fit(model_table(spark, sf_dir), MAIN))
    return rounded(found.withColumn("scaled", F.round("scaled", 4)))


_competing = f"""cr AS (SELECT CASE WHEN first_after_discharge <= lim THEN first_after_discharge ELSE lim END AS e,
  CASE WHEN first_after_discharge <= lim THEN 1 WHEN death <= {END} THEN 2 ELSE 0 END AS ev, index_discharge AS b, least(CAST(index_discharge + INTERVAL 3 YEAR AS DATE), {END}) AS cutoff
  FROM (SELECT *, least(coalesce(death, {END}), {END}) AS lim FROM (SELECT *, last_day(CAST(try_strptime(death_yyyymm, '%Y%m') AS DATE)) AS death FROM tbl))),
ct AS (SELECT CAST(greatest(0, date_diff('day', b, least(e, cutoff))) AS INT) AS "time", CASE WHEN e <= cutoff THEN ev ELSE 0 END AS ev FROM cr),
cc AS (SELECT "time", count(*) AS c, count(*) FILTER (ev = 1) AS d1, count(*) FILTER (ev = 2) AS d2 FROM ct WHERE "time" IS NOT NULL GROUP BY 1),
cn AS (SELECT *, CAST(sum(c) OVER (ORDER BY "time" DESC) AS BIGINT) AS n FROM cc),
cs AS (SELECT *, exp(sum(CASE WHEN d1 + d2 < n THEN ln(1 - (d1 + d2) / n::DOUBLE) ELSE 0 END) OVER (ORDER BY "time")) AS s1,
  max(CASE WHEN d1 + d2 < n THEN 0 ELSE 1 END) OVER (ORDER BY "time") AS ended FROM cn),
cb AS (SELECT *, coalesce(lag(s1) OVER (ORDER BY "time"), 1) AS before, CASE WHEN ended = 1 THEN 0 ELSE s1 END AS surv FROM cs),
ci AS (SELECT *, sum(before * d1 / n) OVER (ORDER BY "time") AS i1, sum(before * d2 / n) OVER (ORDER BY "time") AS i2 FROM cb)"""


@query(prelude=COHORT, sql=f"""{_competing.join([', ', ''])}
SELECT "time", 1 AS cause, n AS n_risk, d1 AS n_event, {r('i1', 'incidence')}, {r('surv', 'surv')} FROM ci
UNION ALL SELECT "time", 2, n, d2, {r('i2', 'incidence')}, {r('surv', 'surv')} FROM ci""")
def cumulative_incidence(spark, sf_dir):
    """Readmission (1) with death (2) as a competing event, taken at the end of its month."""
    people = study.person_table(claims(spark, sf_dir), persons(spark, sf_dir), CONFIG).withColumn("death_dt", F.last_day(ym("death_yyyymm")))
    timed = tte.apply_horizon(tte.time_to_event(people, CONFIG, censor_at="death_dt", competing=2), CONFIG)
    return rounded(incidence.cumulative_incidence(settle(timed.select("time", "event"))))


_forest = [("age10", "", "age10", 0, "TRUE"), ("sex_f", "M", "sex_fM", None, "sex_f = 'M'"), ("sex_f", "F", "sex_fF", 1, "sex_f = 'F'"),
           ("los", "", "los", 2, "TRUE"), ("hx_htn", "No", "hx_htnNo", None, "hx_htn = 'No'"), ("hx_htn", "Yes", "hx_htnYes", 3, "hx_htn = 'Yes'")]


def _forest_row(i, v, level, term, k, where):
    n = f"(SELECT count(*) FROM surv WHERE {where}) AS n"
    if k is None:
        rest = "1.0::DOUBLE AS estimate, NULL::DOUBLE AS conf_low, NULL::DOUBLE AS conf_high, NULL::DOUBLE AS p_value"
    else:
        b, se = f"b{k}", f"sqrt(w{k}_{k})"
        rest = (f"{r(f'exp({b})', 'estimate')}, {r(f'exp({b} - 1.959963984540054 * {se})', 'conf_low')},"
                f" {r(f'exp({b} + 1.959963984540054 * {se})', 'conf_high')}, {r(chi2_sf(f'({b} / {se}) ** 2', '1'), 'p_value')}")
    return f"SELECT '{term}' AS term, {i} AS position, '{v}' AS variable, '{level}' AS level, {str(k is None).lower()} AS reference, {n}, {rest} FROM fit"


@query(prelude=COHORT, sql=_main + " " + " UNION ALL ".join(_forest_row(i, *row) for i, row in enumerate(_forest)))
def forest_rows(spark, sf_dir):
    """Rows of the main model's forest plot, reference levels included."""
    people = model_table(spark, sf_dir)
    return rounded(forest.forest(cox.cox_fit(people, MAIN), people))


@query(prelude=COHORT, sql=f"{_perf} SELECT events, {r(chi2_sf('lr', '4'), 'global_p')}, {r('-2 * ll1 + 8', 'aic')}, {r('c', 'concordance')} FROM perf")
def forest_footer(spark, sf_dir):
    fit = cox.cox_fit(model_table(spark, sf_dir), MAIN)
    return rounded(forest.forest_footer(fit, concordance.model_concordance(fit)))


@query(prelude=COHORT, sql=f"""
SELECT subject_id, "time", event, {r('age10', 'age10')}, CASE sex_f WHEN 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "sex_fF",
       los::DOUBLE AS los, CASE hx_htn WHEN 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "hx_htnYes" FROM surv
WHERE age10 IS NOT NULL AND sex_f IS NOT NULL AND los IS NOT NULL""")
def design_matrix(spark, sf_dir):
    """Complete cases with one column per coefficient of the main model."""
    people = followup_with_history(spark, sf_dir)
    table, names, _ = cox.design(people, MAIN, keep=("subject_id", "time", "event"))
    return rounded(table.select("subject_id", "time", "event", *[F.col(f"x{i}").alias(n) for i, n in enumerate(names)]))


def followup_with_history(spark, sf_dir):
    people = horizon_table(spark, sf_dir, lookback.lookback_counts(CONFIG), lookback.comorbidity(CONFIG))
    people = lookback.label_flags(features.scaled(people), CONFIG.comorbidities)
    return people.withColumn("sex_f", F.when(F.col("sex") == 1, "M").when(F.col("sex") == 2, "F"))
