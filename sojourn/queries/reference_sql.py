"""The same study in plain SQL for DuckDB, one common table expression per step.

Written join by join from the definitions, so it shares nothing with the one-pass
Spark plans it is compared with.
"""

from __future__ import annotations

from sojourn.config import CEREBRO, COMORBIDITIES, HEART

START, END = "DATE '1996-01-01'", "DATE '2001-12-31'"
PHENOTYPE = f"(regexp_matches(dx1, '{HEART}') OR regexp_matches(dx1, '{CEREBRO}'))"
KEYS = "k1, k2, k3, k4, k5"
HX = list(COMORBIDITIES)

_hx = ",\n       ".join(
    f"bool_or(coalesce(regexp_matches(dx1, '{p}'), false) OR coalesce(regexp_matches(dx2, '{p}'), false)) AS {n}"
    for n, p in COMORBIDITIES.items()
)
_hx_labels = ",\n       ".join(f"CASE WHEN coalesce(h.{n}, false) THEN 'Yes' ELSE 'No' END AS {n}" for n in HX)

CLAIMS = """WITH RECURSIVE claims AS (
SELECT o_custkey AS subject_id, CAST(o_orderdate AS DATE) AS start_dt,
       CASE WHEN o_orderstatus='F' THEN '02' WHEN o_orderstatus='O' THEN '03'
            WHEN l_linenumber=7 THEN '07' ELSE '08' END AS form_cd,
       'I' || CAST(10 + l_partkey % 60 AS VARCHAR) AS dx1,
       CASE l_suppkey % 10 WHEN 0 THEN 'E11' WHEN 1 THEN 'E78' WHEN 2 THEN 'N18' WHEN 3 THEN 'J44'
            WHEN 4 THEN 'C34' WHEN 5 THEN 'I10' WHEN 6 THEN 'I63' WHEN 7 THEN 'I50' WHEN 8 THEN 'I20' END AS dx2,
       CAST(CASE l_linenumber % 5 WHEN 0 THEN 12 WHEN 1 THEN 21 WHEN 2 THEN 31 WHEN 3 THEN 32 ELSE 11 END AS INT) AS path_type,
       CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 9 ELSE 4 END AS INT) AS result_type,
       CASE WHEN l_quantity=50 AND l_linenumber=7 THEN NULL ELSE CAST(l_quantity AS INT) % 15 END AS los,
       l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_quantity AS k5
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), person AS (
SELECT c_custkey AS subject_id,
       CASE WHEN c_custkey % 97 = 0 THEN '19xxLE' ELSE CAST(1915 + c_custkey % 85 AS VARCHAR) END AS birth_yyyy,
       CASE WHEN c_custkey % 20 = 0
            THEN strftime(DATE '1999-01-01' + to_months(CAST(c_custkey % 36 AS INT)), '%Y%m') END AS death_yyyymm,
       CAST(1 + c_nationkey % 2 AS INT) AS sex
FROM customer
)"""

COHORT = CLAIMS + f""", idx AS (
SELECT i.subject_id, i.start_dt AS first_admit, i.dx1 AS index_code, s.index_discharge, i.form_cd, i.dx1, i.dx2,
       i.path_type, i.result_type, i.los, i.start_dt + i.los AS discharge_dt,
       p.birth_yyyy, p.death_yyyymm, p.sex, CAST(year(i.start_dt) AS INT) - TRY_CAST(p.birth_yyyy AS INT) AS age_index
FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY start_dt, {KEYS}) AS rn
      FROM claims WHERE form_cd = '02' AND start_dt BETWEEN {START} AND {END} AND {PHENOTYPE}) i
JOIN (SELECT subject_id, start_dt, min(start_dt + los) AS index_discharge FROM claims
      WHERE form_cd = '02' GROUP BY 1, 2) s ON s.subject_id = i.subject_id AND s.start_dt = i.start_dt
JOIN person p ON p.subject_id = i.subject_id
WHERE i.rn = 1
), linked AS (
SELECT c.*, i.first_admit, i.index_code, i.index_discharge,
       CAST(try_strptime(i.death_yyyymm, '%Y%m') AS DATE) AS death_month
FROM claims c JOIN idx i ON i.subject_id = c.subject_id
), washout_ids AS (
SELECT DISTINCT subject_id FROM linked WHERE start_dt < {START} AND (dx1 = index_code OR dx2 = index_code)
), death_ids AS (
SELECT DISTINCT subject_id FROM linked
WHERE form_cd = '02' AND start_dt BETWEEN {START} AND {END} AND death_month IS NOT NULL
  AND death_month >= date_trunc('month', start_dt) AND death_month <= date_trunc('month', start_dt + los)
), unclear_ids AS (
SELECT DISTINCT subject_id FROM linked
WHERE form_cd = '02' AND start_dt BETWEEN {START} AND {END} AND (los IS NULL OR start_dt + los < start_dt)
), invalid_ids AS (
SELECT subject_id FROM idx WHERE age_index IS NULL OR age_index < 0
), incl AS (
SELECT * FROM idx
WHERE subject_id NOT IN (SELECT subject_id FROM washout_ids) AND subject_id NOT IN (SELECT subject_id FROM death_ids)
  AND subject_id NOT IN (SELECT subject_id FROM unclear_ids) AND subject_id NOT IN (SELECT subject_id FROM invalid_ids)
), stays AS (
SELECT l.* FROM linked l WHERE l.form_cd = '02' AND l.start_dt BETWEEN {START} AND {END}
   AND (l.dx1 = l.index_code OR l.dx2 = l.index_code) AND l.subject_id IN (SELECT subject_id FROM incl)
), same_days AS (
SELECT subject_id, count(DISTINCT start_dt) AS same_dx_days FROM stays WHERE start_dt >= first_admit GROUP BY 1
), first_after_admit AS (
SELECT subject_id, min(start_dt) AS first_readmit_dt FROM stays WHERE start_dt > first_admit GROUP BY 1
), last_stay AS (
SELECT subject_id, start_dt AS last_readmit_dt, discharge_dt AS last_readmit_discharge FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY start_dt DESC, discharge_dt ASC NULLS LAST) AS rn
  FROM (SELECT DISTINCT subject_id, start_dt, start_dt + los AS discharge_dt FROM stays WHERE start_dt > first_admit))
WHERE rn = 1
), first_after_discharge AS (
SELECT subject_id, min(start_dt) AS first_after_discharge FROM stays WHERE start_dt > index_discharge GROUP BY 1
), history AS (
SELECT l.* FROM linked l WHERE l.start_dt < l.first_admit AND l.start_dt >= l.first_admit - 180 AND l.start_dt >= {START}
   AND l.subject_id IN (SELECT subject_id FROM incl)
), prior AS (
SELECT subject_id, count(*) FILTER (form_cd <> '02') AS prior_other_n,
       count(*) FILTER (path_type IN (11, 21, 31)) AS prior_emergency_n,
       count(*) FILTER (form_cd = '02' AND dx1 <> index_code) AS prior_inpatient_n
FROM history GROUP BY 1
), hx AS (
SELECT subject_id, {_hx}
FROM history GROUP BY 1
), people AS (
SELECT i.*, s.same_dx_days, CAST(greatest(coalesce(s.same_dx_days, 0), 1) AS BIGINT) AS n_same_dx,
       CAST(CASE WHEN coalesce(s.same_dx_days, 0) >= 2 THEN 1 ELSE 0 END AS INT) AS readmit_flag,
       CASE WHEN coalesce(s.same_dx_days, 0) >= 2 THEN f.first_readmit_dt END AS first_readmit_dt,
       z.last_readmit_dt, z.last_readmit_discharge, d.first_after_discharge,
       p.prior_other_n, p.prior_emergency_n, p.prior_inpatient_n
FROM incl i LEFT JOIN same_days s ON s.subject_id = i.subject_id
LEFT JOIN first_after_admit f ON f.subject_id = i.subject_id
LEFT JOIN last_stay z ON z.subject_id = i.subject_id
LEFT JOIN first_after_discharge d ON d.subject_id = i.subject_id
LEFT JOIN prior p ON p.subject_id = i.subject_id
), tbl AS (
SELECT p.*, {_hx_labels},
       CASE WHEN p.readmit_flag = 1 THEN 'readmit' ELSE 'nonreadmit' END AS grp,
       CASE p.sex WHEN 1 THEN 'M' WHEN 2 THEN 'F' END AS sex_f,
       CASE WHEN regexp_matches(p.index_code, '{HEART}') THEN 'heart'
            WHEN regexp_matches(p.index_code, '{CEREBRO}') THEN 'cerebro' ELSE 'other' END AS index_dx_group_f,
       CAST(p.path_type AS VARCHAR) AS path_type_f,
       CASE WHEN p.path_type IN (11, 21, 31) THEN 'Yes' ELSE 'No' END AS er_flag,
       CAST(p.result_type AS VARCHAR) AS result_type_f,
       CAST(year(p.first_admit) AS VARCHAR) AS index_year_f, substr(p.index_code, 1, 3) AS index_cat,
       CASE WHEN p.death_yyyymm IS NOT NULL THEN 'Yes' ELSE 'No' END AS death_flag,
       CASE WHEN p.readmit_flag = 1 THEN CAST(date_diff('day', p.discharge_dt, p.first_readmit_dt) AS DOUBLE) END AS diff_days,
       p.age_index / 10.0::DOUBLE AS age10, coalesce(p.prior_other_n, 0) / 5.0::DOUBLE AS outpt5
FROM people p LEFT JOIN hx h ON h.subject_id = p.subject_id
), tte AS (
SELECT t.*, t.index_discharge AS "start", coalesce(t.first_after_discharge, {END}) AS end_raw,
       CASE WHEN t.first_after_discharge IS NOT NULL THEN 1 ELSE 0 END AS event_raw,
       least(CAST(t.index_discharge + INTERVAL 3 YEAR AS DATE), {END}) AS cutoff
FROM tbl t
), surv AS (
SELECT * EXCLUDE (end_raw, event_raw), least(end_raw, cutoff) AS "end",
       CAST(CASE WHEN event_raw = 1 AND end_raw <= cutoff THEN 1 ELSE 0 END AS INT) AS event,
       CAST(greatest(0, date_diff('day', "start", least(end_raw, cutoff))) AS INT) AS "time",
       CAST(date_diff('day', "start", end_raw) AS INT) AS diff_days_raw,
       CASE WHEN los >= 5 THEN '>=5d' WHEN los < 5 THEN '<5d' END AS los5
FROM tte
)"""


def chi2_sf(x: str, df: str) -> str:
    """Upper chi-square tail from the power series of the lower incomplete gamma."""
    x, a = f"(({x})::DOUBLE / 2)", f"(({df}) / 2.0::DOUBLE)"
    return (
        f"(CASE WHEN {x} IS NULL OR {a} <= 0 THEN NULL WHEN {x} <= 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - list_sum("
        f"list_transform(range(0, 700), lambda n: exp(({a} + n) * ln({x}) - {x} - lgamma({a} + n + 1))))) END)"
    )


def f_sf(f: str, df1: str, df2: str) -> str:
    """Upper F tail from the power series of the incomplete beta."""
    x = f"(({df1}) * ({f}) / (({df1}) * ({f}) + ({df2})))"
    a, b = f"(({df1}) / 2.0::DOUBLE)", f"(({df2}) / 2.0::DOUBLE)"
    return (
        f"(CASE WHEN ({f}) IS NULL THEN NULL WHEN ({f}) <= 0 THEN 1.0::DOUBLE ELSE 1 - list_sum(list_transform(range(0, 700), lambda n:"
        f" exp(lgamma({a} + {b} + n) - lgamma({a} + n + 1) - lgamma({b}) + ({a} + n) * ln({x}) + {b} * ln(1 - {x})))) END)"
    )


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE AS {name}"


# --- Cox models in SQL --------------------------------------------------------


def _low(name: str, i: int, j: int) -> str:
    return f"{name}{min(i, j)}_{max(i, j)}"


def ldl(p: int, m: str, tag: str) -> list[str]:
    """Column list factoring the symmetric matrix with entries ``m{i}_{j}`` (i <= j)."""
    out = []
    for j in range(p):
        out.append(" - ".join([_low(m, j, j), *[f"{tag}l{j}_{k} * {tag}l{j}_{k} * {tag}d{k}" for k in range(j)]]) + f" AS {tag}d{j}")
        for i in range(j + 1, p):
            top = " - ".join([_low(m, i, j), *[f"{tag}l{i}_{k} * {tag}l{j}_{k} * {tag}d{k}" for k in range(j)]])
            out.append(f"({top}) / {tag}d{j} AS {tag}l{i}_{j}")
    return out


def solve(p: int, tag: str, rhs: list[str], name: str) -> list[str]:
    """Column list solving the factored system for one right-hand side."""
    out = [f"{' - '.join([rhs[i], *[f'{tag}l{i}_{k} * {name}y{k}' for k in range(i)]])} AS {name}y{i}" for i in range(p)]
    out += [
        f"{' - '.join([f'{name}y{i} / {tag}d{i}', *[f'{tag}l{k}_{i} * {name}{k}' for k in range(i + 1, p)]])} AS {name}{i}"
        for i in reversed(range(p))
    ]
    return out


def cox_steps(columns: list[str], source: str = "surv", steps: int = 8) -> str:
    """CTEs ending in ``fit0`` (at zero) and ``fit`` (at the estimate): log-likelihood,
    gradient ``u``, information ``v``, inverse ``w`` and coefficients ``b``."""
    p = len(columns)
    ks, tri = range(p), [(i, j) for i in range(p) for j in range(i, p)]
    xs = ", ".join(f"x{k}" for k in ks)
    eta = "(" + " + ".join(f"b{k} * (x{k} - m{k})" for k in ks) + ")"
    risk, dead = f"n * exp({eta})", f'(CASE WHEN g."time" = pf.t AND g.event = 1 THEN n * exp({eta}) ELSE 0 END)'
    a0 = f"sum({risk}) - f * sum({dead})"
    a1 = [f"sum({risk} * (x{k} - m{k})) - f * sum({dead} * (x{k} - m{k})) AS a1_{k}" for k in ks]
    a2 = [f"sum({risk} * (x{i} - m{i}) * (x{j} - m{j})) - f * sum({dead} * (x{i} - m{i}) * (x{j} - m{j})) AS a2_{i}_{j}" for i, j in tri]
    bs = ", ".join(f"b{k}" for k in ks)
    pieces = (
        f"SELECT i, {bs}, pf.t, f, d, any_value(eta_x) AS ex, {', '.join(f'any_value(sx{k}) AS sx{k}' for k in ks)}, {a0} AS a0, {', '.join(a1 + a2)}"
        f' FROM {{it}}, (SELECT pf.*, ' + " + ".join("0" for _ in ks) + f' AS eta_x FROM pf) pf JOIN g ON g."time" >= pf.t GROUP BY i, {bs}, pf.t, f, d'
    )
    us = [f"sum(sx{k} / d - a1_{k} / a0) AS u{k}" for k in ks]
    vs = [f"sum(a2_{i}_{j} / a0 - a1_{i} * a1_{j} / (a0 * a0)) AS v{i}_{j}" for i, j in tri]
    ll = "sum((" + " + ".join(f"b{k} * sx{k}" for k in ks) + ") / d - ln(a0)) AS ll"
    totals = f"SELECT i, {bs}, {ll}, {', '.join(us + vs)} FROM ({pieces}) GROUP BY i, {bs}"
    newton = f"SELECT *, {', '.join(ldl(p, 'v', 'c'))}, {', '.join(solve(p, 'c', [f'u{k}' for k in ks], 'h'))} FROM ({totals})"
    inverse = [s for k in ks for s in solve(p, "c", ["1" if a == k else "0" for a in ks], f"w{k}_")]
    select_x = ", ".join(f"({c})::DOUBLE AS x{k}" for k, c in enumerate(columns))
    known = " AND ".join(f"({c}) IS NOT NULL" for c in columns)
    return f""", s AS (SELECT "time", event, {select_x} FROM {source} WHERE "time" IS NOT NULL AND {known}),
mu AS (SELECT {', '.join(f'avg(x{k}) AS m{k}' for k in ks)} FROM s),
g AS (SELECT "time", event, {xs}, {', '.join(f'm{k}' for k in ks)}, count(*)::DOUBLE AS n FROM s, mu GROUP BY ALL),
ft AS (SELECT "time" AS t, CAST(sum(n) AS INT) AS d, {', '.join(f'sum(n * (x{k} - m{k})) AS sx{k}' for k in ks)} FROM g WHERE event = 1 GROUP BY 1),
pf AS (SELECT ft.*, unnest(range(d))::DOUBLE / d AS f FROM ft),
it(i, {bs}) AS (SELECT 0, {', '.join('0::DOUBLE' for _ in ks)} UNION ALL
SELECT i + 1, {', '.join(f'b{k} + h{k}' for k in ks)} FROM ({newton.format(it='it')}) WHERE i < {steps}),
ends AS (SELECT * FROM it WHERE i IN (0, {steps})),
fits AS (SELECT *, {', '.join(inverse)} FROM ({newton.format(it='ends')})),
fit0 AS (SELECT * FROM fits WHERE i = 0), fit AS (SELECT * FROM fits WHERE i = {steps}),
pieces AS ({pieces.format(it='(SELECT * FROM ends WHERE i = ' + str(steps) + ')')})"""


def hazard_columns(b: str, se: str, digits: int = 6) -> str:
    z = "1.959963984540054"
    parts = {
        "estimate": f"exp({b})", "std_error": se, "statistic": f"{b} / {se}", "p_value": chi2_sf(f"({b} / {se}) ** 2", "1"),
        "conf_low": f"exp({b} - {z} * {se})", "conf_high": f"exp({b} + {z} * {se})",
    }
    return ", ".join(r(e, name, digits) for name, e in parts.items())
