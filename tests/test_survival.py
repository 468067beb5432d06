"""Survival statistics on a published trial of remission times."""

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sojourn.queries import survival
from sojourn.stats import cox, forest, km, logrank
from sojourn.stats.concordance import concordance, model_concordance
from sojourn.stats.zph import ph_test

# Published data: weeks in remission, "+" = censored.
TREATED = "6 6 6 6+ 7 9+ 10 10+ 11+ 13 16 17+ 19+ 20+ 22 23 25+ 32+ 32+ 34+ 35+"
PLACEBO = "1 1 2 2 3 4 4 5 5 8 8 8 8 11 11 12 12 15 17 22 23"


def parse(text, x):
    return [(int(t.rstrip("+")), int(not t.endswith("+")), x) for t in text.split()]


@pytest.fixture(scope="module")
def trial(spark):
    rows = parse(TREATED, 0) + parse(PLACEBO, 1)
    df = spark.createDataFrame(rows, "time int, event int, x int")
    return df.withColumn("arm", F.when(F.col("x") == 1, "placebo").otherwise("treated"))


@pytest.mark.parametrize("blocks", [None, 4])
def test_km(trial, blocks):
    curve = {r["time"]: r for r in km.kaplan_meier(trial.filter("x = 0"), blocks=blocks).collect()}
    want = {6: (0.8571, 0.0764), 7: (0.8067, 0.0869), 10: (0.7529, 0.0963), 13: (0.6902, 0.1068),
            16: (0.6275, 0.1141), 22: (0.5378, 0.1282), 23: (0.4482, 0.1346)}
    for t, (s, se) in want.items():
        assert curve[t]["surv"] == pytest.approx(s, abs=5e-5)
        assert curve[t]["std_err"] == pytest.approx(se, abs=5e-5)
    rows = sorted(curve.values(), key=lambda r: r["time"])
    assert all(a["surv"] >= b["surv"] for a, b in zip(rows, rows[1:]))
    assert rows[0]["n_risk"] == 21


def test_km_ends_at_zero(trial):
    last = km.kaplan_meier(trial, ["arm"]).filter("arm = 'placebo'").orderBy(F.col("time").desc()).first()
    assert last["surv"] == 0.0 and last["std_err"] is None and last["hazard"] == math.inf


def test_landmarks(trial):
    curve = km.kaplan_meier(trial.filter("x = 0"))
    rows = km.landmarks(curve, [3, 6, 12, 40]).orderBy("time").collect()
    assert [r["time"] for r in rows] == [3, 6, 12]
    assert rows[0]["surv"] == 1.0 and rows[0]["n_risk"] == 21
    extended = km.landmarks(curve, [3, 6, 12, 40], extend=True).orderBy("time").collect()
    assert extended[-1]["surv"] == pytest.approx(0.4482, abs=5e-5) and extended[-1]["n_risk"] == 0
    table = {(r["arm"], r["time"]): r["n_risk"] for r in km.risk_table(trial, [0, 6, 23], ["arm"]).collect()}
    assert table[("treated", 6)] == 21 and table[("placebo", 23)] == 1


def test_logrank(trial):
    row = logrank.logrank_test(trial, "arm", ["treated", "placebo"]).first()
    assert row["chisq"] == pytest.approx(16.7929, abs=1e-4)
    table = {r["arm"]: r for r in logrank.logrank_table(trial, "arm", ["treated", "placebo"]).collect()}
    assert table["placebo"]["observed"] == 21
    assert table["placebo"]["expected"] == pytest.approx(10.7495, abs=1e-4)
    assert table["placebo"]["variance"] == pytest.approx(6.2570, abs=1e-4)
    assert sum(r["observed"] - r["expected"] for r in table.values()) == pytest.approx(0, abs=1e-9)


def test_logrank_three_groups(spark, trial):
    split = trial.withColumn("g", F.concat("arm", (F.col("time") % 2).cast("string")))
    levels = sorted(r["g"] for r in split.select("g").distinct().collect())
    got = logrank.logrank_test(split, "g", levels).first()
    rows = [(r["time"], r["event"], r["g"]) for r in split.collect()]
    k = len(levels)
    u, v = np.zeros(k), np.zeros((k, k))
    for t in sorted({t for t, e, _ in rows if e}):
        n = np.array([sum(a >= t and g == lv for a, _, g in rows) for lv in levels], float)
        d = np.array([sum(a == t and e and g == lv for a, e, g in rows) for lv in levels], float)
        u += d - d.sum() * n / n.sum()
        if n.sum() > 1:
            v += d.sum() * (n.sum() - d.sum()) / (n.sum() - 1) * (np.diag(n / n.sum()) - np.outer(n, n) / n.sum() ** 2)
    want = u[:-1] @ np.linalg.inv(v[:-1, :-1]) @ u[:-1]
    assert got["chisq"] == pytest.approx(want, rel=1e-9) and got["df"] == k - 1


@pytest.fixture(scope="module")
def fit(trial):
    return cox.cox_fit(trial, ["x"])


def test_cox(fit):
    row = fit.tidy().first()
    assert fit.beta[0] == pytest.approx(1.57213, abs=5e-6)
    assert row["estimate"] == pytest.approx(4.81687, abs=5e-5)
    assert row["std_error"] == pytest.approx(0.41240, abs=5e-6)
    assert row["statistic"] == pytest.approx(3.81217, abs=5e-5)
    assert fit.loglik_null == pytest.approx(-93.18427, abs=5e-6)
    assert fit.loglik == pytest.approx(-85.00842, abs=5e-6)
    assert fit.lr == pytest.approx(16.35169, abs=1e-5) and fit.score == pytest.approx(17.24654, abs=1e-5)
    assert fit.converged and fit.n == 42 and fit.events == 30


def test_cox_factor_equals_numeric(trial, fit):
    by_factor = cox.cox_fit(trial, [cox.Factor("arm", ("treated", "placebo"))])
    assert by_factor.names == ["armplacebo"]
    assert by_factor.beta[0] == pytest.approx(fit.beta[0], rel=1e-9)


def test_sweep_matches_single_fits(trial):
    wide = trial.withColumns({"y": (F.col("time") % 3).cast("double"), "none": F.lit(None).cast("double")})
    rows = {r["var"]: r for r in cox.cox_sweep(wide, ["x", "y", "none"]).collect()}
    assert set(rows) == {"x", "y", "none"}
    assert rows["none"]["estimate"] is None and not rows["none"]["finite"]
    for v in ("x", "y"):
        single = cox.cox_fit(wide, [v]).tidy().first()
        assert rows[v]["estimate"] == pytest.approx(single["estimate"], rel=1e-7)
        assert rows[v]["std_error"] == pytest.approx(single["std_error"], rel=1e-7)
    assert rows["x"]["score_chisq"] == pytest.approx(17.24654, abs=1e-5)


def test_no_information_is_no_estimate(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 5.0), (2, 0, 2.0, 5.0), (3, 1, 3.0, 5.0)], "time int, event int, x double, same double")
    rows = {r["var"]: r for r in cox.cox_sweep(df, ["x", "same"]).collect()}
    assert all(r["estimate"] is None and not r["finite"] for r in rows.values())
    assert cox.cox_fit(df, ["x"]).loglik == 0


def test_concordance_does_not_depend_on_scale(spark):
    df = spark.createDataFrame([(t, 1, float(-t)) for t in range(1, 30)], "time int, event int, score double")
    for scale in (1.0, 1e-12, 1e12):
        assert concordance(df, f"score * {scale!r}D").first()["concordance"] == 1.0


def test_separation_stops(spark):
    rows = [(t, int(t % 2 == 0), 0) for t in range(1, 30)] + [(40 + t, 0, 1) for t in range(5)] + [(5, 0, 1)]
    df = spark.createDataFrame(rows, "time int, event int, x int")
    row = cox.cox_sweep(df, ["x"]).first()
    assert row["estimate"] < 1e-6 and row["conf_low"] == 0.0 and row["conf_high"] == math.inf
    assert not row["finite"]


@pytest.mark.parametrize("s0, e0, d", [
    (50.0, 20.0, 30), (31.0, 30.0, 30), (30.0, 30.0, 30), (5.0, 2.0, 1), (9.0, 3.5, 10), (40.0, 11.0, 11),
    (1e9, 1e3, 1000), (1e9, 900.0, 2000), (2e5, 2e5, 200_000), (3e9, 1.0, 65),
])
def test_tie_sums_equal_exact_sums(spark, s0, e0, d):
    df = spark.createDataFrame([(s0, e0, float(d))], "s0 double, e0 double, d double")
    got = cox._with_tie_sums(df).select("k.*").first()
    f = [l / d for l in range(d)]
    a = [(s0 - e0) + e0 * ((d - l) / d) for l in range(d)]
    want = [map(math.log, a), (1 / y for y in a), (x / y for x, y in zip(f, a)), (1 / y**2 for y in a),
            (x / y**2 for x, y in zip(f, a)), ((x / y) ** 2 for x, y in zip(f, a))]
    for value, exact in zip(got, map(math.fsum, want)):
        assert value == pytest.approx(exact, rel=1e-11, abs=1e-300)


# Published data of an ovarian cancer trial: days, died, age, performance status.
OVARIAN = """59 1 72.3315 1, 115 1 74.4932 1, 156 1 66.4658 2, 421 0 53.3644 1, 431 1 50.3397 1, 448 0 56.4301 2,
464 1 56.9370 2, 475 1 59.8548 2, 477 0 64.1753 1, 563 1 55.1781 2, 638 1 56.7562 2, 744 0 50.1096 1, 769 0 59.6301 2,
770 0 57.0521 1, 803 0 39.2712 1, 855 0 43.1233 2, 1040 0 38.8932 2, 1106 0 44.6000 1, 1129 0 53.9068 1, 1206 0 44.2055 1,
1227 0 59.5890 2, 268 1 74.5041 2, 329 1 43.1370 1, 353 1 63.2192 2, 365 1 64.4247 1, 377 0 58.3096 1"""


def test_proportionality_on_a_published_trial(spark):
    rows = [tuple(map(float, line.split())) for line in OVARIAN.split(",")]
    df = spark.createDataFrame(rows, "time double, event double, age double, ps double").withColumn("event", F.col("event").cast("int"))
    got = {r["term"]: r for r in ph_test(cox.cox_fit(df, ["age", "ps"])).collect()}
    want = {"age": (0.698, 0.40), "ps": (2.371, 0.12), "GLOBAL": (3.633, 0.16)}
    for term, (chisq, p) in want.items():
        assert got[term]["chisq"] == pytest.approx(chisq, abs=5.1e-4)
        assert got[term]["p"] == pytest.approx(p, abs=5.1e-3)


def test_concordance(fit):
    row = model_concordance(fit).first()
    assert row["concordance"] == pytest.approx(0.69004, abs=5e-6)
    assert row["std_error"] == pytest.approx(0.04114, abs=5e-6)


def test_concordance_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(t), int(e), float(s)) for t, e, s in zip(rng.integers(1, 12, 90), rng.integers(0, 2, 90), rng.integers(0, 17, 90))]
    conc = disc = tied = 0
    for t, e, s in rows:
        if not e:
            continue
        for t2, e2, s2 in rows:
            if t2 > t or (t2 == t and not e2):
                conc, disc, tied = conc + (s > s2), disc + (s < s2), tied + (s == s2)
    got = concordance(spark.createDataFrame(rows, "time int, event int, score double")).first()
    assert got["pairs"] == conc + disc + tied
    assert got["concordance"] == pytest.approx((conc + tied / 2) / (conc + disc + tied), rel=1e-12)


def test_ph_test(fit):
    rows = {r["term"]: r for r in ph_test(fit).collect()}
    assert rows["x"]["chisq"] == pytest.approx(0.02286, abs=5e-5)
    assert rows["GLOBAL"]["chisq"] == pytest.approx(rows["x"]["chisq"], rel=1e-9)


def numpy_cox(t, e, x, steps=8):
    """Straight-from-definition Efron fit, for comparison."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        u, v, ll = np.zeros_like(b), np.zeros((len(b), len(b))), 0.0
        w = np.exp(x @ b)
        for s in np.unique(t[e == 1]):
            risk, dead = t >= s, (t == s) & (e == 1)
            d = dead.sum()
            ll += (x[dead] @ b).sum()
            u += x[dead].sum(0)
            for l in range(d):
                wt = w * risk - l / d * w * dead
                m = wt @ x / wt.sum()
                ll -= np.log(wt.sum())
                u -= m
                v += (x * wt[:, None]).T @ x / wt.sum() - np.outer(m, m)
        b = b + np.linalg.solve(v, u)
    return b, v, ll


def test_cox_many_covariates_and_blocks(spark):
    rng = np.random.default_rng(5)
    n = 250
    x = np.column_stack([rng.normal(size=n).round(1), rng.integers(0, 2, n), rng.integers(0, 5, n)])
    t = np.ceil(rng.exponential(20 * np.exp(-0.4 * x[:, 0] - 0.6 * x[:, 1])))
    e = (rng.random(n) < 0.7).astype(int)
    df = spark.createDataFrame([(int(a), int(b), *map(float, r)) for a, b, r in zip(t, e, x)], "time int, event int, p double, q double, r double")
    b, v, ll = numpy_cox(t, e, x)
    for blocks in (None, 8):
        got = cox.cox_fit(df, ["p", "q", "r"], blocks=blocks)
        assert np.allclose(got.beta, b, atol=1e-6)
        assert np.allclose(got.information, v, rtol=1e-5)
        assert got.loglik == pytest.approx(ll, rel=1e-9)
    shuffled = cox.cox_fit(df.repartition(7), ["p", "q", "r"])
    assert np.allclose(shuffled.beta, got.beta, atol=1e-9)
    rows = forest.forest(got, df).orderBy("position").collect()
    assert [r["variable"] for r in rows] == ["p", "q", "r"] and rows[0]["n"] == n


def test_factor_with_three_levels(spark):
    rng = np.random.default_rng(9)
    n = 200
    g, z = rng.integers(0, 3, n), rng.integers(0, 4, n)
    t = np.ceil(rng.exponential(15 * np.exp(-0.5 * (g == 1) - 0.9 * (g == 2)))).astype(int)
    e = (rng.random(n) < 0.8).astype(int)
    rows = [(int(a), int(b), "abc"[c], float(d)) for a, b, c, d in zip(t, e, g, z)] + [(5, 1, "q", 1.0), (5, 1, None, 1.0), (None, 1, "a", 1.0)]
    df = spark.createDataFrame(rows, "time int, event int, g string, z double")
    got = cox.cox_fit(df, [cox.Factor("g", ("a", "b", "c")), "z"])
    want, info, _ = numpy_cox(t, e, np.column_stack([g == 1, g == 2, z]).astype(float))
    assert got.names == ["gb", "gc", "z"] and got.n == n
    assert np.allclose(got.beta, want, atol=1e-6) and np.allclose(got.information, info, rtol=1e-5)
    tests = {r["term"]: r for r in ph_test(got).collect()}
    assert tests["g"]["df"] == 2 and tests["z"]["df"] == 1 and tests["GLOBAL"]["df"] == 3
    shown = [(r["term"], r["reference"]) for r in forest.forest(got, df).orderBy("position").collect()]
    assert shown == [("ga", True), ("gb", False), ("gc", False), ("z", False)]


def test_fractional_times_in_blocks(trial):
    fine = trial.withColumn("time", F.col("time") / 7 + F.col("x") / 1000)
    plain = {(r["time"]): r for r in km.kaplan_meier(fine).collect()}
    for r in km.kaplan_meier(fine, blocks=5).collect():
        assert r["surv"] == pytest.approx(plain[r["time"]]["surv"], rel=1e-12) and r["n_risk"] == plain[r["time"]]["n_risk"]
    a = logrank.logrank_test(fine, "arm", ["treated", "placebo"]).first()["chisq"]
    assert logrank.logrank_test(fine, "arm", ["treated", "placebo"], blocks=5).first()["chisq"] == pytest.approx(a, rel=1e-12)


def test_score_residual_identities(trial, fit):
    """The gradient vanishes at the estimate, and the null test equals the fit's score test."""
    at = cox.per_time(fit.counts, fit.predictor(), fit.centred()).agg(F.sum("u0")).first()[0]
    assert abs(at) < 1e-6
    row = cox.null_tests(trial, ["x"]).first()
    assert row["score_chisq"] == pytest.approx(fit.score, rel=1e-9) and row["loglik_null"] == pytest.approx(fit.loglik_null, rel=1e-9)


def test_published_model_summary():
    """Published coefficients, errors and likelihoods give the published limits, p and criteria."""
    published = {  # estimate (rounded), standard error, statistic, p, low, high
        "age10": (0.92, 0.12208779186962102, -0.6609956941632052, 0.509, 0.73, 1.17),
        "sex_fF": (2.2, 0.6646044839059315, 1.1846200431704874, 0.236, 0.6, 8.08),
        "los": (1.16, 0.04248381046998508, 3.5944638339767074, 3.25e-4, 1.07, 1.27),
        "hx_htnYes": (15.5, 1.0754226811683147, 2.5483330646593574, 0.0108, 1.88, 127.53),
    }
    for hr, se, z, p, low, high in published.values():
        got = cox._hazard_row(z * se, se)
        assert round(got[0], 2) == hr and got[3] == pytest.approx(p, rel=5e-3)
        assert round(got[4], 2) == low and round(got[5], 2) == high
    fit = cox.CoxFit(None, [], [], [], np.zeros(4), np.zeros(4), np.eye(4), np.eye(4), -50.203, -39.529, 21.836, 55, 13, 5, True, None)
    assert fit.lr == pytest.approx(21.349, abs=2e-3)
    assert fit.aic == pytest.approx(87.058, abs=1e-3) and fit.bic == pytest.approx(95.087, abs=1e-3)


def test_concordance_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def row(i):
        seen.add(1)
        return 1 + i % 7, i % 2, float(i % 5)

    people = spark.createDataFrame(spark.sparkContext.parallelize(range(60), 3).map(row), "time int, event int, score double")
    got = concordance(people).first()
    rows = [(1 + i % 7, i % 2, i % 5) for i in range(60)]
    pairs = [(s, z) for t, e, s in rows if e for u, f, z in rows if u > t or u == t and not f]
    assert got["pairs"] == len(pairs) and got["concordance"] == pytest.approx(sum((s > z) + (s == z) / 2 for s, z in pairs) / len(pairs), rel=1e-12)
    assert seen.value == 60


def test_followup_joins_claims_once(spark, tmp_path):
    start, rng = date(1997, 1, 1), random.Random(4)
    people = [(c, rng.randrange(2, 15), rng.choice([None, 20, 45, 300])) for c in range(1, 19)]
    orders, lines = [], []
    for c, los, later in people:
        for k, day in enumerate([0] if later is None else [0, los + later]):
            orders.append((10 * c + k, c, start + timedelta(days=day), "F"))
            lines.append((10 * c + k, 10, 1, 1, float(los), "A"))
    tables = {
        "customer": ([(c, c % 3) for c, *_ in people], "c_custkey long, c_nationkey int"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate date, o_orderstatus string"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    table = survival.followup(spark, str(tmp_path))
    assert not [f for f in table.inputFiles() if "lineitem" in f or "orders" in f]
    horizon = (date(2000, 1, 1) - start).days
    want = {c: (los, horizon if later is None else later, int(later is not None)) for c, los, later in people}
    got = {r.subject_id: (r.los, r.time, r.event) for r in table.collect()}
    assert {c: (los, e) for c, (los, _, e) in got.items()} == {c: (los, e) for c, (los, _, e) in want.items()}
    assert all(got[c][1] == want[c][1] for c in want if want[c][2]) and min(t for _, t, e in got.values() if not e) >= horizon
    pairs = [(a, b) for a, t, e in got.values() if e for b, u, f in got.values() if u > t or u == t and not f]
    row = survival.concordance_of_length_of_stay(spark, str(tmp_path)).first()
    assert row["pairs"] == len(pairs) and row["concordance"] == pytest.approx(sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs), abs=1e-6)
