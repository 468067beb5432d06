"""Competing events and residuals."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from sojourn import tte
from sojourn.config import StudyConfig
from sojourn.operators import running
from sojourn.stats import cox, incidence, km, zph


def test_hand_worked_table(spark):
    # at risk 6: event 1 at t=1; 5: death at 2; 4: censored at 3; 3: event and death at 4; 1: event at 5
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 0), (4, 1), (4, 2), (5, 1), (None, 1), (9, None)], "time int, event int")
    got = {(r.time, r.cause): r for r in incidence.cumulative_incidence(df).collect()}
    want = {1: (1 / 6, 0, 5 / 6), 2: (1 / 6, 1 / 6, 4 / 6), 3: (1 / 6, 1 / 6, 4 / 6), 4: (1 / 6 + 2 / 9, 1 / 6 + 2 / 9, 2 / 9), 5: (1 / 6 + 4 / 9, 1 / 6 + 2 / 9, 0)}
    for t, (one, two, surv) in want.items():
        assert got[(t, 1)].incidence == pytest.approx(one) and got[(t, 2)].incidence == pytest.approx(two, abs=1e-12)
        assert got[(t, 1)].surv == pytest.approx(surv, abs=1e-12)
    assert [got[(t, 1)].n_risk for t in range(1, 6)] == [6, 5, 4, 3, 1]


@pytest.mark.parametrize("limit", [10**6, 25])
def test_without_competing_events_it_is_one_minus_survival(spark, monkeypatch, limit):
    monkeypatch.setattr(running, "WINDOW_ROWS", limit)
    rng = random.Random(4)
    df = spark.createDataFrame([(round(rng.expovariate(0.2), 2), int(rng.random() < 0.6), rng.choice("ab")) for _ in range(300)], "time double, event int, g string")
    got = {(r.g, r.time): r for r in incidence.cumulative_incidence(df, [1], ["g"]).collect()}
    for r in km.kaplan_meier(df, ["g"]).collect():
        assert got[(r.g, r.time)].incidence == pytest.approx(r.risk, abs=1e-9) and got[(r.g, r.time)].surv == pytest.approx(r.surv, abs=1e-9)


def test_incidences_and_survival_add_up(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.randint(0, 60), rng.choice([0, 1, 2, 3])) for _ in range(500)], "time int, event int")
    rows = incidence.cumulative_incidence(df, (1, 2, 3)).groupBy("time").agg(F.sum("incidence").alias("i"), F.first("surv").alias("s")).collect()
    assert all(r.i + r.s == pytest.approx(1) for r in rows)
    assert incidence.cumulative_incidence(df.where("1 = 0")).collect() == []


def test_censoring_date(spark):
    cfg = StudyConfig(obs_start=date(2010, 1, 1), study_end=date(2012, 12, 31))
    rows = [(1, "2010-01-01", "2010-03-01", None), (2, "2010-01-01", "2010-03-01", "2010-02-01"), (3, "2010-01-01", None, "2010-02-01"),
            (4, "2010-01-01", "2010-02-01", "2010-02-01"), (5, "2010-01-01", None, None), (6, "2010-01-01", None, "2014-01-01")]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string").selectExpr("id", "CAST(a AS DATE) index_discharge", "CAST(b AS DATE) first_after_discharge", "CAST(c AS DATE) death")
    end = lambda d: {r.id: (str(r.end), r.event) for r in d.collect()}
    assert end(tte.time_to_event(df, cfg, "death", 2)) == {
        1: ("2010-03-01", 1), 2: ("2010-02-01", 2), 3: ("2010-02-01", 2), 4: ("2010-02-01", 1), 5: ("2012-12-31", 0), 6: ("2012-12-31", 0)}
    assert end(tte.time_to_event(df, cfg, "death"))[3] == ("2010-02-01", 0)
    assert end(tte.time_to_event(df, cfg))[2] == ("2010-03-01", 1)
    kept = {r.id: (r.time, r.event) for r in tte.apply_horizon(tte.time_to_event(df, cfg, "death", 2), cfg).collect()}
    assert kept[3] == (31, 2) and kept[5] == (1095, 0)


def test_residuals_sum_to_the_score_and_give_the_test(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(300):
        x, g = rng.gauss(0, 1), rng.choice("ab")
        rows.append((min(12, int(rng.expovariate(0.2 * np.exp(0.5 * x + 0.3 * (g == "b"))))), int(rng.random() < 0.8), round(x, 1), g))
    df = spark.createDataFrame(rows, "time int, event int, x double, g string")
    fit = cox.cox_fit(df, ["x", cox.Factor("g", ("a", "b"))])
    found = zph.schoenfeld_residuals(fit)
    assert found.groupBy("term").agg(F.sum("n")).collect()[0][1] == fit.events
    sums = {r.term: r.s for r in found.groupBy("term").agg(F.sum(F.col("n") * F.col("residual")).alias("s")).collect()}
    assert set(sums) == set(fit.names) and all(abs(s) < 1e-6 for s in sums.values())
    means = {r.term: r.s for r in found.groupBy("term").agg((F.sum(F.col("n") * F.col("scaled")) / F.sum("n")).alias("s")).collect()}
    assert [means[n] for n in fit.names] == pytest.approx(list(fit.beta), abs=1e-6)
    # the trend of the residuals in the transform of time is the numerator of the test
    g = zph._transform(fit.counts, 0)
    trend = found.join(g, "time").groupBy("term").agg(F.sum(F.col("n") * F.col("g") * F.col("residual")).alias("u"))
    u = np.array([{r.term: r.u for r in trend.collect()}[n] for n in fit.names])
    at = cox.per_time(fit.counts, fit.predictor(), fit.centred()).join(g, "time")
    row = at.agg(*cox._total(2), *cox._total(2, "g", "g_"), *cox._total(2, "g * g", "gg_")).first()
    b = cox._matrix(row, 2, "g_")
    schur = cox._matrix(row, 2, "gg_") - b @ np.linalg.inv(cox._matrix(row, 2)) @ b
    want = {r.term: r.chisq for r in zph.ph_test(fit).collect()}
    assert float(u @ np.linalg.inv(schur) @ u) == pytest.approx(want["GLOBAL"], rel=1e-4)
