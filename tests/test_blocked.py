"""Running totals and concordance on continuous times, on both sides of the window bound."""

import random

import pytest

from sojourn.operators import running
from sojourn.stats import concordance as conc
from sojourn.stats import cox, km, logrank, zph


@pytest.fixture(params=["window", "ranges"])
def form(request, monkeypatch):
    monkeypatch.setattr(running, "WINDOW_ROWS", 10**6 if request.param == "window" else 40)
    monkeypatch.setattr(conc, "TIME_BLOCKS", 16)
    return request.param


def _persons(n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        arm = rng.random() < 0.5
        time, x = rng.expovariate(0.4 if arm else 0.7), rng.gauss(0, 1)
        rows.append((round(min(time, 4.0), 3), int(time < 4 and rng.random() < 0.8), "a" if arm else "b", x, round(x * 2 + rng.gauss(0, 1), 1)))
    return rows


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(_persons(), "time double, event int, arm string, x double, score double").repartition(4)


def test_form_by_count(spark, monkeypatch):
    monkeypatch.setattr(running, "WINDOW_ROWS", 100)
    assert running.choose_blocks(spark.range(100))[1] == 0 and running.choose_blocks(spark.range(101))[1] == running.RANGE
    assert running.choose_blocks(spark.range(101), 7)[1] == 7


@pytest.mark.parametrize("descending", [False, True])
def test_range_totals(spark, monkeypatch, descending):
    monkeypatch.setattr(running, "WINDOW_ROWS", 30)
    rng = random.Random(1)
    rows = [(g, x / 7, rng.randint(0, 9)) for g in ("p", None, "q") for x in rng.sample(range(1000), 200)] + [("one", 0.5, 3)]
    df = spark.createDataFrame(rows, "g string, x double, n int")
    got = running.running_totals(df, "x", {"t": "n", "k": "1L"}, by=["g"], descending=descending, blocks=running.RANGE)
    want = {(g, x): (sum(m for h, y, m in rows if h == g and (y >= x if descending else y <= x)), sum(1 for h, y, _ in rows if h == g and (y >= x if descending else y <= x))) for g, x, _ in rows}
    assert {(r.g, r.x): (r.t, r.k) for r in got.collect()} == want and got.columns == ["g", "x", "n", "t", "k"]
    assert got.select("t").count() == len(rows)
    assert running.running_totals(df.where("1 = 0"), "x", {"t": "n"}, blocks=running.RANGE).collect() == []


def test_no_window_holds_all_rows(spark, monkeypatch):
    monkeypatch.setattr(running, "WINDOW_ROWS", 1000)
    placed = running.in_ranges(spark.range(20_000).selectExpr("id * 0.37 AS x"), ["x"])
    sizes = [r["count"] for r in placed.groupBy("__block").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 3000


def test_time_blocks_are_small(spark):
    times = spark.range(100_000).selectExpr("sqrt(id) AS time")
    sizes = [r["count"] for r in running.in_ranges(times, ["time"], "block", conc.TIME_BLOCKS).groupBy("block").count().collect()]
    assert max(sizes) <= 100_000 / 256


def test_curves_and_tests_agree(people, form, monkeypatch):
    curve = {r.time: r for r in km.kaplan_meier(people, ["arm"]).where("arm = 'a'").collect()}
    rows = [(t, e) for t, e, arm, *_ in _persons() if arm == "a"]
    surv = 1.0
    for t in sorted({t for t, _ in rows}):
        at_risk, events = sum(u >= t for u, _ in rows), sum(u == t and e for u, e in rows)
        surv *= 1 - events / at_risk
        assert curve[t].n_risk == at_risk and curve[t].surv == pytest.approx(surv, rel=1e-9, abs=1e-12)
    chisq = logrank.logrank_test(people, "arm", ["a", "b"]).first().chisq
    fit = cox.cox_fit(people, ["x", cox.Factor("arm", ("a", "b"))])
    assert fit.blocks == (0 if form == "window" else running.RANGE)
    swept = cox.cox_sweep(people, ["x"]).first().estimate
    trend = [r.chisq for r in zph.ph_test(fit).collect()]
    monkeypatch.setattr(running, "WINDOW_ROWS", 10**6)
    assert chisq == pytest.approx(logrank.logrank_test(people, "arm", ["a", "b"]).first().chisq, rel=1e-9)
    plain = cox.cox_fit(people, ["x", cox.Factor("arm", ("a", "b"))])
    assert fit.beta == pytest.approx(plain.beta, rel=1e-9) and swept == pytest.approx(cox.cox_sweep(people, ["x"]).first().estimate, rel=1e-9)
    assert trend == pytest.approx([r.chisq for r in zph.ph_test(plain).collect()], rel=1e-6)


def test_concordance_of_continuous_times(people, form):
    rows = [(t, e, s) for t, e, _, _, s in _persons()]
    good = pairs = 0.0
    for t, e, s in rows:
        for u, f, z in rows:
            if e and (u > t or u == t and not f):
                pairs += 1
                good += 1.0 if s > z else 0.5 if s == z else 0.0
    got = conc.concordance(people, "score").first()
    assert got.pairs == pairs and got.concordance == pytest.approx(good / pairs, rel=1e-12)
