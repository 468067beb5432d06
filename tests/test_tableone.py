"""Table 1 arithmetic against published counts and definitions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sojourn.stats import profile, tableone

GROUPS = ("nonreadmit", "readmit")

# Published counts per level (nonreadmit, readmit), then p, test and standardised difference.
PUBLISHED = {
    "sex_f": ([(20, 7), (18, 10)], 0.562, "fisher", 0.231),
    "er_flag": ([(20, 11), (18, 6)], 0.558, "fisher", 0.247),
    "path_type_f": ([(1, 0), (3, 0), (15, 6), (19, 11)], 0.511, "chisq", 0.520),
    "result_type_f": ([(2, 6), (2, 0), (34, 11)], 0.011, "chisq", 0.864),
    "index_year_f": (
        [(2, 1), (4, 2), (1, 0), (1, 3), (1, 4), (3, 2), (4, 1), (4, 0), (1, 2), (5, 0), (5, 0), (3, 1), (2, 1), (2, 0)],
        0.115, "chisq", 1.647,
    ),
    "index_cat": (
        [(7, 4), (5, 0), (1, 0), (2, 0), (1, 0), (1, 0), (0, 1), (2, 0), (2, 0), (2, 3), (0, 1), (1, 0), (0, 1), (9, 6), (1, 0), (4, 1)],
        0.327, "chisq", 1.478,
    ),
    "death_flag": ([(33, 15), (5, 2)], 1.000, "fisher", 0.042),
    "index_dx_group_f": ([(23, 9), (15, 8)], 0.768, "fisher", 0.154),
}
EXACT = ("sex_f", "er_flag", "death_flag", "index_dx_group_f")


@pytest.fixture(scope="module")
def published(spark):
    columns = {}
    for name, (levels, *_) in PUBLISHED.items():
        columns[name] = [
            [f"{i:02d}" for i, counts in enumerate(levels) for _ in range(counts[g])] for g in (0, 1)
        ]
    rows = []
    for g, size in enumerate((38, 17)):
        for i in range(size):
            rows.append((GROUPS[g], *[columns[n][g][i] for n in PUBLISHED]))
    return spark.createDataFrame(rows, "group string, " + ", ".join(f"{n} string" for n in PUBLISHED))


def test_published_categorical(published):
    got = {r["variable"]: r for r in tableone.comparison(published, [], list(PUBLISHED), [], EXACT, "group", GROUPS).collect()}
    for name, (_, p, test, smd) in PUBLISHED.items():
        assert got[name]["test"] == test, name
        assert got[name]["p"] == pytest.approx(p, abs=5.1e-4), name
        assert got[name]["smd"] == pytest.approx(smd, abs=5.1e-4), name


def test_published_display(published):
    rows = {(r["variable"], r["level"]): r for r in tableone.display(published, [], list(PUBLISHED), [], EXACT, "group", GROUPS, overall=True).collect()}
    assert rows[("n", "")]["nonreadmit"] == "38" and rows[("n", "")]["Overall"] == "55"
    assert rows[("sex_f", "00")]["nonreadmit"] == "20 (52.6)" and rows[("sex_f", "00")]["p"] == "0.562"
    assert rows[("sex_f", "01")]["readmit"] == "10 (58.8)" and rows[("sex_f", "01")]["p"] is None
    assert rows[("death_flag", "00")]["p"] == "1.000" and rows[("death_flag", "00")]["test"] == "exact"
    assert rows[("path_type_f", "00")]["readmit"] == "0 (0.0)"
    assert rows[("sex_f", "00")]["Overall"] == "27 (49.1)"


def test_display_in_given_level_order(published):
    rows = tableone.display(published, [], ["sex_f", "er_flag"], [], EXACT, "group", GROUPS, levels={"sex_f": ("01", "00")})
    got = [(r["variable"], r["level"], r["test"]) for r in rows.orderBy("position", "level_position").collect()]
    assert [g[:2] for g in got] == [("n", ""), ("sex_f", "01"), ("sex_f", "00"), ("er_flag", "00"), ("er_flag", "01")]
    assert [g[2] for g in got] == [None, "exact", None, "exact", None]
    assert {r["label"] for r in rows.collect()} == {"n", "sex_f (%)", "er_flag (%)"}


@pytest.fixture(scope="module")
def numeric(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 9, 40).astype(float), rng.integers(2, 12, 31).astype(float)
    rows = [("nonreadmit", float(v), None) for v in a] + [("readmit", float(v), float(i)) for i, v in enumerate(b)]
    return spark.createDataFrame(rows + [("readmit", None, None)], "group string, v double, w double"), a, b


def test_continuous(numeric):
    df, a, b = numeric
    got = {(r["variable"], r["grp"]): r for r in tableone.continuous(df, ["v", "w"], "group").collect()}
    row = got[("v", "readmit")]
    assert (row["n"], row["n_missing"]) == (31, 1)
    assert row["mean"] == pytest.approx(b.mean()) and row["sd"] == pytest.approx(b.std(ddof=1))
    assert [row["q1"], row["median"], row["q3"]] == pytest.approx(list(np.quantile(b, [0.25, 0.5, 0.75])))
    empty = got[("w", "nonreadmit")]
    assert empty["n"] == 0 and empty["median"] is None


def test_kruskal_and_anova(numeric):
    df, a, b = numeric
    rows = {r["variable"]: r for r in tableone.kruskal(df, ["v", "w"], "group", GROUPS).collect()}
    both = np.concatenate([a, b])
    rank = np.array([(both < x).sum() + ((both == x).sum() + 1) / 2 for x in both])
    n, ra, rb = len(both), rank[: len(a)], rank[len(a):]
    h = 12 / (n * (n + 1)) * (ra.sum() ** 2 / len(a) + rb.sum() ** 2 / len(b)) - 3 * (n + 1)
    _, t = np.unique(both, return_counts=True)
    assert rows["v"]["statistic"] == pytest.approx(h / (1 - (t**3 - t).sum() / (n**3 - n)))
    assert rows["w"]["p"] is None and rows["w"]["statistic"] is None
    f = tableone.anova(df, ["v", "w"], "group", GROUPS).filter("variable = 'v'").first()
    grand = both.mean()
    between = len(a) * (a.mean() - grand) ** 2 + len(b) * (b.mean() - grand) ** 2
    within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    assert f["statistic"] == pytest.approx(between / (within / (n - 2)))
    assert f["df2"] == n - 2


def test_all_null_group(numeric):
    df = numeric[0]
    row = tableone.comparison(df, ["w"], [], ["w"], [], "group", GROUPS).first()
    assert row["p"] is None and row["smd"] is None
    shown = tableone.display(df, ["w"], [], ["w"], [], "group", GROUPS).filter("variable = 'w'").first()
    assert shown["nonreadmit"] == "NA" and shown["p"] == "NA" and shown["smd"] == "NA"


def test_smd_needs_no_particular_dropped_level(published):
    swapped = published.withColumn("index_cat", F.concat(F.lit("z"), (F.lit(99) - F.col("index_cat").cast("int")).cast("string")))
    a = tableone.smd_categorical(published, ["index_cat"], "group", GROUPS).first()["smd"]
    b = tableone.smd_categorical(swapped, ["index_cat"], "group", GROUPS).first()["smd"]
    assert a == pytest.approx(b, rel=1e-9)


def test_fisher_against_all_tables():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(2, 60))
        r, c = (int(rng.integers(0, n + 1)) for _ in range(2))
        low, high = max(0, r + c - n), min(r, c)
        x = int(rng.integers(low, high + 1))
        ways = {k: math.comb(r, k) * math.comb(n - r, c - k) for k in range(low, high + 1)}
        want = sum(w for w in ways.values() if w <= ways[x] * (1 + 1e-7)) / math.comb(n, c)
        assert tableone.fisher_p(x, r, c, n) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("off", [0, -9_000, 4_000, 20_000])
def test_fisher_at_a_billion(off):
    """Against sums of ratios to the observed probability, which need no factorials."""
    n, r, c = 1_000_000_000, 400_000_000, 300_000_000
    x = r * c // n + off
    up, down = (np.arange(400_000, dtype="float64") for _ in range(2))
    k = x + up
    above = np.cumsum(np.log((r - k) * (c - k) / ((k + 1) * (n - r - c + k + 1))))
    k = x - down
    below = np.cumsum(np.log(k * (n - r - c + k) / ((r - k + 1) * (c - k + 1))))
    logs = np.concatenate([[0.0], above, below])
    want = math.fsum(np.exp(logs[logs <= 1e-7])) / math.fsum(np.exp(logs))
    assert tableone.fisher_p(x, r, c, n) == pytest.approx(want, rel=1e-9)


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, None), (9, "b")], "k int, s string")
    assert profile.counts(df, "k").first() == (4, 3)
    rows = {r["column_name"]: r for r in profile.glimpse(df).collect()}
    assert rows["s"]["n_missing"] == 1 and rows["k"]["lowest"] == "1"
    many = spark.range(100).select(F.when(F.col("id") < 90, F.col("id") % 9).otherwise(99).cast("string").alias("s"))
    levels = profile.level_summary(many, ["s"], top=4).collect()
    assert len(levels) == 5 and sum(r["n"] for r in levels) == 100
    assert {r["level"]: r["n"] for r in levels}["(Other)"] == 60


@pytest.mark.parametrize("kinds, shown", [(6, 6), (7, 7), (8, 7)])
def test_level_summary_shows_a_single_rest_itself(spark, kinds, shown):
    rows = spark.range(70).select(F.when(F.col("id") % 10 > 0, F.col("id") % kinds).cast("string").alias("s"))
    levels = {r["level"]: r["n"] for r in profile.level_summary(rows, ["s"]).collect()}
    assert levels.pop("(NULL)") == 7 and len(levels) == shown and sum(levels.values()) == 63
    assert ("(Other)" in levels) == (kinds == 8)


def test_overall_beside_groups_in_one_pass(spark, tmp_path):
    """Every cell of the combined table equals that of the separate ones; persons are read once."""
    rows = [(("a", "b", None, "c")[i % 4], float(i * 37 % 11) if i % 5 else None, i * 1.5, ("x", "y", None)[i % 3], "only c" if i % 4 == 3 else "z") for i in range(120)]
    df = spark.createDataFrame(rows, "g string, v double, w double, k string, m string")
    args = (["v", "w"], ["k", "m"], ["v"], [])
    both = {(r.variable, r.level): r for r in tableone.display(df, *args, "g", ("a", "b"), overall=True).collect()}
    alone = {(r.variable, r.level): r for r in tableone.display(df, *args, None, ()).collect()}
    groups = {(r.variable, r.level): r for r in tableone.display(df, *args, "g", ("a", "b")).collect()}
    assert {k: r.Overall for k, r in both.items()} == {k: r.Overall for k, r in alone.items()}
    assert {k: (r.a, r.b, r.p, r.smd) for k, r in groups.items()}.items() <= {k: (r.a, r.b, r.p, r.smd) for k, r in both.items()}.items()
    assert both[("n", "")].Overall == "120" and both[("n", "")].a == "30"
    v = sorted(x for _, x, *_ in rows if x is not None)
    assert both[("v", "")].Overall.startswith(f"{(v[47] + v[48]) / 2:.2f} [")
    df.write.parquet(str(tmp_path / "p"))
    stored, reads = spark.read.parquet(str(tmp_path / "p")), []
    real = tableone.tally
    try:
        tableone.tally = lambda *a: reads.append(1) or real(*a)
        shown = tableone.display(stored, *args, "g", ("a", "b"), overall=True)
    finally:
        tableone.tally = real
    assert reads == [1] and str(tmp_path / "p") not in shown._jdf.queryExecution().analyzed().toString()
    assert not any(str(tmp_path / "p") in f for f in shown.inputFiles())


def test_sketched_quartiles(spark):
    df = spark.range(30_000).selectExpr("IF(id % 2 = 0, 'a', 'b') AS g", "CAST(id AS DOUBLE) AS v", "CAST(NULL AS DOUBLE) AS w")
    exact = {(r.variable, r.grp): r for r in tableone.continuous(df, ["v", "w"], "g").collect()}
    near = {(r.variable, r.grp): r for r in tableone.continuous(df, ["v", "w"], "g", rank_error=0.01).collect()}
    assert near.keys() == exact.keys() and near[("w", "a")].median is None
    for q in ("q1", "median", "q3"):
        assert abs(near[("v", "a")][q] - exact[("v", "a")][q]) <= 0.02 * 30_000
