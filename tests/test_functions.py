import math

import pytest
from pyspark.sql import functions as F

from sojourn.functions import dates, logic, numbers


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_tails(spark):
    # Published critical values and closed forms.
    cases = [(3.841458820694124, 1, 0.05), (6.6348966, 1, 0.01), (55.7584789, 40, 0.05), (10.0, 2, math.exp(-5)), (200.0, 2, math.exp(-100)), (0.0, 3, 1.0)]
    df = spark.createDataFrame([(x, k, p) for x, k, p in cases], "x double, k int, p double")
    for row in df.withColumn("got", numbers.chi2_sf("x", "k")).collect():
        assert row["got"] == pytest.approx(row["p"], rel=1e-7)
    z = one(spark, p=numbers.chi2_sf("1.959963984540054D * 1.959963984540054D", "1"))
    assert z["p"] == pytest.approx(math.erfc(1.959963984540054 / math.sqrt(2)), rel=1e-12)
    for x in (1e-3, 0.3, 2.0, 7.0, 30.0, 80.0):
        got = one(spark, p=numbers.chi2_sf(f"{x * x}D", "1"))["p"]
        assert got == pytest.approx(math.erfc(x / math.sqrt(2)), rel=1e-10, abs=1e-300)


def test_f_tail(spark):
    # F(2, m) has the closed form (1 + 2f/m)^(-m/2); t with one degree of freedom is Cauchy.
    for f, m in [(0.1, 7), (3.0, 10), (3.0, 1000), (12.0, 50000), (0.9, 3)]:
        got = one(spark, p=numbers.f_sf(f"{f}D", "2", str(m)))["p"]
        assert got == pytest.approx((1 + 2 * f / m) ** (-m / 2), rel=1e-9)
    assert one(spark, p=numbers.f_sf("4D", "1", "1"))["p"] == pytest.approx(1 - 2 * math.atan(2) / math.pi, rel=1e-10)
    assert one(spark, p=numbers.f_sf("0.0035D", "1", "53"))["p"] == pytest.approx(0.953, abs=5e-4)
    assert one(spark, p=numbers.f_sf("CAST(NULL AS DOUBLE)", "1", "5"))["p"] is None


def test_gamma_family(spark):
    for x in (0.5, 1.0, 3.5, 42.0, 1e6):
        got = one(spark, g=F.expr(numbers.ln_gamma(f"{x}D")))
        assert got["g"] == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13)


def test_rounding(spark):
    df = spark.createDataFrame([(0.000123456,), (1234.56,), (0.0,), (None,), (-0.0996,)], "x double")
    got = [r[0] for r in df.select(numbers.signif("x", 3)).collect()]
    assert got == [pytest.approx(0.000123), 1230.0, 0.0, None, pytest.approx(-0.0996)]
    assert one(spark, a=numbers.round_even(F.lit(0.125), 2), b=numbers.round_even(F.lit(0.375), 2)) == (0.12, 0.38)


def test_null_rules(spark):
    row = spark.createDataFrame([(None, 3)], "a int, b int").select(
        logic.in_list("a", [1]).alias("in"),
        logic.if_else(F.col("a") > 1, F.lit("y"), F.lit("n")).alias("choice"),
        logic.row_min("a", "b").alias("low"),
        logic.row_max("b", F.lit(5)).alias("high"),
        logic.yes_no(F.col("a").isNotNull()).alias("yn"),
        logic.recode("b", {3: "three"}).alias("r"),
    ).first()
    assert row == (False, None, None, 5, "No", "three")
    none = spark.createDataFrame([(None,), (None,)], "p boolean").agg(logic.any_true("p").alias("x")).first()
    assert none["x"] is False


def test_cut(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 8.0, 9.0, None)], "x double")
    got = [r[0] for r in df.select(logic.cut("x", [1.0, 2.0, 2.0, 8.0, 8.0], ["Q1", "Q2", "Q3", "Q4"])).collect()]
    assert got == ["Q1", "Q1", "Q3", "Q3", None, None]


def test_dates(spark):
    row = one(
        spark,
        good=dates.ymd(F.lit("20080229")), bad=dates.ymd(F.lit("20061301")), month=dates.ym(F.lit("200802")),
        number=dates.ymd(F.lit(20080229)), three=dates.years_after(F.lit("2008-02-29").cast("date"), 3),
        year=dates.whole_number(F.lit("19xxLE")), ok=dates.whole_number(F.lit("1950")),
    )
    assert str(row["good"]) == "2008-02-29" and row["bad"] is None and str(row["month"]) == "2008-02-01"
    assert row["number"] == row["good"] and str(row["three"]) == "2011-02-28"
    assert row["year"] is None and row["ok"] == 1950
