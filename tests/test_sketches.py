"""Sketches against exact results, code books against regexes, level summaries of many levels."""

import random

import pytest
from pyspark.sql import functions as F

from sojourn.functions.logic import matches
from sojourn.operators import codebook, sketches
from sojourn.stats import profile


@pytest.mark.parametrize("error", [0.05, 0.01])
def test_distinct_counts_from_stored_parts(spark, tmp_path, error):
    rows = spark.range(200_000).selectExpr("id % 10 AS day", "CASE WHEN id % 7 = 0 THEN NULL ELSE id * 31 % 50021 END AS person", "CAST(id % 3 AS STRING) AS form")
    for day in (0, 5):  # appended day by day
        part = rows.where(f"day >= {day} AND day < {day + 5}")
        sketches.distinct_sketches(part, ["day", "form"], "person", error).write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    for by in ([], ["form"], [(F.col("day") >= 5).alias("late")]):
        got = sketches.distinct_estimates(sketches.united(stored, by)).collect()
        want = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_distinct("person").alias("n_ids")).collect()
        assert sorted(r.n_rows for r in got) == sorted(r.n_rows for r in want)
        for a, b in zip(sorted(r.n_ids for r in got), sorted(r.n_ids for r in want)):
            assert abs(a - b) <= 4 * error * b
    assert sketches.relative_error(sketches.log_size(error)) <= error


def test_distinct_counts_of_nothing(spark):
    empty = spark.createDataFrame([("a", None)], "g string, k long")
    assert sketches.distinct_estimates(sketches.distinct_sketches(empty, ["g"], "k")).collect() == [("a", 1, 0)]
    assert sketches.distinct_estimates(sketches.distinct_sketches(empty.where("1 = 0"), ["g"], "k")).collect() == []


def test_quantiles_from_merged_parts(spark):
    rng = random.Random(3)
    rows = [(v, i % 8, rng.gauss(0, 1) if v == "x" else float(rng.randint(0, 5))) for v in ("x", "y") for i in range(40_000)] + [("z", 0, None), ("w", 1, 2.5)]
    df = spark.createDataFrame(rows, "variable string, part int, value double")
    parts = sketches.quantile_sketches(df, ["variable", "part"], rank_error=0.01)
    probs = {"low": 0.0, "q1": 0.25, "median": 0.5, "tail": 0.99, "high": 1.0}
    got = {r.variable: r for r in sketches.sketched_quantiles(sketches.merged(parts, ["variable"]), ["variable"], probs).collect()}
    assert set(got) == {"x", "y", "w"} and got["w"].n == 1 and got["w"].median == 2.5
    for v in ("x", "y"):
        values = sorted(x for w, _, x in rows if w == v)
        assert got[v].n == len(values)
        for name, p in probs.items():
            q = got[v][name]
            assert sum(x < q for x in values) / len(values) <= p + 0.02 and sum(x <= q for x in values) / len(values) >= p - 0.02


def test_state_does_not_grow(spark):
    size = lambda n: len(sketches.quantile_sketches(spark.range(n).selectExpr("id * 1.5 AS value"), []).first().sketch)
    assert size(400_000) <= 1.3 * size(50_000) < 40_000


PATTERNS = {"heart": "^I2[0-5]", "any_i": "^I", "cancer": r"^C\d{2}", "nothing": "^ZZ"}


@pytest.mark.parametrize("limit", [codebook.MAX_CODES, 2])
def test_code_book(spark, limit):
    rng = random.Random(1)
    codes = ["I21", "I30", "C34", "C3", "E11", "", None]
    df = spark.createDataFrame([(i, rng.choice(codes), rng.choice(codes), 7) for i in range(500)], "id int, dx1 string, dx2 string, code int")
    book = codebook.code_book(df, ["dx1", "dx2"], PATTERNS, limit)
    assert (book.table is None) == (limit == 2)
    coded = codebook.with_code_bits(df, ["dx1", "dx2"], book)
    flags = coded.select("id", "dx1", "dx2", "code", *[book.has(F.col("code_bits"), n).alias(n) for n in PATTERNS], book.has(F.col("code_bits"), "heart", "cancer").alias("either"))
    want = df.select("*", *[F.coalesce(matches(["dx1", "dx2"], p), F.lit(False)).alias(n) for n, p in PATTERNS.items()], F.coalesce(matches(["dx1", "dx2"], PATTERNS["heart"], PATTERNS["cancer"]), F.lit(False)).alias("either"))
    assert sorted(flags.collect(), key=repr) == sorted(want.collect(), key=repr)
    plan = coded._jdf.queryExecution().executedPlan().toString()
    assert ("RLIKE" in plan) == (limit == 2)  # rows themselves meet no pattern, the book's few codes did


def test_empty_code_book(spark):
    df = spark.createDataFrame([(1, None)], "id int, dx1 string")
    book = codebook.code_book(df, ["dx1"], PATTERNS)
    assert codebook.with_code_bits(df, ["dx1"], book).first().code_bits == 0


def test_level_summary_of_many_levels(spark):
    many = spark.range(300_000).selectExpr("concat('v', id) AS a", "CASE WHEN id < 9 THEN 'few' WHEN id % 2 = 0 THEN 'even' END AS b", "id % 5 AS c")
    many = many.unionByName(many.where("a IN ('v7', 'v9')"))
    found = profile.level_summary(many, ["a", "b", "c"], top=3)
    got = sorted(map(tuple, found.collect()))
    n_null = 300_000 - 9 - (150_000 - 5) + 1
    assert got == sorted([
        ("a", "v7", 2), ("a", "v9", 2), ("a", "v0", 1), ("a", "(Other)", 299_997),
        ("b", "few", 10), ("b", "even", 149_995), ("b", "(NULL)", n_null),
        ("c", "2", 60_001), ("c", "4", 60_001), ("c", "0", 60_000), ("c", "(Other)", 120_000),
    ])
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
