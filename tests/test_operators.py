import numpy as np
import pytest
from pyspark.sql import functions as F

from sojourn.operators import columns, quantiles, running, select, sets, skew, work


@pytest.fixture(scope="module")
def lopsided(spark):
    """A third of all rows belong to one key; 40 exact copies of one of its rows too."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"),
        F.when(F.col("id") % 75 == 0, 0).otherwise(F.col("id")).alias("id"),
    )
    return rows.repartition(6)


def test_hot_keys_bounded(lopsided):
    hot = skew.hot_keys(lopsided, "key", rows_per_salt=50).collect()
    assert [(r["key"], r["salts"]) for r in hot] == [("big", 20)]
    assert skew.hot_keys(lopsided, "key").isEmpty()
    assert skew.hot_keys(lopsided.filter("key = 'none'"), "key", rows_per_salt=50).isEmpty()
    assert skew.hot_keys(lopsided.select(F.lit(None).cast("string").alias("key")), "key", rows_per_salt=50).count() <= 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_keyed_join_equals_plain_join(spark, lopsided, how):
    lookup = lopsided.select("key").distinct().filter("key <> 'k7'").withColumn("v", F.length("key"))
    got = skew.keyed_join(lopsided, lookup, "key", ["id"], how=how, hot=skew.hot_keys(lopsided, "key", rows_per_salt=40))
    want = lopsided.join(lookup, "key", how)
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_keyed_join_spreads_the_hot_key(lopsided):
    lookup = lopsided.select("key").distinct()
    hot = skew.hot_keys(lopsided, "key", rows_per_salt=50)
    salted = lopsided.join(hot, "key").select(
        F.pmod(F.xxhash64("id", F.spark_partition_id()), F.col("salts")).alias("s")
    ).groupBy("s").count().collect()
    assert len(salted) > 15 and max(r["count"] for r in salted) < 200
    assert skew.keyed_join(lopsided, lookup, "key", ["id"], hot=hot).count() == 3000


def test_first_per_key(spark):
    rows = [("a", None, 1), ("a", 5, 2), ("a", 3, 3), ("b", None, 4), (None, 1, 5)]
    df = spark.createDataFrame(rows, "k string, d int, v int")
    got = {r["k"]: r["v"] for r in select.first_per_key(df, "k", ["d", "v"], ["v"]).collect()}
    assert got == {"a": 3, "b": 4, None: 5}
    last = {r["k"]: r["v"] for r in select.first_per_key(df, "k", ["-d", "v"], ["v"]).collect()}
    assert last == {"a": 2, "b": 4, None: 5}
    with pytest.raises(TypeError):
        select.first_per_key(df, "v", ["-k"], ["d"])


def test_append_checks_types(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2,)], "i int")
    rows = sets.append(a, b, seq="n").orderBy("n").collect()
    assert [(r["i"], r["s"], r["n"]) for r in rows] == [(1, "x", 0), (2, None, 1)]
    with pytest.raises(TypeError):
        sets.append(a, spark.createDataFrame([("2",)], "i string"))


def test_sets(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "subject_id string")
    listed = spark.createDataFrame([("a",), (None,)], "subject_id string")
    assert sorted(str(r[0]) for r in sets.drop(df, listed).collect()) == ["None", "b"]
    assert [r[0] for r in sets.keep(df, listed).collect()] == ["a"]
    assert sets.any_of(df, listed).count() == 3


def test_null_safe_join(spark):
    a = spark.createDataFrame([(1, None), (2, 5)], "k int, d int")
    b = spark.createDataFrame([(1, None, "x"), (2, 6, "y")], "k int, d int, v string")
    assert [tuple(r) for r in sets.null_safe_join(a, b, ["k", "d"], nullable=["d"]).collect()] == [(1, None, "x")]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    assert columns.select_any(df, ["b", "zz", "a"]).columns == ["b", "a"]
    assert columns.add_missing(df, a=F.lit(9), c=F.lit(3)).first() == (1, 2.0, 3)
    with pytest.raises(Exception):
        columns.select_all(df, ["zz"]).collect()


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("blocks", [None, 3, 50])
def test_running_totals(spark, descending, blocks):
    rng = np.random.default_rng(1)
    rows = [(g, float(x), int(n)) for g in ("p", "q") for x, n in zip(rng.permutation(200) / 7, rng.integers(1, 9, 200))]
    df = spark.createDataFrame(rows, "g string, x double, n int")
    got = running.running_totals(df, "x", {"t": "n"}, by=["g"], descending=descending, blocks=blocks).collect()
    for r in got:
        want = sum(n for g, x, n in rows if g == r["g"] and ((x >= r["x"]) if descending else (x <= r["x"])))
        assert r["t"] == want
    assert len(got) == 400


@pytest.mark.parametrize("blocks", [None, 16])
def test_quantiles(spark, blocks):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 40, 301) / 4
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 1.0), ("h", 2.0), ("h", 4.0), ("h", 9.0), ("h", None)], "g string, value double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["g"]: r for r in quantiles.exact_quantiles(quantiles.collapse(df, ["g"]), ["g"], probs, blocks=blocks).collect()}
    for name, p in probs.items():
        assert got["g"][name] == pytest.approx(np.quantile(values, p))
    assert got["h"]["b"] == 1.75
    assert quantiles.quantile(df.filter("g = 'h'"), "value", 0.25).first()[0] == 1.75


def test_settle(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    kept = work.settle(df)
    assert kept.columns == df.columns and kept.agg(F.sum("x")).first()[0] == 90
    assert work.settle(df.filter("id < 0")).count() == 0


def test_local_scratch_is_told_apart():
    from sojourn.operators import work

    assert [work._is_local(p) for p in ("/tmp/w/scratch", "file:/tmp/w", "file:///tmp", "hdfs://n/w", "s3a://b/w", "viewfs://x/y")] == [True, True, True, False, False, False]
