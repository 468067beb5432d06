"""Claims stored by person, and the id filter: same results, and plans that move less."""

import re
from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sojourn import cohort
from sojourn.config import StudyConfig
from sojourn.operators.idfilter import id_filter, keep_known, plan_size
from sojourn.plans import study
from sojourn.sources.person_store import bucket_count, read_by_person, write_by_person

CFG = StudyConfig(obs_start=date(2010, 1, 1), study_end=date(2014, 12, 31), order=("k",))
CLAIMS = "subject_id long, start_dt date, form_cd string, dx1 string, dx2 string, path_type int, result_type int, los int, k long"


def _claims():
    rows = []
    for k in range(6000):
        person = None if k % 997 == 0 else 1 if k % 3 == 0 else k * 7919 % 180
        day = date(2009, 8, 1) + timedelta(days=k * 31 % 1900)
        rows.append((person, day, "02" if k % 4 else "03", f"I{18 + k * 13 % 50}", ("I10", None, "I21")[k % 3], (11, 21, 5)[k % 3], 1 + k % 2, k % 12, k))
    return rows


@pytest.fixture(scope="module")
def claims(spark):
    return spark.createDataFrame(_claims(), CLAIMS).repartition(6)


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(i, "1950", "201205" if i % 9 == 0 else None, 1 + i % 2) for i in range(170)], "subject_id long, birth_yyyy string, death_yyyymm string, sex int")


@pytest.fixture(scope="module")
def store(spark, claims, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s")
    write_by_person(claims, path, buckets=4, rows_per_salt=500)
    return read_by_person(spark, path)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _rows(df):
    return sorted(map(repr, df.collect()))


def _above_scan(df, mark):
    """Names of the plan's nodes between the scan that holds ``mark`` and the top."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    lines = [line for line in plan.splitlines() if line.strip()]
    depth = lambda line: len(re.match(r"[ :+\-*|()0-9]*", line)[0])
    out = []
    for at, line in enumerate(lines):
        if mark in line:
            level, names = depth(line), []
            for above in reversed(lines[:at]):
                if depth(above) < level:
                    level = depth(above)
                    names.append(re.sub(r"^[ :+\-*|()0-9]*", "", above).split(" ")[0])
            out.append(names)
    return out


def test_store_holds_every_claim_once(claims, store):
    assert _rows(store.both().select(*claims.columns)) == _rows(claims)
    assert {r.subject_id for r in store.heavy.select("subject_id").distinct().collect()} == {1}
    assert store.light.where("subject_id = 1").isEmpty() and store.buckets == 4


def test_index_and_link_move_no_claim(spark, store, people, no_broadcast):
    index = cohort.index_event(store.light, people, CFG)
    for names in _above_scan(index, "Bucketed: true"):
        below = names[: names.index("SortMergeJoin")]
        assert "Exchange" not in below, names
    known = spark.createDataFrame(cohort.index_event(store.both(), people, CFG).collect(), index.schema)
    measures = study.all_measures(CFG)
    linked = cohort.link_local(cohort.reach(store.light, measures, CFG), known.withColumn("index_discharge", F.col("discharge_dt")))
    scans = _above_scan(cohort.summarise(linked, measures), "Bucketed: true")
    assert scans and all("Exchange" not in names for names in scans), scans


def test_heavy_person_is_split(store, people):
    index = cohort.index_event(store.both(), people, CFG)
    linked = cohort.link(store.heavy, index, CFG, hot=store.hot)
    assert linked.count() == store.heavy.count() > 1900
    assert store.hot.first().salts >= 4


@pytest.mark.parametrize("cfg", [CFG, replace(CFG, match="prefix3", death_scope="index")])
def test_study_is_the_same(claims, people, store, cfg):
    plain = _rows(study.survival_table(claims, people, cfg))
    assert len(plain) > 10
    assert _rows(study.survival_table(store, people, cfg).select(*study.survival_table(claims, people, cfg).columns)) == plain
    assert _rows(study.survival_table(claims, people, replace(cfg, id_filter=0.05))) == plain


def test_store_by_year(spark, claims, people, tmp_path):
    by_year = claims.withColumn("yr", F.year("start_dt"))
    write_by_person(by_year, str(tmp_path / "s"), buckets=2, partition_by=["yr"])
    opened = read_by_person(spark, str(tmp_path / "s"))
    assert _rows(opened.both().select(*by_year.columns)) == _rows(by_year)
    plan = opened.light.where("yr = 2011")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(yr" in plan
    assert _rows(cohort.index_event(opened.light, people, CFG)) == _rows(cohort.index_event(claims, people, CFG))


def test_empty_store(spark, claims, people, tmp_path):
    write_by_person(claims.where("1 = 0"), str(tmp_path / "s"))
    opened = read_by_person(spark, str(tmp_path / "s"))
    assert opened.both().isEmpty() and study.survival_table(opened, people, CFG).isEmpty()


def test_bucket_counts():
    assert [bucket_count(n, 100) for n in (0, 1, 100, 101, 250, 10**9)] == [1, 1, 1, 2, 4, 1 << 14]


def test_filter_keeps_members_and_drops_most_others(spark):
    ids = spark.range(0, 20_000).selectExpr("id * 3 AS subject_id").unionByName(spark.range(1).selectExpr("CAST(NULL AS BIGINT) AS subject_id"))
    rows = spark.range(0, 300_000).selectExpr("id AS subject_id").unionByName(spark.range(5).selectExpr("CAST(NULL AS BIGINT) AS subject_id"))
    for error in (0.2, 0.01):
        left = keep_known(rows, ids, error=error)
        kept = {r.subject_id for r in left.collect()}
        assert set(range(0, 60_000, 3)) <= kept and None not in kept
        foreign = (len(kept) - 20_000) / 280_000
        assert foreign <= 1.2 * id_filter(ids, error=error).error <= 1.5 * error
    assert "Exchange" not in left._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]


def test_filter_of_text_ids_and_of_none(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "subject_id string")
    assert "a" in {r.subject_id for r in keep_known(rows, rows.where("subject_id = 'a'")).collect()}
    assert keep_known(rows, rows.where("1 = 0")).collect() == []


def test_filter_is_left_out_when_it_would_not_help(spark):
    rows = spark.range(100).withColumnRenamed("id", "subject_id")
    ids = spark.range(100_000).withColumnRenamed("id", "subject_id")
    assert id_filter(ids, max_bytes=64) is None
    assert keep_known(rows, ids, max_bytes=64).count() == 100
    assert plan_size(10**9)[0] == (16 << 20) * 8
