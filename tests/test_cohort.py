"""One small table per rule of cohort building, with expected outcomes worked out by hand."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from sojourn import cohort, features, lookback, outcome, tte
from sojourn.config import StudyConfig
from sojourn.operators import sets
from sojourn.operators.skew import hot_keys
from sojourn.plans import study

CFG = StudyConfig(order=("seq",))
CLAIM = "subject_id string, start_dt date, form_cd string, dx1 string, dx2 string, path_type int, los int, result_type int, seq int"
PERSON = "subject_id string, birth_yyyy string, death_yyyymm string, sex int"


def day(text):
    return date.fromisoformat(text)


def claim(who, when, form="02", dx1="I20", dx2=None, path=32, los=3, result=9):
    return [who, day(when) if isinstance(when, str) else when, form, dx1, dx2, path, los, result]


def events(spark, rows):
    return spark.createDataFrame([tuple(r) + (i,) for i, r in enumerate(rows)], CLAIM)


def people(spark, **attributes):
    rows = [(who, a.get("birth", "1950"), a.get("death"), a.get("sex", 1)) for who, a in attributes.items()]
    return spark.createDataFrame(rows, PERSON)


def run(spark, rows, cfg=CFG, **attributes):
    ids = sorted({r[0] for r in rows})
    persons = people(spark, **{i: attributes.get(i, {}) for i in ids})
    return study.flagged_persons(events(spark, rows), persons, cfg)


def by_id(df, *columns):
    return {r["subject_id"]: (r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns)) for r in df.collect()}


def test_index_event(spark):
    got = by_id(run(spark, [
        claim("a", "2008-01-01", form="03"), claim("a", "2008-05-01", dx1="I63"), claim("a", "2009-01-01"),
        claim("b", "2005-01-01", dx1="I21"), claim("b", "2010-01-01", dx1="J40"), claim("b", "2010-02-01", dx1="I510"),
        claim("c", "2010-01-01", dx1="I52"), claim("d", "2010-01-01", dx1="J40", dx2="I20"),
        claim("e", "2020-01-01"), claim("f", None),
    ]), "first_admit", "index_code")
    assert got == {"a": (day("2008-05-01"), "I63"), "b": (day("2010-02-01"), "I510")}


def test_index_discharge_is_earliest_of_the_day(spark):
    rows = [claim("a", "2008-01-01", los=9), claim("a", "2008-01-01", dx1="J40", los=2), claim("a", "2008-01-01", los=None)]
    table = events(spark, rows)
    got = by_id(cohort.index_stay(table, cohort.index_event(table, people(spark, a={}), CFG), CFG), "index_discharge", "los", "discharge_dt")
    assert got["a"] == (day("2008-01-03"), 9, day("2008-01-10"))


def test_tie_break_is_explicit(spark):
    rows = [claim("a", "2008-01-01", dx1="I63", los=1), claim("a", "2008-01-01", dx1="I20", los=2)]
    for order in (rows, rows[::-1]):
        frame = events(spark, order).repartition(5, "dx1")
        index = cohort.index_event(frame, people(spark, a={}), CFG).first()
        assert index["index_code"] == order[0][3]


def test_washout_needs_unfiltered_events(spark):
    rows = [claim("a", "2004-01-01", form="03", dx1="J40", dx2="I20"), claim("a", "2008-01-01"), claim("b", "2004-01-01", dx1="I21"), claim("b", "2008-01-01")]
    assert by_id(run(spark, rows), "washout") == {"a": True, "b": False}
    kept = [r for r in rows if r[1] >= CFG.obs_start]
    assert by_id(run(spark, kept), "washout") == {"a": False, "b": False}


def test_death_month(spark):
    rows = [claim(p, "2008-01-30", los=5) for p in "abcd"]
    deaths = {"a": {"death": "200801"}, "b": {"death": "200802"}, "c": {"death": "200803"}}
    assert by_id(run(spark, rows, **deaths), "death_in_stay") == {"a": True, "b": True, "c": False, "d": False}
    later = [claim("a", "2008-01-30", los=5), claim("a", "2012-06-01", dx1="J40", los=1)]
    assert by_id(run(spark, later, a={"death": "201206"}), "death_in_stay") == {"a": True}
    index_only = StudyConfig(order=("seq",), death_scope="index")
    assert by_id(run(spark, later, index_only, a={"death": "201206"}), "death_in_stay") == {"a": False}
    other_form = [claim("a", "2008-01-30"), claim("a", "2012-06-01", form="07", los=1)]
    assert by_id(run(spark, other_form, a={"death": "201206"}), "death_in_stay") == {"a": False}


def test_unclear_discharge(spark):
    rows = [claim("a", "2008-01-01", los=None), claim("b", "2008-01-01", los=-1), claim("c", "2008-01-01", los=0),
            claim("d", "2008-01-01"), claim("d", "2009-01-01", form="03", los=None)]
    assert by_id(run(spark, rows), "unclear_discharge") == {"a": True, "b": True, "c": False, "d": False}


def test_age(spark):
    rows = [claim(p, "2008-01-01") for p in "abcd"]
    births = {"a": {"birth": "19xxLE"}, "b": {"birth": "2008"}, "c": {"birth": "2009"}, "d": {"birth": "1950"}}
    got = run(spark, rows, **births)
    assert by_id(got, "age_index", "invalid_age") == {"a": (None, True), "b": (0, False), "c": (-1, True), "d": (58, False)}
    assert sorted(by_id(cohort.included(got), "age_index")) == ["b", "d"]


def test_exclusions_agree_and_attrition(spark):
    rows = [claim("a", "2004-01-01"), claim("a", "2008-01-01"), claim("b", "2008-01-01", los=None), claim("c", "2008-01-01"),
            claim("c", "2010-01-01", form="03"), claim("d", "2008-01-01"), claim("e", "2004-05-01"), claim("z", "2008-01-01", dx1="J40")]
    persons = people(spark, **{i: ({"birth": "x"} if i == "d" else {}) for i in "abcdez"})
    table = events(spark, rows)
    flagged = study.flagged_persons(table, persons, CFG)
    by_flag = sorted(by_id(cohort.included(flagged), "first_admit"))
    reasons = {n: flagged.filter(n).select("subject_id") for n in cohort.EXCLUSIONS}
    assert by_flag == sorted(by_id(cohort.exclude(flagged.select("subject_id", "first_admit"), reasons), "first_admit")) == ["c"]
    steps = [tuple(r)[1:] for r in cohort.attrition(events(spark, [*rows, claim("unknown", "2008-01-01")]), persons, flagged, CFG).orderBy("seq").collect()]
    assert steps == [("qualified", 5, 7), ("in_period", 4, 5), ("indexed", 4, 5), ("washout", 3, 4), ("death_in_stay", 3, 4),
                     ("unclear_discharge", 2, 3), ("invalid_age", 1, 2)]
    kept = cohort.cohort_claims(table, cohort.included(flagged), CFG)
    assert sorted(r["form_cd"] for r in kept.collect()) == ["02", "03"]


def test_unknown_person_drops(spark):
    table = events(spark, [claim("a", "2008-01-01"), claim("q", "2008-01-01")])
    assert by_id(cohort.index_event(table, people(spark, a={}), CFG), "index_code") == {"a": "I20"}
    assert cohort.build_events(table, people(spark, a={}), CFG).count() == 1


def test_same_code_rules(spark):
    rows = [claim("a", "2008-01-01", dx1="I200"), claim("a", "2009-01-01", dx1="I209"), claim("a", "2010-01-01", dx1="J40", dx2="I49"),
            claim("a", "2011-01-01", dx1="J40", dx2=None), claim("a", "2012-01-01", dx1="I63")]
    for mode, days in {"exact": 1, "prefix3": 2, "group": 3}.items():
        cfg = StudyConfig(order=("seq",), match=mode)
        assert by_id(run(spark, rows, cfg), "same_dx_days") == {"a": days}


def test_label_and_events(spark):
    rows = [
        # a: same-day duplicate does not count; readmitted on the discharge day
        claim("a", "2008-01-01", los=4), claim("a", "2008-01-01", los=4), claim("a", "2008-01-05"),
        # b: readmitted one day after discharge
        claim("b", "2008-01-01", los=4), claim("b", "2008-01-06", dx1="J40", dx2="I20"),
        # c: second admission before the first discharge
        claim("c", "2008-01-01", los=30), claim("c", "2008-01-10", los=1),
        # d: later stay for another cause, and an outpatient claim for the same one
        claim("d", "2008-01-01"), claim("d", "2008-05-01", dx1="I63"), claim("d", "2008-06-01", form="03"),
        # e: two later stays
        claim("e", "2008-01-01"), claim("e", "2009-01-01", los=2), claim("e", "2010-01-01", los=7), claim("e", "2010-01-01", los=5),
    ]
    got = study.person_table(events(spark, rows), people(spark, **{i: {} for i in "abcde"}), CFG)
    assert by_id(got, "readmit_flag", "n_same_dx") == {"a": (1, 2), "b": (1, 2), "c": (1, 2), "d": (0, 1), "e": (1, 3)}
    after = by_id(got, "first_after_discharge")
    assert after == {"a": None, "b": day("2008-01-06"), "c": None, "d": None, "e": day("2009-01-01")}
    assert by_id(got, "last_readmit_dt", "last_readmit_discharge")["e"] == (day("2010-01-01"), day("2010-01-06"))
    gaps = by_id(got, "gap_days")
    assert gaps["e"] == 731 and gaps["d"] == (CFG.study_end - day("2008-01-01")).days
    shown = features.person_features(got, CFG)
    assert by_id(shown, "diff_days") == {"a": 0.0, "b": 1.0, "c": -21.0, "d": None, "e": 363.0}
    pairs = outcome.event_pairs(got)
    assert pairs.count() == 8
    by_pairs = by_id(outcome.paired_gap(pairs).unionByName(outcome.gap_to_end(got, CFG)), "gap_days")
    assert by_pairs == gaps
    again, other = outcome.split_groups(got)
    assert sorted(r[0] for r in again.collect()) == ["a", "b", "c", "e"] and [r[0] for r in other.collect()] == ["d"]


def test_stays_collapse(spark):
    rows = [claim("a", "2008-01-01"), claim("a", "2009-01-01", dx1="J40", los=2), claim("a", "2009-01-01", dx1="I20", los=2),
            claim("a", "2009-01-01", dx1="J40", los=3), claim("a", "2010-01-01", dx1="J40", dx2=None)]
    table = events(spark, rows)
    linked = cohort.link(table, cohort.index_event(table, people(spark, a={}), CFG), CFG)
    got = outcome.same_dx_stays(linked, CFG).collect()
    assert [(r["start_dt"], r["discharge_dt"]) for r in got] == [(day("2009-01-01"), day("2009-01-03"))]


def test_lookback_window_and_counts(spark):
    index = day("2008-12-01")
    rows = [claim("a", index)]
    rows += [claim("a", index - timedelta(days=180), form="03", dx1="I10", path=11)]
    rows += [claim("a", index - timedelta(days=181), form="03", dx1="E11")]
    rows += [claim("a", index, form="03", dx1="N18"), claim("a", index - timedelta(days=5), dx1="J45", dx2=None, path=None)]
    rows += [claim("a", index - timedelta(days=6), dx1=None, dx2="C34", path=21)]
    rows += [claim("b", index), claim("c", index), claim("c", index - timedelta(days=1), form="03", dx1=None)]
    got = study.person_table(events(spark, rows), people(spark, a={}, b={}, c={}), CFG)
    counts = by_id(got, "prior_other_n", "prior_emergency_n", "prior_inpatient_n")
    assert counts == {"a": (1, 2, 1), "b": (None, None, None), "c": (1, 0, 0)}
    flags = lookback.label_flags(got, CFG.comorbidities)
    yes = {r["subject_id"]: sorted(n for n in CFG.comorbidities if r[n] == "Yes") for r in flags.collect()}
    assert yes == {"a": ["hx_cancer", "hx_copd", "hx_htn"], "b": [], "c": []}
    assert by_id(features.scaled(got), "outpt5") == {"a": 0.2, "b": 0.0, "c": 0.2}


def test_horizon(spark):
    leave = day("2008-02-29")
    rows = [
        ("cut", leave, day("2011-02-28")), ("late", leave, day("2011-03-01")), ("none", leave, None),
        ("near_end", day("2018-05-01"), None), ("after_end", day("2020-01-05"), None),
    ]
    df = spark.createDataFrame(rows, "subject_id string, index_discharge date, first_after_discharge date")
    got = tte.apply_horizon(tte.time_to_event(df, CFG), CFG)
    days = (day("2011-02-28") - leave).days
    assert by_id(got, "cutoff", "event", "time") == {
        "cut": (day("2011-02-28"), 1, days), "late": (day("2011-02-28"), 0, days), "none": (day("2011-02-28"), 0, days),
        "near_end": (day("2019-12-31"), 0, (day("2019-12-31") - day("2018-05-01")).days), "after_end": (day("2019-12-31"), 0, 0),
    }
    assert got.agg(F.max("time")).first()[0] <= CFG.horizon_days
    summary = tte.followup_summary(got).first()
    assert (summary["n"], summary["events"]) == (5, 1) and summary["median_days"] == days


def test_feature_labels(spark):
    rows = [claim("a", "2008-03-01", dx1="I2510", path=21), claim("b", "2009-01-01", dx1="I639", path=12)]
    got = study.analysis_table(events(spark, rows), people(spark, a={"sex": 2, "death": "201001"}, b={"sex": 9}), CFG)
    names = ["group", "sex_f", "index_dx_group_f", "path_type_f", "er_flag", "index_year_f", "index_cat", "death_flag", "age10"]
    assert by_id(got, *names) == {
        "a": ("nonreadmit", "F", "heart", "21", "Yes", "2008", "I25", "Yes", 5.8),
        "b": ("nonreadmit", None, "cerebro", "12", "No", "2009", "I63", "No", 5.9),
    }


def test_los_bins(spark):
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate([1, 2, 5, 8, 8, 20, None])], "subject_id string, los int")
    got = by_id(features.los_bins(df, CFG), "los_q", "los5", "los_q4")
    assert got["0"] == ("Q1", "<5d", "Q1-3 (Low)") and got["2"][1] == ">=5d"
    assert got["3"][2] == "Q4 (High)" and got["6"] == (None, None, None)
    flat = spark.createDataFrame([(str(i), 4) for i in range(3)], "subject_id string, los int")
    assert set(by_id(features.los_bins(flat, CFG), "los_q").values()) == {"Q1"}
    assert df.filter(features.top_quartile(df, "los")).count() == 3


def test_one_person_owns_a_third_of_all_claims(spark):
    """The heavy person is salted; results equal those of the same person among equals."""
    start = day("2007-01-01")
    heavy = [claim("big", start + timedelta(days=i % 1500), form="03", dx1="I10" if i % 7 == 0 else "J45", path=11) for i in range(2000)]
    heavy += [claim("big", "2011-06-01"), claim("big", "2012-01-01")]
    others = [claim(f"p{i}", start + timedelta(days=1400 + i % 90)) for i in range(4000)]
    table = events(spark, heavy + others).repartition(6)
    persons = table.select("subject_id").distinct().select("subject_id", F.lit("1950").alias("birth_yyyy"), F.lit(None).cast("string").alias("death_yyyymm"), F.lit(1).alias("sex"))
    hot = hot_keys(table, "subject_id", rows_per_salt=100)
    assert [r["subject_id"] for r in hot.collect()] == ["big"]
    flagged = study.flagged_persons(table, persons, CFG, hot=hot)
    plain = study.flagged_persons(table, persons, CFG)
    assert flagged.exceptAll(plain).isEmpty() and plain.exceptAll(flagged).isEmpty()
    got = outcome.with_label(flagged)
    big = got.filter("subject_id = 'big'").first()
    seen = [h for h in heavy if day("2011-06-01") - timedelta(days=180) <= h[1] < day("2011-06-01")]
    assert big["prior_other_n"] == (len(seen) or None) and big["readmit_flag"] == 1 and big["n_claims"] == 2002
    assert got.count() == 4001
    index = cohort.index_event(table, persons, CFG)
    plain = sets.keep(table, index.select("subject_id")).count()
    assert cohort.link(table, index, CFG, hot).count() == plain == 6002


def test_result_does_not_depend_on_row_order(spark):
    rows = [claim(p, day("2008-01-01") + timedelta(days=37 * i % 400), dx1=["I20", "I63", "J40"][i % 3], los=i % 9) for p in "abcdef" for i in range(12)]
    table, persons = events(spark, rows), people(spark, **{i: {} for i in "abcdef"})
    a = study.survival_table(table, persons, CFG)
    b = study.survival_table(table.orderBy(F.rand(1)).repartition(7), persons, CFG)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_claims_are_cut_before_the_link(spark, tmp_path):
    """Every scan of the claims has the date bounds; what is cut changes no measure."""
    codes = ["I20", "I63", "J40", "E11", "I209"]
    rows = [
        claim(p, day("2004-06-01") + timedelta(days=(211 * i + 97 * j) % 6400), form=["02", "03"][i % 2], dx1=codes[(i + j) % 5], dx2=codes[i % 5], los=i % 6)
        for j, p in enumerate("abcdefghij") for i in range(40)
    ]
    events(spark, rows).write.parquet(str(tmp_path / "claims"))
    table, persons = spark.read.parquet(str(tmp_path / "claims")), people(spark, **{i: {} for i in "abcdefghij"})
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = study.survival_table(table, persons, CFG)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", length)
    scans = [line for line in plan.splitlines() if "FileScan" in line and "claims" in line]
    assert scans and all("LessThanOrEqual(start_dt,2019-12-31)" in line for line in scans)
    for match in ("exact", "prefix3", "group"):
        cfg = StudyConfig(order=("seq",), match=match)
        measures = study.all_measures(cfg)
        index = cohort.index_stay(table, cohort.index_event(table, persons, cfg), cfg)
        whole = cohort.flag_persons(index, cohort.summarise(cohort.link(table, index, cfg), measures))
        cut = study.flagged_persons(table, persons, cfg)
        assert cut.filter("washout").count() > 0
        assert cut.exceptAll(whole).isEmpty() and whole.exceptAll(cut).isEmpty()
