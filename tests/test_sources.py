import pytest
from pyspark.sql import types as T

from sojourn.sources import tables


def write(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_claims_keep_their_text(spark, tmp_path):
    first = write(tmp_path, "a.csv", "RN_INDI,EXTRA,MDCARE_STRT_DT,FORM_CD,SICK_SYM1,SICK_SYM2,HSPTZ_PATH_TYPE,VSHSP_DD_CNT,MCARE_RSLT_TYPE,FST_HSPTZ_DT\n"
                  "007,x,20080229,02,I20,,21,3,1,\n007,x,20061301,03,I10,E11,,,9,20050101\n")
    second = write(tmp_path, "b.csv", "MDCARE_STRT_DT,RN_INDI,FORM_CD,SICK_SYM1,VSHSP_DD_CNT\n20170101,8,12,I63,4\n")
    rows = tables.load_claims(spark, [first, second]).orderBy("source_seq", "start_text").collect()
    assert [r["form_cd"] for r in rows] == ["03", "02", "12"]
    assert rows[0]["start_dt"] is None and str(rows[1]["start_dt"]) == "2008-02-29"
    assert rows[1]["subject_id"] == "007" and rows[1]["dx2"] is None and rows[0]["los"] is None
    assert rows[2]["dx2"] is None and rows[2]["source_seq"] == 1 and rows[2]["los"] == 4


def test_each_file_of_a_folder_has_its_own_header(spark, tmp_path):
    folder = tmp_path / "people"
    folder.mkdir()
    write(folder, "a.csv", "RN_INDI,SEX\n1,2\n")
    write(folder, "b.csv", "SEX,RN_INDI\n1,777\n")
    write(folder, "c.csv", "RN_INDI,SEX\n3,1\n")
    rows = tables.read_files(spark, str(folder), tables.ELIGIBILITY_SCHEMA).collect()
    assert {(r["RN_INDI"], r["SEX"]) for r in rows} == {("1", 2), ("777", 1), ("3", 1)}


def test_persons_first_row_wins(spark, tmp_path):
    birth = write(tmp_path, "birth.csv", "RN_INDI,BTH_YYYY,DTH_YYYYMM\n1,1950,\n2,19xxLE,201001\n3,1960,\n")
    one = write(tmp_path, "one.csv", "RN_INDI,SEX\n1,2\n2,1\n")
    two = write(tmp_path, "two.csv", "RN_INDI,SEX\n1,1\n2,1\n9,1\n")
    rows = {r["subject_id"]: r for r in tables.load_persons(spark, birth, [one, two]).collect()}
    assert sorted(rows) == ["1", "2"]
    assert rows["1"]["sex"] == 2 and rows["2"]["birth_yyyy"] == "19xxLE" and rows["1"]["death_yyyymm"] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("02", 2006), ("03", 2007)], "form_cd string, yr int")
    tables.write_table(df, str(tmp_path / "csv"))
    schema = T.StructType([T.StructField("form_cd", T.StringType()), T.StructField("yr", T.IntegerType())])
    back = tables.read_files(spark, str(tmp_path / "csv"), schema).orderBy("yr").collect()
    assert [(r["form_cd"], r["yr"]) for r in back] == [("02", 2006), ("03", 2007)]
    tables.write_table(df, str(tmp_path / "pq"), "parquet", partition_by=["yr"])
    assert sorted(p.name for p in (tmp_path / "pq").glob("yr=*")) == ["yr=2006", "yr=2007"]
    assert tables.read_files(spark, str(tmp_path / "pq"), schema, "parquet").count() == 2


def test_source_types_must_agree(spark, tmp_path):
    from sojourn.operators.sets import append

    with pytest.raises(TypeError):
        append(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x",)], "a string"))


def test_malformed_lines_go_to_the_quarantine_and_nowhere_else(spark, tmp_path):
    folder = tmp_path / "claims"
    folder.mkdir()
    write(folder, "a.csv", "RN_INDI,FORM_CD,VSHSP_DD_CNT\n1,02,3\n2,02,many\n3,02\n4,02,5,6\n5,,\n\n")
    write(folder, "b.csv", "VSHSP_DD_CNT,,RN_INDI\n7,x,8\n,y,9\nbad,z,10\n")
    write(folder, "c.csv", "RN_INDI,FORM_CD,VSHSP_DD_CNT\n")
    other = write(tmp_path, "d.csv", 'RN_INDI,SICK_SYM1\n11,"I20, unspecified"\n')
    rows = tables.read_files(spark, [str(folder), other], tables.CLAIM_SCHEMA).collect()
    assert sorted((r.RN_INDI, r.VSHSP_DD_CNT, r.source_seq) for r in rows) == [("1", 3, 0), ("11", None, 1), ("5", None, 0), ("8", 7, 0), ("9", None, 0)]
    left_out = tables.quarantine(spark, [str(folder), other], tables.CLAIM_SCHEMA).collect()
    assert sorted((r.source_seq, r.file.rsplit("/", 1)[1], r.line) for r in left_out) == [(0, "a.csv", "2,02,many"), (0, "a.csv", "3,02"), (0, "a.csv", "4,02,5,6"), (0, "b.csv", "bad,z,10")]
    report = tables.file_report(spark, [str(folder), other], tables.CLAIM_SCHEMA).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.n_rows, r.n_bad) for r in report) == [("a.csv", 2, 3), ("b.csv", 2, 1), ("d.csv", 1, 0)]
