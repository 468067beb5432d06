"""File sources with fixed schemas, and sinks.

Schemas are explicit on read: inference would turn form code ``"02"`` into the
number 2 and a birth year with a stray letter into a string column in one file and
a number in another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sojourn.functions.dates import ymd
from sojourn.operators.columns import select_any
from sojourn.operators.select import first_per_key
from sojourn.operators.sets import append

# Column names and types of the national claims sample's files.
CLAIM_SCHEMA = T.StructType([
    T.StructField("RN_INDI", T.StringType()),
    T.StructField("MDCARE_STRT_DT", T.StringType()),
    T.StructField("FORM_CD", T.StringType()),
    T.StructField("SICK_SYM1", T.StringType()),
    T.StructField("SICK_SYM2", T.StringType()),
    T.StructField("HSPTZ_PATH_TYPE", T.IntegerType()),
    T.StructField("VSHSP_DD_CNT", T.IntegerType()),
    T.StructField("MCARE_RSLT_TYPE", T.IntegerType()),
    T.StructField("FST_HSPTZ_DT", T.StringType()),
])
BIRTH_SCHEMA = T.StructType([
    T.StructField("RN_INDI", T.StringType()),
    T.StructField("BTH_YYYY", T.StringType()),
    T.StructField("DTH_YYYYMM", T.StringType()),
])
ELIGIBILITY_SCHEMA = T.StructType([
    T.StructField("RN_INDI", T.StringType()),
    T.StructField("SEX", T.IntegerType()),
])

# Source column -> name used throughout this library.
CLAIM_NAMES = {
    "RN_INDI": "subject_id",
    "MDCARE_STRT_DT": "start_text",
    "FORM_CD": "form_cd",
    "SICK_SYM1": "dx1",
    "SICK_SYM2": "dx2",
    "HSPTZ_PATH_TYPE": "path_type",
    "VSHSP_DD_CNT": "los",
    "MCARE_RSLT_TYPE": "result_type",
    "FST_HSPTZ_DT": "first_hosp_text",
}
BIRTH_NAMES = {"RN_INDI": "subject_id", "BTH_YYYY": "birth_yyyy", "DTH_YYYYMM": "death_yyyymm"}
ELIGIBILITY_NAMES = {"RN_INDI": "subject_id", "SEX": "sex"}


def read_files(spark: SparkSession, paths, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    """Read one or more files of the same kind and append them.

    CSV columns are matched by header name, so each file's own header decides the
    position and columns outside the schema are ignored. ``source_seq`` keeps the
    order the files were named in.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if fmt == "parquet":
        frames = [select_any(spark.read.parquet(p), schema.fieldNames()) for p in paths]
    else:
        frames = [_read_csv(spark, p, schema) for p in paths]
    return append(*frames, seq="source_seq")


CORRUPT = "__line"


def _parse_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line, bad, columns…) of all lines under ``path`` but the headers, each by its own
    file's header. Only the distinct headers come to the driver, never a list of files."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    first = lines.filter("file_block_start = 0").groupBy("file").agg(F.min(F.struct("at", "value")).alias("h")).select("file", F.col("h.at").alias("header_at"), F.col("h.value").alias("header"))
    body = lines.join(first, "file").filter(F.col("at") != F.col("header_at")).filter(F.trim("value") != "")
    frames = []
    for row in first.select("header").distinct().orderBy("header").collect():
        names = spark.createDataFrame([(row["header"],)], "h string").select(F.from_csv("h", ", ".join(f"c{i} string" for i in range(row["header"].count(",") + 1)))).first()[0]
        kinds: dict[str, str] = {}
        for i, n in enumerate(names[: max((i + 1 for i, n in enumerate(names) if n is not None), default=0)]):
            n = (n or "").lstrip("\ufeff").strip()
            kinds[n if n and n not in kinds else f"__{i}"] = schema[n].dataType.simpleString() if n in schema.fieldNames() else "string"
        as_read = ", ".join([*[f"`{n}` {k}" for n, k in kinds.items()], f"`{CORRUPT}` string"])
        parsed = F.from_csv("value", as_read, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        own = body.filter(F.col("header") == row["header"]).select("file", "value", parsed.alias("r"))
        frames.append(own.select("file", F.col("value").alias("line"), F.col(f"r.{CORRUPT}").isNotNull().alias("bad"), *[F.col(f"r.`{n}`").alias(n) for n in schema.fieldNames() if n in kinds]))
    if not frames:
        return spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), T.StructField("line", T.StringType()), T.StructField("bad", T.BooleanType()), *schema.fields]))
    return append(*frames)


def _read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The well-formed rows of all files under ``path``."""
    parsed = _parse_csv(spark, path, schema)
    return parsed.filter(~F.col("bad")).drop("file", "line", "bad")


def quarantine(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    """(source_seq, file, line): lines that ``read_files`` leaves out, as they stand.

    A line is malformed if it has more or fewer fields than its header, or a field that is
    not of its column's type.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    return append(*[_parse_csv(spark, p, schema).filter("bad").select("file", "line") for p in paths], seq="source_seq")


def file_report(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    """(source_seq, file, n_rows, n_bad): rows read and lines left out, per file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    counted = [_parse_csv(spark, p, schema).groupBy("file").agg(F.count_if(~F.col("bad")).alias("n_rows"), F.count_if("bad").alias("n_bad")) for p in paths]
    return append(*counted, seq="source_seq")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Project to the mapped columns under their new names."""
    kept = [F.col(old).alias(new) for old, new in names.items() if old in df.columns]
    extra = ["source_seq"] if "source_seq" in df.columns else []
    return df.select(*kept, *extra)


def load_claims(spark: SparkSession, paths, fmt: str = "csv") -> DataFrame:
    claims = renamed(read_files(spark, paths, CLAIM_SCHEMA, fmt), CLAIM_NAMES)
    return claims.withColumn("start_dt", ymd("start_text"))


def load_persons(spark: SparkSession, birth_paths, eligibility_paths, fmt: str = "csv") -> DataFrame:
    """One row per person found in both the birth/death and the eligibility files.

    Where a person has several rows the first wins: earlier file, then lowest values.
    """
    birth = renamed(read_files(spark, birth_paths, BIRTH_SCHEMA, fmt), BIRTH_NAMES)
    sex = renamed(read_files(spark, eligibility_paths, ELIGIBILITY_SCHEMA, fmt), ELIGIBILITY_NAMES)
    birth = first_per_key(birth, "subject_id", ["source_seq", "birth_yyyy", "death_yyyymm"], ["birth_yyyy", "death_yyyymm"])
    sex = first_per_key(sex, "subject_id", ["source_seq", "sex"], ["sex"])
    return birth.join(sex, "subject_id")


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by=()) -> None:
    """Write a result; CSV carries a header. Partition a large event table by year
    so that a study window prunes files."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
