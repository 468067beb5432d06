"""Claims and persons derived from the TPC-H-like test tables.

Order lines stand for claims and customers for persons. The five ``k`` columns tell
any two claims apart and serve as the tie-break order.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from sojourn.config import StudyConfig

KEYS = ("k1", "k2", "k3", "k4", "k5")

CONFIG = StudyConfig(obs_start=date(1996, 1, 1), study_end=date(2001, 12, 31), order=KEYS)

CLAIMS_SQL = """
SELECT o_custkey AS subject_id, CAST(o_orderdate AS DATE) AS start_dt,
       CASE WHEN o_orderstatus = 'F' THEN '02' WHEN o_orderstatus = 'O' THEN '03'
            WHEN l_linenumber = 7 THEN '07' ELSE '08' END AS form_cd,
       'I' || CAST(10 + l_partkey % 60 AS STRING) AS dx1,
       CASE l_suppkey % 10 WHEN 0 THEN 'E11' WHEN 1 THEN 'E78' WHEN 2 THEN 'N18' WHEN 3 THEN 'J44'
            WHEN 4 THEN 'C34' WHEN 5 THEN 'I10' WHEN 6 THEN 'I63' WHEN 7 THEN 'I50' WHEN 8 THEN 'I20' END AS dx2,
       CASE l_linenumber % 5 WHEN 0 THEN 12 WHEN 1 THEN 21 WHEN 2 THEN 31 WHEN 3 THEN 32 ELSE 11 END AS path_type,
       CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 9 ELSE 4 END AS result_type,
       CASE WHEN l_quantity = 50 AND l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS INT) % 15 END AS los,
       l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4, l_quantity AS k5
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""

PERSON_SQL = """
SELECT c_custkey AS subject_id,
       CASE WHEN c_custkey % 97 = 0 THEN '19xxLE' ELSE CAST(1915 + c_custkey % 85 AS STRING) END AS birth_yyyy,
       CASE WHEN c_custkey % 20 = 0
            THEN date_format(add_months(DATE'1999-01-01', CAST(c_custkey % 36 AS INT)), 'yyyyMM') END AS death_yyyymm,
       1 + c_nationkey % 2 AS sex
FROM {customer}
"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        CLAIMS_SQL,
        lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"),
        orders=spark.read.parquet(f"{sf_dir}/orders.parquet"),
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PERSON_SQL, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
