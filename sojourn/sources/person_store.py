"""Claims stored by person, so that repeated studies join and group them where they lie.

A store is a folder with three parts:

* ``light``: bucketed by person and sorted by person and date. Its reader keeps the layout: a
  join or aggregate by person needs no exchange on this side, whatever the number of studies.
* ``heavy``: the claims of heavy persons (``operators.skew.hot_keys``), spread over files by row.
  In a bucket one such person would be one task, so these few are kept apart; operators
  reduce them in each task or split them by salts, as on any table.
* ``layout``: one row with the key, the bucket count and a version, and ``hot``: the
  heavy persons and their salt counts.

No person is in both parts, so what is computed per person from each can be appended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.operators.skew import ROWS_PER_SALT, hot_keys
from sojourn.operators.work import settle

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 1 << 14


@dataclass(frozen=True)
class PersonStore:
    light: DataFrame
    heavy: DataFrame
    hot: DataFrame
    key: str
    buckets: int

    @property
    def columns(self) -> list[str]:
        return self.light.columns

    def both(self) -> DataFrame:
        """All claims as one table, its layout lost."""
        return self.light.unionByName(self.heavy)

    def per_person(self, on_light: Callable[[DataFrame], DataFrame], on_heavy: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Apply a per-person operator to each part and append the results."""
        return on_light(self.light).unionByName((on_heavy or on_light)(self.heavy))


def bucket_count(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """A power of two, so that tables of different sizes stay joinable bucket by bucket."""
    wanted = max(1, -(-rows // rows_per_bucket))
    return min(MAX_BUCKETS, 1 << (wanted - 1).bit_length())


def write_by_person(
    claims: DataFrame, path: str, key: str = "subject_id", order: str = "start_dt", buckets: int | None = None, rows_per_salt: int = ROWS_PER_SALT, partition_by=(),
) -> None:
    """Write ``claims`` as a store under ``path``, which must be new.

    Each bucket is one file (per value of ``partition_by``, such as the year). A NULL key
    is an ordinary value: it shares a bucket and joins with nothing.
    """
    spark = claims.sparkSession
    hot = settle(hot_keys(claims, key, rows_per_salt))
    if buckets is None:
        buckets = bucket_count(claims.count())
    light = claims.join(F.broadcast(hot.select(key)), key, "left_anti").select(*claims.columns)
    name = f"sojourn_write_{uuid.uuid4().hex}"
    writer = light.repartition(buckets, key).sortWithinPartitions(*partition_by, key, order).write.format("parquet").option("path", f"{path}/light")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer.bucketBy(buckets, key).sortBy(key, order).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    heavy = claims.join(F.broadcast(hot.select(key)), key, "left_semi").select(*claims.columns)
    heavy.write.parquet(f"{path}/heavy")
    hot.write.parquet(f"{path}/hot")
    layout = [(key, order, buckets, uuid.uuid4().hex, ",".join(partition_by))]
    spark.createDataFrame(layout, "key string, order string, buckets int, version string, partition_by string").coalesce(1).write.parquet(f"{path}/layout")


def read_by_person(spark: SparkSession, path: str) -> PersonStore:
    """Open a store. Its layout enters the session's catalog as an external table."""
    layout = spark.read.parquet(f"{path}/layout").first()
    heavy, hot = spark.read.parquet(f"{path}/heavy"), spark.read.parquet(f"{path}/hot")
    name, parts = f"sojourn_store_{layout['version']}", [p for p in layout["partition_by"].split(",") if p]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted(heavy.schema, key=lambda f: f.name in parts))
    divided = f"PARTITIONED BY ({', '.join(f'`{p}`' for p in parts)})" if parts else ""
    if not spark.catalog.tableExists(name):
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet {divided} CLUSTERED BY (`{layout['key']}`) SORTED BY (`{layout['key']}`, `{layout['order']}`)"
            f" INTO {layout['buckets']} BUCKETS LOCATION '{path}/light'"
        )
        if parts:
            spark.sql(f"MSCK REPAIR TABLE {name}")
    return PersonStore(spark.table(name).select(*heavy.columns), heavy, hot, layout["key"], layout["buckets"])
