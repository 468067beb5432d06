"""Cutting lineage before iterating, in storage every executor can reach."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, or else one inside the warehouse.

    The warehouse may be a folder of the driver's machine, which executors on other
    machines could not read: on a cluster that names no checkpoint folder this warns.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            return chosen.get().rstrip("/")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
        if _is_local(folder) and not spark.sparkContext.master.startswith("local"):
            warnings.warn(f"scratch goes to {folder}, a local folder; set spark.checkpoint.dir to shared storage", stacklevel=2)
    return folder.rstrip("/")


def _is_local(folder: str) -> bool:
    """Whether a path is on the machine's own file system."""
    return ":" not in folder.split("/")[0] or folder.startswith("file:")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; ``release`` removes what was written there."""
    path = f"{shared_folder(spark)}/sojourn-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later passes scan
    it instead of recomputing it and survive the loss of executors.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A position among the scratch paths, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete scratch written between two marks. Call it once nothing reads it any more:
    a table that is still to be computed from a settled one needs the files."""
    paths = _written[since:until]
    _written[since:until] = [""] * len(paths)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in filter(None, paths):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
