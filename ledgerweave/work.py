"""The shared working folder: where lineage is cut and intermediate tables live."""

from __future__ import annotations

import re
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on a single machine, one beside the warehouse's tables.

    On several machines there is no folder to fall back to that all of them are
    sure to share, so one has to be set.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return re.sub(r"^file:/+", "file:///", folder).rstrip("/")


#: What each session has put into the shared folder.
MADE: WeakKeyDictionary[SparkSession, list[str]] = WeakKeyDictionary()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.setdefault(spark, []).append(path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Delete one path that new_path() gave out."""
    if path in MADE.get(spark, []):
        MADE[spark].remove(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Delete what new_path() gave out to this session; for when no DataFrame that reads it is needed any more."""
    for path in list(MADE.get(spark, [])):
        forget(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: compressed, and later reads prune columns."""
    return write_to(df, new_path(df.sparkSession, name))


def write_to(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
