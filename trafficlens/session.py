"""Session settings the engine relies on, and the shared working folder."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Bytes that one task of a batch job reads, and parts that a shuffle is written in before small ones are joined.
TASK_BYTES, SHUFFLE_PARTS = "16m", "512"

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='trafficlens-')}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package and pin the settings results depend on: UTC and AQE.

    Joins of requests with window tables are often followed by an aggregation
    on the same keys. Skewed windows are split there too, at the price of one
    more shuffle and only when a join is found skewed at run time.

    Tasks keep their size as tables grow: a scan or a shuffle is dealt out in
    parts of ``TASK_BYTES``, so there are more of them. Streams are not touched
    by that, they have as many partitions as their checkpoint says. Their state
    is saved as a log of changes, and keys are not counted on every write; so
    the metric of state rows in a query's progress stays 0.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.files.maxPartitionBytes", TASK_BYTES)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", TASK_BYTES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", SHUFFLE_PARTS)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for tables and stream checkpoints.

    It lies under ``spark.checkpoint.dir``, which a cluster points at storage
    every executor reaches. A ``local`` master has one machine only and gets a
    temporary folder, set once for the session; any other master without the
    setting is an error, because its executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='trafficlens-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/trafficlens/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table once and continue from the written copy.

    For window tables that several passes read: the raw log is aggregated a
    single time, and a lost executor costs a re-read instead of a re-run.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
