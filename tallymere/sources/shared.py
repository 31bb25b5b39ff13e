"""The folder that driver and executors share, and tables held in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own on one machine (tests); on a cluster an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def held(rows: DataFrame, label: str) -> DataFrame:
    """rows written to the shared folder and read back: the lineage is cut, and a lost executor costs a read."""
    path = new_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def sweeping(spark: SparkSession) -> Iterator[None]:
    """What is written inside has its shuffle files deleted at once, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def holding(rows: DataFrame, label: str) -> Iterator[DataFrame]:
    """rows as held() gives them, until the block ends; then their folder goes, so what leaves the block must be written."""
    path = new_path(rows.sparkSession, label)
    with sweeping(rows.sparkSession):
        rows.write.parquet(path)
    try:
        yield rows.sparkSession.read.schema(rows.schema).parquet(path)
    finally:
        delete_path(rows.sparkSession, path)
