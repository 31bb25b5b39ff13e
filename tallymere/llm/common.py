"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(column, _UPPER, _LOWER)


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, `_row`, so that helper columns beside it never meet a column of the same name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own on one machine (tests), else an error."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def shuffle_files_freed(spark: SparkSession):
    """While this holds, Spark deletes the shuffle files of each finished SQL execution at once, not when the driver next collects garbage."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def arrow_rows(spark: SparkSession, rows: int):
    """While this holds, batches for Python have at most so many rows."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written_to(df: DataFrame, path: str) -> DataFrame:
    with shuffle_files_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: the lineage is cut, and a lost executor costs a read."""
    return written_to(df, new_path(df.sparkSession, label))


class Scratch:
    """Tables of the shared folder that go when the block ends, or before by drop().

    What leaves the block must be written with the outer `written`, as a lazy result would still read these tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        out = written_to(df, path)
        self.tables.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t, path in self.tables:
            if any(t is x for x in tables):
                delete_path(self.spark, path)
        self.tables = [x for x in self.tables if not any(x[0] is t for t in tables)]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[t for t, _ in self.tables])


def hash_sample(df: DataFrame, key: str, rows: int, *ties: str) -> DataFrame:
    """The `rows` rows with the smallest hashes of key. A threshold leaves about twice as many before they are ordered,
    so what tasks send on is bounded by `rows`, not by the number of tasks."""
    h, n = F.xxhash64(key), df.count()
    if n > 2 * rows:
        df = df.where(h < F.lit(-(1 << 63) + (1 << 64) * 2 * rows // n))
    return df.orderBy(h, key, *ties).limit(rows)

