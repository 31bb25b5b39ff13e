"""Results of repeated runs as they are stored: JSON of any metrics, their spread over the repeats, what was covered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, modified, result) of all JSON files below path, a variant each; null where a file is no JSON object.

    Modification times come with the scan, from the file system's listing; no file is opened twice.
    """
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path)
    parsed = F.try_parse_json("value")
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"), F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed).alias("result"))


def newest(files: DataFrame, *by: str) -> DataFrame:
    """The newest row of files per `by`; of equal times the greatest path."""
    last = F.max_by(F.struct(*files.columns), F.struct("modified", "file_path"))
    return files.groupBy(*by).agg(last.alias("_f")).select("_f.*")


def metric_rows(results: DataFrame, *by: str) -> DataFrame:
    """(by, key, number, is_null): a row for every metric of every result, whatever its name.

    number is null for a metric that isn't a number; booleans and texts aren't, and is_null tells them from nulls.
    """
    metrics = F.try_variant_get("result", "$.metrics", "map<string,variant>")
    rows = results.select(*by, F.explode(metrics).alias("key", "v"))
    kind = F.schema_of_variant("v")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return rows.select(*by, "key", F.when(number, F.try_variant_get("v", "$", "double")).alias("number"), (F.col("v").isNull() | (kind == "VOID")).alias("is_null"))


def spread_stored(results: DataFrame, *by: str) -> DataFrame:
    """(by, key, min, max, median, n, n_null) of the metrics that some repeat has a number for, or all have as null.

    Every figure was observed: the median is the lower of the middle two. A repeat that lacks a key counts as a null. One
    grouping by key with partial aggregation, and the number of repeats by a join.
    """
    repeats = results.groupBy(*by).agg(F.count(F.lit(1)).alias("_repeats"))
    number = F.col("number")
    median = F.expr("percentile_disc(0.5) within group (order by number)")
    s = metric_rows(results, *by).groupBy(*by, "key").agg(F.min("number").alias("min"), F.max("number").alias("max"), median.alias("median"), F.count(number).alias("n"), F.count_if(~F.col("is_null")).alias("_said"))
    both = s.join(repeats, list(by)) if by else s.crossJoin(F.broadcast(repeats))  # a single row
    return both.where("n > 0 or _said = 0").select(*by, "key", "min", "max", "median", "n", (F.col("_repeats") - F.col("_said")).alias("n_null"))


def aggregate(results: DataFrame, *by: str) -> DataFrame:
    """(by, n_repeats, n_failed, spread_omitted, scored): how many results there are, the failed documents over all of them,
    the metrics that have no spread, and the documents that any repeat covered, sorted.

    Lists are per run: as long as its metrics and its documents are.
    """
    failed = F.try_variant_get("result", "$.counts.failed", "bigint")
    heads = results.groupBy(*by).agg(F.count(F.lit(1)).alias("n_repeats"), F.sum(F.coalesce(failed, F.lit(0))).alias("n_failed"))
    items = F.try_variant_get("result", "$.results", "array<variant>")
    ids = results.select(*by, F.explode(items).alias("i")).select(*by, F.try_variant_get("i", "$.receipt_id", "string").alias("id")).where("id is not null").distinct()
    scored = ids.groupBy(*by).agg(F.array_sort(F.collect_list("id")).alias("scored"))
    kept = spread_stored(results, *by).select(*by, "key")
    keys = metric_rows(results, *by).select(*by, "key").distinct()
    omitted = keys.join(kept, [*by, "key"], "left_anti").groupBy(*by).agg(F.array_sort(F.collect_list("key")).alias("spread_omitted"))
    none = F.array().cast("array<string>")
    out = heads
    for part, name in ((omitted, "spread_omitted"), (scored, "scored")):
        out = (out.join(part, list(by), "left") if by else out.crossJoin(F.broadcast(part.agg(F.first(name).alias(name))))).withColumn(name, F.coalesce(name, none))
    return out


