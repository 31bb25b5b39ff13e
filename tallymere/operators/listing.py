"""Filtered listings, pages, exports and summaries over receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import dec
from .scoring import rate

EXPORT_CAP = 5000


def filtered(receipts: DataFrame, status: str | None = None, merchant_id: int | None = None, since: str | None = None, until: str | None = None, least_confidence: str | None = None) -> DataFrame:
    """All given conditions hold; a date condition leaves out rows without a date."""
    conditions = [
        (status, lambda v: F.col("status") == v), (merchant_id, lambda v: F.col("merchant_id") == v), (since, lambda v: F.col("txn_date") >= F.lit(v).cast("date")),
        (until, lambda v: F.col("txn_date") <= F.lit(v).cast("date")), (least_confidence, lambda v: F.col("confidence") >= dec(v)),
    ]
    for value, make in conditions:
        if value is not None:
            receipts = receipts.where(make(value))
    return receipts


def export_scope(receipts: DataFrame, **conditions) -> DataFrame:
    """filtered, without pending and rejected rows unless a status is asked for."""
    out = filtered(receipts, **conditions)
    return out if conditions.get("status") else out.where(~F.col("status").isin("pending", "rejected"))


def page(rows: DataFrame, *order: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page with has_more: one row beyond it is looked at and left out, so nothing is counted."""
    if not (1 <= limit <= 1000 and 0 <= offset <= 1_000_000):
        raise ValueError("limit is 1 to 1000, offset 0 to 1,000,000")
    held = rows.orderBy(*order).offset(offset).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(*order))
    return held.withColumn("_n", n).withColumn("has_more", F.max("_n").over(Window.partitionBy(F.lit(0))) > limit).where(F.col("_n") <= limit).drop("_n")


def guard_export(rows: DataFrame, cap: int = EXPORT_CAP) -> DataFrame:
    """Refuses an export of more than cap rows; looks at cap + 1 rows at most."""
    if rows.limit(cap + 1).count() > cap:
        raise ValueError(f"more than {cap} rows; narrow the export")
    return rows


def summary_columns(r: DataFrame) -> DataFrame:
    return r.select("doc_id", "merchant_name", F.date_format("txn_date", "yyyy-MM-dd").alias("date"), F.col("total").cast("string").alias("total"), "currency", F.col("confidence").cast("string").alias("confidence"), "status", "merchant_id")


def export_rows(receipts: DataFrame, items: DataFrame, findings: DataFrame, merchants: DataFrame, tasks: DataFrame) -> DataFrame:
    """A row per receipt with its merchant's name, task priority, number of purchases and whether an error is open: four left joins."""
    n_items = items.where(~F.col("is_template_row")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"))
    open_errors = findings.groupBy("doc_id").agg(F.bool_or((F.col("severity") == "error") & ~F.col("resolved")).alias("open_error"))
    return (
        receipts.join(merchants.select("merchant_id", "canonical_name"), "merchant_id", "left").join(tasks.select("doc_id", F.col("priority").alias("task_priority")), "doc_id", "left")
        .join(n_items, "doc_id", "left").join(open_errors, "doc_id", "left")
        .withColumn("merchant", F.coalesce("canonical_name", "merchant_name"))
        .withColumns({"n_items": F.coalesce("n_items", F.lit(0)), "open_error": F.coalesce("open_error", F.lit(False))})
    )


def review_order() -> list[Column]:
    return [F.coalesce("task_priority", F.lit(65536)), F.coalesce(F.date_format("txn_date", "yyyy-MM-dd"), F.lit("")), F.col("doc_id")]


def export_summary(rows: DataFrame) -> DataFrame:
    """The summary sheet as (metric, value): counts, dates, rates, and totals by status and by merchant, in one pass of grouping sets."""
    rows = rows.withColumn("m", F.coalesce(F.nullif(F.col("merchant"), F.lit("")), F.lit("(unknown)")))
    sets = rows.groupingSets([["status"], ["m"], []], "status", "m").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("total").cast("decimal(24,4)").alias("s"), F.min("txn_date").alias("first"), F.max("txn_date").alias("last"),
        F.count_if(F.col("status") == "auto_approved").alias("a"), F.sum("confidence").alias("c"), F.count("total").alias("k"))
    text = lambda x: x.cast("string")
    pair = lambda name, value: F.struct((F.lit(name) if isinstance(name, str) else name).alias("metric"), text(value).alias("value"))
    whole = F.array(
        pair("receipts", F.col("n")), pair("first_date", F.col("first")), pair("last_date", F.col("last")), pair("auto_approval_rate", rate(F.col("a"), F.col("n"), 4)),
        pair("avg_confidence", F.round(F.col("c") / F.nullif(F.col("n"), F.lit(0)), 3).cast("decimal(12,3)")), pair("total_value", F.coalesce(F.col("s"), dec("0").cast("decimal(24,4)"))))
    pairs = F.when(F.col("g") == 3, whole).when(F.col("g") == 1, F.array(pair(F.concat(F.lit("status:"), "status"), F.col("n")))).when(F.col("k") > 0, F.array(pair(F.concat(F.lit("merchant:"), "m"), F.col("s"))))
    return sets.select(F.explode_outer(pairs).alias("p")).where("p is not null").select("p.*")
