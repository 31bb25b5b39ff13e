"""One row per document with its lines as an array: the shape that rules, scoring and export read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import frame

ITEM = "struct<position:int,description_raw:string,qty:decimal(12,4),unit_price:decimal(14,4),line_total:decimal(14,4),modifiers:array<struct<label:string,amount:decimal(14,4)>>,is_template_row:boolean>"


def gathered(items: DataFrame) -> DataFrame:
    """A row per document that has lines: line_items in the order of their positions, n_purchases, s and s0 (as v_sums), in one grouping."""
    none = F.array().cast("array<struct<label:string,amount:decimal(14,4)>>")
    modifiers = F.when(F.col("modifier_amount") != 0, F.array(F.struct(F.lit("promo").alias("label"), F.col("modifier_amount").alias("amount")))).otherwise(none)
    item = F.struct("position", "description_raw", "qty", "unit_price", "line_total", modifiers.alias("modifiers"), "is_template_row")
    bought, missing = ~F.col("is_template_row"), F.col("line_total").isNull()
    net = F.sum(F.when(bought, F.col("line_total") + F.col("modifier_amount")))
    whole = (F.count_if(bought & missing) == 0) & (F.count_if(bought) > 0)
    return items.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(item)).alias("line_items"), F.count_if(bought).alias("n_purchases"), F.when(whole, net).cast("decimal(18,4)").alias("s"),
        F.coalesce(net, F.lit(0)).cast("decimal(14,4)").alias("s0"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head and lines of every document; documents without lines have an empty array."""
    whole = frame(spark, sf_dir, "v_headers", gathered(frame(spark, sf_dir, "v_items")))
    return whole.withColumn("line_items", F.coalesce("line_items", F.array().cast(f"array<{ITEM}>")))


def purchases(items: Column | str = "line_items") -> Column:
    """The lines that are purchases: blank rows of a form are not."""
    return F.filter(items, lambda x: ~x["is_template_row"])


def net_amount(item: Column) -> Column:
    """A line's total and its modifiers; null without a total, missing modifier amounts left out."""
    return F.aggregate(item["modifiers"], item["line_total"].cast("decimal(24,4)"), lambda a, x: (a + F.coalesce(x["amount"], F.lit(0).cast("decimal(14,4)"))).cast("decimal(24,4)"))


def line_sum(items: Column | str = "line_items") -> Column:
    """Sum of the purchases' net amounts; null if there are none or one is missing."""
    nets = F.transform(purchases(items), net_amount)
    total = F.aggregate(nets, F.lit(0).cast("decimal(24,4)"), lambda a, x: (a + x).cast("decimal(24,4)"))
    return F.when((F.size(nets) > 0) & ~F.exists(nets, lambda x: x.isNull()), total)


def decimal_median(values: Column) -> Column:
    """Exact median of an array of decimals without nulls; the mean of the middle two for an even number."""
    v, n = F.array_sort(values), F.size(values)
    low, high = F.get(v, F.floor((n - 1) / 2).cast("int")), F.get(v, F.floor(n / 2).cast("int"))
    return ((low + high) / F.lit(2)).cast("decimal(28,8)")
