"""Merchants: exact lookup by key, registration, confirmed variants, few-shot examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import merchant_key


def merchant_keys(merchants: DataFrame) -> DataFrame:
    """(key, merchant_id): the keys of the canonical name and the variants, none of them empty."""
    names = F.explode(F.array_compact(F.array("canonical_name", "variant")))
    keyed = merchants.select("merchant_id", names.alias("name")).select("merchant_id", merchant_key(F.col("name")).alias("key"))
    return keyed.where("key <> ''").distinct()


def unique_keys(keys: DataFrame) -> DataFrame:
    """Keys that one merchant alone has; a key of several resolves to none."""
    return keys.groupBy("key").agg(F.min("merchant_id").alias("found_id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def lookup(names: DataFrame, merchants: DataFrame) -> DataFrame:
    """names (doc_id, name) with merchant_id: by exact key, or null."""
    keyed = names.withColumn("key", merchant_key(F.col("name")))
    return keyed.join(unique_keys(merchant_keys(merchants)), "key", "left").select("doc_id", F.col("found_id").alias("merchant_id"))


def resolve(docs: DataFrame, merchants: DataFrame) -> DataFrame:
    """docs (doc_id, name, tax_id) with merchant_id: the tax number first, then the name."""
    by_tax = merchants.where("tax_id is not null").groupBy("tax_id").agg(F.min("merchant_id").alias("by_tax"))
    keyed = docs.withColumn("key", merchant_key(F.col("name"))).join(by_tax, "tax_id", "left").join(unique_keys(merchant_keys(merchants)), "key", "left")
    return keyed.select("doc_id", F.coalesce("by_tax", "found_id").alias("merchant_id"))


def register(candidates: DataFrame, merchants: DataFrame) -> DataFrame:
    """New merchants among candidates (name, tax_id): both are needed, and the tax number must be new; the first name by order wins."""
    whole = candidates.where("trim(coalesce(name, '')) <> '' and tax_id is not null")
    return whole.join(merchants.where("tax_id is not null").select("tax_id"), "tax_id", "left_anti").groupBy("tax_id").agg(F.min("name").alias("canonical_name"))


def confirm_variants(seen: DataFrame, merchants: DataFrame) -> DataFrame:
    """(merchant_id, name): names seen with a merchant's tax number that are new to it and no other merchant's."""
    keys = merchant_keys(merchants)
    named = seen.join(merchants.where("tax_id is not null").select("tax_id", "merchant_id"), "tax_id").withColumn("key", merchant_key(F.col("name"))).where("key <> ''")
    new = named.join(keys.select("key"), "key", "left_anti")
    # Of new names with one key, a merchant may take it only if no other one claims it in the same batch.
    claims = new.groupBy("key").agg(F.count_distinct("merchant_id").alias("n"), F.min("merchant_id").alias("merchant_id"), F.min("name").alias("name")).where("n = 1")
    return claims.select("merchant_id", "name")


def few_shots(receipts: DataFrame, runs: DataFrame, corrected: DataFrame, k: int = 2) -> DataFrame:
    """The k newest reviewed, never corrected receipts of each merchant that were read by exactly one extract run."""
    single = runs.where("pass_name = 'extract'").groupBy("receipt_id").agg(F.count(F.lit(1)).alias("n"), F.min("attempt").alias("attempt")).where("n = 1")
    good = receipts.where("status = 'reviewed' and merchant_id is not null").join(single, F.col("doc_id") == F.col("receipt_id")).join(corrected.select("doc_id").distinct(), "doc_id", "left_anti")
    newest = Window.partitionBy("merchant_id").orderBy(F.col("created_rank").desc(), "doc_id")
    return good.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k).select("merchant_id", "rank", "doc_id", "attempt")
