"""Stored rows as the objects that are shown: summaries, details with lines and findings, corrections by page. JSON in the JVM.

Money is text with the digits of its column, dates are ISO, and what has no value is null, never left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WHOLE = {"ignoreNullFields": "false"}


def as_json(value: Column) -> Column:
    return F.to_json(value, _WHOLE)


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def summary(prefix: str = "") -> Column:
    """A receipt as one line of a list."""
    c = lambda n: F.col(prefix + n)
    return F.struct(
        c("doc_id").cast("string").alias("id"), c("status").alias("status"), c("confidence").cast("string").alias("confidence"), c("merchant_name_raw").alias("merchant_name_raw"),
        F.date_format(c("txn_date"), "yyyy-MM-dd").alias("txn_date"), c("currency").alias("currency"), c("total").cast("string").alias("total"),
    )


def line(x: Column) -> Column:
    """A line with everything that can be corrected, its modifiers and its place on the page."""
    text = lambda n: x[n].cast("string").alias(n)
    modifiers = F.transform(x["modifiers"], lambda m: F.struct(m["label"].alias("label"), m["amount"].cast("string").alias("amount")))
    return F.struct(
        x["position"].alias("position"), x["description_raw"].alias("description_raw"), x["sku"].alias("sku"), text("qty"), x["unit"].alias("unit"), text("unit_price"), text("line_total"),
        x["is_template_row"].alias("is_template_row"), modifiers.alias("modifiers"), x["bbox"].alias("bbox"),
    )


def finding(x: Column) -> Column:
    return F.struct(x["rule_id"].alias("rule_id"), x["severity"].alias("severity"), x["message"].alias("message"), F.parse_json(x["context"]).alias("context"), x["resolved_by_repair"].alias("resolved_by_repair"))


def correction(x: Column) -> Column:
    return F.struct(x["path"].alias("field_path"), x["value_before"].alias("value_before"), x["value_after"].alias("value_after"), x["corrected_by"].alias("corrected_by"))


def details(receipts: DataFrame, items: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, detail): whole receipts as JSON, lines by position and findings as they were written. Rows are as in persist.

    Lines and findings are gathered by document once each; a document's detail is one text, as it is shown.
    """
    gathered = lambda df, order, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in ("doc_id", *order)]))).alias(name))
    lines = gathered(items, ("position",), "_lines")
    found = gathered(findings, ("commit_no", "seq"), "_findings")
    both = receipts.join(lines, "doc_id", "left").join(found, "doc_id", "left")
    totals = F.struct(*[_text(c).alias(n) for n, c in (("subtotal", "subtotal"), ("tax", "tax_total"), ("discount", "discount_total"), ("total", "total"), ("tender", "tender_amount"), ("change", "change_amount"))])
    none = lambda df, name: F.coalesce(name, F.array().cast(df.schema[name].dataType))
    whole = F.struct(
        _text("doc_id").alias("id"), "status", _text("confidence").alias("confidence"), "confidence_reasons", "merchant_name_raw", F.struct(F.col("buyer_name_raw").alias("name"), F.col("buyer_tax_id").alias("tax_id")).alias("buyer"),
        "receipt_number", F.date_format("txn_date", "yyyy-MM-dd").alias("txn_date"), "date_raw", "txn_time", "currency", "payment_method", "card_last4", "is_handwritten", "legibility", _text("duplicate_of").alias("duplicate_of"),
        "receipt_is_inconsistent", totals.alias("totals"), F.transform(none(lines, "_lines"), line).alias("line_items"), F.transform(none(found, "_findings"), finding).alias("findings"),
    )
    return both.select("doc_id", as_json(whole).alias("detail"))


def correction_pages(asks: DataFrame, corrections: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """(user_id, doc_id, code, corrections, has_more) for asks (user_id, doc_id, known, allowed): one page of a document's corrections.

    corrections: (doc_id, n, path, value_before, value_after, corrected_by), n their order. An unknown document is 404, one
    that the user may not see 403, both without corrections (null); one that has none is 200 with an empty list. Only the rows of
    the page and one more are gathered.
    """
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("n", "path"))
    page = corrections.withColumn("_k", place).where((F.col("_k") > offset) & (F.col("_k") <= offset + limit + 1))
    rows = page.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_k", "path", "value_before", "value_after", "corrected_by"))).alias("_rows"))
    code = F.when(~F.coalesce("known", F.lit(False)), 404).when(~F.coalesce("allowed", F.lit(False)), 403).otherwise(200)
    both = asks.withColumn("code", code).join(rows, "doc_id", "left")
    some = F.coalesce("_rows", F.array().cast(rows.schema["_rows"].dataType))
    seen = F.col("code") == 200
    shown = as_json(F.transform(F.slice(some, 1, limit), correction))
    return both.select("user_id", "doc_id", "code", F.when(seen, shown).alias("corrections"), F.when(seen, F.size(some) > limit).alias("has_more"))


# --- lookups in the findings of one document ---
def by_severity(findings: Column | str, severity: str) -> Column:
    return F.filter(findings, lambda f: f["severity"] == severity)


def fired(findings: Column | str, rule_id: str) -> Column:
    return F.exists(findings, lambda f: f["rule_id"] == rule_id)


def touching(findings: Column | str, path: str) -> Column:
    """The findings that name a path."""
    return F.filter(findings, lambda f: F.array_contains(f["field_paths"], path))
