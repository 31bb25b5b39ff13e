"""A whole record in its canonical form, without guessing: text, currency, date and the order of lines. Money is never touched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import clean_text, clean_texts, currency_chain


def _in_order(items: Column) -> Column:
    """Lines by their positions where these are 0 to n - 1 in some order; else numbered as they stand."""
    places = F.array_sort(F.transform(items, lambda x: x["position"]))
    whole = places == F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(x["position"].alias("p"), i.alias("i"), x.alias("x"))))
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(keyed, lambda k: k["x"])).otherwise(F.transform(items, lambda x, i: x.withField("position", i)))


def normalised(records: DataFrame, merchant_currency: Column | None = None, system_currency: Column | None = None, reference_year: int = 2026, record_col: str = "record") -> DataFrame:
    """records with their record in canonical form.

    Names, addresses and descriptions lose control characters and needless white space. The currency is the first code of what is
    printed, the merchant's and the system's; a mere symbol is none. A date that can be told becomes ISO; one whose day and
    month can't be told apart is taken out and kept as date_raw, unless that says something; any other text stays for the
    rules. Null records stay null. Map work only; Python sees text that isn't ASCII.
    """
    none = F.lit(None).cast("string")
    r = F.col(record_col)
    texts = records.withColumn("_lines", clean_texts(F.transform(r["line_items"], lambda x: x["description_raw"])))
    texts = texts.withColumn("_name", clean_text(r["merchant"]["name"])).withColumn("_address", clean_text(r["merchant"]["address"]))
    texts = texts.withColumn("_date", parse_date(r["receipt"]["date"], reference_year))
    said, raw, told = r["receipt"]["date"], r["receipt"]["date_raw"], F.col("_date.date")
    unsure = told.isNull() & F.col("_date.ambiguous")
    lines = F.zip_with(r["line_items"], "_lines", lambda x, t: x.withField("description_raw", t))
    made = r
    for path, value in (
        ("merchant.name", F.col("_name")), ("merchant.address", F.col("_address")),
        ("receipt.currency", currency_chain(r["receipt"]["currency"], none if merchant_currency is None else merchant_currency, none if system_currency is None else system_currency)),
        ("receipt.date", F.when(told.isNotNull(), told.cast("string")).when(~F.coalesce(unsure, F.lit(False)), said)),
        ("receipt.date_raw", F.when(unsure & (F.coalesce(raw, F.lit("")) == ""), said).otherwise(raw)), ("line_items", _in_order(lines)),
    ):
        made = made.withField(path, value)
    return texts.withColumn(record_col, F.when(r.isNotNull(), made)).drop("_lines", "_name", "_address", "_date")
