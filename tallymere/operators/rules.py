"""The thirty integrity rules as columns: each gives the findings of one document as an array.

A rule whose inputs are missing says nothing. Nothing here can fail on data: comparisons are null-safe and parsing is by try_ functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import strict_iso
from ..functions.money import dec, digits, money_text, within
from ..functions.text import blank, merchant_key, nfkc_each, normal_description, plain_description, strip
from ..sources.adapters import TODAY
from .paths import bound
from .records import decimal_median, line_sum, purchases

FINDING = "struct<rule_id:string,severity:string,message:string,field_paths:array<string>>"
RANK = {"info": 0, "warn": 1, "error": 2}

# Descriptions that are summary rows, certainly and possibly.
SUMMARY_ROWS = (
    "TOTAL", "SUBTOTAL", "SUB TOTAL", "GRAND TOTAL", "NET TOTAL", "GROSS TOTAL", "TOTAL DUE", "AMOUNT DUE", "BALANCE DUE", "TOTAL AMOUNT", "TOTAL SALES",
    "TAX", "TAXES", "TOTAL TAX", "SALES TAX", "VAT", "VAT AMOUNT", "VATABLE", "VATABLE SALES", "VAT EXEMPT", "VAT EXEMPT SALES", "ZERO RATED",
    "ZERO RATED SALES", "GST", "GST AMOUNT", "TOTAL VAT", "CHANGE", "CHANGE DUE", "CASH", "CASH TENDERED", "TENDER", "TENDERED", "AMOUNT TENDERED",
    "TOTAL PAYMENT", "TOTAL ITEMS", "ITEMS SOLD", "NO OF ITEMS", "TOTAL QTY", "THANK YOU", "THANKS", "CUSTOMER COPY", "MERCHANT COPY",
)
SUMMARY_ROWS_PERHAPS = ("SERVICE CHARGE", "DISCOUNT", "TOTAL DISCOUNT", "LESS DISCOUNT", "ROUNDING", "ROUND OFF", "PAYMENT")
# Currencies that raise no question.
FAMILIAR_CURRENCIES = tuple("AED ARS AUD BDT BGN BHD BND BRL CAD CHF CLP CNY COP CZK DKK EGP EUR GBP HKD HRK HUF IDR ILS INR IQD ISK JPY KES KRW KWD LKR MAD MXN MYR NGN NOK NZD OMR PEN PHP PKR PLN QAR RON RSD RUB SAR SEK SGD THB TRY TWD TZS UAH USD VND ZAR".split())
CRITICAL_PATHS = ("merchant.name", "receipt.date", "totals.total", "totals.subtotal", "totals.tax")


@dataclass(frozen=True)
class RuleConfig:
    """Thresholds; each becomes a literal of the plan."""

    tolerance: dict[str, tuple[str, str]] = field(default_factory=lambda: {"default": ("0.0002", "0.02"), "R020": ("0.0002", "0.05"), "R021": ("0.0005", "0.05"), "R024": ("0.0005", "0.10")})
    most_total: str = "1000000"
    least_total: str = "0.01"
    most_age_years: int = 10
    future_slack_days: int = 1
    most_qty: str = "10000"
    most_tax_rate: str = "0.35"
    price_outlier: str = "100"
    require_lines: bool = True
    strict_ocr: bool = False
    buyer_name: str | None = "Tallymere Inc."
    buyer_tax_id: str | None = "123-456-789"
    today: str = TODAY

    def tol(self, rule: str) -> tuple[str, str]:
        return self.tolerance.get(rule, self.tolerance["default"])

    def overlay(self, **changes) -> RuleConfig:
        """A copy with these thresholds; tolerances are merged rule by rule."""
        tolerance = self.tolerance | changes.pop("tolerance", {})
        return replace(self, tolerance=tolerance, **changes)

    @property
    def expects_buyer(self) -> bool:
        return bool((self.buyer_name or "").strip() or (self.buyer_tax_id or "").strip())


REGISTRY: dict[str, tuple[str, str, Callable[[RuleConfig], Column]]] = {}


def rule(rule_id: str, severity: str, what: str):
    def register(build: Callable[[RuleConfig], Column]):
        REGISTRY[rule_id] = (severity, what, build)
        return build

    return register


def finding(rule_id: str, severity: Column | str, message: Column | str, *paths: Column | str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(rule_id).alias("rule_id"), lit(severity).alias("severity"), lit(message).alias("message"), F.array(*map(lit, paths)).cast("array<string>").alias("field_paths"))


def _none() -> Column:
    return F.array().cast(f"array<{FINDING}>")


def one(fires: Column, found: Column) -> Column:
    """The finding if the condition is true; none if it is false or can't be told."""
    return F.when(F.coalesce(fires, F.lit(False)), F.array(found)).otherwise(_none())


def each(items: Column, fires: Callable[[Column], Column], make: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(items, lambda x: F.coalesce(fires(x), F.lit(False))), make)


def _at(item: Column, name: str = "") -> Column:
    return F.concat(F.lit("line_items["), item["position"].cast("string"), F.lit("]" + (f".{name}" if name else "")))


@rule("R001", "error", "The response is a record of the schema.")
def _r001(c):
    return one(F.col("parse_failed"), finding("R001", "error", "the response is no record of the schema"))


@rule("R010", "error", "There is a total.")
def _r010(c):
    return one(F.col("total").isNull(), finding("R010", "error", "no total was read", "totals.total"))


@rule("R011", "warn", "There is a date.")
def _r011(c):
    raw = F.coalesce(F.col("date_raw"), F.lit("")) != ""
    return one(F.col("date_text").isNull(), finding("R011", F.when(raw, "info").otherwise("warn"), "no date was read", "receipt.date"))


@rule("R012", "warn", "There is a merchant's name.")
def _r012(c):
    return one(blank(F.col("merchant_name")), finding("R012", "warn", "no merchant name was read", "merchant.name"))


@rule("R013", "warn", "There are lines.")
def _r013(c):
    return one(F.lit(c.require_lines) & ~F.col("estimate").eqNullSafe(F.lit(0)) & (F.size("line_items") == 0), finding("R013", "warn", "no lines were read", "line_items"))


@rule("R014", "warn", "The buyer is named, where one is expected.")
def _r014(c):
    return one(F.lit(c.expects_buyer) & blank(F.col("buyer_name")), finding("R014", "warn", "no buyer name was read", "buyer.name"))


@rule("R015", "warn", "The buyer is the expected one.")
def _r015(c):
    read, want = digits(F.coalesce("buyer_tax_id", F.lit(""))), digits(F.lit(c.buyer_tax_id or ""))
    by_number = (read != "") & (want != "")
    other_name = ~blank(F.col("buyer_name")) & ~blank(F.lit(c.buyer_name or "")) & (merchant_key(F.col("buyer_name")) != merchant_key(c.buyer_name))
    found = F.when(by_number, F.when(read != want, finding("R015", "error", "another buyer's tax number", "buyer.tax_id"))).when(other_name, finding("R015", "warn", "another buyer's name", "buyer.name"))
    return F.when(F.lit(c.expects_buyer) & found.isNotNull(), F.array(found)).otherwise(_none())


def _readings(net: Column, gross: Column) -> list[tuple[Column, Column]]:
    """(whether this figure counts, the figure): the net one unless lines include tax, the gross one unless they don't."""
    flag = F.col("prices_include_tax")
    return [(~flag.eqNullSafe(F.lit(True)) & net.isNotNull(), net), (~flag.eqNullSafe(F.lit(False)) & gross.isNotNull(), gross)]


def _sum_fits_none(c: RuleConfig, rule_id: str, net: Column, gross: Column) -> Column:
    rel, floor = c.tol(rule_id)
    least = F.greatest(dec(floor), (dec("0.01") * F.size(F.col("_purchases"))).cast("decimal(14,4)"))
    readings = _readings(net, gross)
    usable = reduce(lambda a, b: a | b, [u for u, _ in readings])
    fits = reduce(lambda a, b: a | b, [u & within(F.col("_line_sum"), v, rel, least) for u, v in readings])
    return usable & F.col("_line_sum").isNotNull() & ~fits


def _compared(*figures: tuple[str, Column, Column]) -> Column:
    """Each figure that the lines' sum was held against (name, whether it counts, value), with its own difference."""
    said = lambda name, value: F.concat(F.lit(f"{name} "), money_text(value), F.lit(" differs by "), money_text(F.col("_line_sum") - value))
    return F.array_join(F.array_compact(F.array(*[F.when(counts, said(name, value)) for name, counts, value in figures])), "; ")


@rule("R020", "error", "The lines add up to the subtotal, or to the total where they include tax.")
def _r020(c):
    fires = F.col("subtotal").isNotNull() & _sum_fits_none(c, "R020", F.col("subtotal"), F.col("total"))
    (net, subtotal), (gross, total) = _readings(F.col("subtotal"), F.col("total"))
    said = F.concat(F.lit("the lines add up to "), money_text(F.col("_line_sum")), F.lit(": "), _compared(("the subtotal", net, subtotal), ("the total", gross, total)))
    return one(fires, finding("R020", "error", said, "line_items", "totals.subtotal", "totals.total"))


@rule("R021", "error", "Quantity times price is the line's total.")
def _r021(c):
    rel, floor = c.tol("R021")
    whole = lambda x: x["qty"].isNotNull() & x["unit_price"].isNotNull() & x["line_total"].isNotNull()
    return each(F.col("_purchases"), lambda x: whole(x) & ~within(x["qty"] * x["unit_price"], x["line_total"], rel, floor), lambda x: finding("R021", "error", F.concat(F.lit("quantity times price is not "), money_text(x["line_total"])), _at(x, "line_total")))


@rule("R022", "error", "Subtotal, tax and discount make the total.")
def _r022(c):
    zero = F.lit(0).cast("decimal(14,4)")
    made = F.col("subtotal") + F.coalesce("tax", zero) - F.abs(F.coalesce("discount", zero))
    return one(made.isNotNull() & F.col("total").isNotNull() & ~within(made, F.col("total"), *c.tol("R022")), finding("R022", "error", F.concat(F.lit("subtotal, tax and discount make "), money_text(made)), "totals.total"))


@rule("R023", "warn", "Tender less total is the change.")
def _r023(c):
    left = F.col("tender") - F.col("total")
    return one(left.isNotNull() & F.col("change").isNotNull() & ~within(left, F.col("change"), *c.tol("R023")), finding("R023", "warn", "tender less total is not the change", "totals.tender", "totals.change"))


@rule("R024", "warn", "Without a subtotal, the lines add up to the total, before or after tax.")
def _r024(c):
    zero = F.lit(0).cast("decimal(14,4)")
    net = F.col("total") - F.coalesce("tax", zero) + F.abs(F.coalesce("discount", zero))
    fires = F.col("subtotal").isNull() & F.col("total").isNotNull() & _sum_fits_none(c, "R024", net, F.col("total"))
    (by_net, before), (by_gross, total) = _readings(net, F.col("total"))
    said = F.concat(F.lit("the lines add up to "), money_text(F.col("_line_sum")), F.lit(": "), _compared(("the total before tax", by_net, before), ("the total", by_gross, total)))
    return one(fires, finding("R024", "warn", said, "line_items", "totals.total"))


@rule("R025", "warn", "The tax bands add up to the tax.")
def _r025(c):
    bands = F.col("band_a") + F.col("band_b")
    return one(bands.isNotNull() & F.col("tax").isNotNull() & ~within(bands, F.col("tax"), *c.tol("R025")), finding("R025", "warn", "the tax bands don't add up to the tax", "totals.tax_breakdown", "totals.tax"))


@rule("R030", "error", "The date is a calendar date, year first.")
def _r030(c):
    return one(F.col("date_text").isNotNull() & strict_iso(F.col("date_text")).isNull(), finding("R030", "error", F.concat(F.lit("no calendar date: "), F.col("date_text")), "receipt.date"))


def _age(c: RuleConfig) -> Column:
    return F.date_diff(F.lit(c.today).cast("date"), strict_iso(F.col("date_text")))


@rule("R031", "error", "The date is not in the future.")
def _r031(c):
    return one(-_age(c) > c.future_slack_days, finding("R031", "error", "the date is in the future", "receipt.date"))


@rule("R032", "warn", "The date is not long ago.")
def _r032(c):
    return one(_age(c) > c.most_age_years * 365, finding("R032", "warn", "the date is long ago", "receipt.date"))


@rule("R033", "warn", "The currency is a familiar one.")
def _r033(c):
    return one((F.coalesce("currency", F.lit("")) != "") & ~F.upper(strip(F.col("currency"))).isin(*FAMILIAR_CURRENCIES), finding("R033", "warn", F.concat(F.lit("unfamiliar currency "), F.col("currency")), "receipt.currency"))


@rule("R040", "error", "The total is over zero, but for refunds.")
def _r040(c):
    return one(~F.coalesce("is_refund", F.lit(False)) & (F.col("total") <= 0), finding("R040", "error", "the total is not over zero", "totals.total", "meta.is_refund"))


@rule("R041", "warn", "The total has a plausible size.")
def _r041(c):
    return one(~F.abs("total").between(dec(c.least_total), dec(c.most_total)), finding("R041", "warn", "the total has an unlikely size", "totals.total"))


@rule("R042", "warn", "No price is far from the document's median.")
def _r042(c):
    priced = F.filter(F.col("_purchases"), lambda x: F.coalesce(x["unit_price"] > 0, F.lit(False)))
    limit = decimal_median(F.transform(priced, lambda x: x["unit_price"])) * dec(c.price_outlier)
    found = each(priced, lambda x: x["unit_price"] > limit, lambda x: finding("R042", "warn", "a price far over the median", _at(x, "unit_price")))
    return F.when(F.size(priced) >= 4, found).otherwise(_none())


@rule("R043", "warn", "Quantities are over zero and not absurd.")
def _r043(c):
    return each(F.col("_purchases"), lambda x: ~((x["qty"] > 0) & (x["qty"] <= dec(c.most_qty))), lambda x: finding("R043", "warn", "an unlikely quantity", _at(x, "qty")))


@rule("R044", "warn", "The tax rate is plausible.")
def _r044(c):
    rate_ok = (F.col("tax") >= 0) & (F.col("tax") <= dec(c.most_tax_rate) * F.col("subtotal"))
    return one((F.col("subtotal") > 0) & ~rate_ok, finding("R044", "warn", "an unlikely tax rate", "totals.tax", "totals.subtotal"))


@rule("R045", "warn", "The discount is within the subtotal.")
def _r045(c):
    return one(F.abs("discount") > F.col("subtotal"), finding("R045", "warn", "the discount is over the subtotal", "totals.discount"))


@rule("R050", "info", "No line repeats the one before.")
def _r050(c):
    p = purchases(_named_lines())
    same = lambda a, b: (a["name"] == b["name"]) & (b["name"] != "") & a["qty"].eqNullSafe(b["qty"]) & a["unit_price"].eqNullSafe(b["unit_price"]) & a["line_total"].eqNullSafe(b["line_total"])
    pairs = F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size("line_items"), F.lit(1))), lambda a, b: F.when(same(a, b), b))  # the last has none after it
    return F.transform(F.filter(pairs, lambda x: x.isNotNull()), lambda x: finding("R050", "info", "this line repeats the one before", _at(x)))


@rule("R051", "info", "Positions count up from zero.")
def _r051(c):
    n = F.size("line_items")
    positions = F.array_sort(F.transform("line_items", lambda x: x["position"]))
    return one((n > 0) & (positions != F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))), finding("R051", "info", "positions don't count up from zero", "line_items"))


@rule("R052", "error", "No line is a summary row.")
def _r052(c):
    return each(_named_lines(), lambda x: x["name"].isin(*SUMMARY_ROWS, *SUMMARY_ROWS_PERHAPS), lambda x: finding("R052", F.when(x["name"].isin(*SUMMARY_ROWS), "error").otherwise("warn"), "a summary row among the lines", _at(x)))


@rule("R053", "warn", "Every line has a description.")
def _r053(c):
    return each(F.col("line_items"), lambda x: blank(x["description_raw"]), lambda x: finding("R053", "warn", "a line without a description", _at(x, "description_raw")))


@rule("R060", "warn", "The total's digits stand in the separately read text.")
def _r060(c):
    needle = digits(F.abs(F.bround("total", 2)).cast("decimal(14,2)").cast("string"))
    fires = (F.coalesce("ocr_text", F.lit("")) != "") & (needle != "") & ~F.contains(digits(F.col("ocr_text")), needle)
    return one(fires, finding("R060", "error" if c.strict_ocr else "warn", "the total isn't in the separately read text", "totals.total"))


@rule("R061", "info", "The merchant's words stand in the separately read text.")
def _r061(c):
    words = lambda x: F.array_distinct(F.filter(F.split(normal_description(F.col(x)), " "), lambda w: w != ""))
    mine, theirs = words("merchant_name"), words("ocr_text")
    fires = (F.coalesce("ocr_text", F.lit("")) != "") & (F.size(mine) > 0) & (F.size(F.array_intersect(mine, theirs)) * 10 < F.size(mine) * 6)
    return one(fires, finding("R061", "info", "the merchant isn't in the separately read text", "merchant.name"))


@rule("R070", "warn", "Repeated readings agree.")
def _r070(c):
    disputed = F.col("disputed")
    critical = each(disputed, lambda p: p.isin(*CRITICAL_PATHS), lambda p: finding("R070", "warn", "readings differ in a critical field", p))
    rest = F.filter(disputed, lambda p: ~p.isin(*CRITICAL_PATHS))
    others = one(F.size(rest) > 0, F.struct(F.lit("R070").alias("rule_id"), F.lit("info").alias("severity"), F.lit("readings differ in further fields").alias("message"), rest.alias("field_paths")))
    return F.when(disputed.isNotNull(), F.concat(critical, others)).otherwise(_none())


def disputed_paths() -> Column:
    return F.filter(F.array(F.when(F.col("disputes_total"), F.lit("totals.total")), F.when(F.col("disputes_address"), F.lit("merchant.address"))), lambda p: p.isNotNull())


def _named_lines() -> Column:
    """line_items with `name`, the normal form of each line's description."""
    return F.zip_with("line_items", "_texts", lambda x, t: x.withField("name", plain_description(t)))


def with_findings(records: DataFrame, config: RuleConfig | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """records with `findings`: those of all rules (or of these) in the order of rule ids. Map work only: no shuffle.

    Python sees a text only where it isn't ASCII, for its normal form; without the rules that compare texts it isn't planned.
    """
    config = config or RuleConfig()
    built = [build(config).cast(f"array<{FINDING}>") for r, (_, _, build) in sorted(REGISTRY.items()) if only is None or r in only]
    base = records if "disputed" in records.columns else records.withColumn("disputed", disputed_paths())
    # Columns that many rules read are made once, before the rules.
    by_name = only is None or not {"R050", "R052"}.isdisjoint(only)
    if by_name:
        base = base.withColumn("_texts", nfkc_each(F.transform("line_items", lambda x: x["description_raw"])))
    base = base.withColumn("_purchases", purchases()).withColumn("_line_sum", line_sum())
    return base.withColumn("findings", F.concat(*built) if len(built) > 1 else built[0]).drop("_texts", "_purchases", "_line_sum")


def findings_table(records: DataFrame, config: RuleConfig | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """A row per finding: doc_id, rule_id, severity, message, field_paths."""
    found = with_findings(records, config, only).select("doc_id", "findings")
    return found.select("doc_id", F.explode_outer("findings").alias("f")).where("f is not null").select("doc_id", "f.*")


def catalogue(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(w).alias("description")) for r, (s, w, _) in sorted(REGISTRY.items())])
    return spark.range(1).select(F.inline(rows))


def count_of(severity: str, findings: Column | str = "findings") -> Column:
    return F.size(F.filter(findings, lambda f: f["severity"] == severity))


def worst_severity(findings: Column | str = "findings") -> Column:
    """The gravest severity among the findings; null without one."""
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    return F.array_max(F.transform(findings, lambda f: F.struct(F.try_element_at(rank, f["severity"]).alias("rank"), f["severity"].alias("severity"))))["severity"]


def summary_text(findings: Column | str = "findings") -> Column:
    ids = F.array_sort(F.array_distinct(F.transform(findings, lambda f: f["rule_id"])))
    names = F.when(F.size(ids) == 0, "clean").otherwise(F.array_join(ids, ", "))
    return F.concat(count_of("error").cast("string"), F.lit(" error(s), "), count_of("warn").cast("string"), F.lit(" warning(s), "), count_of("info").cast("string"), F.lit(" info: "), names)


def repair_text(findings: Column | str = "findings", most: int = 12) -> Column:
    """The worst findings first, at most `most` of them, for asking again."""
    serious = F.filter(findings, lambda f: f["severity"] != "info")
    keyed = F.array_sort(F.transform(serious, lambda f: F.struct(F.when(f["severity"] == "error", 0).otherwise(1).alias("k"), f["rule_id"].alias("r"), F.concat(F.lit("["), f["rule_id"], F.lit("] "), f["message"]).alias("t"))))

    def text(ks: Column) -> Column:
        shown = F.array_join(F.transform(F.slice(ks, 1, most), lambda f: f["t"]), "\n")
        return F.when(F.size(ks) > most, F.concat(shown, F.lit("\n... and "), (F.size(ks) - most).cast("string"), F.lit(" further problems."))).otherwise(shown)

    return bound(keyed, text)
