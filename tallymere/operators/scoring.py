"""Confidence from findings and reading signals, and the routing that follows."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import dec
from .rules import count_of

# Penalties, their caps, the bonus and the thresholds.
ANY_ERROR, PER_WARN, CAP_WARN = "-0.35", "-0.08", "-0.30"
LEGIBILITY = {"fair": "-0.10", "poor": "-0.25"}
PER_ISSUE, CAP_ISSUES, HANDWRITTEN = "-0.03", "-0.10", "-0.15"
PER_AMBIGUOUS, CAP_AMBIGUOUS = "-0.05", "-0.20"
NO_TOTAL, NO_DATE, NO_MERCHANT = "-0.30", "-0.10", "-0.10"
PER_DISPUTE, CAP_DISPUTE = "-0.06", "-0.30"
PRIOR_LEAST, PRIOR_BONUS = 10, "0.05"
AUTO_APPROVE, QUICK_REVIEW = "0.85", "0.60"

# The texts of reasons and routes, which are stored with a document and must read alike; numbers go before them.
REASONS = {
    "errors": "validation errors present", "warnings": " warning finding(s)", "legibility": "legibility: ", "issues": " triage issue(s)", "handwritten": "handwritten receipt",
    "ambiguous": " ambiguous field(s)", "no_total": "total is missing", "no_date": "date is missing", "no_merchant": "merchant name is missing",
    "disputed": " disputed field(s) across consistency runs", "prior": "verified merchant prior",
}
ROUTES = {"urgent": "urgent: validation errors and total is missing", "approved": "auto-approved at confidence ", "quick": "quick verify", "full": "full re-key"}

_P = "decimal(6,3)"


def capped(per: str, n: Column, cap: str) -> Column:
    """per times n, bounded by cap; both are negative."""
    return F.greatest((dec(per) * n).cast(_P), dec(cap).cast(_P))


def signals(prior: Column | None = None) -> Column:
    """Ordered array of struct(reason, penalty) that lower or raise the confidence."""
    warns, disputes = count_of("warn"), F.size("disputed")
    some = lambda on, penalty: F.when(F.coalesce(on, F.lit(False)), penalty.cast(_P))
    said = lambda n, what: F.concat(n.cast("string"), F.lit(what))
    rows = [
        (F.lit(REASONS["errors"]), some(count_of("error") > 0, dec(ANY_ERROR))),
        (said(warns, REASONS["warnings"]), some(warns > 0, capped(PER_WARN, warns, CAP_WARN))),
        *[(F.lit(REASONS["legibility"] + k), some(F.col("legibility") == k, dec(v))) for k, v in LEGIBILITY.items()],
        (said(F.col("n_issues"), REASONS["issues"]), some(F.col("n_issues") > 0, capped(PER_ISSUE, F.col("n_issues"), CAP_ISSUES))),
        (F.lit(REASONS["handwritten"]), some(F.col("is_handwritten"), dec(HANDWRITTEN))),
        (said(F.col("n_ambiguous"), REASONS["ambiguous"]), some(F.col("n_ambiguous") > 0, capped(PER_AMBIGUOUS, F.col("n_ambiguous"), CAP_AMBIGUOUS))),
        (F.lit(REASONS["no_total"]), some(F.col("total").isNull(), dec(NO_TOTAL))),
        (F.lit(REASONS["no_date"]), some(F.col("date_text").isNull(), dec(NO_DATE))),
        (F.lit(REASONS["no_merchant"]), some(F.col("merchant_name").isNull(), dec(NO_MERCHANT))),
        (said(disputes, REASONS["disputed"]), some(disputes > 0, capped(PER_DISPUTE, disputes, CAP_DISPUTE))),
    ]
    if prior is not None:
        rows.append((F.lit(REASONS["prior"]), some(prior >= PRIOR_LEAST, dec(PRIOR_BONUS))))
    return F.filter(F.array(*[F.struct(reason.alias("reason"), penalty.alias("penalty")) for reason, penalty in rows]), lambda s: s["penalty"].isNotNull())


def confidence(parts: Column | str = "reasons") -> Column:
    total = F.aggregate(parts, dec("1.000").cast("decimal(10,3)"), lambda a, s: (a + s["penalty"]).cast("decimal(10,3)"))
    return F.round(F.least(dec("1"), F.greatest(dec("0"), total)), 3).cast("decimal(4,3)")


def route(score: Column, has_errors: Column, total: Column, auto: str = AUTO_APPROVE, review: str = QUICK_REVIEW) -> Column:
    """struct(status, priority, reason); a smaller priority is worked sooner, -1 is no review."""
    made = lambda status, priority, reason: F.struct(F.lit(status).alias("status"), F.lit(priority).alias("priority"), reason.alias("reason"))
    return (
        F.when(has_errors & total.isNull(), made("needs_review", 0, F.lit(ROUTES["urgent"])))
        .when(score >= dec(auto), made("auto_approved", -1, F.concat(F.lit(ROUTES["approved"]), score.cast("string"))))
        .when(score >= dec(review), made("needs_review", 2, F.lit(ROUTES["quick"])))
        .otherwise(made("needs_review", 1, F.lit(ROUTES["full"])))
    )


def scored(found: DataFrame) -> DataFrame:
    """with_findings' rows with reasons, confidence, status, priority and reason."""
    s = found.withColumn("reasons", signals()).withColumn("confidence", confidence())
    return s.withColumn("_r", route(F.col("confidence"), count_of("error") > 0, F.col("total"))).select("*", "_r.*").drop("_r")


def rate(part: Column, whole: Column, scale: int) -> Column:
    """part / whole as a decimal, rounded half up; null where there is nothing to divide by."""
    return F.round(F.try_divide(part.cast("decimal(20,0)"), F.nullif(whole, F.lit(0)).cast("decimal(20,0)")), scale).cast(f"decimal(12,{scale})")


def rate_even(part: Column, whole: Column, scale: int) -> Column:
    return F.bround(F.try_divide(part.cast("decimal(20,0)"), F.nullif(whole, F.lit(0)).cast("decimal(20,0)")), scale).cast(f"decimal(12,{scale})")


