"""Runs over documents: which attempt is kept, what it costs, and what may be written over a stored row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcomes(attempts: DataFrame, *also: str) -> DataFrame:
    """One row per document from (doc_id, rung, model_id, call_failed, usable, cost_usd, latency_ms).

    The first rung that read something is kept, else the last one; if that one's call failed, the document failed.
    Every attempt is paid for. One grouping by document with map-side combining. `also` are further columns of the kept attempt.
    """
    row = F.struct("rung", "model_id", "call_failed", *also)
    good = ~F.col("call_failed") & F.col("usable")
    found = attempts.groupBy("doc_id").agg(
        F.min(F.when(good, row)).alias("first"), F.max(row).alias("last"), F.count(F.lit(1)).alias("n_attempts"),
        F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"), F.sum("latency_ms").alias("latency_ms"),
    )
    kept = F.coalesce("first", "last")
    return found.select("doc_id", kept["rung"].alias("rung"), kept["model_id"].alias("model_id"), kept["call_failed"].alias("failed"), F.col("first").isNull().alias("read_nothing"), "n_attempts", "cost_usd", "latency_ms", *[kept[c].alias(c) for c in also])


def failures_landed(receipts: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows after failed runs: a failed document needs review at confidence 0, a new row is made where there was none, and
    a reviewed row keeps what a person decided."""
    marked = receipts.select("doc_id", "status", "confidence").join(failed.select("doc_id", F.lit(True).alias("_failed")), "doc_id", "full")
    hit = F.col("_failed") & ~F.coalesce(F.col("status") == "reviewed", F.lit(False))
    return marked.select(
        "doc_id", F.when(hit, "needs_review").otherwise(F.col("status")).alias("status"),
        F.when(hit, F.lit(0)).otherwise(F.col("confidence")).cast("decimal(4,3)").alias("confidence"), F.coalesce("_failed", F.lit(False)).alias("queued"),
    )


def saved(receipts: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming (doc_id, total, confidence) over stored rows: reviewed rows stay as they are and say so."""
    new = incoming.select("doc_id", F.struct("total", "confidence").alias("_new"))
    both = receipts.select("doc_id", "status", "total", "confidence").join(new, "doc_id", "full")
    takes = F.col("_new").isNotNull() & ~F.coalesce(F.col("status") == "reviewed", F.lit(False))
    verdict = F.when(F.col("_new").isNull(), "kept").when(~takes, "refused").when(F.col("status").isNull(), "inserted").otherwise("updated")
    return both.select("doc_id", F.when(takes, F.col("_new.total")).otherwise(F.col("total")).alias("total"), F.when(takes, F.col("_new.confidence")).otherwise(F.col("confidence")).alias("confidence"), verdict.alias("verdict"))


def reprocess_gate(status: Column | str, force: bool = False) -> Column:
    """Whether a stored document may be run again: approved ones only by force, reviewed ones run but are never written over."""
    s = F.col(status) if isinstance(status, str) else status
    approved = F.lit("run") if force else F.lit("needs force")
    return F.when(s.isNull(), "unknown").when(s == "auto_approved", approved).when(s == "reviewed", "run, not written").otherwise("run")


def cache_key(model: Column, temperature: Column, prompt_hash: Column, image_hash: Column) -> Column:
    return F.concat_ws(":", model, temperature.cast("string"), prompt_hash, image_hash)


def same_currency(a: Column, b: Column) -> Column:
    """Null, empty and blank are the same; letter case doesn't matter."""
    plain = lambda c: F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return plain(a) == plain(b)


def retry_wait(attempt: Column, chance: Column | None = None, base: float = 1.0, most: float = 30.0) -> Column:
    """Seconds before the next try: doubled each time up to `most`, then spread by chance (0 to 1) over its upper half, so that
    callers that failed together don't come back together. Without a chance, the whole of it."""
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))
    return wait if chance is None else wait * (F.lit(0.5) + chance / 2)


def sort_key(path: Column) -> Column:
    """A key by which parents come before children and list places count as numbers."""
    parts = F.split(path, r"\.")
    numbered = F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit(r"^.*?\[\d+\]$")), F.concat(F.regexp_extract(p, r"^(.*?)\[(\d+)\]$", 1), F.lit("\t"), F.lpad(F.regexp_extract(p, r"^(.*?)\[(\d+)\]$", 2), 9, "0"))).otherwise(F.concat(p, F.lit("\t-00000001"))))
    return F.array_join(numbered, "\t")


def fitted_size(width: Column, height: Column, most: int = 2048) -> Column:
    """Size with the longest edge at most `most`, in proportion; never larger than it was. Halves round to even."""
    longest = F.greatest(width, height)
    scale = F.lit(float(most)) / longest
    edge = lambda e: F.when(longest <= most, e).otherwise(F.greatest(F.lit(1), F.bround(e * scale).cast("int"))).cast("int")
    return F.struct(edge(width).alias("width"), edge(height).alias("height"))


def ordered_corners(points: Column) -> Column:
    """Of four points (x, y): top left and bottom right by x + y, top right and bottom left by y - x; the first one wins ties."""
    def best(key, sign: int) -> Column:
        keyed = F.transform(points, lambda p, i: F.struct((key(p) * sign).alias("k"), i.alias("i"), p.alias("p")))
        return F.array_min(keyed)["p"]

    total, slope = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(best(total, 1), best(slope, 1), best(total, -1), best(slope, -1))
