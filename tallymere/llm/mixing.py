"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, whole_row, word_count, written

#: The weights of sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken this many times at most.
MAX_REPEATS = 3
_LEVEL_BITS, _LEVELS = 12, 5  # 60 bits of hash, 4,096 buckets a level


def _ticket(id_col: str):
    """A 60-bit number per document from its id alone, so reruns agree."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, size): weighted shares of all sizes, capped and reshared.

    Resharing the excess by weight until no target is above its cap ends in target = min(cap, level * weight), so
    the level is found directly: sources in the order of cap / weight, those before the break at their cap.
    Only the table of sources is ordered as a whole, never the documents. Null is a source, in the last place.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(everything)
    s = s.withColumn("fill", open_level["level"])
    return s.select("source", "source_size", F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("fill") * F.col("weight"))).alias("target"))


def _sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"), _ticket(id_col).alias("ticket")), "mix-sizes")


def _budgets(docs: DataFrame, weights, max_repeats: int, share: float) -> DataFrame:
    """(b_source, source_size, target, whole, under): copies that every document gets, and one more for tickets under `under`."""
    targets = source_targets(docs, weights, max_repeats, share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = written(targets.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    state = budgets.select("source", "left", F.lit(0).cast("long").alias("prefix"))
    for level in range(_LEVELS):
        shift = _LEVEL_BITS * (_LEVELS - 1 - level)
        t, d = state.alias("t"), docs.alias("d")
        inside = d.join(t, F.col("d.source").eqNullSafe(F.col("t.source")) & (F.shiftright(F.col("d.ticket"), shift + _LEVEL_BITS) == F.col("t.prefix")))
        histogram = inside.groupBy(F.col("d.source").alias("source"), F.shiftright(F.col("d.ticket"), shift).alias("bucket")).agg(F.sum("d.size").alias("size"), F.first("t.left").alias("left"))
        running = Window.partitionBy("source").orderBy("bucket")
        found = histogram.withColumn("through", F.sum("size").over(running))
        # The first bucket that goes over what is left; without one, everything in this prefix is in.
        edge = found.where(F.col("through") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("left") - (F.col("through") - F.col("size"))).alias("left"), "size")).alias("e"))
        state = written(edge.select("source", F.col("e.left").alias("left"), F.col("e.bucket").alias("prefix"), F.col("e.size").alias("size")), "mix-level")
    # A source without an edge takes all its documents once more. At the edge, the last bucket holds one id.
    edge = state.select(F.col("source").alias("edge_source"), (F.col("prefix") + F.when(F.col("left") * 2 >= F.col("size"), 1).otherwise(0)).alias("under"), F.lit(True).alias("has_edge"))
    under = F.when(F.col("left") > 0, F.when(F.col("has_edge"), F.col("under")).otherwise(F.lit(1 << 60))).otherwise(F.lit(0)).cast("long")
    joined = budgets.join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left")
    return written(joined.select(F.col("source").alias("b_source"), "source_size", "target", "whole", under.alias("under")), "mix-budgets")


def _copies(ticket, max_repeats: int):
    return F.least(F.lit(max_repeats), F.col("whole") + F.when(ticket < F.col("under"), 1).otherwise(0)).cast("long")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies, taken (= copies * size).

    Every document of a source is taken floor(target / source_size) times; the rest of the target is met by one
    more copy of the documents whose hash lies under the source's threshold. The threshold is found without sorting
    documents: sizes are summed by (source, bucket of the hash), a running sum over at most 4,096 buckets a source
    finds the bucket where the budget ends, and only that bucket is summed again at the next 12 bits, until 60 bits
    are used. The boundary document is in if that brings the sum nearer, so a source misses its target by half a
    document at most. A null text has size 0. Rows that repeat an id share its hash and are taken together.
    Reruns agree: the hash is of the id alone. Empty tables and sources of size 0 give targets of 0.
    """
    docs = _sizes(df, id_col, text_col, source_col)
    b = _budgets(docs, weights, max_repeats, share)
    copies = _copies(F.col("ticket"), max_repeats)
    return docs.join(b, F.col("source").eqNullSafe(F.col("b_source"))).select(
        F.col("id").alias(id_col), "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = 1.0) -> DataFrame:
    """The mix itself: each row of df as often as mix_sources takes it, with df's columns. The texts meet only the small table of sources."""
    b = _budgets(_sizes(df, id_col, text_col, source_col), weights, max_repeats, share)
    rows = df.select(whole_row(df), F.col(source_col).alias("_source"), _ticket(id_col).alias("_ticket"))
    joined = rows.join(b, F.col("_source").eqNullSafe(F.col("b_source"))).withColumn("_copies", _copies(F.col("_ticket"), max_repeats).cast("int")).where("_copies > 0")
    return joined.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")).select("_row.*")
