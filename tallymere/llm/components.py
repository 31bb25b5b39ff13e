"""Connected components of a graph that is only a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def _stars(e: DataFrame) -> bool:
    """Whether every node hangs on one root and no root hangs on another node."""
    end = lambda node, hangs, root: F.struct(F.col(node).alias("node"), F.lit(hangs).alias("hangs"), F.lit(root).alias("root"))
    ends = e.select(F.explode(F.array(end("high", 1, 0), end("low", 0, 1))).alias("n"))
    return ends.groupBy("n.node").agg(F.sum("n.hangs").alias("hangs"), F.max("n.root").alias("root")).where("hangs > 1 or (hangs > 0 and root > 0)").isEmpty()


def _dealt_anew(left: str, right: str):
    """Equality by a key that neither side is dealt by yet: both are dealt for the join, so that the rows of a hub can be split."""
    return F.bitwise_not(F.col(left)) == F.bitwise_not(F.col(right))


def components(edges: DataFrame, keep=written) -> DataFrame:
    """(node, component) for the nodes of edges (a, b): the smallest node that links lead to.

    Alternating large and small stars: every round ties each node's neighbours to the smallest of them, with grouped
    minima and joins only, until all groups are stars; the number of rounds grows with the logarithm of the graph. Neither
    links nor components pass through the driver, and the neighbours of a node are never gathered. Each round's table goes
    when the next one is written; `keep` writes the result.
    """
    a, b = F.col("a"), F.col("b")
    with Scratch(edges.sparkSession) as own:
        e = own.written(edges.where(a != b).select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "edges")
        while not _stars(e):
            both = e.select(F.col("high").alias("u"), F.col("low").alias("v")).union(e.select(F.col("low").alias("u"), F.col("high").alias("v")))
            least = both.groupBy(F.col("u").alias("mu")).agg(F.min("v").alias("m")).select("mu", F.least("m", "mu").alias("m"))
            large = both.join(least, _dealt_anew("u", "mu")).where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low"))
            large = own.written(large.distinct(), "edges")
            lowest = large.groupBy(F.col("high").alias("mh")).agg(F.min("low").alias("m"))
            joined = large.join(lowest, _dealt_anew("high", "mh"))
            pair = lambda high, low: F.struct(F.col(high).alias("high"), F.col(low).alias("low"))
            small = joined.select(F.explode(F.array(pair("high", "m"), pair("low", "m"))).alias("s")).select("s.high", "s.low")
            then = own.written(small.where("high != low").distinct(), "edges")
            own.drop(e, large)
            e = then
        roots = e.select(F.col("low").alias("node")).distinct()
        return keep(e.select(F.col("high").alias("node"), F.col("low").alias("component")).union(roots.select("node", F.col("node").alias("component"))), "components")
