"""Exact duplicates: grouped by a 128-bit content hash, bytes compared inside the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    sha = F.sha2(text_or_empty(text_col), 256)
    return df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"), sha.alias("_sha"), F.unhex(F.substring(sha, 1, 32)).alias("_hash"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The grouping key is (128-bit hash, text): rows meet by the hash and only rows with the same bytes become one
    group, so a collision of hashes never merges two texts. Copies are combined before the shuffle, so a text that
    a third of the rows share reaches the reducers once per map task. Membership comes from a join on the digest;
    its hot keys are split by adaptive execution. A null text counts as empty. keep is "min" or "max": the id that
    stays. Rows that repeat the id which stays are all marked kept. Null ids never win unless a group has no other.
    An empty table gives an empty result; extra columns are ignored.
    """
    best = {"min": F.min, "max": F.max}[keep]
    keyed = _keyed(df, id_col, text_col)
    texts = keyed.groupBy("_hash", "_text", "_sha").agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Two texts under one full digest would be a broken SHA-256: stop instead of joining members to the wrong text.
    classes = texts.groupBy(F.col("_sha").alias("_class")).agg(
        best("keep_id").alias("keep_id"),
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two texts have one SHA-256")).cast("long")).otherwise(F.max("group_size")).alias("group_size"),
    )
    # The digest as bytes, so that both sides are dealt anew for the join and its hot keys can be split.
    return keyed.select("_id", "_sha").join(classes, F.unhex("_sha") == F.unhex("_class")).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of df that stay, with df's columns: of equal texts the row with the smallest (or largest) id.

    One shuffle of the texts: the whole row travels with its text and the group keeps the best. Ties in the id
    are broken by the other columns. Null and empty texts are equal; the row keeps its own of the two.
    """
    best = {"min": F.min, "max": F.max}[keep]
    others = [c for c in df.columns if c not in (id_col, text_col)]
    row = F.struct(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("null_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    sha = F.sha2(text_or_empty(text_col), 256)
    kept = df.groupBy(F.unhex(F.substring(sha, 1, 32)).alias("_hash"), text_or_empty(text_col).alias("_text")).agg(best(row).alias("_row"))
    back = {id_col: F.col("_row.id"), text_col: F.when(~F.col("_row.null_text"), F.col("_text"))} | {c: F.col(f"_row.c{i}") for i, c in enumerate(others)}
    return kept.select(*[back[c].alias(c) for c in df.columns])
