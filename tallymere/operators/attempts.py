"""Readings of one document by several calls: the loop of asking again, and the vote of independent runs by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.record_schema import RECORD
from .paths import bound, read_leaves, unflattened, with_defaults


def repaired(responses: DataFrame, most_repairs: int = 1) -> DataFrame:
    """One row per document from (doc_id, seq, parsed, n_error, n_warn, n_null, rules): what asking again came to.

    Responses are taken in the order of seq: the first is an extraction; while the last one has errors and fewer than
    most_repairs were asked for, the next is a repair, or an extraction anew if the last one didn't parse. What comes after
    is never called. Kept is the attempt with the fewest errors, then warnings, then missing values, then the earliest; rules
    of the first attempt that are silent in the kept one are resolved. `rules` are the ids of an attempt's findings.

    Responses are gathered by document; a document has as many as were asked for, and only their counts travel.
    """
    row = F.struct("seq", F.coalesce("parsed", F.lit(False)).alias("parsed"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_error", "n_warn", "n_null")], F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))
    whole = responses.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("given"))
    attempt = "struct<seq:bigint,pass_name:string,parsed:boolean,n_error:bigint,n_warn:bigint,n_null:bigint,rules:array<string>>"
    none = F.array().cast(f"array<{attempt}>")

    def step(made: Column, e: Column) -> Column:
        n = F.size(made)
        last = F.element_at(made, -1)
        called = (n == 0) | ((n <= most_repairs) & (F.when(n > 0, last["n_error"] > 0)))
        name = F.when(n == 0, "extract").when(F.when(n > 0, last["parsed"]), "repair").otherwise("re_extract")
        new = F.struct(e["seq"].cast("bigint").alias("seq"), name.alias("pass_name"), e["parsed"].alias("parsed"), e["n_error"].alias("n_error"), e["n_warn"].alias("n_warn"), e["n_null"].alias("n_null"), e["rules"].alias("rules"))
        return F.when(F.coalesce(called, F.lit(False)), F.concat(made, F.array(new).cast(f"array<{attempt}>"))).otherwise(made)

    made = whole.select("doc_id", F.size("given").alias("_given"), F.aggregate("given", none, step).alias("attempts"))
    ranked = F.transform("attempts", lambda a, i: F.struct(a["n_error"].alias("n_error"), a["n_warn"].alias("n_warn"), a["n_null"].alias("n_null"), i.alias("at")))
    best = made.withColumn("kept", F.array_min(ranked)["at"]).withColumn("_kept", F.get("attempts", F.col("kept")))
    first = F.array_sort(F.array_distinct(F.get("attempts", F.lit(0))["rules"]))
    return best.select(
        "doc_id", F.transform("attempts", lambda a: a["pass_name"]).alias("passes"), (F.col("kept") + 1).alias("kept_attempt"), F.col("_kept.seq").alias("kept_seq"), F.col("_kept.n_error").alias("n_error"),
        F.col("_kept.n_warn").alias("n_warn"), F.array_except(first, F.col("_kept.rules")).alias("resolved"), (F.col("_given") - F.size("attempts")).alias("n_not_called"),
    )


def path_votes(runs: DataFrame, record_col: str = "record") -> DataFrame:
    """(doc_id, path, kind, n_runs, value, agreement, disputed, readings) from (doc_id, run, record) of runs that parsed.

    At every path that any run has, each run has a vote; one that lacks the path votes for null. The value that more than
    half of the runs read stands, else null. Agreement is the share of the most frequent reading, of equal ones that of the
    first run. Disputed are paths on which not all agree; readings are the different values there, in the order of the
    runs. With a single run its values stand and nothing is agreed or disputed.

    Runs of a document meet once, dealt by its id; its paths are voted on in the row.
    """
    lists = runs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("run", F.col(record_col).alias("record")))).alias("runs"))
    n = F.size("runs").alias("n_runs")
    rows = lists.select("doc_id", n, F.inline(votes(F.transform("runs", lambda r: r["record"]), runs.schema[record_col].dataType)))
    alone, disputed = F.col("n_runs") == 1, F.col("n_top") < F.col("n_runs")
    return rows.select("doc_id", "path", "kind", "n_runs", "value", F.when(~alone, F.col("n_top") / F.col("n_runs")).alias("agreement"), disputed.alias("disputed"), "readings")


def votes(records: Column, kind: T.StructType = RECORD) -> Column:
    """array<struct<path, kind, value, n_top, readings>>: the vote at every path of one document's records, in the order of its
    runs; n_top is how many gave the most frequent reading, readings is null where all agree. As path_votes has it."""
    n = lambda v: F.size(v)

    def tally(v: Column) -> Column:
        wrapped = bound(F.transform(v, lambda x: F.struct(x.alias("v"))), lambda w: F.array_max(F.transform(F.array_distinct(w), lambda d: F.struct(F.size(F.filter(w, lambda x: x == d)).alias("n"), (-F.array_position(w, d)).alias("first"), d["v"].alias("v")))))
        return F.struct(wrapped.alias("top"), F.array_distinct(v).alias("readings"))

    def one(x: Column) -> Column:
        v = x["votes"]
        split = bound(tally(v), lambda t: F.struct(
            x["path"].alias("path"), x["kind"].alias("kind"), F.when(t["top"]["n"] * 2 > n(v), t["top"]["v"]).alias("value"), t["top"]["n"].alias("n_top"), t["readings"].alias("readings")))
        same = F.struct(x["path"].alias("path"), x["kind"].alias("kind"), F.get(v, F.lit(0)).alias("value"), n(v).alias("n_top"), F.lit(None).cast("array<string>").alias("readings"))
        agreed = F.forall(v, lambda y: y.eqNullSafe(F.get(v, F.lit(0))))
        return F.when(agreed, same).otherwise(split)

    return F.transform(read_leaves(records, kind), one)


def disputed_lists(votes: DataFrame) -> DataFrame:
    """(doc_id, disputed): the disputed paths of each document, sorted, as rule R070 reads them."""
    return votes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("disputed"), F.col("path")))).alias("disputed"))


def consensus(votes: DataFrame) -> DataFrame:
    """(doc_id, record): the voted values as a record of the schema; what no majority read has its default or is null."""
    return unflattened(votes).select("doc_id", with_defaults(F.col("record")).alias("record"))
