"""Line dedup by content-defined chunks: repeated multi-line chunks go, wherever in a document they stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty, written

#: A chunk ends after a line when the hash of it and the line before it is a multiple of this: so many lines a chunk on average.
CHUNK_LINES = 3
#: A chunk counts only with this many lines that have a word.
LEAST_LINES = 2
#: A repeated passage has more words than this.
PASSAGE_WORDS = 50


def _chunked(df: DataFrame, id_col: str, text_col: str, every: int) -> DataFrame:
    """(_id, _key, n_lines, chunks): every row's text cut into chunks of whole lines; _key tells rows that repeat an id apart by their text.

    The rolling hash at a line covers the hashes of that line and the one before, so boundaries inside a passage are
    the same wherever it stands, from its second line on.
    """
    rolling = lambda a, b: F.conv(F.substring(F.md5(F.concat(a, b)), 1, 8), 16, 10).cast("long") % every == 0
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("_ends", k - 1) + 1)
    return (
        df.select(F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_key"), F.split(text_or_empty(text_col), "\n", -1).alias("_lines"))
        .withColumn("n_lines", F.size("_lines"))
        .withColumn("_hashes", F.transform("_lines", lambda x: F.md5(x)))
        .withColumn("_cut", F.zip_with(F.concat(F.array(F.lit(None).cast("string")), F.slice("_hashes", 1, F.greatest(F.col("n_lines") - 1, F.lit(0)))), "_hashes", rolling))
        .withColumn("_ends", F.filter(F.transform("_cut", lambda c, k: F.when(c | (k == F.size("_cut") - 1), k)), lambda k: k.isNotNull()))
        .select("_id", "_key", "n_lines", F.transform("_ends", lambda e, k: F.array_join(F.slice("_lines", start(k) + 1, e - start(k) + 1), "\n")).alias("chunks"))
    )


def _counts(chunk: Column) -> Column:
    """Whether a chunk has LEAST_LINES lines with a word."""
    return F.size(F.filter(F.split(chunk, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))) >= LEAST_LINES


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = CHUNK_LINES) -> DataFrame:
    """One row per document: id, n_lines, n_chunks, removed_chunks, removed_lines, text (what stays, chunks joined by line breaks).

    A chunk of at least two lines with a word that stands more than once, in the whole table or in one text, stays at
    its first place (the smallest id, there the first position) and goes everywhere else. Chunks meet by a 128-bit hash
    and their bytes: the group is (hash, chunk), combined before the shuffle, so a chunk in a third of all documents
    costs one row a map task. Two different chunks of one hash are never taken for each other; they stay. Single lines
    are never removed. A null text is empty: one empty line, nothing to remove. Rows that repeat an id are told apart by their
    text; those with the first id and the same text all keep the chunk. Other columns are ignored.
    """
    chunked = _chunked(df, id_col, text_col, every)
    # The outer form: for the plain one Spark would add a filter on the size of `chunks` and build them again for it.
    one = chunked.select("_id", "_key", F.posexplode_outer("chunks").alias("at", "chunk")).where(_counts(F.col("chunk")))
    one = one.withColumn("hash", F.unhex(F.substring(F.sha2("chunk", 256), 1, 32)))
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "at", "_key")
    groups = one.groupBy("hash", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    repeated = groups.groupBy(F.col("hash").alias("r_hash")).agg(F.max("n").alias("n"), F.min("first").alias("first"), F.count(F.lit(1)).alias("texts")).where("n > 1 and texts = 1")
    # The hash as hex on both sides: dealt anew for this join, so that the places of a very common chunk are split.
    gone = one.drop("chunk").join(repeated, F.hex("hash") == F.hex("r_hash")).where(~place.eqNullSafe(F.col("first")))
    gone = written(gone.groupBy(F.col("_id").alias("g_id"), F.col("_key").alias("g_key")).agg(F.collect_set("at").alias("gone")), "removed-chunks")
    # The removed places grow with the input, so the texts are always dealt by id for this join and never meet a broadcast.
    joined = chunked.join(gone.hint("merge"), F.col("_id").eqNullSafe(F.col("g_id")) & (F.col("_key") == F.col("g_key")), "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    stays = F.filter("chunks", lambda c, k: ~F.array_contains(F.col("gone"), k))
    out = joined.select("_id", "n_lines", F.size("chunks").alias("n_chunks"), F.size("gone").alias("removed_chunks"), stays.alias("stays"))
    left_lines = F.aggregate("stays", F.lit(0), lambda a, c: a + F.size(F.split(c, "\n", -1)))
    return out.select(F.col("_id").alias(id_col), F.col("n_lines").cast("long"), F.col("n_chunks").cast("long"), F.col("removed_chunks").cast("long"), (F.col("n_lines") - left_lines).cast("long").alias("removed_lines"), F.array_join("stays", "\n").alias(text_col))


def _passages(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(_id, _key, _lines, _at, _runs): a text's lines, the places of those with a word, and its runs of these as first * (words + 2) + lines.

    A run is the shortest of more than `words` words from some line on or up to some line. Which lines a run has depends
    on them alone, so it is the same wherever it stands; and the runs inside a passage cover it from end to end.
    """
    step, most = words + 2, words + 1  # a run has at most `most` lines, as each has a word
    # Words and lines read so far in one number, as words * step + lines; it grows no more once there are enough words.
    read = lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda a, x: F.when(a >= most * step, a).otherwise(a + x * step + 1))
    run = lambda first, a: F.when(a >= most * step, first.cast("long") * step + a % step)
    first = lambda k: F.greatest(k - words, F.lit(0))

    def down(x: Column, k: Column) -> Column:
        return run(k, read(F.slice("_words", k + 1, most)))

    def up(x: Column, k: Column) -> Column:
        a = read(F.reverse(F.slice("_words", first(k) + 1, k - first(k) + 1)))
        return run(k + 1 - a % step, a)

    return (
        df.select(F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_key"), F.split(text_or_empty(text_col), "\n", -1).alias("_lines"))
        .withColumn("_all", F.transform("_lines", lambda x: F.regexp_count(x, F.lit(WORD)).cast("long")))
        .withColumn("_at", F.filter(F.transform("_all", lambda n, k: F.when(n > 0, k)), lambda k: k.isNotNull()))
        .withColumn("_words", F.filter("_all", lambda n: n > 0))
        .withColumn("_runs", F.filter(F.array_distinct(F.concat(F.transform("_words", down), F.transform("_words", up))), lambda r: r.isNotNull()))
        .select("_id", "_key", "_lines", "_all", "_at", "_runs")
    )


def dedup_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per document: id, n_lines, removed_lines, removed_words, text (the lines that stay).

    Every run of whole lines of more than `words` words, a single line too, that stands at an earlier place (the smallest
    id, there the first line) goes, however many lines it has. Lines without a word are skipped in comparing and stay.
    Runs meet by their whole SHA-256, combined before the shuffle; a run that overlaps its own first place stays. Null
    texts, repeated ids and other columns are taken as in dedup_lines.
    """
    step = words + 2
    texts = _passages(df, id_col, text_col, words)
    body = lambda r: F.array_join(F.transform(F.slice("_at", (F.floor(r / step) + 1).cast("int"), (r % step).cast("int")), lambda k: F.get("_lines", k)), "\n")
    one = texts.select("_id", "_key", F.inline(F.transform("_runs", lambda r: F.struct(r.alias("run"), F.unhex(F.sha2(body(r), 256)).alias("hash")))))
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", F.floor(F.col("run") / step).alias("at"), "_key")
    repeated = one.groupBy(F.col("hash").alias("r_hash")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    here = F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("_key") == F.col("first._key"))
    kept = here & (F.floor(F.col("run") / step) < F.col("first.at") + F.col("run") % step)
    # Dealt anew by hex as in dedup_lines.
    gone = one.join(repeated, F.hex("hash") == F.hex("r_hash")).where(~kept)
    gone = written(gone.groupBy(F.col("_id").alias("g_id"), F.col("_key").alias("g_key")).agg(F.collect_set("run").alias("gone")), "removed-passages")
    joined = texts.drop("_runs").join(gone.hint("merge"), F.col("_id").eqNullSafe(F.col("g_id")) & (F.col("_key") == F.col("g_key")), "left")
    lines_of = lambda r: F.slice("_at", (F.floor(r / step) + 1).cast("int"), (r % step).cast("int"))
    removed = F.array_distinct(F.flatten(F.transform(F.coalesce("gone", F.array().cast("array<bigint>")), lines_of)))
    out = joined.withColumn("_removed", removed)
    stays = F.transform(F.array_except(F.transform("_lines", lambda x, k: k), F.col("_removed")), lambda k: F.get("_lines", k))
    n_words = F.aggregate("_removed", F.lit(0).cast("long"), lambda a, k: a + F.get("_all", k))
    return out.select(F.col("_id").alias(id_col), F.size("_lines").cast("long").alias("n_lines"), F.size("_removed").cast("long").alias("removed_lines"), n_words.alias("removed_words"), F.array_join(stays, "\n").alias(text_col))
