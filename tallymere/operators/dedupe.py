"""Near and semantic duplicates of receipts, and the graph of links between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import held

BITS = 64


def hash_from_bits(bits: Column) -> Column:
    """A signed 64-bit number from 64 characters 0 and 1, by two halves: the upper bit doesn't overflow."""
    half = lambda at: F.conv(F.substring(bits, at, 32), 2, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(33))


def hash_from_hex(text: Column) -> Column:
    half = lambda at: F.conv(F.substring(text, at, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(hashes: DataFrame, most: int = 5) -> DataFrame:
    """(a, b, distance), a < b: pairs of ids whose 64-bit hashes differ in `most` bits at most.

    Equal hashes are pairs too: where many images may share one, give each hash once (class_pairs). With most + 1 bands, two such hashes have an equal band, so equal bands are joined, not all pairs; a pair that
    meets in several bands is taken in the first of them, without a distinct. Bands that very many images share are
    split by adaptive execution.
    """
    n = most + 1
    edges = [BITS * k // n for k in range(n + 1)]
    band = lambda h, k: F.shiftrightunsigned(h, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    banded = hashes.select("id", "hash", F.posexplode(F.array(*[band(F.col("hash"), k) for k in range(n)])).alias("band", "key"))
    a, b = banded.alias("a"), banded.alias("b")
    joined = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")))
    first = F.array_position(F.array(*[band(F.col("a.hash"), k) == band(F.col("b.hash"), k) for k in range(n)]), True) - 1
    d = distance(F.col("a.hash"), F.col("b.hash"))
    return joined.where((first == F.col("a.band")) & (d <= most)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), d.alias("distance"))


def hash_classes(hashes: DataFrame) -> DataFrame:
    """(id, hash, n): of each hash the smallest id that has it, and how many have it. Counts are combined before the shuffle, so very
    many copies of one image are one row."""
    return hashes.groupBy("hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "hash", "n")


def class_members(hashes: DataFrame) -> DataFrame:
    """(id, class_id): every image with the smallest id of its hash. Dealt anew by the hash, so that many copies of one are split."""
    classes = hash_classes(hashes).select(F.col("hash").alias("_hash"), F.col("id").alias("class_id"))
    return hashes.join(classes.hint("merge"), F.bitwise_not("hash") == F.bitwise_not("_hash")).select("id", "class_id")


def class_pairs(hashes: DataFrame, most: int = 5) -> DataFrame:
    """(a, b, distance, n_a, n_b), a < b: pairs of different hashes that are near, by the smallest ids that have them, and how many
    images have each. With class_members these are all near pairs, and copies aren't multiplied out."""
    classes = hash_classes(hashes)
    size = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
    return near_pairs(classes, most).join(size("a"), "a").join(size("b"), "b").select("a", "b", "distance", "n_a", "n_b")


def distance_counts(hashes: DataFrame, most: int = 5) -> DataFrame:
    """(distance, n): how many pairs of images are at each distance up to `most`, counted by classes."""
    between = class_pairs(hashes, most).select("distance", (F.col("n_a") * F.col("n_b")).alias("n"))
    inside = hash_classes(hashes).where("n > 1").select(F.lit(0).alias("distance"), F.expr("n * (n - 1) div 2").alias("n"))
    return between.union(inside).groupBy("distance").agg(F.sum("n").alias("n"))


def first_match(hashes: DataFrame, most: int = 5) -> DataFrame:
    """(id, duplicate_of): for each image of (id, hash, created) the earliest near one, where that is earlier than itself.

    The earliest of a class stands for it, so a class meets its near classes once, however many copies they have.
    """
    me = F.struct("created", "id")
    classes = hashes.groupBy("hash").agg(F.min("id").alias("id"), F.min(me).alias("first"))
    pairs = near_pairs(classes.select("id", "hash"), most)
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).union(pairs.select("b", "a"))
    firsts = classes.select(F.col("id").alias("y"), F.col("first"))
    near = both.join(firsts, "y").groupBy("x").agg(F.min("first").alias("near"))
    best = classes.join(near, classes["id"] == near["x"], "left").select(F.col("hash").alias("_hash"), F.least("first", F.coalesce("near", "first")).alias("best"))
    found = hashes.join(best.hint("merge"), F.bitwise_not("hash") == F.bitwise_not("_hash"))
    return found.where(F.col("best") < me).select("id", F.col("best.id").alias("duplicate_of"))


def semantic_duplicates(receipts: DataFrame, null_merchants_match: bool = False) -> DataFrame:
    """(doc_id, duplicate_of): the earliest receipt of the same merchant, date and total. Without a date or total there is no match.

    The earliest row of each group of the three keys, joined back, is everyone's match; no self-join.
    """
    rows = receipts.where("txn_date is not null and total is not null")
    if not null_merchants_match:
        rows = rows.where("merchant_id is not null")
    firsts = rows.groupBy("merchant_id", "txn_date", "total").agg(F.min(F.struct("created_rank", "doc_id")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    r, f = rows.alias("r"), firsts.alias("f")
    same = F.col("r.merchant_id").eqNullSafe(F.col("f.merchant_id")) & (F.col("r.txn_date") == F.col("f.txn_date")) & (F.col("r.total") == F.col("f.total"))
    return r.join(f, same).where(F.col("r.doc_id") != F.col("f.first.doc_id")).select(F.col("r.doc_id").alias("doc_id"), F.col("f.first.doc_id").alias("duplicate_of"))


def link_roots(links: DataFrame) -> DataFrame:
    """(id, root, hops, cyclic) for links (id, target): follows each chain to its end by pointer doubling.

    A chain without a loop has no more hops than there are links, so after as many doublings as that number has bits,
    every such chain has ended; what hasn't leads into a loop and is marked, with neither root nor hops. Both sides are
    dealt anew for each join, so that the many chains that lead to one id can be split.
    """
    state = links.select("id", F.col("target").alias("at"), F.lit(1).cast("long").alias("hops"), F.lit(False).alias("ended"))
    for _ in range(links.count().bit_length() + 1):
        step = state.select(F.col("id").alias("s_id"), F.col("at").alias("s_at"), F.col("hops").alias("s_hops"), F.col("ended").alias("s_ended"))
        joined = state.join(step, F.bitwise_not("at") == F.bitwise_not("s_id"), "left")
        state = joined.select("id", F.when(F.col("ended") | F.col("s_id").isNull(), F.col("at")).otherwise(F.col("s_at")).alias("at"),
                              F.when(F.col("ended") | F.col("s_id").isNull(), F.col("hops")).otherwise(F.col("hops") + F.col("s_hops")).alias("hops"),
                              (F.col("ended") | F.col("s_id").isNull() | F.col("s_ended")).alias("ended"))
        state = held(state, "link-roots")
        if state.where(~F.col("ended")).isEmpty():
            break
    return state.select("id", F.when(F.col("ended"), F.col("at")).alias("root"), F.when(F.col("ended"), F.col("hops")).alias("hops"), (~F.col("ended")).alias("cyclic"))


def accepted_links(proposed: DataFrame, existing: DataFrame, known: DataFrame) -> DataFrame:
    """proposed (id, target) with accepted: both ends are known, they differ, and the target doesn't lead back to id."""
    roots = link_roots(existing.union(proposed.select("id", "target")).dropDuplicates(["id"]))
    ok_ends = proposed.join(known.select("id"), "id", "left_semi").join(known.select(F.col("id").alias("target")), "target", "left_semi").select("id", "target", F.lit(True).alias("known"))
    return proposed.join(ok_ends, ["id", "target"], "left").join(roots.select("id", "cyclic"), "id", "left").select(
        "id", "target", (F.coalesce("known", F.lit(False)) & (F.col("id") != F.col("target")) & ~F.coalesce("cyclic", F.lit(False))).alias("accepted"))
