"""N-gram Jaccard self-join: exact links between word-shingle sets, and the groups they form.

Two sets link when percent * union <= 100 * intersection.

1. One pass over the texts gives each document's signature (set size, digest of the set, hashed bitmap) and adds up how
   often shingles occur, in a sketch of fixed size. Equal sets are one class from here on.
2. In one order of all shingles, rare ones by the sketch first, two linked sets share one of their leading shingles (as
   many as a set may miss, and one more). An equi-join on those gives candidates; a passage that many documents share
   stands last and makes few. Each document is paired with the smallest one of each shared shingle.
3. Pairs are tested by size, then by bitmaps, whose differing bits bound the overlap from above, then by intersecting
   sorted arrays.
4. Where documents that share a shingle with one smallest document are still apart, they are compared in size-banded
   tiles, again by bitmaps before sorted arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, shuffle_files_freed, whole_row, written
from .components import components
from .words import Words, mix, pieces

#: A bitmap has a power of two of bits, at least BITS_EACH for each shingle.
BITS_EACH, LEAST_BITS = 2, 64
#: Counters of the sketch (16 MB in all) and of the parts in which it is added up.
SKETCH_BITS, SKETCH_PART = 22, 16384
#: A tile compares two blocks of at most about this many documents and bytes of shingles.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
#: Leading shingles that a task holds before it combines equal ones, and documents of a shingle in a task that it combines.
FLUSH_ROWS, COMBINE_OVER = 1_500_000, 8


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted 64-bit hashes; a text of fewer words is one shingle, without words none."""
    w = Words(texts, lower=True)
    h = w.hashes()
    g, at = w.grams(h, n)
    bounds = np.searchsorted(at, w.first)
    out = []
    for i in range(w.n):
        x = np.sort(g[bounds[i] : bounds[i + 1]])
        words = h[w.first[i] : w.first[i + 1]]
        if not len(x) and len(words):
            whole = np.array([len(words)], np.uint64)
            for k in range(len(words)):
                whole = mix(whole ^ words[k : k + 1]) + np.uint64(k)
            x = whole
        out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x)
    return out


@lru_cache(maxsize=8)
def bands(percent: int) -> np.ndarray:
    """First sizes of the bands: the largest set that can link with the first size of a band ends the next one at the latest."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(-(-out[-1] * 100 // percent))
    return np.array(out)


def bitmap(x: np.ndarray) -> np.ndarray:
    bits = LEAST_BITS
    while bits < BITS_EACH * len(x):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    out[(x & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that has only so many 64-bit words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """Bits in which two bitmaps differ, the larger one folded: at most as many as shingles that only one set has."""
    n = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, n) ^ _folded(y, n)).sum())


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = int(np.isin(x, y, assume_unique=True, kind="sort").sum()) if len(x) and len(y) else 0
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _may_link(nx, ny, differing_bits, percent: int):
    """Whether the overlap that bit counts allow, (|x| + |y| - differing bits) / 2, is enough."""
    return (200 + 2 * percent) * (nx + ny - differing_bits) >= 4 * percent * (nx + ny)


def leading(x: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set by (count in the sketch, hash): one more than a linked set may lack."""
    order = np.argsort(counts[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
    return x[order[: len(x) - -(-percent * len(x) // 100) + 1]]


def _signatures(df: DataFrame, n: int, keep: Callable) -> DataFrame:
    """(id, n, digest, bits) for each row, and (part, counts) rows of the sketch, one of each part a task; either half is null."""
    names, no_id, no_bytes = ["id", "n", "digest", "bits", "part", "counts"], pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for piece, texts in pieces(batch, batch.column("_text")):
                sets = shingle_sets(texts, n)
                for x in sets:
                    np.add.at(counts, (x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                digests = pa.array([hashlib.blake2b(x, digest_size=16).digest() if len(x) else None for x in sets], pa.binary())
                bits = pa.array([bitmap(x).tobytes() if len(x) else None for x in sets], pa.binary())
                none = [pa.nulls(len(sets), kind) for kind in (pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array([len(x) for x in sets], pa.int64()), digests, bits, *none], names)
        for part, c in enumerate(counts.reshape(-1, SKETCH_PART)):
            if top := int(c.max()):
                packed = c.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([no_id, no_id, no_bytes, no_bytes, pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names)

    return keep(df.mapInArrow(run, "id bigint, n bigint, digest binary, bits binary, part int, counts binary"), "signatures")


def _sketch(signed: DataFrame) -> np.ndarray:
    """The counters of all tasks added up on executors, each part in one task as a stream; 2 ** SKETCH_BITS numbers come back."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                data = packed.as_buffer()
                c = np.frombuffer(data, f"<u{data.size // SKETCH_PART}")
                total[part] = total[part] + c if part in total else c.astype(np.uint64)
        rows = [np.minimum(c, 2**32 - 1).astype("<u4").tobytes() for c in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(rows, pa.binary())], ["part", "counts"])

    added = signed.where("part is not null").select("part", "counts").repartition("part").mapInArrow(add, "part int, counts binary")
    out = np.zeros((1 << SKETCH_BITS) // SKETCH_PART * SKETCH_PART, np.uint32).reshape(-1, SKETCH_PART)
    for part, counts in added.collect():
        out[part] = np.frombuffer(counts, "<u4")
    return out.reshape(-1)


def _candidates(df: DataFrame, counts: np.ndarray, n: int, percent: int, keep: Callable) -> DataFrame:
    """(id, pivot, alone, local): each document with the smallest one that shares a leading shingle with it, for every
    such shingle; alone: wherever the two meet, they are the only ones.

    A task combines a shingle of more than COMBINE_OVER of its documents before the shuffle: one row goes on, and the
    others name the smallest of the task at once (local). So a group of copies costs a few rows a task, however large.
    """
    held_counts = df.sparkSession.sparkContext.broadcast(counts)

    def emit(shingle: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, shingle))
        shingle, ids = shingle[order], ids[order]
        new = np.concatenate(([True], shingle[1:] != shingle[:-1]))
        at = np.flatnonzero(new)
        size = np.diff(np.concatenate((at, [len(ids)])))
        group = np.cumsum(new) - 1
        pivot, of = ids[at][group], size[group]
        few = ~new & (of <= COMBINE_OVER) & (ids != pivot)
        many = ~new & (of > COMBINE_OVER) & (ids != pivot)
        a, b = ids[many], pivot[many]
        pair, once = np.unique(mix(mix(a.view(np.uint64)) + b.view(np.uint64)), return_index=True)
        a, b = a[once], b[once]
        whole = len(at) + int(few.sum())  # rows that keep their shingle
        key = np.concatenate((shingle[at], shingle[few], pair)).view(np.int64)
        pivots = np.concatenate((np.zeros(whole, np.int64), b))
        weigh = np.concatenate((np.minimum(size, 3), np.zeros(len(pivots) - len(at), np.int64))).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate((ids[at], ids[few], a))), pa.array(pivots, mask=np.arange(len(key)) < whole), pa.array(weigh)], ["shingle", "id", "pivot", "weigh"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shingles, ids, held = held_counts.value, [], [], 0
        for batch in batches:
            for piece, texts in pieces(batch, batch.column("_text")):
                for i, x in zip(piece.column("_id").to_numpy(), shingle_sets(texts, n), strict=True):
                    if len(x):
                        first = leading(x, counts, percent)
                        shingles.append(first)
                        ids.append(np.full(len(first), i, np.int64))
                        held += len(first)
                if held > FLUSH_ROWS:
                    yield emit(np.concatenate(shingles), np.concatenate(ids))
                    shingles, ids, held = [], [], 0
        if held:
            yield emit(np.concatenate(shingles), np.concatenate(ids))

    rows = df.where("_id is not null").mapInArrow(run, "shingle bigint, id bigint, pivot bigint, weigh int")
    here = Window.partitionBy("shingle")
    local = F.col("pivot").isNotNull()
    pairs = rows.select("id", F.coalesce("pivot", F.min("id").over(here)).alias("pivot"), (~local & (F.sum("weigh").over(here) <= 2)).alias("alone"), local.alias("local")).where("id != pivot")
    return keep(pairs.groupBy("id", "pivot").agg(F.min("alone").alias("alone"), F.max("local").alias("local")), "candidates")


def _sets(df: DataFrame, ids: DataFrame, n: int, keep: Callable) -> DataFrame:
    """(id, items): sorted shingle hashes (packed) of the documents named in ids, once for each different set.

    The ids grow with the input, so they are joined by a shuffle at every size and never broadcast.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, set()  # rows of one id come together
        for batch in batches:
            for piece, texts in pieces(batch, batch.column("_text")):
                new = []
                for i, x in zip(piece.column("_id").to_pylist(), shingle_sets(texts, n), strict=True):
                    if i != last:
                        last, seen = i, set()
                    if len(x) and (digest := hashlib.blake2b(x, digest_size=16).digest()) not in seen:
                        seen.add(digest)
                        new.append((i, x.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in new], pa.int64()), pa.array([r[1] for r in new], pa.binary())], ["id", "items"])

    named = df.join(ids.select(F.col("id").alias("_id")).distinct().hint("merge"), "_id", "left_semi").select("_id", "_text")
    return keep(named.mapInArrow(pack, "id bigint, items binary"), "candidate-sets")


def _numbers(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return np.frombuffer(batch.column(column)[i].as_buffer(), np.uint64)


def _with_both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """pairs (a, b) with x_ columns of a and y_ columns of b."""
    for end, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(table.select(F.col("id").alias(end), *[F.col(c).alias(f"{name}_{c}") for c in columns]).hint("merge"), end)
    return pairs


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = batch.column("x_n").to_numpy(), batch.column("y_n").to_numpy()
            left = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
            for i in np.flatnonzero(left):
                left[i] = _may_link(nx[i], ny[i], differing(_numbers(batch, "x_bits", i), _numbers(batch, "y_bits", i)), percent)
            yield batch.select(["a", "b"]).filter(pa.array(left))

    return _with_both(pairs.select("a", "b"), classes, "n", "bits").mapInArrow(run, "a bigint, b bigint")


def _tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_linked(_numbers(batch, "x_items", i), _numbers(batch, "y_items", i), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return _with_both(pairs.select("a", "b"), sets, "items").mapInArrow(run, "a bigint, b bigint")


def _tiles(members: DataFrame, classes: DataFrame, percent: int, keep: Callable) -> DataFrame:
    """(id, cluster, label, tile): members (id, cluster, label) dealt to the tiles that hold more than one label.

    Clusters are cut by size band and then into blocks; each pair of blocks of one band, or of neighbouring bands, is a tile.
    """
    starts = F.array(*[F.lit(int(x)) for x in bands(percent)])
    rows = members.join(classes.select("id", "n"), "id").withColumn("band", (F.size(F.filter(starts, lambda s: s <= F.col("n"))) - 1))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    counts = rows.groupBy("cluster", "band").agg(blocks.alias("blocks"))

    def with_blocks(rows: DataFrame, step: int, name: str) -> DataFrame:
        near = counts.select(F.col("cluster").alias("c"), (F.col("band") - step).alias("s"), F.col("blocks").alias(name))
        return rows.join(near, (F.col("cluster") == F.col("c")) & (F.col("band") == F.col("s")), "left").drop("c", "s")

    rows = with_blocks(with_blocks(with_blocks(rows, 0, "own"), 1, "above"), -1, "below")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("own")).cast("int"))
    block, band = F.col("block"), F.col("band")

    def each(blocks: str, make: Callable) -> Column:
        there = F.coalesce(F.col(blocks), F.lit(0))
        return F.transform(F.when(there > 0, F.sequence(F.lit(0), there - 1)).otherwise(F.array().cast("array<int>")), make)

    tile = lambda *at: F.concat_ws("/", *[x.cast("string") for x in at])
    # A tile of two bands holds the pairs across them, a tile of one band also those inside its blocks.
    tiles = F.concat(
        each("own", lambda j: tile(band, band, F.least(block, j), F.greatest(block, j))),
        each("above", lambda j: tile(band, band + 1, block, j)), each("below", lambda j: tile(band - 1, band, j, block)))
    dealt = rows.select("id", "cluster", "label", F.explode(tiles).alias("tile"))
    # Tiles of documents that have one label, or are alone, have nothing to compare.
    useful = dealt.groupBy("cluster", "tile").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1").select(F.col("cluster").alias("c"), F.col("tile").alias("t"))
    return keep(dealt.join(useful, (F.col("cluster") == F.col("c")) & (F.col("tile") == F.col("t")), "left_semi"), "tiles")


def _partners(pdf: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a tile the later rows of another label that sizes and bit counts don't rule out."""
    bits = [np.frombuffer(x, np.uint64) for x in pdf["bits"]]
    width = min(map(len, bits))
    n, labels, bits = pdf["n"].to_numpy(), pdf["label"].to_numpy(), np.stack([_folded(x, width) for x in bits])
    for i in range(len(n)):
        rest = slice(i + 1, len(n))
        size_ok = 100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])
        may = np.flatnonzero(size_ok & (labels[rest] != labels[i]))
        if len(may):
            may = may[_may_link(n[rest][may], n[i], np.bitwise_count(bits[rest][may] ^ bits[i]).sum(1).astype(np.int64), percent)]
        yield i, may + i + 1


def _tiled(docs: DataFrame, members: DataFrame, classes: DataFrame, n: int, percent: int, own: Scratch) -> DataFrame:
    """(a, b): links between members of one cluster that have different labels; those that join labels anew, never all pairs."""

    def possible(pdf: pd.DataFrame) -> pd.DataFrame:
        left = np.zeros(len(pdf), bool)
        for i, others in _partners(pdf, percent):
            left[i] |= len(others) > 0
            left[others] = True
        return pdf.loc[left, ["id", "cluster", "label", "tile"]]

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, labels, root = pdf["id"].to_numpy(), pdf["label"].to_numpy(), dict(zip(pdf["label"], pdf["label"], strict=True))
        items = [np.frombuffer(x, np.uint64) for x in pdf["items"]]

        def top(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found = []
        for i, others in _partners(pdf, percent):
            for j in others:
                if (a := top(labels[i])) != (b := top(labels[j])) and _linked(items[i], items[j], percent):
                    root[max(a, b)] = min(a, b)
                    found.append((ids[i], ids[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    # By bitmaps alone first: the sorted sets, many times as large, come only to the documents of a tile that are left.
    signs = classes.select("id", "n", "bits")
    left = _tiles(members, classes, percent, own.written).join(signs, "id").groupBy("cluster", "tile").applyInPandas(possible, "id bigint, cluster bigint, label bigint, tile string")
    left = own.written(left, "tiles-left")
    sets = _sets(docs, left.select("id"), n, own.written)
    return left.join(signs, "id").join(sets, "id").groupBy("cluster", "tile").applyInPandas(compare, "a bigint, b bigint")


def _labelled(rows: DataFrame, column: str, found: DataFrame, name: str) -> DataFrame:
    """rows with the component of the node in `column`, or that node itself, as `name`. Dealt anew, so that a hub's rows can be split."""
    near = found.select(F.col("node").alias("l_node"), F.col("component").alias("l_component"))
    return rows.join(near.hint("merge"), F.bitwise_not(F.col(column)) == F.bitwise_not(F.col("l_node")), "left").withColumn(name, F.coalesce("l_component", column)).drop("l_node", "l_component")


def _around_pivots(pairs: DataFrame) -> DataFrame:
    """(cluster, id): for each pivot itself, the documents that name it, and those that name one of these as their task's."""
    named = pairs.select(F.col("b").alias("cluster"), F.col("a").alias("id"))
    behind = pairs.where("local").select(F.col("a").alias("further"), F.col("b").alias("local_pivot"))
    further = named.join(behind.hint("merge"), F.bitwise_not("id") == F.bitwise_not("local_pivot")).select("cluster", F.col("further").alias("id"))
    return named.union(further).union(named.select("cluster", F.col("cluster").alias("id"))).distinct()


def link_components(docs: DataFrame, n: int, percent: int, keep: Callable = written) -> tuple[DataFrame, DataFrame]:
    """(id, n) of all documents (_id, _text), and (node, component) of those that have a link; both as written by `keep`."""
    spark = docs.sparkSession
    with shuffle_files_freed(spark), arrow_rows(spark, 512), Scratch(spark) as own:  # a pair of sets may have many KB
        signed = _signatures(docs, n, own.written)
        sizes = keep(signed.where("part is null").select("id", "n"), "sizes")
        sets_of = signed.where("id is not null and n > 0").groupBy("digest").agg(F.min(F.struct("id", "n", "bits")).alias("c"), F.min("id").alias("low"), F.max("id").alias("high"))
        classes = own.written(sets_of.select("c.*", "digest", (F.col("low") != F.col("high")).alias("shared")), "set-classes")
        twins = classes.where("shared").select(F.col("id").alias("b"), F.hex("digest").alias("c_digest"))
        copies = signed.where("id is not null and n > 0").select(F.col("id").alias("a"), F.hex("digest").alias("a_digest"))
        copies = own.written(copies.join(twins.hint("merge"), F.col("a_digest") == F.col("c_digest")).where("a != b").select("a", "b").distinct(), "equal-sets")
        pairs = _candidates(docs, _sketch(signed), n, percent, own.written)
        own.drop(signed)
        # From copies to their classes; an id that has several texts has several classes, its own among them where it leads one.
        own_too = classes.select(F.col("id").alias("a"), F.col("id").alias("b")).join(copies.select("a").hint("merge"), "a", "left_semi")
        to = own.written(copies.union(own_too).distinct().select(F.col("a").alias("from"), F.col("b").alias("to")), "classes-of")
        for column in ("id", "pivot"):
            pairs = pairs.join(to.hint("merge"), F.bitwise_not(F.col(column)) == F.bitwise_not(F.col("from")), "left").withColumn(column, F.coalesce("to", column)).drop("from", "to")
        pairs = pairs.where("id != pivot").groupBy(F.col("id").alias("a"), F.col("pivot").alias("b")).agg(F.min("alone").alias("alone"), F.max("local").alias("local"))
        pairs = own.written(pairs, "class-pairs")
        possible = own.written(_possible(pairs, classes, percent), "possible-pairs")
        sets = _sets(docs, possible.select(F.explode(F.array("a", "b")).alias("id")), n, own.written)
        # First one partner a document; most other pairs then lie inside one group and need no test.
        links = own.written(_tested(possible.groupBy("a").agg(F.min("b").alias("b")), sets, percent), "links")
        found = components(links, own.written)
        others = _labelled(_labelled(possible, "a", found, "la"), "b", found, "lb").where("la != lb")
        links = own.written(links.union(_tested(others, sets, percent)), "links")
        own.drop(sets, possible)
        found = components(links, own.written)
        # A shingle's documents may link without linking to its smallest one, their pivot. All that have one pivot, those
        # behind a local pivot too, are compared where they are of several groups; two that meet nowhere with a third are tested.
        members = own.written(_labelled(_around_pivots(pairs.where("not alone")), "id", found, "label"), "members")
        split = members.groupBy("cluster").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 != l1").select("cluster")
        members = own.written(members.join(split.hint("merge"), "cluster", "left_semi"), "members")
        links = links.union(own.written(_tiled(docs, members, classes, n, percent, own), "more-links"))
        return sizes, components(links.union(copies), keep)


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))


def ngram_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that links lead to, its own included).

    Texts are lower-cased (A-Z); words are runs of anything but ASCII white space. A text of fewer than n words is one
    shingle; a null or empty text, or one without words, has none and links with nothing. Copies link like any other
    pair. Rows that repeat an id share its links. A null id links with nothing. Very long texts are read whole, one at
    a time. An empty table gives an empty result; extra columns are ignored.
    """
    sizes, found = link_components(_documents(df, id_col, text_col), n, percent)
    joined = sizes.join(found.hint("merge"), F.col("id") == F.col("node"), "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that stay, with df's columns: of each group of linked documents the one with the smallest id.

    Rows with a null id stay. The rows go through the last join as one struct, so extra columns may have any name.
    """
    _, found = link_components(_documents(df, id_col, text_col), n, percent)
    gone = found.where("node != component").select(F.col("node").alias("_gone"))
    rows = df.select(whole_row(df), F.col(f"`{id_col}`").cast("long").alias("_id"))
    return rows.join(gone.hint("merge"), F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
