"""Passages of a benchmark found in training texts through an FM-index per shard, and texts without them.

Words are numbered by the benchmark's vocabulary; all other words, and the ends of texts, are separators, as no window
can reach over them. A shard's sequence is indexed, every window is searched backwards, its places are located and the
spans of all windows merged. Texts never leave their task and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_or_empty
from .fm_index import FmIndex
from .words import Words, distinct, pieces

WINDOW = 10
#: Bytes of text in a slice, and numbers in the sequence of a shard at most; a long text makes several shards.
SLICE_BYTES, SHARD = 4 << 20, 1 << 20
#: Bytes of benchmark texts that are searched for at once, which bounds what is sent to executors: about 80 bytes a word.
BLOCK_BYTES = 8 << 20
#: Places that are located at once.
PLACES = 1 << 20

SPANS = "array<struct<first:bigint,end:bigint,first_byte:bigint,end_byte:bigint>>"
_SPAN = [pa.field(n, pa.int64()) for n in ("first", "end", "first_byte", "end_byte")]
#: Letters, digits and all bytes beyond ASCII are parts of words, A to Z as small letters; all else parts words.
_TABLE = np.full(256, 32, np.uint8)
_TABLE[48:58], _TABLE[65:91], _TABLE[97:123], _TABLE[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def _plain(texts: pa.Array) -> pa.Array:
    """Texts of the same length in bytes where words stand in small letters between spaces."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    w = Words(texts)
    return pa.Array.from_buffers(pa.large_string(), w.n, [None, pa.py_buffer(np.ascontiguousarray(w.off)), pa.py_buffer(_TABLE[w.bytes])])


@dataclass
class Block:
    """Windows of benchmark items: the vocabulary, each distinct window as word numbers from 1 (shorter ones have zeros in
    front), and the items that each belongs to: names[owners[bounds[k] : bounds[k + 1]]]."""

    vocabulary: list[bytes]
    windows: np.ndarray
    bounds: np.ndarray
    owners: np.ndarray
    names: list[str]


def windows_of(items: pa.Table, window: int) -> Block:
    """From (item, text): every stretch of `window` words of an item, or all of its words where there are fewer."""
    w = Words(_plain(items.column("text").combine_chunks()))
    word, values = distinct(w.bytes, w.start, w.end)
    at = w.windows(window)
    whole = np.lib.stride_tricks.sliding_window_view(word + 1, window)[at] if len(at) else np.zeros((0, window), np.int64)
    n = np.diff(w.first)
    short = np.flatnonzero((n > 0) & (n < window))
    few = np.zeros((len(short), window), np.int64)
    for row, k in enumerate(short):
        few[row, window - n[k] :] = word[w.first[k] : w.first[k + 1]] + 1
    rows = np.ascontiguousarray(np.concatenate((whole, few)).astype(np.int32))
    names, item = np.unique(np.array([x or "" for x in items.column("item").to_pylist()], object), return_inverse=True) if w.n else (np.zeros(0, object), np.zeros(0, np.int64))
    owner = item[np.concatenate((w.doc[at], short)).astype(np.int64)]
    _, first, number = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * window))).ravel(), return_index=True, return_inverse=True)
    pairs = np.unique(number.astype(np.int64) * max(1, len(names)) + owner)
    kinds = pairs // max(1, len(names))
    return Block(values.to_pylist(), rows[first], np.searchsorted(kinds, np.arange(len(first) + 1)), pairs % max(1, len(names)), list(names))


def _hits(sequence: np.ndarray, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, place) of all occurrences in a sequence of word numbers, shard by shard; neighbours overlap by a window."""
    width = block.windows.shape[1]
    for start in range(0, len(sequence), SHARD):
        shard = sequence[start : start + SHARD + width - 1]
        there = np.bincount(shard, minlength=len(block.vocabulary) + 1) > 0
        there[0] = True
        asked = np.flatnonzero(there[block.windows].all(axis=1))
        if not len(asked):
            continue
        index = FmIndex(shard, len(block.vocabulary) + 1)
        low, high = index.search(block.windows[asked])
        n = high - low
        some = np.flatnonzero(n)
        ends = np.cumsum(n[some])
        for at in range(0, int(ends[-1]) if len(ends) else 0, PLACES):
            k = np.arange(at, min(at + PLACES, int(ends[-1])))
            of = np.searchsorted(ends, k, "right")
            rows = high[some[of]] - (ends[of] - k)
            yield asked[some[of]], index.locate(rows) + start


def _spans(w: Words, covered: np.ndarray) -> pa.Array:
    """Merged spans of covered words by text: numbers of words and of bytes inside the text."""
    inside = covered.copy()
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1] & (w.doc[1:] == w.doc[:-1])))) if len(inside) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:] & (w.doc[1:] == w.doc[:-1]), [False]))) if len(inside) else starts
    doc = w.doc[starts]
    columns = [starts - w.first[doc], ends + 1 - w.first[doc], w.start[starts] - w.off[doc], w.end[ends] - w.off[doc]]
    offsets = np.searchsorted(doc, np.arange(w.n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=_SPAN))


def _searched(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the hits of one block to rows (id, text, n_words, spans, items)."""
    block: Block = shared.value
    vocabulary = pa.array(block.vocabulary, pa.large_binary())
    length = (block.windows > 0).sum(axis=1)
    for whole in batches:
        for batch, texts in pieces(whole, whole.column(1), SLICE_BYTES):
            w = Words(_plain(texts))
            word, values = distinct(w.bytes, w.start, w.end)
            known = pc.fill_null(pc.index_in(values, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            number = known[word] if len(word) else word
            # A separator stands before the first word of each text and for each run of unknown words.
            edge = np.zeros(len(number), bool)
            edge[w.first[:-1][np.diff(w.first) > 0]] = True
            stays = (number > 0) | edge | np.concatenate(([True], number[:-1] > 0))[: len(number)]
            at = np.repeat(np.flatnonzero(stays), 1 + ((number > 0) & edge)[stays])  # a known first word follows its separator
            sequence = number[at]
            sequence[np.flatnonzero(edge[at] & (np.concatenate(([True], at[1:] != at[:-1])) if len(at) else at.astype(bool)))] = 0
            gain = np.zeros(len(number) + 1, np.int64)
            pairs = [np.zeros(0, np.int64)]
            for window, place in _hits(sequence, block):
                first = at[place]
                np.add.at(gain, first, 1)
                np.add.at(gain, first + length[window], -1)
                pairs.append(np.unique(w.doc[first] * len(block.windows) + window))
            covered = np.cumsum(gain[:-1]) > 0
            names: list[set[str]] = [set(x or ()) for x in batch.column(4).to_pylist()]
            for pair in np.unique(np.concatenate(pairs)).tolist():
                doc, k = divmod(pair, len(block.windows))
                names[doc].update(block.names[o] for o in block.owners[block.bounds[k] : block.bounds[k + 1]])
            for k, spans in enumerate(batch.column(3).to_pylist()):
                for s in spans or ():
                    covered[w.first[k] + s["first"] : w.first[k] + s["end"]] = True
            items = pa.array([sorted(x) for x in names], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(w.first), pa.int64()), _spans(w, covered), items], ["id", "text", "n_words", "spans", "items"])


def contaminated_spans(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row per row of df: id, text, n_words, spans of words that lie in a window of an item (merged; words and bytes, the
    end not included) and items, the ids of those items as sorted strings.

    Words are runs of letters, digits and characters beyond ASCII, A to Z as small letters. A window is `window` words in
    a row of an item; an item of fewer words is one window, one without words none. Null texts have no words; an item's null
    id is an empty string, and items that share an id are one. Repeated rows each have their result; extra columns are left
    out. Without items no word is hit; without rows there is no result. Very long texts are one slice, indexed in shards.

    Items are searched in blocks of about block_bytes of text, so what is sent to executors is bounded; each block is a
    pass over the texts, and hits of earlier blocks are carried along.
    """
    spark = df.sparkSession
    asked = items.select(F.col(f"`{item_col}`").cast("string").alias("item"), text_or_empty(item_text_col).alias("text")).where("text != ''").distinct()
    size = items.agg(F.sum(F.octet_length(text_or_empty(item_text_col))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"), F.lit(None).cast("bigint").alias("n_words"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, text string, n_words bigint, spans {SPANS}, items array<string>"
    own = Scratch(spark)
    for k in range(blocks):
        mine = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(windows_of(mine.toArrow(), window))
        rows = rows.mapInArrow(_bound(shared), kind)
        if k < blocks - 1:
            before = own.tables[-1:]
            rows = own.written(rows, "benchmark-hits")
            own.drop(*[t for t, _ in before])
    return rows.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", "spans", "items")


def _bound(shared):
    return lambda batches: _searched(shared, batches)


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the bytes of its spans; null where the text is null."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(texts, at, strict=True):
            if t is not None and spans_ is not None and len(spans_):
                raw, parts, done = t.encode(), [], 0
                for s in spans_:
                    parts.append(raw[done : s["first_byte"]])
                    done = s["end_byte"]
                t = b"".join([*parts, raw[done:]]).decode()
            out.append(t)
        return pd.Series(out, dtype=object)

    return cut(text, spans)
