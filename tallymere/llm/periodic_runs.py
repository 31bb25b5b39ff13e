"""Periodic runs of words inside texts, found lag by lag on bit planes, and texts with the repetitions collapsed.

The words of a text are numbered, and bit b of all numbers is one big integer, a plane. For a lag p, a plane XOR itself
shifted by p has a one where words p apart differ in that bit; the OR over planes has a zero exactly where they are the
same. A stretch of m zeros is a run of m + p words with period p, and AND of shifted copies, doubling the shift, leaves
ones only where a stretch is long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty
from .words import Words, distinct, pieces

#: A run has at least so many words and repeats its period so often.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: So many planes tell most lags apart; the others follow where a stretch is left.
FIRST_PLANES = 3
#: In texts of more words, a lag is looked at only where words at its multiples repeat. That changes the time, not the result.
STRIDED_OVER = 1 << 15

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _planes(ids: np.ndarray) -> list[int]:
    bits = max(1, int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits(((ids >> b) & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(bits)]


def _long_stretches(ones: int, least: int) -> int:
    """A one at each place where a stretch of `least` ones starts."""
    have = 1
    while ones and have < least:
        step = min(have, least - have)
        ones &= ones >> step
        have += step
    return ones


def _bounds(ones: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the stretches of ones."""
    bits = np.unpackbits(np.frombuffer(ones.to_bytes((n + 8) // 8, "little"), np.uint8), bitorder="little").astype(np.int8)
    edge = np.diff(bits, prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _smaller_period(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether a run with this period has a smaller one. That one divides it, as a run is at least as long as both
    together, so it is enough to compare one period of words at each of its largest divisors."""
    rest, r, primes = period, 2, []
    while r * r <= rest:
        if rest % r == 0:
            primes.append(r)
            while rest % r == 0:
                rest //= r
        r += 1
    if rest > 1:
        primes.append(rest)
    block = ids[start : start + period]
    return any(np.array_equal(block, ids[start + period // r : start + period // r + period]) for r in primes)


def _repeats_at_multiples(ids: np.ndarray, period: int, times: int) -> bool:
    """Whether words at multiples of period are equal `times` - 1 times in a row; so they are inside every run of that period."""
    at = ids[::period]
    equal = at[1:] == at[:-1]
    same = equal
    for k in range(1, times - 1):
        same = same[:-1] & equal[k:]
    return bool(same.any())


def find_runs(ids: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the numbers ids, by start, then period.

    A run is a stretch with smallest period q and length >= max(least_words, least_times * q), as long as it can be.
    least_times is 2 or more. Planes and lags take len(ids) ** 2 / 240 steps of 30 bits at most; long texts skip the lags
    that words at multiples rule out.
    """
    n = len(ids)
    if n < max(least_words, least_times):
        return []
    planes, full, found = _planes(ids), (1 << n) - 1, []
    for p in range(1, n // least_times + 1):
        if n > STRIDED_OVER and not _repeats_at_multiples(ids, p, least_times):
            continue
        least = max(max(least_words, least_times * p) - p, 1)
        differ = full ^ (full >> p)  # the last p words have no partner
        for plane in planes[:FIRST_PLANES]:
            differ |= plane ^ (plane >> p)
        if not _long_stretches(full ^ (differ & full), least):
            continue
        for plane in planes[FIRST_PLANES:]:
            differ |= plane ^ (plane >> p)
        left = _long_stretches(full ^ (differ & full), least)
        if left:
            first, last = _bounds(left, n)
            for i, j in zip(first.tolist(), last.tolist(), strict=True):
                if not _smaller_period(ids, i, p):
                    found.append((i, j - i + least + p, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _collapsed(w: Words, keep: np.ndarray) -> pa.Array:
    """Of each text the words to keep, joined by one space: the byte after a word, white space, stands for the space."""
    at = np.flatnonzero(keep)
    doc = w.doc[at]
    more = at[np.concatenate((doc[1:] == doc[:-1], [False]))] if len(at) else at  # another kept word follows
    edge = np.zeros(len(w.bytes) + 1, np.int8)
    np.add.at(edge, w.start[at], 1)
    np.add.at(edge, w.end[at], -1)
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    data = w.bytes.copy()
    mask[w.end[more]] = True
    data[w.end[more]] = 32
    offsets = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[w.off].astype(np.int32)
    return pa.Array.from_buffers(pa.string(), w.n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[mask]))])


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """One row per row of df: id, n_words, runs (start, length and period by word, in the order of start and period) and
    collapsed, the text without the words of a run after its first period, joined by one space.

    Words are runs of anything but ASCII white space. A null or empty text has no words, no runs and an empty collapsed
    text. Ids pass through, nulls and repeated ones too; runs that overlap are all given. Each text is looked at whole and
    alone, without a shuffle; a very long one takes a slice of its own. An empty table gives an empty result; extra columns
    are left out, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in pieces(whole, whole.column(1)):
                w = Words(texts)
                word, _ = distinct(w.bytes, w.start, w.end)
                ends, rows, keep = [0], [], np.ones(len(word), bool)
                for k in range(w.n):
                    lo, hi = int(w.first[k]), int(w.first[k + 1])
                    runs = find_runs(np.unique(word[lo:hi], return_inverse=True)[1], least_words, least_times) if hi - lo >= least_words else []
                    for start, length, period in runs:
                        keep[lo + start + period : lo + start + length] = False
                    rows += runs
                    ends.append(len(rows))
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(w.first), pa.int64()), found, _collapsed(w, keep)], ["id", "n_words", "runs", "collapsed"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, runs {RUNS}, collapsed string")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period; of equal ones the first. Null without runs. Fractions are compared as products."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))


def as_lines(runs: Column) -> Column:
    """start,length,period and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def with_planted_tails(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df, where a tenth of the texts (by the CRC of their decimal id) go on from some word as a repetition of what follows it.

    With h the CRC and g = h div 10: from word a = g mod n on, every word is that of a + (i - a) mod p,
    p = 1 + (n - a) div (3 + g mod 8). Texts without words and rows with a null id stay as they are.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string"))

    def planted(text: Column) -> Column:
        words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
        n, g = F.size(words).cast("long"), F.floor(h / 10)

        def with_words(s: Column) -> Column:
            a = s["g"] % s["n"]
            p = F.lit(1) + F.floor((s["n"] - a) / (F.lit(3) + s["g"] % 8))
            place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
            return F.when(s["n"] > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(s["n"] - 1, F.lit(0).cast("long"))), lambda i: F.get(s["words"], place(i))), " "))

        made = F.transform(F.array(F.struct(words.alias("words"), n.alias("n"), g.alias("g"))), with_words)  # words are cut once
        return F.coalesce(F.get(made, F.lit(0)), text)

    text = F.col(f"`{text_col}`").cast("string")
    return df.withColumn(text_col, F.when((h % 10 == 0) & text.isNotNull(), planted(text)).otherwise(text))
