"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

Equal words are told by Arrow's dictionary, which compares their bytes. Hashes are XXH3 over the bytes of a word; they
depend on the word alone, not on batch or machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: ASCII white space: bytes 9 to 13 and 32.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The batch and its texts in slices of about `size` bytes of text; a longer text has a slice of its own. Bounds the arrays below."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each byte range's value, the distinct values) of ranges that are in order, apart and not empty.

    Ranges have one number exactly if their bytes are equal.
    """
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start] += 1
    edge[end] -= 1
    values = np.ascontiguousarray(data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)])
    offsets = np.concatenate(([0], np.cumsum(end - start, dtype=np.int64)))
    whole = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    found = whole.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges as in distinct()."""
    at, values = distinct(data, start, end)
    return np.array([xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()], np.uint64)[at] if len(at) else np.zeros(0, np.uint64)


class Words:
    """The words of a column of texts (null: none): .start and .end in .bytes, .first[i] to .first[i + 1] those of text i."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        self.n, self.off, self.bytes = len(texts), off - off[0], LOWER[raw] if lower else raw
        ink = ~SPACE[self.bytes]
        edge = np.zeros(len(raw) + 1, bool)
        edge[self.off] = True
        before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
        before[1:], after[:-1] = ink[:-1], ink[1:]
        self.ink = ink
        self.start = np.flatnonzero(ink & (~before | edge[:-1]))
        self.end = np.flatnonzero(ink & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))

    def per_text(self, flags: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Sums of flags by text; flags are by byte, or by the units whose bounds `at` has."""
        c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        at = self.off if at is None else at
        return c[at[1:]] - c[at[:-1]]

    def hashes(self) -> np.ndarray:
        """Of the words."""
        return range_hashes(self.bytes, self.start, self.end)

    def windows(self, n: int) -> np.ndarray:
        """The numbers of the words that start a window of n words inside their text."""
        last = self.first[1:][self.doc]  # the end of the word's text
        return np.flatnonzero(np.arange(len(self.start)) + n <= last)

    def grams(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows inside each text, and the number of the first word of each."""
        at = self.windows(n)
        out = np.full(len(at), n, np.uint64)
        for k in range(n):
            out = mix(out ^ h[at + k]) + np.uint64(k)
        return out, at

    def equal_windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers that are equal exactly for windows of one text with the same words, the number of the first word of each)."""
        word, values = distinct(self.bytes, self.start, self.end)
        at = self.windows(n)
        out = self.doc[at]
        for k in range(n):
            out = pd.factorize(out * np.int64(max(1, len(values))) + word[at + k])[0].astype(np.int64)
        return out, at
