"""Pixels of images of any size: grey values, a small grid by windowed-sinc resampling, and its difference hash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The grid of a difference hash, lobes of the window, bits of a weight, and the shares of red, green and blue in 65,536.
GRID_WIDTH, GRID_HEIGHT = 9, 8
LOBES, WEIGHT_BITS = 3, 22
GREY = (19595, 38470, 7471)


@lru_cache(256)
def weights(n_in: int, n_out: int) -> np.ndarray:
    """Whole-number weights (n_out, n_in) of a Lanczos window of three lobes; where an image shrinks, the window grows with it."""
    scale = n_in / n_out
    wide = max(scale, 1.0)
    centre = (np.arange(n_out) + 0.5) * scale
    low = np.maximum(0, (centre - LOBES * wide + 0.5).astype(np.int64))[:, None]
    high = np.minimum(n_in, (centre + LOBES * wide + 0.5).astype(np.int64))[:, None]
    at = np.arange(n_in)[None, :]
    x = (at - centre[:, None] + 0.5) / wide
    w = np.where((at >= low) & (at < high) & (np.abs(x) < LOBES), np.sinc(x) * np.sinc(x / LOBES), 0.0)
    w /= w.sum(axis=1, keepdims=True)
    return np.trunc(w * (1 << WEIGHT_BITS) + np.where(w < 0, -0.5, 0.5)).astype(np.int64)


def _applied(w: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    return np.clip((w @ pixels + (1 << (WEIGHT_BITS - 1))) >> WEIGHT_BITS, 0, 255)


def small_grid(grey: np.ndarray, width: int = GRID_WIDTH, height: int = GRID_HEIGHT) -> np.ndarray:
    """A grey image (rows of pixels) at another size, rounded to whole values after each direction, first along rows."""
    rows = _applied(weights(grey.shape[1], width), grey.astype(np.int64).T).T
    return _applied(weights(grey.shape[0], height), rows)


def grey_of(pixels: np.ndarray) -> np.ndarray:
    """Grey values of (height, width, channels) pixels of one (grey), three or four channels; alpha doesn't count."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    return (pixels[:, :, :3].astype(np.int64) @ np.array(GREY) + (1 << 15)) >> 16


def difference_hash(grey: np.ndarray) -> str:
    """Sixteen hex digits: whether each pixel of the small grid is brighter than the one to its left."""
    grid = small_grid(grey)
    return np.packbits((grid[:, 1:] > grid[:, :-1]).ravel()).tobytes().hex()


def with_hash(images: DataFrame, id_col: str = "image_id") -> DataFrame:
    """(id, dhash) from (id, width, height, pixels): pixels are bytes, row by row, of one, three or four channels.

    Null where the size and the number of bytes don't fit, or a part is missing. One image is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for width, height, raw in zip(*[batch.column(c).to_pylist() for c in ("width", "height", "pixels")], strict=True):
                channels, rest = divmod(len(raw), width * height) if raw and width and height and width > 0 and height > 0 else (0, 0)
                fits = not rest and channels in (1, 3, 4)
                out.append(difference_hash(grey_of(np.frombuffer(raw, np.uint8).reshape(height, width, channels))) if fits else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "dhash"])

    rows = images.select(F.col(id_col).alias("id"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "pixels")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, dhash string").withColumnRenamed("id", id_col)
