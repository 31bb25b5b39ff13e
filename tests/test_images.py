"""Hashes of images of any size against a plain resampler."""

import math
import random

import numpy as np

from tallymere.operators import images
from tallymere.plans import review_queries

from .oracle import SF


def plain_axis(row, n_out):
    scale = len(row) / n_out
    wide, out = max(scale, 1.0), []
    for x in range(n_out):
        centre = (x + 0.5) * scale
        low, high = max(0, int(centre - 3 * wide + 0.5)), min(len(row), int(centre + 3 * wide + 0.5))
        w = []
        for i in range(low, high):
            t = (i - centre + 0.5) / wide
            sinc = lambda v: 1.0 if v == 0 else math.sin(math.pi * v) / (math.pi * v)
            w.append(sinc(t) * sinc(t / 3) if abs(t) < 3 else 0.0)
        total = sum(w)
        fixed = [int(v / total * (1 << 22) + (-0.5 if v / total < 0 else 0.5)) for v in w]
        out.append(min(255, max(0, ((1 << 21) + sum(f * p for f, p in zip(fixed, row[low:high], strict=True))) >> 22)))
    return out


def plain_grid(rows):
    wide = [plain_axis(r, 9) for r in rows]
    return [list(r) for r in zip(*[plain_axis(list(c), 8) for c in zip(*wide, strict=True)], strict=True)]


def plain_hash(rows):
    bits = "".join("1" if b > a else "0" for r in plain_grid(rows) for a, b in zip(r, r[1:], strict=False))
    return f"{int(bits, 2):016x}"


def test_grids_of_any_size():
    rng = random.Random(6)
    for _ in range(40):
        w, h = rng.choice([1, 2, 8, 9, 10, 40, 133]), rng.choice([1, 3, 8, 9, 25, 90])
        rows = [[rng.randrange(256) for _ in range(w)] for _ in range(h)]
        assert images.small_grid(np.array(rows)).tolist() == plain_grid(rows), (w, h)
    same = [[rng.randrange(256) for _ in range(9)] for _ in range(8)]
    assert images.small_grid(np.array(same)).tolist() == same


def test_rows(spark):
    ramp = bytes(range(0, 90, 1)) * 2
    rgb = bytes(v for p in range(20 * 10) for v in (p, 255 - p, 7))
    rows = [(1, 90, 2, ramp), (2, 20, 10, rgb), (3, 20, 10, rgb[:-1]), (4, 0, 5, b""), (5, None, 2, ramp), (6, 90, 2, None), (None, 3, 3, bytes(9)), (7, 1, 1, b"x")]
    got = {r["image_id"]: r["dhash"] for r in images.with_hash(spark.createDataFrame(rows, "image_id long, width int, height int, pixels binary")).collect()}
    grey = [[(p * 19595 + (255 - p) * 38470 + 7 * 7471 + 32768) >> 16 for p in range(r * 20, r * 20 + 20)] for r in range(10)]
    assert got == {1: "f" * 16, 2: plain_hash(grey), 3: None, 4: None, 5: None, 6: None, None: "0" * 16, 7: "0" * 16}


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: (r["width"], r["height"], r["dhash"]) for r in review_queries.QUERIES["image_dhash"](spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages[:60]:
        raw, w = (p["html"] or "").encode(), 20 + p["page_id"] % 40
        h = len(raw) // w
        want = plain_hash([list(raw[k * w : (k + 1) * w]) for k in range(h)]) if h else None
        assert got[p["page_id"]] == (w, h, want)
