"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, scores as sparse dot products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash_sample
from .words import Words, mix, pieces, range_hashes

BUCKET_BITS = 18
#: Documented bounds of the training sample: of the labelled rows with the smallest hashes of ids, in that order, as many
#: as have so many features in all (8 bytes each; a row has at most 2 ** BUCKET_BITS).
TRAIN_ROWS, TRAIN_FEATURES, EPOCHS = 6000, 16_000_000, 3
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.02, 0.5, 6.0
CUT = 0.7

#: Small letters and all bytes beyond ASCII are one class, capitals one, digits one; other bytes are their own.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def _shape_hashes(w: Words) -> np.ndarray:
    """A hash for each word's shape: its classes of characters with runs as one, so that unseen words are known by form."""
    c = _CLASS[w.bytes]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    new[w.start] = True
    new &= w.ink
    rank = np.concatenate(([0], np.cumsum(new)))
    return range_hashes(c[new], rank[w.start], rank[w.end])


def hashed_grams(texts: pa.Array, bits: int = BUCKET_BITS) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Groups of features: (bucket of each n-gram, bounds by text), for words and pairs and for shapes, pairs and triples of shapes."""
    w = Words(texts, lower=False)
    groups, n = [], w.n
    for kind, h, orders in ((1, Words(texts, lower=True).hashes(), (1, 2)), (2, _shape_hashes(w), (1, 2, 3))):
        for order in orders:
            g, at = w.grams(h, order)
            bucket = (mix(g + np.uint64(10 * kind + order)) >> np.uint64(64 - bits)).astype(np.int64)
            groups.append((bucket, np.searchsorted(at, w.first)))
    return groups, n


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1: bias plus, for each group, the mean weight of the text's n-grams."""
        groups, n = hashed_grams(texts, int(np.log2(len(self.weights))))
        z = np.full(n, self.bias)
        for bucket, at in groups:
            c = np.concatenate(([0.0], np.cumsum(self.weights[bucket])))
            z += SCALE * (c[at[1:]] - c[at[:-1]]) / np.maximum(np.diff(at), 1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def sparse_rows(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text: the same numbers that Model.score uses."""
    groups, n = hashed_grams(texts)
    out = []
    for i in range(n):
        parts = [(b[at[i] : at[i + 1]], SCALE / max(at[i + 1] - at[i], 1)) for b, at in groups]
        bucket, back = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        out.append((bucket, np.bincount(back, np.concatenate([np.full(len(p), v) for p, v in parts]), len(bucket))))
    return out


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BUCKET_BITS, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over (label, buckets, values), in the order given; rare labels weigh more so that both count alike."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    good = sum(y for y, _, _ in rows)
    if not good or good == len(rows):  # one kind of label, or none: the prior is all there is to learn
        return Model(np.zeros(1 << bits), 0.0 if not rows else 3.0 if good else -3.0)
    weigh = (len(rows) / 2 / (len(rows) - good), len(rows) / 2 / good)
    solve = lambda z, n: np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    for _ in range(epochs):
        for y, at, x in rows:
            w, b = solve(z[at], n[at]), float(-zb / ((BETA + np.sqrt(nb)) / ALPHA))
            p = 1 / (1 + np.exp(-np.clip(w @ x + b, -35, 35)))
            e = (p - y) * weigh[y]
            g = e * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
            zb += e - (np.sqrt(nb + e * e) - np.sqrt(nb)) / ALPHA * b
            nb += e * e
    return Model(solve(z, n), float(-zb / ((BETA + np.sqrt(nb)) / ALPHA)))


def fold(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_fold: int = 2, max_rows: int = TRAIN_ROWS, max_features: int = TRAIN_FEATURES) -> Model:
    """Learns from labelled rows outside the held fold. The sample's ids (at most max_rows, so their broadcast is
    bounded) go to the documents, features are made where the texts are, and those of at most max_rows rows and max_features
    features come back. Of the rows that repeat an id, the one with the smallest hash of its text is taken."""
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_label in (0, 1)").where(fold("_id") != held_fold)
    chosen = hash_sample(known.groupBy("_id").agg(F.max("_label").alias("_label")), "_id", max_rows)
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    texts = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", F.xxhash64("_text").alias("_key"), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in pieces(batch, batch.column("_text")):
                rows = sparse_rows(texts)
                sizes = pa.array([len(r[0]) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], sizes, pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["_id", "_label", "_key", "size", "at", "x"])

    with Scratch(df.sparkSession) as own:
        made = own.written(texts.mapInArrow(run, "_id bigint, _label int, _key bigint, size bigint, at array<int>, x array<float>"), "features")
        one = made.groupBy("_id").agg(F.min(F.struct("_key", "size")).alias("r")).select("_id", "r.*").collect()
        order, taken, total = {}, [], 0
        for r in sorted(one, key=lambda r: (int(mix(np.array([r["_id"]], np.int64).view(np.uint64))[0]), r["_id"])):
            if (total := total + r["size"]) > max_features:
                break
            order[r["_id"]] = len(taken)
            taken.append((r["_id"], r["_key"]))
        picked = df.sparkSession.createDataFrame(taken, "_id bigint, _key bigint")
        got = made.join(F.broadcast(picked), ["_id", "_key"]).dropDuplicates(["_id"]).select("_id", "_label", "at", "x").toArrow()
    rows = sorted(zip(got["_id"].to_pylist(), got["_label"].to_pylist(), (np.asarray(a.values) for a in got["at"]), (np.asarray(a.values) for a in got["x"]), strict=True), key=lambda r: order[r[0]])
    return train([(y, at, x.astype(float)) for _, y, at, x in rows])


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted.

    A null or empty text has no n-grams, so its score is the bias alone. Rows that repeat an id are scored each by
    its text. Labels other than 0 and 1 are ignored; conflicting labels of an id count as 1; without labels of both
    kinds the score is constant. An empty table gives an empty result; extra columns are ignored; very long texts are read
    whole, one at a time. The model (2**18 weights) goes with the tasks.
    """
    model = fit(df, labels, id_col, text_col)
    held = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        own = Model(weights, bias)
        for batch in batches:
            for piece, texts in pieces(batch, batch.column("_text")):
                yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(own.score(texts))], ["_id", "score"])

    scored = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "_id bigint, score double")
    return scored.select(F.col("_id").alias(id_col), (fold("_id") == 2).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))
