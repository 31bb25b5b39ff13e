"""Quality rules: fixed base rules, then an isolation forest on rule statistics with a threshold from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash_sample, whole_row, written
from .words import Words, distinct, pieces

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Statistics of a text; the first five make the base, the others only serve the forest.
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: What the rules allow: shares of a text, or characters a word.
ALLOWED = {"symbols_per_word": 0.1, "repeated_lines": 0.3, "capitals": 0.3, "longest_mean_word": 10.0, "shortest_mean_word": 3.0, "repeated_words": 0.3}
#: The forest's documented bounds: each tree is grown on TREE_ROWS of TREES * TREE_ROWS documents, which a hash of their ids chooses.
TREES, TREE_ROWS, SEED = 64, 256, 7
#: The threshold rejects this share of the rows labelled good at most; without labels it is DEFAULT_THRESHOLD.
MAX_GOOD_LOST, DEFAULT_THRESHOLD, SCORE_STEPS = 0.005, 0.7, 1000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys: which occur twice or more, and which are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order[1:][same]] = any_[order[:-1][same]] = True
    later[order[1:][same]] = True
    return any_, later


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """STATISTICS of each text; a null text has no words. Lines and windows are compared byte by byte, never by a hash alone."""
    w = Words(texts)
    chars = (w.bytes & 0xC0) != 0x80
    lines_end = np.flatnonzero(w.bytes == 10)
    after = np.searchsorted(w.off, lines_end, "right") - 1  # the text that a line break is in
    start = np.concatenate((w.off[:-1], lines_end + 1))
    line_text = np.concatenate((np.arange(w.n), after))
    order = np.lexsort((start, line_text))
    start, line_text = start[order], line_text[order]
    end = np.concatenate((start[1:] - 1, [len(w.bytes)])) if len(start) else start
    last = np.concatenate((line_text[1:] != line_text[:-1], [True])) if len(start) else np.zeros(0, bool)
    end[last] = w.off[1:][line_text[last]]
    ink = np.concatenate(([0], np.cumsum(w.ink)))
    full = ink[end] > ink[start]
    line, values = distinct(w.bytes, start[full], end[full])
    _, later = _repeated(line_text[full] * np.int64(max(1, len(values))) + line)
    window, at = w.equal_windows(3)
    again, _ = _repeated(window)
    covered = np.zeros(len(w.start), bool)
    for k in range(3):
        covered[at[again] + k] = True
    return {
        "n_words": np.diff(w.first), "word_chars": w.per_text(chars & w.ink), "n_symbols": w.per_text(_SYMBOL[w.bytes]),
        "n_dup_lines": np.bincount(line_text[full][later], minlength=w.n)[: w.n], "n_repeat_words": w.per_text(covered, w.first),
        "n_lines": np.bincount(line_text[full], minlength=w.n)[: w.n], "n_upper": w.per_text((w.bytes >= 65) & (w.bytes <= 90)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """How far each rule's statistic lies beyond what the rule allows, so that a text within all rules is the origin."""
    per = lambda a, b: s[a] / np.maximum(s[b], 1)
    over = lambda x, most: np.maximum(x - most, 0.0)
    length = per("word_chars", "n_words")
    return np.column_stack([
        over(per("n_symbols", "n_words"), ALLOWED["symbols_per_word"]), over(per("n_dup_lines", "n_lines"), ALLOWED["repeated_lines"]),
        over(per("n_upper", "word_chars"), ALLOWED["capitals"]), over(length, ALLOWED["longest_mean_word"]) + over(ALLOWED["shortest_mean_word"] - length, 0.0),
        over(per("n_repeat_words", "n_words"), ALLOWED["repeated_words"]),
    ])


def _worst(table: DataFrame) -> dict[str, np.ndarray]:
    """STATISTICS of the row of the whole table that is farthest beyond each rule, where there is one: one aggregate, a row a rule."""
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    length = per("word_chars", "n_words")
    excess = [
        per("n_symbols", "n_words") - ALLOWED["symbols_per_word"], per("n_dup_lines", "n_lines") - ALLOWED["repeated_lines"], per("n_upper", "word_chars") - ALLOWED["capitals"],
        F.greatest(length - ALLOWED["longest_mean_word"], ALLOWED["shortest_mean_word"] - length), per("n_repeat_words", "n_words") - ALLOWED["repeated_words"],
    ]
    found = table.agg(*[F.max(F.struct(e.alias("excess"), *STATISTICS)).alias(f"r{k}") for k, e in enumerate(excess)]).first()
    rows = [r for r in found if r is not None and r["excess"] > 0]
    return {n: np.array([r[n] for r in rows], np.int64) for n in STATISTICS}


def _usual_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), split, the left child (the right one follows it) and path length at leaves."""

    rows: int = TREE_ROWS
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    threshold: float = DEFAULT_THRESHOLD

    def grow(self, x: np.ndarray, rng: np.random.Generator) -> None:
        feature, split, child, path, deepest = [-1], [0.0], [0], [0.0], int(np.ceil(np.log2(max(2, len(x)))))
        todo = [(0, x, 0)]
        while todo:
            node, rows, depth = todo.pop()
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
            usable = np.flatnonzero(high > low)
            if depth >= deepest or len(rows) < 2 or not len(usable):
                path[node] = depth + _usual_path(len(rows))
                continue
            k = int(rng.choice(usable))
            at = float(rng.uniform(low[k], high[k]))
            feature[node], split[node], child[node] = k, at, len(feature)
            for part in (rows[rows[:, k] < at], rows[rows[:, k] >= at]):
                todo.append((len(feature), part, depth + 1))
                for a, v in ((feature, -1), (split, 0.0), (child, 0), (path, 0.0)):
                    a.append(v)
        self.trees.append((np.array(feature), np.array(split), np.array(child), np.array(path)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Near 1: isolated by few splits. About 0.5 and less: usual."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total, every = np.zeros(len(x)), np.arange(len(x))
        for feature, split, child, path in self.trees:
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(inner, child[at] + (x[every, f] >= split[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(_usual_path(self.rows), 1e-9))


def _statistics_table(df: DataFrame, id_col: str, text_col: str, keep=written) -> DataFrame:
    """_id and STATISTICS of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in pieces(batch, batch.column("_text")):
                s = text_statistics(texts)
                yield pa.RecordBatch.from_arrays([piece.column("_id"), *[pa.array(s[n], pa.int64()) for n in STATISTICS]], ["_id", *STATISTICS])

    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return keep(texts.mapInArrow(run, f"_id bigint, {', '.join(f'{n} bigint' for n in STATISTICS)}"), "rule-statistics")


def _scored(table: DataFrame, forest: Forest) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in STATISTICS}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(features(s)))], [*batch.schema.names, "score"])

    return table.mapInArrow(run, f"_id bigint, {', '.join(f'{n} bigint' for n in STATISTICS)}, score double")


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", trees: int = TREES, rows: int = TREE_ROWS) -> Forest:
    """A forest grown on trees * rows documents that pass the base rules (the smallest hashes of ids; a documented
    bound) and, in each tree, the row of the whole table farthest beyond each rule, so that no rule that any document
    breaks is missing; its threshold from every labelled document: the counts of good and bad rows by score step, at most
    2 * SCORE_STEPS numbers, give the threshold that parts them best while losing at most MAX_GOOD_LOST of the good."""
    forest = Forest(rows)
    passed = table.where(~base_failed())
    sample, worst = hash_sample(passed, "_id", trees * rows, *STATISTICS).toPandas(), _worst(passed)
    forest.rows = max(1, min(rows, len(sample)))
    for k in range(trees if len(sample) else 0):
        rng = np.random.default_rng([SEED, k])
        part = sample.iloc[rng.permutation(len(sample))[: forest.rows]]
        forest.grow(features({n: np.concatenate((part[n].to_numpy(), worst[n])) for n in STATISTICS}), rng)
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("good")).where("good is not null")
    counts = _scored(passed, forest).join(known, "_id").groupBy(F.floor(F.col("score") * SCORE_STEPS).alias("step"), "good").count().collect()
    good, bad = np.zeros(SCORE_STEPS + 2), np.zeros(SCORE_STEPS + 2)
    for step, label, n in counts:
        (good if label == 1 else bad)[step] += n
    if good.sum() and bad.sum():
        over = lambda c: c[::-1].cumsum()[::-1] / c.sum()  # noqa: E731  share of rows with at least this score
        gain = np.where(over(good) <= MAX_GOOD_LOST, over(bad) - over(good), -1)
        forest.threshold = float(np.argmax(gain) / SCORE_STEPS) if gain.max() > 0 else np.inf
    return forest


def judge_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    The statistics of whole texts are written once to the shared folder and used for fit, threshold and verdict.
    A null or empty text has no words and fails the base rules; rows that repeat an id are judged each by its text;
    without labels (or with labels of one kind) DEFAULT_THRESHOLD holds; an empty table gives an empty result. Very long
    texts are read whole, one at a time; extra columns are ignored.
    """
    table = _statistics_table(df, id_col, text_col)
    forest = fit(table, labels, id_col)
    return _scored(table, forest).select(
        F.col("_id").alias(id_col), *STATISTICS[:5], base_failed().alias("base_failed"), "score", (~base_failed() & (F.col("score") < forest.threshold)).alias("kept"))


def keep_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that judge_quality keeps, with df's columns; the texts are read a second time and never shuffled.

    Rows go to Python and back as one struct, so extra columns may have any name.
    """
    with Scratch(df.sparkSession) as own:
        forest = fit(_statistics_table(df, id_col, text_col, own.written), labels, id_col)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in pieces(batch, batch.column("_row").field(place)):
                s = text_statistics(texts.cast(pa.string()))
                failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
                yield piece.filter(pa.array(~failed & (forest.score(features(s)) < forest.threshold)))

    row = df.select(whole_row(df))
    return row.mapInArrow(run, row.schema).select("_row.*")
