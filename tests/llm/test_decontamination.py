"""The index against plain search, and the query and its texts against a plain version of the contract."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymere.llm import decontamination, queries
from tallymere.llm.fm_index import FmIndex, suffix_order

from ..oracle import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(items):
    """{window: item ids}"""
    out = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            out[tuple(w[k : k + 10])].add("" if i is None else str(i))
    return out


def expected(doc_id, text, asked):
    w = words(text)
    hit, items = set(), set()
    for n in {len(x) for x in asked}:
        for k in range(len(w) - n + 1):
            if (x := tuple(w[k : k + n])) in asked:
                hit.update(range(k, k + n))
                items |= asked[x]
    return doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("seed", range(12))
def test_index(seed):
    rng = random.Random(seed)
    symbols, n = rng.choice([2, 3, 5, 70]), rng.randint(0, 300)
    s = [rng.randrange(symbols) for _ in range(n)]
    if seed % 3 == 0:
        s = (s + [0]) * 7  # equal stretches
    ends = [min(k for k in range(i, len(s) + 1) if k == len(s) or s[k] == 0) for i in range(len(s))]
    key = lambda i: [(s[k], 0) for k in range(i, ends[i])] + [(0, ends[i])]
    order = suffix_order(np.array([*s, 0]), max(1, (symbols - 1).bit_length()))
    assert order.tolist() == sorted(range(len(s) + 1), key=lambda i: key(i) if i < len(s) else [(0, len(s))])
    index = FmIndex(np.array(s, np.int64), symbols)
    patterns = [[rng.randrange(1, symbols) for _ in range(rng.randint(1, 4))] for _ in range(60)]
    low, high = index.search(np.array([[0] * (4 - len(p)) + p for p in patterns]))
    for p, a, b in zip(patterns, low.tolist(), high.tolist(), strict=True):
        assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(s)) if s[i : i + len(p)] == p], (s, p)


def check(df, items, got, rows, asked):
    by = sorted((tuple(r) for r in got), key=str)
    assert by == sorted((expected(*r, asked) for r in rows), key=str)


def shown(found):
    return found.select("doc_id", "n_words", decontamination.hit_words(F.col("spans")), F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256), F.size("spans") > 0).collect()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    asked = windows(tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect())
    got = {tuple(r) for r in queries.op12_decontamination(spark, SF).collect()}
    assert got == {expected(*r, asked) for r in rows}
    assert sum(r[5] for r in got) >= 3


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "Short one"), (2, "c d e f g h i j k l m"), (10, "A-B C,d e f g h i j"), (3, None), (4, " .. "), (None, "null item here"), (5, "x x x"), (6, "é中 ñ"), (1, "a b c d e f g h i j k l")]
DOCS = [
    (1, "so A b. c d e f G h i j k l m n"), (2, None), (3, ""), (4, "?!"), (None, "a short one, short one"), (None, None), (7, "x x x x x x"), (7, "x x x x x x"), (8, "x"), (9, "a b c d e f g h i"),
    (10, "a b c d e"), (11, "f g h i j k l"), (12, "É中 Ñ é中 ñ"), (-(2**63), "null item here null item"), (13, ("filler " * 50 + "a b c d e f g h i j ") * 400), (14, "short ONE"),
]


@pytest.mark.parametrize("block_bytes", [8 << 20, 30])
@pytest.mark.parametrize("shard", [1 << 20, 37])
def test_odd_rows(spark, monkeypatch, block_bytes, shard):
    """Nulls, copies, clashing names, short items, items of one id; more blocks and shards change nothing."""
    monkeypatch.setattr(decontamination, "SHARD", shard)  # for the driver; workers are checked by test_shards
    df = spark.createDataFrame([(*r, "s", 1) for r in DOCS], "doc_id bigint, text string, items string, spans int")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontamination.contaminated_spans(df, items, block_bytes=block_bytes)
    check(df, items, shown(found), DOCS, windows(ITEMS))
    assert decontamination.contaminated_spans(df.limit(0), items).count() == 0
    assert not any(r[5] for r in shown(decontamination.contaminated_spans(df, items.limit(0))))


def test_shards(monkeypatch):
    """A sequence cut into small shards gives the same places."""
    import pyarrow as pa

    rng = random.Random(8)
    text = " ".join(rng.choice("abc") for _ in range(400))
    block = decontamination.windows_of(pa.table({"item": ["1", "2"], "text": ["a b c a b c a b a b c", "b a"]}), 10)
    sequence = np.array([block.vocabulary.index(x.encode()) + 1 for x in text.split()], np.int64)
    places = lambda: {(int(k), int(p)) for ks, ps in decontamination._hits(sequence, block) for k, p in zip(ks, ps, strict=True)}
    every = places()
    for shard, at_once in ((1, 3), (7, 5), (50, 1 << 20)):
        monkeypatch.setattr(decontamination, "SHARD", shard)
        monkeypatch.setattr(decontamination, "PLACES", at_once)
        assert places() == every
    assert every


def test_texts_without_spans(spark):
    df = spark.createDataFrame([(1, "Über! a b c d e f g h i j, Ende"), (2, "clean"), (3, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id bigint, text string")
    found = decontamination.contaminated_spans(df, items)
    got = {r[0]: r[1] for r in found.select("doc_id", decontamination.without_spans(F.col("text"), F.col("spans"))).collect()}
    assert got == {1: "Über! , Ende", 2: "clean", 3: ""}
