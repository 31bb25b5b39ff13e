"""Runs of words against brute force, and the query against a plain version of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallymere.llm import periodic_runs, queries

from ..oracle import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if words[p:] == words[:-p] or p == len(words))


def brute_runs(words):
    """Every stretch that can't be made longer at its smallest period, by trying all stretches."""
    n, found = len(words), []
    for s in range(n):
        for e in range(s + 6, n + 1):
            q = smallest_period(words[s:e])
            grows = (s > 0 and words[s - 1] == words[s - 1 + q]) or (e < n and words[e] == words[e - q])
            if e - s >= max(6, 4 * q) and not grows:
                found.append((s, e - s, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_runs(words):
    """The same by comparing words at every distance, quick enough for whole texts."""
    n, found = len(words), []
    for p in range(1, n // 4 + 1):
        s = 0
        while s < n - p:
            e = s
            while e < n - p and words[e] == words[e + p]:
                e += 1
            if e - s + p >= max(6, 4 * p) and smallest_period(words[s : s + 2 * p]) == p:
                found.append((s, e - s + p, p))
            s = max(e, s) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("strided", [0, 1 << 15])
def test_runs_of_short_texts(monkeypatch, strided):
    monkeypatch.setattr(periodic_runs, "STRIDED_OVER", strided)
    rng = random.Random(3)
    for _ in range(300):
        n, kinds = rng.randint(0, 36), rng.choice([1, 2, 3])
        words = [rng.randrange(kinds) for _ in range(n)]
        if n > 10 and rng.random() < 0.5:
            p, s = rng.randint(1, 5), rng.randrange(n // 2)
            words = [words[i] if i < s else words[s + (i - s) % p] for i in range(n)]
        ids = np.array(words, np.int64)
        assert periodic_runs.find_runs(ids) == brute_runs(words) == plain_runs(words), words


def test_long_texts_skip_no_run(monkeypatch):
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50, 6000)
    ids[1000:1900], ids[3000:5000] = np.resize(ids[1000:1100], 900), np.resize(ids[3000:3400], 2000)
    every = periodic_runs.find_runs(ids)
    monkeypatch.setattr(periodic_runs, "STRIDED_OVER", 0)
    assert periodic_runs.find_runs(ids) == every
    assert {100, 400} <= {p for _, _, p in every}


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: r[1] / r[2], default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *tail, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in queries.op13_periodic_runs(spark, SF).collect()}
    assert got == {expected(*r) for r in rows}
    assert sum(r[1] > 0 for r in got) > 3


def test_odd_rows(spark, tmp_path):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (None, "a b " * 9), (None, None), (5, "x " * 7), (5, "x " * 7), (-(2**63), "é 中 " * 20), (7, "a b a b a b a b c c c c c c"),
        (8, ("one two three " * 4000) + "end"), (9, "a b " * 8),
    ]
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id bigint, text string, runs string, n_words int, `best.start` int")
    got = periodic_runs.periodic_runs(df)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    by = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=str)
    want = sorted(((i is None, i or 0, len(w := WORD.findall(t or "")), plain_runs(w) if len(w) < 100 else [(0, 12000, 3)],
                    " ".join(x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in (plain_runs(w) if len(w) < 100 else [(0, 12000, 3)])))) for i, t in rows), key=str)
    assert by == want
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).where("doc_id is not null").collect()} == {expected(*r) for r in rows if r[0] is not None}
