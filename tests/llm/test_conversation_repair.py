"""Repairs against a plain recursion over (cost, audit), and the query against a plain version of its contract."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from tallymere.llm import conversation_repair, queries

from ..oracle import SF

INK = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def best_edits(rows):
    """(cost, audit, repaired rows) of rows (role, text, fault): the least of all edits, cost first, then letters."""
    n = len(rows)

    @lru_cache(None)
    def go(i, state, inserts):
        found = []
        made = "a" if state == "u" else "u"
        name = "assistant" if made == "a" else "user"
        if i == n and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            c, a, r = go(i, made, inserts + 1)
            found.append((c + 3, "I" + a, ((name, ""), *r)))
        if i < n:
            role, text, fault = rows[i]
            c, a, r = go(i + 1, state, 0)
            found.append((c + 4, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if (to := NEXT[state].get(role[:1])) is not None:
                    c, a, r = go(i + 1, to, 0)
                    found.append((c + extra, "K" + a, ((role, text), *r)))
                c, a, r = go(i + 1, made, 0)
                found.append((c + extra + 3, "R" + a, ((name, text), *r)))
        return min(found, key=lambda x: x[:2], default=(10**9, "", ()))

    return go(0, "", 0)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        ink = INK.findall(text)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def summary(rows):
    """gaps ... repaired_sha256 of rows (turn, role, text) in order."""
    plain = [(r, t) for _, r, t in rows]
    kinds = faults(plain)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, repaired = best_edits(tuple((r, t, f) for (r, t), f in zip(plain, kinds, strict=True)))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, sha


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows):
    by = defaultdict(list)
    for conv, *r in damage(rows):
        by[conv].append(tuple(r))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    return {conv: summary(sorted(by[conv], key=key)) for conv in {r[0] for r in rows}}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_conversation_repair(spark, SF).collect()}
    assert got == expected(rows)
    assert len({r[6] for r in got.values()}) > 5


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_blocks(block):
    """Distances and letters of rows in blocks are those of the plain recursion."""
    rng = random.Random(block)
    for _ in range(200):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), f"{k}", rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for k in range(rng.randint(0, 9))]
        kinds = [(r[:1] if r[:1] in "sua" else "", ["", "blank", "duplicate", "truncated"].index(f)) for r, _, f in rows]
        end, steps = conversation_repair._END, []
        for at in range(len(kinds) - 1 - (len(kinds) - 1) % block if kinds else -1, -1, -block):
            part = kinds[at : at + block]
            dist = conversation_repair.distances(part, end)
            steps = [conversation_repair._steps(k, dist[i], dist[i + 1]) for i, k in enumerate(part)] + steps
            end = dist[0]
        state, audit = 0, ""
        for s in steps:
            audit, state = audit + s[state][:-1], int(s[state][-1])
        cost, want, _ = best_edits(tuple(rows))
        assert (end[0], audit + conversation_repair._TAIL[state]) == (cost, want), rows


def test_odd_rows(spark, tmp_path):
    said = "Well. And so on?"
    rows = (
        [(1, k, r, t) for k, (r, t) in enumerate([("user", None), (None, "x."), ("assistant", "y."), ("user", "a."), ("user", "a."), ("tool", "?"), ("", "."), ("system", "late.")])]
        + [(2, None, "user", said), (2, None, "user", said), (2, None, "assistant", "z"), (None, 3, "user", "q."), (None, None, None, None), (3, 5, "user", " \t"), (4, -(2**63), "assistant", "o."), (4, 2**62, "user", "p.")]
        + [(5, k // 2, ("user", "assistant")[k % 2], f"{k % 7}.") for k in range(60)]
        + [(c, 0, "user", "Hi.") for c in range(100, 160)]
        + [(6, 1, "user", "long words. " * 30000), (6, 2, "assistant", "中 é!")]
    )
    rows = [r for r in rows if r[0] != 4]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, steps int, digest string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == expected(rows)
    assert any(g == (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for g in got.values())  # all of its rows dropped
    assert conversation_repair.repair_conversations(df.limit(0)).count() == 0


def test_repaired_turns(spark):
    rows = [(7, k, r, t) for k, (r, t) in enumerate([("assistant", "So."), ("user", "a"), ("user", "b."), ("assistant", "c."), ("user", "b.")])]
    df = spark.createDataFrame(rows, "c bigint, n int, role string, said string")
    got = [tuple(r) for r in conversation_repair.repaired_turns(df, "c", "n", "role", "said").orderBy("seq").collect()]
    _, _, want = best_edits(tuple((r, t, f) for (_, _, r, t), f in zip(rows, faults([r[2:] for r in rows]), strict=True)))
    assert got == [(7, k, r, t) for k, (r, t) in enumerate(want)]
