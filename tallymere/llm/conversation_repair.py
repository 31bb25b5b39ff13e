"""Conversations brought back into the form `(s?(ua)+)?` by the cheapest edits, with the edits as an audit.

Between two rows a conversation is in one of four states: nothing yet, after a system turn, after a user turn, after an
assistant turn. Keep, Rerole and Delete lead over a row, Insert stays before it, so the edits are a graph of four nodes
a row whose arcs cost 0 to 6. Dial's bucket queue finds every node's distance to the end; arcs that keep to a shortest
path are tight, and from each node the tight arc with the least letter is the one to walk.

Rows are never gathered: one pass goes through a conversation from its end, block by block, with four distances carried
from block to block, and writes down for each row what to do from each state; the other goes from its start and edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows that a bucket queue holds at once.
BLOCK = 4096
#: Faults of rows by number; the first that fits counts.
SOUND, BLANK, DUPLICATE, CUT = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn of each initial, by state; and after the only turn that Insert or Rerole can make there.
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_MADE = (USER, USER, ASSISTANT, USER)
_MADE_FROM = {to: [q for q in range(4) if _MADE[q] == to] for to in range(4)}
_LEGAL = {"su", "ua", "au"}
_INK = r"[^\x20\x09-\x0D]"


def _role(to: int) -> str:
    return "assistant" if to == ASSISTANT else "user"


def _arcs(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """By state: (letter, cost, state) of the arcs over a row, in the order of their letters."""
    extra, out = TRUNCATED if fault == CUT else 0, []
    for q in range(4):
        arcs = [("D", DELETE, q)]
        if fault not in (BLANK, DUPLICATE):
            if (to := _AFTER.get(initial, {}).get(q)) is not None:
                arcs.append(("K", KEEP + extra, to))
            arcs.append(("R", REROLE + extra, _MADE[q]))
        out.append(arcs)
    return out


#: The arcs of every kind of row, and the same backwards: by state, (state before, cost).
_KINDS = {(i, f): _arcs(i, f) for i in ("s", "u", "a", "") for f in range(4)}
_BACK = {k: [[(q, cost) for q in range(4) for _, cost, to in arcs[q] if to == end] for end in range(4)] for k, arcs in _KINDS.items()}


def distances(kinds: list[tuple[str, int]], end: list[int]) -> list[list[int]]:
    """Distance to the end from each state before each row of a block; the last entry is for what follows the block.

    `end` has the distances that are known after the block. Costs are small whole numbers, so the queue is a list of
    buckets by distance, which never needs sorting.
    """
    n, least = len(kinds), min(end)
    far = -1
    dist = [[far] * 4 for _ in range(n + 1)]
    buckets: list[list[tuple[int, int]]] = [[] for _ in range(max(end) - least + 7)]
    for q, d in enumerate(end):
        buckets[d - least].append((n, q))
    left, d = 4 * (n + 1), 0
    while left:
        while len(buckets) < d + 7:
            buckets.append([])
        bucket = buckets[d]
        while bucket:  # arcs that cost nothing add to it
            i, q = bucket.pop()
            if dist[i][q] != far:
                continue
            dist[i][q] = d + least
            left -= 1
            for p in _MADE_FROM[q]:
                if dist[i][p] == far:
                    buckets[d + INSERT].append((i, p))
            if i:
                before = dist[i - 1]
                for p, cost in _BACK[kinds[i - 1]][q]:
                    if before[p] == far:
                        buckets[d + cost].append((i - 1, p))
        buckets[d] = []
        d += 1
    return dist


def _steps(kind: tuple[str, int], here: list[int], there: list[int]) -> list[str]:
    """By state: the letters up to the one that leads over the row, and the state behind it."""
    out = []
    for start in range(4):
        q, letters, to = start, "", -1
        while to < 0:
            tight = [(x, end) for x, cost, end in _KINDS[kind][q] if here[q] == cost + there[end]]
            inserts = here[q] == INSERT + here[_MADE[q]]
            if tight and (not inserts or tight[0][0] < "I"):
                letters, to = letters + tight[0][0], tight[0][1]
            else:
                letters, q = letters + "I", _MADE[q]
        out.append(f"{letters}{to}")
    return out


#: From each state to the end of a conversation when no row is left: letters, and what they cost.
_TAIL = ("", "II", "I", "")
_END = [INSERT * len(x) for x in _TAIL]


def _written_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations from their end to their start, with what to do from each state (_steps, joined by a space)."""
    current, end, held = None, _END, []

    def flush() -> tuple[list[int], pa.RecordBatch]:
        rows = held[::-1]
        kinds = [k for _, _, k in rows]
        dist = distances(kinds, end)
        steps = [" ".join(_steps(k, dist[i], dist[i + 1])) for i, k in enumerate(kinds)]
        where = pa.concat_batches([b.slice(at, 1) for b, at, _ in rows]) if len(rows) < 2 else _taken(rows)
        return dist[0], pa.RecordBatch.from_arrays([*where.columns, pa.array(steps, pa.string())], [*where.schema.names, "steps"])

    for batch in batches:
        ids, initials, faults = (batch.column(n).to_pylist() for n in ("conv", "initial", "fault"))
        for at, (conv, initial, fault) in enumerate(zip(ids, initials, faults, strict=True)):
            if held and (conv != current or len(held) == BLOCK):
                first, out = flush()
                yield out
                end, held = (first if conv == current else _END), []
            current = conv
            held.append((batch, at, (initial if initial in _AFTER else "", fault)))
    if held:
        yield flush()[1]


def _taken(rows: list) -> pa.RecordBatch:
    """The rows (batch, place, kind) as one batch; neighbours of one batch are taken together."""
    parts, k = [], 0
    while k < len(rows):
        batch, j = rows[k][0], k
        while j < len(rows) and rows[j][0] is batch:
            j += 1
        parts.append(batch.take(pa.array([r[1] for r in rows[k:j]], pa.int64())))
        k = j
    return pa.concat_batches(parts)


class _Edited:
    """One conversation as its rows come in from the start."""

    def __init__(self, conv):
        self.conv, self.state, self.audit, self.pending = conv, START, [], None
        self.digest, self.n = hashlib.sha256(), 0
        self.counts, self.illegal, self.cost = [0] * 4, 0, 0
        self.before = None
        self.low = self.high = self.turn = None
        self.turns = self.rows = 0

    def step(self, turn: int | None, role: str, fault: int, steps: str) -> list[tuple[int, str, str]]:
        """Edits up to a row and over it; a row that stays waits for its text. Gives the turns that are inserted."""
        self.rows += 1
        self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in _LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and (self.turns == 0 or turn != self.turn):
            self.low, self.high, self.turn, self.turns = turn if self.turns == 0 else self.low, turn, turn, self.turns + 1
        chosen = steps.split(" ")[self.state]
        made = self.insert(chosen[:-2])
        letter = chosen[-2]
        self.audit.append(letter)
        self.cost += DELETE if letter == "D" else (REROLE if letter == "R" else KEEP) + (TRUNCATED if fault == CUT else 0)
        to = int(chosen[-1])
        self.pending = None if letter == "D" else role if letter == "K" else _role(to)
        self.state = to
        return made

    def insert(self, letters: str) -> list[tuple[int, str, str]]:
        made = []
        for _ in letters:
            self.state = _MADE[self.state]
            self.audit.append("I")
            self.cost += INSERT
            made.append(self.say(_role(self.state), ""))
        return made

    def say(self, role: str, text: str) -> tuple[int, str, str]:
        self.digest.update((("\n" if self.n else "") + role + ":" + text).encode())
        self.n += 1
        return self.n - 1, role, text

    def summary(self) -> dict:
        return {
            "conv": self.conv, "gaps": self.high - self.low + 1 - self.turns if self.turns else 0, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE],
            "truncated": self.counts[CUT], "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest(),
        }


_SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_TURN = "seq bigint, role string, text string"


def _edits(turns: bool, schema: pa.Schema) -> Callable:
    """Edits conversations whose rows come in order; gives their turns, or a summary each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Edited | None = None
        out: list[dict] = []

        def add(rows: list[tuple[int, str, str]]) -> None:
            if turns:
                out.extend({"conv": now.conv, "seq": n, "role": r, "text": t} for n, r, t in rows)

        def finish() -> None:
            if now is not None:
                add(now.insert(_TAIL[now.state]))
                if not turns:
                    out.append(now.summary())

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("conv", "turn", "role", "fault", "steps", "text"))
            for conv, turn, role, fault, steps, text in zip(*columns, strict=True):
                if now is None or conv != now.conv:
                    finish()
                    now = _Edited(conv)
                if steps is not None:
                    add(now.step(turn, role, fault, steps))
                elif text is not None and now.pending is not None:
                    add([now.say(now.pending, text)])
                    now.pending = None
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        finish()
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _plan(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: DataFrame | None) -> DataFrame:
    """Rows for _edits, dealt by conversation and in order: a mark for each conversation, then for each row what to do and its text."""
    rows = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    blank = ~F.regexp_like("text", F.lit(_INK))
    cut = F.regexp_like("text", F.lit(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"))
    # Without texts: equal rows are counted, and the first row that says something is told from the later ones.
    facts = rows.select("conv", "turn", "role", "digest", blank.alias("blank"), cut.alias("cut")).groupBy("conv", "turn", "role", "digest", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    said = F.row_number().over(Window.partitionBy("conv", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    each = facts.withColumn("again", said).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    fault = F.when(F.col("blank"), BLANK).when(F.col("again") | (F.col("copy") > 0), DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND)
    marked = each.select("conv", "turn", "role", "digest", "copy", F.left("role", F.lit(1)).alias("initial"), fault.cast("int").alias("fault"))
    back = marked.repartition("conv").sortWithinPartitions("conv", *[F.col(c).desc_nulls_last() for c in ("turn", "role", "digest", "copy")])
    conv_type = rows.schema["conv"].dataType.simpleString()
    stepped = back.mapInArrow(_written_steps, f"conv {conv_type}, turn bigint, role string, digest binary, copy bigint, initial string, fault int, steps string")
    none = lambda kind: F.lit(None).cast(kind)
    all_ = (
        stepped.select("conv", F.lit(1).alias("what"), "turn", "role", "digest", "copy", "fault", "steps", none("string").alias("text"))
        .union(rows.select("conv", F.lit(1), "turn", "role", "digest", F.lit(0).cast("long"), none("int"), none("string"), "text"))
        .union((df if present is None else present).select(F.col(f"`{conv_col}`").alias("conv")).distinct().select("conv", F.lit(0), none("long"), none("string"), none("binary"), none("long"), none("int"), none("string"), none("string")))
    )
    return all_.repartition("conv").sortWithinPartitions("conv", "what", F.col("turn").asc_nulls_first(), "role", "digest", "copy", F.col("steps").desc_nulls_last())


def repair_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: DataFrame | None = None) -> DataFrame:
    """A row per conversation: gaps in its turn numbers, faults (blank, duplicate, truncated), illegal neighbours, cost, audit
    and the SHA-256 of the repaired turns (`role:text`, joined by line feeds).

    Rows go by turn (nulls first), then role, then the SHA-256 of the text; a null role or text is one space, a role counts
    by its first character. Blank and repeated rows must go. Conversations of `present` that have no row, and an empty
    repair, have zeros, an empty audit and the hash of nothing; a null id is a conversation too. Equal rows are counted
    before they are dealt. The rows of one conversation, however many, stream through one task, as the hash of its turns
    needs them in order; BLOCK of them, without texts, and one text are held. The audit is one string. Extra columns are left out.
    """
    plan = _plan(df, conv_col, turn_col, role_col, text_col, present)
    schema = pa.schema([pa.field("conv", _arrow(plan.schema["conv"].dataType)), *[pa.field(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split(" ") for x in _SUMMARY.split(", "))]])
    return plan.mapInArrow(_edits(False, schema), f"conv {plan.schema['conv'].dataType.simpleString()}, {_SUMMARY}").withColumnRenamed("conv", conv_col)


def repaired_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired turns themselves: the conversation, seq from 0, role, text. Rows are read as in repair_conversations."""
    plan = _plan(df, conv_col, turn_col, role_col, text_col, None)
    schema = pa.schema([pa.field("conv", _arrow(plan.schema["conv"].dataType)), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    return plan.mapInArrow(_edits(True, schema), f"conv {plan.schema['conv'].dataType.simpleString()}, {_TURN}").withColumnRenamed("conv", conv_col)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by the CRC of `conv_id:turn`: of twenty rows one is dropped, one emptied, one loses
    its full stops, one is repeated and one gets the role user. Nulls of role and text, and in what is hashed, are one space."""
    space: Callable[[str], Column] = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind != 0")
    return rows.withColumn("_k", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_k", "_kind")
