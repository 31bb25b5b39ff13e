"""Chat formatting: reply trees, root-to-leaf paths by iterated self-joins, ranked branches, one conversation per chosen path."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, written

TURN_START, TURN_END, TRAINED_ROLE = "<|im_start|>", "<|im_end|>", "assistant"
#: Strings that chat templates give a meaning to. Inside texts a backslash after their first character breaks them.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_OPENER = re.compile("([" + re.escape("".join({c[0] for c in CONTROL})) + "])(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(TURN_START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(TURN_END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    """Reversible: backslashes are doubled, then control strings broken by one."""
    return _OPENER.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the ranges of it (code points) that the loss counts: the trained role's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN_START + escape(role).replace("\n", "\\\n") + "\n", escape(text)
        if role == TRAINED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, TURN_END, "\n"]
        at += len(head) + len(body) + len(TURN_END) + 1
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """format_turns undone. A text that isn't whole turns from end to end is refused."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def _tree_key(column: Column) -> Column:
    return F.when(column.isNull(), F.lit("none")).otherwise(F.concat(F.lit("="), column.cast("string")))


def _rooted(messages: DataFrame, own: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, depth, score) of every node that a root leads to, and jumps: the k-th has (tree, node, up) of 2 ** k steps.

    Pointer doubling: each round joins every node's furthest known ancestor with that ancestor's own row, so paths of d
    nodes take log2(d) self-joins, and only nodes that haven't reached their root are joined again. A row has a pointer,
    a depth and a summed score, never a path; texts aren't joined. A parent that doesn't exist makes its node a root. No
    path is longer than the number of nodes; what has no root after so many doublings is on a loop of parents or below
    one, and drops.
    """
    nodes = messages.select(F.col("tree").alias("q_tree"), F.col("node").alias("q_node"))
    rows = messages.join(nodes, (F.col("tree") == F.col("q_tree")) & (F.col("parent") == F.col("q_node")), "left")
    state = own.written(rows.select("tree", "node", F.when(F.col("q_node").isNotNull(), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "chat-nodes")
    most = state.count().bit_length() + 1
    done, jumps = [state.where("up is null")], []
    while len(jumps) < most and not (open_ := state.where("up is not null")).isEmpty():
        jumps.append(open_.select("tree", "node", "up"))
        everyone = reduce(DataFrame.union, [*done, open_])
        q = everyone.select(F.col("tree").alias("q_tree"), F.col("node").alias("q_node"), F.col("up").alias("q_up"), F.col("depth").alias("q_depth"), F.col("score").alias("q_score"))
        joined = open_.join(q, (F.col("tree") == F.col("q_tree")) & (F.col("up") == F.col("q_node")))
        state = own.written(joined.select("tree", "node", F.col("q_up").alias("up"), (F.col("depth") + F.col("q_depth")).alias("depth"), (F.col("score") + F.col("q_score")).alias("score")), "chat-nodes")
        done.append(state.where("up is null"))
    return reduce(DataFrame.union, done).select("tree", "node", "depth", "score"), jumps


def chosen_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, rank, at, node): the nodes, from the root on (at 1, 2, ...), of each tree's `best` root-to-leaf paths by the
    sum of their scores; ties: longer, then the smaller leaf. messages: tree, node (unique in its tree), parent, score.

    Only chosen leaves have their paths written out: from a leaf, one jump of each length doubles the nodes known.
    """
    with Scratch(messages.sparkSession) as own:
        rooted, jumps = _rooted(messages, own)
        parents = messages.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
        order = Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("depth").desc(), F.col("node"))
        leaves = rooted.join(parents, ["tree", "node"], "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        path = own.written(leaves.select("tree", "rank", "node"), "chat-path")
        for jump in jumps:
            longer = own.written(path.union(path.join(jump, ["tree", "node"]).select("tree", "rank", F.col("up").alias("node"))), "chat-path")
            own.drop(path)
            path = longer
        return written(path.join(rooted.select("tree", "node", F.col("depth").alias("at")), ["tree", "node"]).select("tree", "rank", "at", "node"), "chat-steps")


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """One row per chosen path: id, rank, formatted, loss_start, loss_end (arrays of code points).

    messages: id, tree, node (unique in its tree), parent (null: root), role, text, score. The turns of one path come
    together in one row, as their conversation must; nothing else is gathered. Null roles and texts count as empty; very
    long texts are formatted whole; other columns are ignored.
    """
    steps = chosen_paths(messages.select("tree", "node", "parent", "score"), best)
    turns = steps.join(messages.select("id", "tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "node"])
    whole = turns.groupBy("tree", "rank").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns.as_py()]) for turns in batch.column("turns")]
            spans = [[[s[k] for s in m[1]] for m in made] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rank"), pa.array([m[0] for m in made], pa.string()), *[pa.array(s, pa.list_(pa.int64())) for s in spans]], ["id", "rank", "formatted", "loss_start", "loss_end"])

    kind = messages.schema["id"].dataType.simpleString()
    return whole.select("id", "rank", "turns").mapInArrow(run, f"id {kind}, rank int, formatted string, loss_start array<bigint>, loss_end array<bigint>")


def conversation_trees(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each turn answers the one before it. Turns that share a number, or repeat, follow each other."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = df.select(F.col(id_col).alias("id"), _tree_key(F.col(id_col)).alias("tree"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    node = F.row_number().over(order).cast("long")
    return rows.withColumn("node", node).select("id", "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_conversations(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """format_trees for a table of turns: id, formatted, loss_start, loss_end; the id keeps its name.

    Null texts and roles are empty; rows of a null conversation id form one conversation; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = conversation_trees(df, id_col, turn_col, role_col, text_col)
    return format_trees(written(rows, "chat-rows")).select(F.col("id").alias(id_col), "formatted", "loss_start", "loss_end")


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """From format_conversations' rows alone: id, n_turns, turns (role, line break, text, line break of each), loss_text, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, turns, loss, chars = [], [], [], []
            for text, starts, ends in zip(*[batch.column(c).to_pylist() for c in ("formatted", "loss_start", "loss_end")], strict=True):
                read = read_turns(text)
                n.append(len(read))
                turns.append("".join(f"{role}\n{said}\n" for role, said in read))
                loss.append("".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True)))
                chars.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(loss, pa.string()), pa.array(chars, pa.int64())], ["_id", "n_turns", "turns", "loss_text", "formatted_chars"])

    kind = formatted.schema[id_col].dataType.simpleString()
    made = formatted.select(F.col(id_col).alias("_id"), "formatted", "loss_start", "loss_end").mapInArrow(run, f"_id {kind}, n_turns bigint, turns string, loss_text string, formatted_chars bigint")
    return made.withColumnRenamed("_id", id_col)
