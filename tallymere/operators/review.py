"""The review queue as a fold over events, its visible tasks and its statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import held

STATE = "receipt_id bigint, state string, priority int, assigned_to bigint, opened_at timestamp, closed_at timestamp, n_events bigint"


def _more_urgent(a: int | None, b: int | None) -> int | None:
    """The smaller of two priorities; one that isn't given comes after all others."""
    return b if a is None else a if b is None else min(a, b)


def apply_event(task: dict | None, action: str, priority: int | None, user: int | None, ts) -> dict | None:
    """One step of a task's life: none - enqueue -> open - claim -> in_progress - close -> done; release and enqueue lead back to open.

    A smaller or equal priority replaces the one there, and one that isn't given replaces none; a done task that is
    enqueued opens anew; closing twice keeps the first time; a claim by nobody and what doesn't fit the state change nothing.
    """
    if action == "enqueue":
        if task is None:
            return {"state": "open", "priority": priority, "assigned_to": None, "opened_at": ts, "closed_at": None}
        if task["state"] == "done":
            return task | {"state": "open", "priority": priority, "assigned_to": None, "opened_at": ts, "closed_at": None}
        return task | {"priority": _more_urgent(task["priority"], priority)}
    if task is None:
        return None
    if action == "claim" and task["state"] == "open" and user is not None:
        return task | {"state": "in_progress", "assigned_to": user}
    if action == "close" and task["state"] != "done":
        return task | {"state": "done", "closed_at": ts}
    if action == "release" and task["state"] == "in_progress":
        return task | {"state": "open", "assigned_to": None}
    return task


def fold_events(events: DataFrame) -> DataFrame:
    """State of each receipt's task after its events in the order (ts, event_id).

    Events go by receipt and are sorted inside partitions; one pass folds them with a single task in memory, so a
    receipt with very many events needs no more than one with few. Nulls are allowed in every column: events without a
    time come first, and a null receipt is one of its own.
    """

    schema = pa.schema([("receipt_id", pa.int64()), ("state", pa.string()), ("priority", pa.int32()), ("assigned_to", pa.int64()), ("opened_at", pa.timestamp("us", "UTC")), ("closed_at", pa.timestamp("us", "UTC")), ("n_events", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, task, n, began, out = None, None, 0, False, []

        def done():
            if task is not None:
                out.append({"receipt_id": current, **task, "n_events": n})

        for batch in batches:
            for receipt, ts, action, priority, user in zip(*[batch.column(c).to_pylist() for c in ("receipt_id", "ts", "action", "priority", "user_id")], strict=True):
                if not began or receipt != current:
                    done()
                    current, task, n, began = receipt, None, 0, True
                if action != "view":
                    n += 1
                task = apply_event(task, action, priority, user, ts)
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        done()
        yield pa.RecordBatch.from_pylist(out, schema)

    dealt = events.select("receipt_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "action", F.col("priority").cast("int").alias("priority"), F.col("user_id").cast("bigint").alias("user_id"))
    dealt = dealt.repartition("receipt_id").sortWithinPartitions("receipt_id", "ts", "event_id")
    return dealt.mapInArrow(run, STATE)


def visible_tasks(tasks: DataFrame, user: int | None) -> DataFrame:
    """Open tasks and one's own; without a user (an admin) all of them."""
    return tasks if user is None else tasks.where((F.col("state") == "open") | (F.col("assigned_to") == user))


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """rows with n, their place from 1 in the order of `by`, whose values tell all rows apart.

    Rows are dealt by range and sorted; each task numbers its own, and the tasks' counts shift the numbers. The rows
    are held before counting, as a second sampling could draw other bounds.
    """
    kept = held(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()), "queue")
    part = F.shiftright("_id", 33)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    shift = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    at = F.col("_id").bitwiseAND((1 << 33) - 1)
    return kept.join(F.broadcast(shift), part == F.col("_part")).select(*rows.columns, (at + F.col("_shift") + 1).alias("n"))


def next_task(tasks: DataFrame, users: DataFrame) -> DataFrame:
    """For each user their earliest task in progress, else the k-th open task for the k-th user without one: no task is given twice."""
    tasks = held(tasks, "queue")
    mine = tasks.where("state = 'in_progress'").groupBy(F.col("assigned_to").alias("user_id")).agg(F.min(F.struct("opened_at", "receipt_id")).alias("first"))
    asked = users.join(mine.select("user_id", F.col("first.receipt_id").alias("own")), "user_id", "left")
    waiting = numbered(asked.where("own is null").select("user_id"), "user_id")
    claimable = numbered(tasks.where("state = 'open'").select("priority", "opened_at", "receipt_id"), "priority", "opened_at", "receipt_id")
    given = waiting.join(claimable.select("n", "receipt_id"), "n", "left").select("user_id", "receipt_id", F.lit(False).alias("resumed"))
    return asked.where("own is not null").select("user_id", F.col("own").alias("receipt_id"), F.lit(True).alias("resumed")).union(given)


def queue_stats(tasks: DataFrame) -> DataFrame:
    """Counts by state and the open backlog by priority, as (metric, n)."""
    sets = tasks.groupingSets([["state"], ["state", "priority"]], "state", "priority").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("g") == 1, F.concat(F.lit("state:"), "state")).otherwise(F.concat(F.lit("open_priority:"), F.col("priority").cast("string")))
    return sets.where((F.col("g") == 1) | (F.col("state") == "open")).select(name.alias("metric"), "n")
