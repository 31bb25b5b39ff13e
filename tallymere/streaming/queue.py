"""Structured Streaming: the review queue as a stateful fold, and job ids taken once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.review import apply_event

STATE = "state string, priority int, assigned_to bigint, opened_at timestamp, closed_at timestamp, n_events bigint"
OUT = f"receipt_id bigint, {STATE}"


def queue_updates(events: DataFrame) -> DataFrame:
    """A row for each receipt that a micro-batch touches: its task after the batch's events in the order (ts, event_id).

    State is one task a receipt; receipts without a task keep none.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["state", "priority", "assigned_to", "opened_at", "closed_at"]
        *held, n = state.get if state.exists else (None,) * 6
        task, n = (dict(zip(names, held, strict=True)) if state.exists and held[0] is not None else None), n or 0
        for e in pd.concat([b for b in batches if len(b)]).sort_values(["ts", "event_id"]).itertuples(index=False):
            n += e.action != "view"
            whole = lambda x: None if pd.isna(x) else int(x)
            task = apply_event(task, e.action, whole(e.priority), whole(e.user_id), None if pd.isna(e.ts) else e.ts.to_pydatetime())
        clean = lambda x: None if x is None or pd.isna(x) else x
        row = tuple(clean(task[k]) for k in names) if task else (None,) * 5
        state.update((*row, int(n)))
        yield pd.DataFrame([(key[0], *row, int(n))], columns=["receipt_id", *names, "n_events"]).astype({"priority": "Int64", "assigned_to": "Int64", "opened_at": "datetime64[ns]", "closed_at": "datetime64[ns]"})

    # Pandas makes floats of whole numbers beside nulls; as text an id keeps all its digits.
    exact = events.withColumn("user_id", F.col("user_id").cast("string"))
    return exact.groupBy("receipt_id").applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def taken_once(jobs: DataFrame, time_col: str = "ts", within: str = "1 day", id_col: str = "receipt_id") -> DataFrame:
    """Jobs whose id wasn't seen within the watermark: delivery is at least once, work is done once."""
    return jobs.withWatermark(time_col, within).dropDuplicatesWithinWatermark([id_col])


def by_window(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of events by tumbling window and type (an extension for metrics)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def run_to_table(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Drains a stream into a Parquet table with its own checkpoint; every micro-batch is a folder, so a repeated batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number:06d}")

    spark: SparkSession = stream.sparkSession
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
