"""Jobs lent to workers for a while: what isn't finished in time goes back to the queue, and every result lands once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that a worker has for a job.
LEASE_S = 900
OUT = "job_id bigint, event string, worker bigint, at timestamp, attempt int, result string"
_STATE = "status string, worker bigint, until_us bigint, attempt int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime(1970, 1, 1)


def _us(at) -> int:
    return int(pd.Timestamp(at).value // 1000)


def _time(us: int) -> datetime:
    return _EPOCH + timedelta(microseconds=us)


class Leases(StatefulProcessor):
    """One job: queued, taken until a time, or done. Events: enqueue, take and done, by time and then event_id.

    A job that is there already isn't enqueued again (`duplicate`), a take of one that isn't queued and a done of one that
    was never enqueued are `stale`, as is a second done. A job whose time is over before it is done is `requeued` at that
    time, whether an event shows it or the watermark does; the first result counts even if it comes late. A done
    job keeps a row of state, so that its duplicates are known.
    """

    def __init__(self, seconds: int = LEASE_S):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def _held(self) -> list:
        return list(self.job.get()) if self.job.exists() else [None, None, None, 0]

    def _over(self, job: list, us: int, out: list, key: int) -> list:
        """The job as it is at a time: back in the queue if its lease ended before."""
        if job[0] == "taken" and job[2] < us:
            out.append((key, "requeued", job[1], _time(job[2]), job[3], None))
            return ["queued", None, None, job[3]]
        return job

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job, out, id_ = self._held(), [], int(key[0])
        was = job[2]
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        for e in events.itertuples(index=False):
            us = _us(e.ts)
            job = self._over(job, us, out, id_)
            worker = None if pd.isna(e.worker) else int(e.worker)
            said = "stale"
            if e.kind == "enqueue":
                said = "queued" if job[0] is None else "duplicate"
                job = ["queued", None, None, 0] if job[0] is None else job
            elif e.kind == "take" and job[0] == "queued":
                said, job = "taken", ["taken", worker, us + self.seconds * 1_000_000, job[3] + 1]
            elif e.kind == "done" and job[0] in ("queued", "taken"):
                said, job = "landed", ["done", worker, None, job[3]]
            out.append((id_, said, worker, e.ts.to_pydatetime(), job[3], e.result if said == "landed" else None))
        if job[0] is not None:
            self.job.update(tuple(job))
        if was is not None and was != job[2]:
            self.handle.deleteTimer(was // 1000 + 1)
        if job[2] is not None and was != job[2]:
            self.handle.registerTimer(job[2] // 1000 + 1)  # the first whole millisecond after it
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out: list = []
        job = self._over(self._held(), expiredTimerInfo.getExpiryTimeInMs() * 1000, out, int(key[0]))
        if out:
            self.job.update(tuple(job))
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["job_id", "event", "worker", "at", "attempt", "result"])
    return f.astype({"job_id": "int64", "worker": "Int64", "attempt": "int32", "at": "datetime64[ns]"})


def lease_events(events: DataFrame, seconds: int = LEASE_S, late: str = "0 seconds") -> DataFrame:
    """What becomes of jobs, from a stream of (job_id, event_id, ts, kind, worker, result): the rows of OUT, as they happen.

    Keys are jobs, with one row of state each and one timer while they are taken. Rows of a null job are left out.
    """
    keyed = events.where("job_id is not null and ts is not null").withWatermark("ts", late)
    return keyed.groupBy("job_id").transformWithStateInPandas(Leases(seconds), outputStructType=OUT, outputMode="append", timeMode="eventTime")


@contextmanager
def rocks(spark: SparkSession):
    """While this holds, streams that start keep their state in RocksDB, which timers need."""
    old = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if old is None else spark.conf.set(_PROVIDER, old)


