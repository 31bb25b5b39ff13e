"""Leases of jobs as a stream: lost workers, duplicates, late results, whatever the batches."""

from datetime import datetime, timedelta

import pytest

from tallymere.streaming import leases, queue

T0 = datetime(2026, 1, 1)
#: (job, seconds, kind, worker, result)
EVENTS = [
    (1, 0, "enqueue", None, None), (1, 10, "take", 7, None), (1, 60, "done", 7, "a"),
    (2, 0, "enqueue", None, None), (2, 5, "enqueue", None, None), (2, 20, "take", 7, None), (2, 1500, "take", 8, None), (2, 1600, "done", 8, "b"), (2, 1700, "done", 7, "late"),
    (3, 0, "take", 7, None), (3, 1, "done", 7, "never"), (4, 0, "enqueue", None, None), (4, 30, "take", 9, None),  # 4's worker is lost
    (5, 0, "enqueue", None, None), (5, 40, "take", 9, None), (5, 2000, "done", 9, "c"), (6, 5000, "enqueue", None, None), (6, 5010, "take", 9, None), (6, 5020, "take", 8, None),
]
WANT = {
    (1, "queued", 0), (1, "taken", 10), (1, "landed", 60), (2, "queued", 0), (2, "duplicate", 5), (2, "taken", 20), (2, "requeued", 920), (2, "taken", 1500), (2, "landed", 1600), (2, "stale", 1700),
    (3, "stale", 0), (3, "stale", 1), (4, "queued", 0), (4, "taken", 30), (4, "requeued", 930), (5, "queued", 0), (5, "taken", 40), (5, "requeued", 940), (5, "landed", 2000),
    (6, "queued", 5000), (6, "taken", 5010), (6, "stale", 5020),
}


@pytest.mark.parametrize("files", [1, 4])
def test_leases(spark, tmp_path, files):
    rows = sorted(EVENTS, key=lambda e: e[1])
    schema = "job_id bigint, event_id bigint, ts timestamp_ntz, kind string, worker bigint, result string"
    step = -(-len(rows) // files)
    for n in range(files):
        part = [(j, n * step + k, T0 + timedelta(seconds=s), kind, w, r) for k, (j, s, kind, w, r) in enumerate(rows[n * step : (n + 1) * step])]
        df = spark.createDataFrame(part, schema).selectExpr("job_id", "event_id", "cast(ts as timestamp) as ts", "kind", "worker", "result")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    with leases.rocks(spark):
        out = queue.run_to_table(leases.lease_events(stream), f"file://{tmp_path}/out", "append").collect()
    assert sorted((r["job_id"], r["event"], int((r["at"] - T0).total_seconds())) for r in out) == sorted(WANT)
    assert {(r["job_id"], r["result"]) for r in out if r["event"] == "landed"} == {(1, "a"), (2, "b"), (5, "c")}
    assert {r["attempt"] for r in out if r["job_id"] == 2 and r["event"] == "landed"} == {2}
