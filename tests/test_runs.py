import random
import re

from pyspark.sql import functions as F

from tallymere.operators import answers, runs


def plain_blob(text):
    """The object in an answer, or None: a walk over its characters."""
    if not text or not text.strip():
        return None
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    inner = fence[1] if fence else text
    at = inner.find("{")
    depth, quoted, skip = 0, False, False
    for n in range(at, len(inner) if at >= 0 else at):
        c = inner[n]
        if quoted and skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return re.sub(r",\s*([}\]])", r"\1", inner[at : n + 1])
    return None


def test_blob_like_plain_walk(spark):
    r = random.Random(7)
    bits = ["{", "}", '"', "\\", ",", "]", " ", "é", "\U0001f600", "a", "\n", "```", "```json", " "]
    texts = [None, "", " \n", "x", "{}", '{"a": "}"} }', "{" * 300 + "}" * 300, '{"k": "' + '\\"' * 30000 + '"}', "{" + "x" * 200000 + "}"]
    texts += ["".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(1500)]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")
    got = {x.n: x.blob for x in answers.with_blob(rows).collect()}
    assert [got[n] for n in range(len(texts))] == [plain_blob(t) for t in texts]


def test_record_keeps_values_and_names_bad_paths(spark):
    texts = ['{"totals": {"total": 12.50, "tax": 1e2}}', '{"totals": {"total": "abc", "tax": "x"}}', "{'totals': {}}", None, '{"totals": {"total": null}}', '{"line_items": []}', '{"merchant": {"name": " A "}}']
    rows = answers.with_record(spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string")).withColumn("full", answers.has_content())
    got = {x.n: x for x in rows.collect()}
    assert got[0].record.totals.total == "12.5" and got[0].full
    assert got[1].error == "not a number: totals.tax, totals.total" and got[1].record is None
    assert got[2].error == "invalid JSON" and got[3].error == "empty answer"
    assert not got[4].full and not got[5].full and got[6].full


def test_outcomes_over_rungs(spark):
    rows = [(1, 0, "s", True, False), (1, 1, "l", False, True), (2, 0, "s", False, False), (2, 1, "l", True, False), (3, 0, "s", False, True), (3, 1, "l", False, True), (4, 0, "s", False, False), (4, 1, "l", False, False)]
    frame = spark.createDataFrame(rows, "doc_id long, rung int, model_id string, call_failed boolean, usable boolean").withColumn("cost_usd", F.lit("0.5").cast("decimal(18,6)")).withColumn("latency_ms", F.lit(3).cast("long"))
    got = {x.doc_id: (x.rung, x.failed, x.read_nothing, float(x.cost_usd), x.latency_ms) for x in runs.outcomes(frame).collect()}
    assert got == {1: (1, False, False, 1.0, 6), 2: (1, True, True, 1.0, 6), 3: (0, False, False, 1.0, 6), 4: (1, False, True, 1.0, 6)}


def test_stored_rows_and_reviewed_ones(spark):
    old = spark.sql("select * from values (1L, 'reviewed', 1.5, 0.7), (2L, 'pending', 2.5, 0.6), (3L, 'rejected', 3.5, 0.5) t(doc_id, status, total, confidence)")
    failed = spark.sql("select * from values (1L), (2L), (9L) t(doc_id)")
    got = {x.doc_id: (x.status, float(x.confidence), x.queued) for x in runs.failures_landed(old, failed).collect()}
    assert got == {1: ("reviewed", 0.7, True), 2: ("needs_review", 0.0, True), 3: ("rejected", 0.5, False), 9: ("needs_review", 0.0, True)}
    new = spark.sql("select * from values (1L, 9.5, 0.9), (2L, 8.5, 0.9), (7L, 7.5, 0.9) t(doc_id, total, confidence)")
    got = {x.doc_id: (float(x.total), x.verdict) for x in runs.saved(old, new).collect()}
    assert got == {1: (1.5, "refused"), 2: (8.5, "updated"), 3: (3.5, "kept"), 7: (7.5, "inserted")}


def test_path_keys_and_waits(spark):
    paths = ["b[10].x", "b[2].x", "b", "a.c", "b[2]", "a"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [x.p for x in rows.orderBy(runs.sort_key(F.col("p"))).collect()] == ["a", "a.c", "b", "b[2]", "b[2].x", "b[10].x"]
    waits = spark.range(1, 8).select(runs.retry_wait(F.col("id"))).collect()
    assert [w[0] for w in waits] == [1, 2, 4, 8, 16, 30, 30]
