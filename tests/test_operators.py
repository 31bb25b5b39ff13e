"""Duplicates, merchants, the queue, patches, evaluation, ingest and sources on small cases."""

import json
import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallymere.operators import corrections, dedupe, entities, evaluation, ingest, listing, review
from tallymere.sources import readers


def test_near_pairs_are_complete(spark):
    rng = random.Random(2)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    for h in hashes[:40]:
        flips = rng.sample(range(64), rng.randint(0, 8))
        hashes.append(h ^ sum(1 << f for f in flips))
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    got = {(r["a"], r["b"]): r["distance"] for r in dedupe.near_pairs(spark.createDataFrame(list(enumerate(signed)), "id long, hash long")).collect()}
    want = {(i, j): (hashes[i] ^ hashes[j]).bit_count() for i in range(100) for j in range(i + 1, 100) if (hashes[i] ^ hashes[j]).bit_count() <= 5}
    assert got == want and want


def test_hex_hash_with_upper_bit(spark):
    row = spark.createDataFrame([("ffffffffffffffff", "8000000000000001")], "a string, b string").select(dedupe.hash_from_hex(F.col("a")).alias("a"), dedupe.hash_from_hex(F.col("b")).alias("b")).first()
    assert (row["a"], row["b"]) == (-1, -(1 << 63) + 1)


def test_semantic_duplicates_need_all_keys(spark):
    rows = [(1, 7, "2026-01-01", "5.00", 1), (2, 7, "2026-01-01", "5.00", 0), (3, None, "2026-01-01", "5.00", 2), (4, None, "2026-01-01", "5.00", 3), (5, 7, None, "5.00", 4), (6, 7, "2026-01-01", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, merchant_id long, d string, t string, created_rank int").select("doc_id", "merchant_id", F.col("d").cast("date").alias("txn_date"), F.col("t").cast("decimal(14,4)").alias("total"), "created_rank")
    plain = {tuple(r) for r in dedupe.semantic_duplicates(df).collect()}
    assert plain == {(1, 2)}
    assert {tuple(r) for r in dedupe.semantic_duplicates(df, True).collect()} == {(1, 2), (4, 3)}


def test_links_refuse_cycles(spark):
    links = lambda rows: spark.createDataFrame(rows, "id long, target long")
    roots = {r["id"]: (r["root"], r["hops"], r["cyclic"]) for r in dedupe.link_roots(links([(1, 2), (2, 3), (3, 4), (5, 6), (6, 5), (7, 5)])).collect()}
    assert roots == {1: (4, 3, False), 2: (4, 2, False), 3: (4, 1, False), 5: (None, None, True), 6: (None, None, True), 7: (None, None, True)}
    known = spark.range(10)
    got = {(r["id"], r["target"]): r["accepted"] for r in dedupe.accepted_links(links([(4, 1), (8, 8), (9, 6), (0, 77)]), links([(1, 2), (2, 4)]), known).collect()}
    assert got == {(4, 1): False, (8, 8): False, (9, 6): True, (0, 77): False}


def test_ambiguous_names_resolve_to_nothing(spark):
    merchants = spark.createDataFrame([(1, "Acme Inc", "T1", None), (2, "Acme Ltd", None, None), (3, "Solo", "T3", "Solo Mart")], "merchant_id long, canonical_name string, tax_id string, variant string")
    names = spark.createDataFrame([(1, "ACME"), (2, "solo mart #4"), (3, "nobody"), (4, None)], "doc_id long, name string")
    assert {r[0]: r[1] for r in entities.lookup(names, merchants).collect()} == {1: None, 2: 3, 3: None, 4: None}
    docs = spark.createDataFrame([(1, "ACME", "T1"), (2, "Solo", "T9")], "doc_id long, name string, tax_id string")
    assert {r[0]: r[1] for r in entities.resolve(docs, merchants).collect()} == {1: 1, 2: 3}
    new = {tuple(r) for r in entities.confirm_variants(spark.createDataFrame([("Acme Corner", "T1"), ("Solo", "T1"), ("Both", "T1"), ("Both", "T3")], "name string, tax_id string"), merchants).collect()}
    assert new == {(1, "Acme Corner")}


def events(spark, steps):
    at = datetime(2026, 1, 1)
    rows = [(k, at + timedelta(minutes=k), user, receipt, action, priority) for k, (receipt, action, user, priority) in enumerate(steps)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, receipt_id long, action string, priority int")


def test_queue_life(spark):
    steps = [(1, "claim", 5, 0), (1, "enqueue", 0, 2), (1, "enqueue", 0, 1), (1, "enqueue", 0, 3), (1, "claim", 5, 0), (1, "claim", 6, 0), (2, "enqueue", 0, 0), (2, "close", 0, 0), (2, "close", 0, 0), (3, "enqueue", 0, 2), (3, "claim", 8, 0), (3, "release", 0, 0), (4, "enqueue", 0, 1), (4, "close", 0, 0), (4, "enqueue", 0, 2)]
    tasks = review.fold_events(events(spark, steps))
    got = {r["receipt_id"]: (r["state"], r["priority"], r["assigned_to"], r["closed_at"] is None) for r in tasks.collect()}
    assert got == {1: ("in_progress", 1, 5, True), 2: ("done", 0, None, False), 3: ("open", 2, None, True), 4: ("open", 2, None, True)}
    assert next(r for r in tasks.collect() if r["receipt_id"] == 2)["closed_at"] == datetime(2026, 1, 1, 0, 7)
    users = spark.createDataFrame([(5,), (9,), (10,), (11,)], "user_id long")
    given = {r["user_id"]: (r["receipt_id"], r["resumed"]) for r in review.next_task(tasks, users).collect()}
    assert given == {5: (1, True), 9: (3, False), 10: (4, False), 11: (None, False)}


def test_patches_are_whole_or_nothing(spark):
    rows = [(1, "totals.total", "12.5"), (1, "meta.is_handwritten", "No"), (2, "totals.total", "NaN"), (2, "merchant.name", "x"), (3, "receipt.currency", "EURO"), (4, "line_items[0].qty", "2"), (4, "line_items[9].qty", "2"), (5, "totals.tax", None), (6, "receipt.date", "2026-3-1"), (7, "payment.card_last4", "4111-1111-1111-1234"), (8, "merchant.name", "4111111111111111 Shop")]
    plan = corrections.planned(spark.createDataFrame(rows, "doc_id long, path string, new_value string"))
    ok = {(r["doc_id"], r["path"]): (r["value"], r["ok"], r["patch_ok"]) for r in plan.collect()}
    assert ok[1, "totals.total"] == ("12.5000", True, True) and ok[1, "meta.is_handwritten"] == ("false", True, True)
    assert ok[2, "merchant.name"][2] is False and not ok[3, "receipt.currency"][1] and not ok[6, "receipt.date"][1]
    assert ok[5, "totals.tax"] == (None, True, True) and ok[7, "payment.card_last4"][0] == "1234" and ok[8, "merchant.name"][0] == "************1111 Shop"
    current = spark.createDataFrame([(1, "totals.total", "12.5000"), (1, "meta.is_handwritten", "true"), (4, "line_items[0].qty", "1.0000"), (5, "totals.tax", "3.0000")], "doc_id long, path string, value string")
    rows = {(r["doc_id"], r["path"]): (r["value_before"], r["value_after"]) for r in corrections.audit(plan, current).collect()}
    assert rows[1, "meta.is_handwritten"] == ("true", "false") and rows[5, "totals.tax"] == ("3.0000", None) and (1, "totals.total") not in rows and not any(d in (2, 3, 4, 6) for d, _ in rows)


def test_field_classes_tile_the_paths(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, path string, kind string, value string")
    truth = make([(1, "merchant.name", "text", "A  b"), (1, "totals.tax", "money", None), (1, "totals.total", "money", "5.00"), (1, "line_items[0].qty", "money", "1"), (1, "line_items[1].qty", "money", None), (1, "meta.x", "bool", "true")])
    pred = make([(1, "merchant.name", "text", "a B"), (1, "totals.tax", "money", "1"), (1, "totals.total", "money", "5.01"), (1, "line_items[0].qty", "money", "2"), (1, "meta.x", "bool", "true"), (1, "line_items[2].qty", "money", None)])
    got = {r["path"]: (r["class"], r["ok"]) for r in evaluation.field_results(pred, truth).collect()}
    assert got == {"merchant.name": ("core", True), "totals.tax": ("hallucinated", False), "totals.total": ("core", True), "line_items[0].qty": ("line_items", False), "line_items[1].qty": ("structural", False), "line_items[2].qty": ("structural", False), "meta.x": ("self_report", True)}


def test_all_orders_are_voted_on(spark):
    from tallymere import catalogue

    folder = "/root/testdata/sf0.001"
    orders = {r[0] for r in spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey").collect()}
    rows = catalogue.QUERIES["majority_vote_all"](spark, folder).collect()
    assert {r["doc_id"] for r in rows} == orders and len(rows) == len(orders) and any(r["doc_id"] % 3 for r in rows)


def test_whole_records_are_evaluated(spark):
    from tallymere import catalogue

    run = lambda name: catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert {("core", True), ("core", False), ("line_items", True), ("self_report", True)} <= {(r["class"], r["ok"]) for r in run("field_accuracy_whole")}
    assert sum(r["core_total"] for r in run("field_breakdown_whole")) > 0
    paths = run("flatten_paths_whole")
    assert {"buyer.tax_id", "totals.tax", "line_items[0].qty", "line_items"} <= {r["path"] for r in paths}
    assert sum(r["n_null"] for r in run("null_counts_whole")) == sum(r["value"] is None for r in paths) > sum(r["n_null"] for r in run("null_counts"))


def test_line_scores(spark):
    make = lambda rows: spark.createDataFrame([(1, p, n, D(q), D("1"), D(t)) for p, n, q, t in rows], "doc_id long, position int, description_raw string, qty decimal(12,4), unit_price decimal(14,4), line_total decimal(14,4)")
    truth, pred = make([(0, "MILK", "1", "1"), (1, "BREAD", "2", "2"), (2, "EGGS", "1", "3")]), make([(0, "milk", "1", "1"), (1, "BREADS", "2", "2"), (2, "SOAP", "1", "9")])
    exact, fuzzy = evaluation.line_scores_exact(pred, truth).first(), evaluation.line_scores_fuzzy(pred, truth).first()
    assert (exact["tp"], fuzzy["tp"]) == (1, 2) and abs(fuzzy["f1"] - 2 / 3) < 1e-9


def test_numbers_in_parallel(spark):
    rows = spark.range(5000, numPartitions=7).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = review.numbered(rows, "a", "b")
        assert "Window [sum" in (plan := got._jdf.queryExecution().toString()) and "row_number" not in plan
        found = {(r["a"], r["b"]): r["n"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts)
    assert found == {key: k for k, key in enumerate(sorted((x % 3, x) for x in range(5000)), 1)}


def test_every_user_is_served(spark):
    from tallymere import catalogue

    folder = "/root/testdata/sf0.01"
    users = spark.read.parquet(f"{folder}/events.parquet").select("user_id").distinct().count()
    rows = catalogue.QUERIES["review_next_for_all_users"](spark, folder).collect()
    given = [r["receipt_id"] for r in rows if r["receipt_id"] is not None]
    assert len(rows) == len({r["user_id"] for r in rows}) == users > 20 and len(given) == len(set(given))


def test_calibration_spread_and_votes(spark):
    results = spark.createDataFrame([(D("0.900"), True), (D("0.900"), False), (D("0.300"), True)], "confidence decimal(4,3), critical_correct boolean")
    curve = {r["threshold"]: (r["rate"], r["precision"]) for r in evaluation.calibration(results).collect()}
    assert curve[D("1.000")] == (0.0, 1.0) and curve[D("0.900")] == (2 / 3, 0.5) and curve[D("0.000")][0] == 1.0 and len(curve) == 11
    s = {r["metric"]: tuple(r)[1:] for r in evaluation.spread(spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("a", 5.0), ("a", None), ("b", None)], "metric string, value double")).collect()}
    assert s == {"a": (1.0, 5.0, 2.0, 4, 1), "b": (None, None, None, 0, 1)}
    v = {r["doc_id"]: tuple(r)[1:] for r in evaluation.votes(spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "y"), (2, None), (3, None), (3, None), (3, "z"), (4, "q"), (4, "q"), (4, "q")], "doc_id long, value string"), 3).collect()}
    assert v == {1: ("x", 2 / 3, True), 2: (None, 1 / 3, True), 3: (None, 2 / 3, True), 4: ("q", 1.0, False)}


def test_pages_and_export_cap(spark):
    rows = spark.range(12).withColumnRenamed("id", "doc_id")
    got = listing.page(rows, F.col("doc_id"), limit=5, offset=5).collect()
    assert [r["doc_id"] for r in got] == [5, 6, 7, 8, 9] and all(r["has_more"] for r in got)
    assert not any(r["has_more"] for r in listing.page(rows, F.col("doc_id"), limit=5, offset=10).collect())
    with pytest.raises(ValueError):
        listing.guard_export(rows, 11)
    assert listing.guard_export(rows, 12).count() == 12


def test_upload_gate_on_files(spark, tmp_path):
    for name, data in {"a.jpg": b"\xff\xd8\xff\xe0data", "b.gif": b"GIF89a", "d.pdf": b"%PDF-1.7", "e.png": b"<html>", "f.webp": b"RIFF\0\0\0\0WEBPVP8 ", "g.heic": b"\0\0\0\x18ftypheic"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["ok"], r["reason"], r["content_type"]) for r in ingest.gated_files(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": (True, None, "image/jpeg"), "b.gif": (False, "unsupported ending", None), "d.pdf": (True, None, "application/pdf"), "e.png": (False, "unknown content", None), "f.webp": (True, None, "image/webp"), "g.heic": (True, None, "image/heic")}


def test_tall_strips_cover_the_image(spark):
    rows = [(100, 300), (100, 301), (100, 1000), (50, 2000), (0, 10), (33, 500)]
    for w, h, strips in spark.createDataFrame(rows, "w int, h int").select("w", "h", ingest.tall_strips(F.col("w"), F.col("h"))).collect():
        assert strips[0]["top"] == 0 and strips[-1]["bottom"] == h and all(b["top"] <= a["bottom"] for a, b in zip(strips, strips[1:]))
        assert len(strips) == 1 if h <= 3 * w or w == 0 else len(strips) > 1


def test_label_files(spark, tmp_path):
    label = {"merchant": {"name": "A"}, "line_items": [{"line_total": "12.10"}], "totals": {"total": "892.86"}, "meta": {}, "extra": 1}
    (tmp_path / "r1.json").write_text(json.dumps(label, indent=1))
    (tmp_path / "TEMPLATE.json").write_text("{}")
    row = readers.with_defaults(readers.read_labels(spark, str(tmp_path))).first()
    assert row["file_name"] == "r1.json" and row["totals"]["total"] == "892.86" and row["line_items"][0]["position"] == 0 and row["meta"]["legibility"] == "good" and row["meta"]["is_refund"] is False
    (tmp_path / "bad.json").write_text("{nope")
    with pytest.raises(Exception, match="(?i)malformed|bad.json"):
        readers.read_labels(spark, str(tmp_path)).collect()
    loose = {r["file_name"]: r["corrupt"] for r in readers.read_labels(spark, str(tmp_path), strict=False).collect()}
    assert loose["r1.json"] is None and "nope" in loose["bad.json"]


def test_jobs_and_upserts(spark):
    messages = spark.createDataFrame([('{"id": "1", "image_key": "k"}',), ("{broken",), ('{"id": "2"}',), (None,)], "payload string")
    jobs, dead = readers.split_jobs(messages)
    assert [r["id"] for r in jobs.collect()] == ["1"] and dead.count() == 3
    base = spark.createDataFrame([(1, "reviewed", "a"), (2, "pending", "b")], "doc_id long, status string, v string")
    delta = spark.createDataFrame([(1, "needs_review", "x"), (2, "auto_approved", "y"), (3, "pending", "z")], "doc_id long, status string, v string")
    assert {tuple(r) for r in readers.upsert(base, delta, "doc_id").collect()} == {(1, "reviewed", "a"), (2, "auto_approved", "y"), (3, "pending", "z")}


def test_runs_are_never_overwritten(spark, tmp_path):
    readers.write_once(spark.range(1), str(tmp_path / "run"))
    with pytest.raises(Exception, match="(?i)exists"):
        readers.write_once(spark.range(1), str(tmp_path / "run"))


def test_long_chains_and_hubs_of_links(spark):
    links = [(k, k + 1) for k in range(1, 300)] + [(1000 + k, 300) for k in range(200)] + [(2000, 2001), (2001, 2002), (2002, 2001)]
    roots = {r["id"]: (r["root"], r["hops"], r["cyclic"]) for r in dedupe.link_roots(spark.createDataFrame(links, "id long, target long")).collect()}
    assert roots == {**{k: (300, 300 - k, False) for k in range(1, 300)}, **{1000 + k: (300, 1, False) for k in range(200)}, **{k: (None, None, True) for k in (2000, 2001, 2002)}}


def test_many_copies_of_one_image(spark):
    """Classes, their members and their pairs are all near pairs, and first matches those of all images, without multiplying copies."""
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(6)]
    hashes = [base[0]] * 40 + [base[0] ^ 1] * 30 + [base[1], base[1] ^ 3, base[2], base[3]] + [base[4], base[4]]
    rng.shuffle(hashes)
    rows = [(k * 3 + 1, h, rng.randint(0, 4)) for k, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "id long, hash long, created int")
    near = {(a, b): (x ^ y).bit_count() for a, x, _ in rows for b, y, _ in rows if a < b and (x ^ y).bit_count() <= 5}
    member = {r["id"]: r["class_id"] for r in dedupe.class_members(df.select("id", "hash")).collect()}
    pairs = {(r["a"], r["b"]): r for r in dedupe.class_pairs(df.select("id", "hash")).collect()}
    told = {(a, b): 0 if member[a] == member[b] else pairs[tuple(sorted((member[a], member[b])))]["distance"] for a, b in near}
    assert told == near and sum(r["n_a"] * r["n_b"] for r in pairs.values()) == sum(d > 0 for d in near.values())
    counts = {r["distance"]: r["n"] for r in dedupe.distance_counts(df.select("id", "hash")).collect()}
    assert counts == {d: list(near.values()).count(d) for d in set(near.values())}
    key = {i: (c, i) for i, _, c in rows}
    close = {i: [j for j in key if (min(i, j), max(i, j)) in near] for i in key}
    want = {i: min(close[i], key=key.get) for i in key if close[i] and min(key[j] for j in close[i]) < key[i]}
    assert {r["id"]: r["duplicate_of"] for r in dedupe.first_match(df).collect()} == want


def test_null_users_and_priorities_in_both_folds(spark, tmp_path):
    from tallymere.streaming import queue

    at = datetime(2026, 1, 1)
    rows = [(1, 0, "enqueue", None, 2), (1, 1, "enqueue", None, None), (1, 2, "claim", None, 1), (1, 3, "claim", 2**60 + 1, None), (2, 0, "enqueue", 5, None), (2, 1, "enqueue", None, 1), (3, 4, "claim", 5, 1), (3, 5, "enqueue", None, None), (3, 6, "close", None, None)]
    df = spark.createDataFrame([(r, at + timedelta(seconds=s), n, a, u, p) for n, (r, s, a, u, p) in enumerate(rows)], "receipt_id long, ts timestamp, event_id long, action string, user_id long, priority int")
    want = {1: ("in_progress", 2, 2**60 + 1), 2: ("open", 1, None), 3: ("done", None, None)}
    assert {r["receipt_id"]: (r["state"], r["priority"], r["assigned_to"]) for r in review.fold_events(df).collect()} == want
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = queue.run_to_table(queue.queue_updates(stream), f"file://{tmp_path}/out", "update").collect()
    assert {r["receipt_id"]: (r["state"], r["priority"], r["assigned_to"]) for r in out} == want


def test_links_from_the_smallest_id(spark):
    least = -(2**63)
    got = {r["id"]: (r["root"], r["hops"]) for r in dedupe.link_roots(spark.createDataFrame([(least, 1), (1, 5), (7, least)], "id long, target long")).collect()}
    assert got == {least: (5, 2), 1: (5, 1), 7: (5, 3)}


def test_worst_severity(spark):
    from tallymere.operators import rules

    df = spark.createDataFrame([([("R1", "warn"), ("R2", "error"), ("R3", "info")],), ([("R3", "info")],), ([],)], "findings array<struct<rule_id:string,severity:string>>")
    assert [r[0] for r in df.select(rules.worst_severity()).collect()] == ["error", "info", None]


def test_blobs_and_workbooks(spark, tmp_path):
    from tallymere.plans import ledger_queries

    from .oracle import SF

    files = spark.createDataFrame([(1, b"a", datetime(2026, 3, 1)), (2, b"b", datetime(2025, 12, 31))], "id long, content binary, arrived timestamp")
    readers.write_blobs(files, f"{tmp_path}/blobs", "arrived")
    assert {(r["id"], r["yyyy"], r["mm"]) for r in spark.read.parquet(f"{tmp_path}/blobs").collect()} == {(1, 2026, 3), (2, 2025, 12)}
    names = ("export_receipts_sheet", "needs_review_sheet", "export_summary")
    sheets = {n: ledger_queries.QUERIES[n](spark, SF) for n in names}
    readers.write_sheets(sheets, f"{tmp_path}/book")
    for n, rows in sheets.items():
        back = spark.read.option("header", True).option("multiLine", True).csv(f"{tmp_path}/book/{n}")
        assert back.columns == rows.columns and back.count() == rows.count()


def test_windowed_counts(spark, tmp_path):
    from tallymere.streaming import queue

    at = datetime(2026, 1, 1)
    rows = [(at + timedelta(minutes=m), t, float(m)) for m, t in ((1, "a"), (50, "a"), (59, "b"), (61, "a"), (600, "z"))]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    out = queue.run_to_table(queue.by_window(stream), f"file://{tmp_path}/out", "append").collect()
    got = {(int((r["window"]["start"] - at).total_seconds()) // 3600, r["event_type"]): (r["n"], r["value"]) for r in out}
    assert got == {(0, "a"): (2, 51.0), (0, "b"): (1, 59.0), (1, "a"): (1, 61.0)}
