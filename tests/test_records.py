"""Whole records: answers checked against the schema, leaves and records out of leaves, patches."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymere.operators import answers, attempts, corrections, paths, record_checks
from tallymere.sources.record_schema import ITEM, RECORD


def faults_of(spark, *docs):
    df = spark.createDataFrame([(k, json.dumps(d) if not isinstance(d, str) else d) for k, d in enumerate(docs)], "k int, text string")
    return {r["k"]: r["f"] for r in df.select("k", record_checks.faults(F.try_parse_json("text")).alias("f")).collect()}


CASES = [
    ({}, []),
    ({"line_items": [{"line_total": "abc"}]}, ["line_items[0].line_total: not a number"]),
    ({"receipt": {"date": 5}}, ["receipt.date: not a text"]),
    ({"totals": {"total": "12.50", "tax": 3, "change": 1e2, "tender": " -.5 ", "subtotal": None}}, []),
    ({"totals": {"total": "NaN", "tax": True, "change": "", "tender": "1,5"}}, [f"totals.{n}: not a number" for n in ("tax", "total", "tender", "change")]),
    ({"totals": {"tax_breakdown": [{"rate": "x"}, {"amount": [1]}], "prices_include_tax": "maybe"}}, ["totals.tax_breakdown[0].rate: not a number", "totals.tax_breakdown[1].amount: not a number", "totals.prices_include_tax: not true or false"]),
    ({"line_items": [{"position": "2", "is_template_row": "Yes"}, {"position": 2.0, "is_template_row": 0}, {"position": True}]}, []),
    ({"line_items": [{"position": 2.5}, {"position": None}, {"position": "x"}]}, [f"line_items[{k}].position: not a whole number" for k in range(3)]),
    ({"line_items": [{"modifiers": [{"amount": 1}, {"label": None}, "x"], "bbox": [1, "0.5", "y"]}]}, ["line_items[0].modifiers[0].label: missing", "line_items[0].modifiers[1].label: not a text", "line_items[0].modifiers[2]: not an object", "line_items[0].bbox[2]: not a number"]),
    ({"line_items": {"0": {}}, "merchant": None, "payment": [], "buyer": "x"}, ["merchant: not an object", "buyer: not an object", "line_items: not a list", "payment: not an object"]),
    ({"line_items": [1, None, []]}, [f"line_items[{k}]: not an object" for k in range(3)]),
    ({"meta": {"legibility": "blurry", "ambiguous_fields": ["a", 1], "notes": None, "is_refund": None}, "extra": [1]}, ["meta.is_refund: not true or false", "meta.legibility: not one of good, fair, poor, unreadable", "meta.ambiguous_fields[1]: not a text"]),
    ({"receipt": {"decimal_convention": None}}, ["receipt.decimal_convention: not one of point, comma"]),
    ("[1]", ["not an object"]),
    ("{", None),
]


def test_faults_by_path(spark):
    got = faults_of(spark, *[d for d, _ in CASES])
    assert got == {k: want for k, (_, want) in enumerate(CASES)}


def test_first_five_faults_become_the_error(spark):
    many = {"line_items": [{"qty": "x"} for _ in range(7)]}
    df = spark.createDataFrame([("so: " + json.dumps(many),), (json.dumps({"totals": {"total": "1.50"}}),), (None,)], "text string")
    rows = answers.with_record(df).select("error", "record.totals.total").collect()
    assert rows[0]["error"] == "not a number: " + ", ".join(f"line_items[{k}].qty" for k in range(5)) and rows[0]["total"] is None
    assert tuple(rows[1]) == (None, "1.50") and rows[2]["error"] == "empty answer"


def test_white_space_is_no_content(spark):
    df = spark.createDataFrame([(json.dumps({"merchant": {"name": "\t\n "}}),), (json.dumps({"merchant": {"name": " x"}}),)], "text string")
    assert [r[0] for r in answers.with_record(df).select(answers.has_content()).collect()] == [False, True]


DOCS = [
    {"merchant": {"name": "A"}, "line_items": [{"position": 0, "qty": 1.5, "modifiers": [{"label": "x", "amount": -1}, {"label": "y"}], "bbox": [0.1, 0.25]}, {"position": 1}], "totals": {"total": 5, "tax_breakdown": [{"rate": 0.12}]}, "meta": {"ambiguous_fields": ["a", "b"]}},
    {}, {"line_items": [{"position": k, "description_raw": f"d{k}"} for k in range(13)], "meta": {"notes": "[]"}},
    {"line_items": [{"modifiers": [{"label": "z"}]}, {"bbox": []}]},
]


def plain(value, path=""):
    """{path: leaf} by plain recursion."""
    if isinstance(value, dict):
        return {p: v for k, x in value.items() for p, v in plain(x, f"{path}.{k}" if path else k).items()}
    if isinstance(value, list):
        return {p: v for k, x in enumerate(value) for p, v in plain(x, f"{path}[{k}]").items()} or {path: "[]"}
    return {path: value}


@pytest.fixture(scope="module")
def whole(spark):
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(DOCS)], "doc_id long, t string").select("doc_id", F.from_json("t", RECORD).alias("record"))
    return df.select("doc_id", paths.with_defaults(F.col("record")).alias("record"))


def test_leaves_and_back(spark, whole):
    flat = paths.flattened(whole)
    got = {}
    for r in flat.collect():
        got.setdefault(r["doc_id"], {})[r["path"]] = r["value"]
    for r in whole.collect():
        want = {p: None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for p, v in plain(r["record"].asDict(True)).items()}
        assert got[r["doc_id"]] == want and list(got[r["doc_id"]]) == list(want)  # in the order of the schema
    shuffled = flat.select("doc_id", "path", "value").repartition(3, "path")
    assert {r["doc_id"]: r["record"] for r in paths.unflattened(shuffled).collect()} == {r["doc_id"]: r["record"] for r in whole.collect()}


def test_unflatten_fills_missing_places(spark):
    rows = [(1, "line_items[2].qty", "3"), (1, "line_items[0].modifiers[1].label", "m"), (1, "no.such.path", "x"), (2, "totals.total", None)]
    got = {r["doc_id"]: r["record"] for r in paths.unflattened(spark.createDataFrame(rows, "doc_id long, path string, value string")).collect()}
    items = got[1]["line_items"]
    assert len(items) == 3 and items[1] is None and str(items[2]["qty"]) == "3.0000" and items[0]["modifiers"][0] is None and items[0]["modifiers"][1]["label"] == "m"
    assert got[2]["totals"]["total"] is None and got[2]["line_items"] is None


def test_unflatten_of_other_schemas(spark):
    kind = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("b", T.ArrayType(T.StructType([T.StructField("c", T.ArrayType(T.StringType()))])))]))), T.StructField("d", T.IntegerType())])
    df = spark.createDataFrame([(1, '{"a":[{"b":[{"c":["x","y"]},{"c":[]}]},{"b":[]}],"d":4}'), (2, '{"a":[],"d":null}')], "doc_id long, t string").select("doc_id", F.from_json("t", kind).alias("record"))
    back = paths.unflattened(df.select("doc_id", F.inline(paths.leaves(F.col("record"), kind))), kind)
    assert {r["doc_id"]: r["record"] for r in back.collect()} == {r["doc_id"]: r["record"] for r in df.collect()}


def test_pairs_are_a_full_join_by_path(spark, whole):
    one, two = whole.alias("a"), whole.select((F.col("doc_id") + 1).alias("doc_id"), "record").alias("b")
    both = one.join(two, "doc_id").select("doc_id", F.inline(paths.paired_leaves(F.col("a.record"), F.col("b.record"))))
    flat = paths.flattened(whole)
    left, right = flat.where("doc_id > 0"), flat.select((F.col("doc_id") + 1).alias("doc_id"), "path", "kind", F.col("value").alias("right")).where("doc_id < 4")
    join = left.withColumnRenamed("value", "left").withColumn("l", F.lit(True)).join(right.withColumn("r", F.lit(True)), ["doc_id", "path", "kind"], "full_outer")
    want = {(r["doc_id"], r["path"], r["left"], r["right"], r["l"] or False, r["r"] or False) for r in join.collect()}
    got = [(r["doc_id"], r["path"], r["left"], r["right"], r["in_left"], r["in_right"]) for r in both.collect()]
    assert set(got) == want and len(got) == len(want)


def test_schema_of_items():
    assert [f.name for f in ITEM.fields][:3] == ["position", "description_raw", "sku"]


# --- patches, votes, asking again ---
def test_patches_are_whole_or_not_at_all(spark):
    lines = [{"position": 5, "qty": 1, "description_raw": "five"}, {"position": 2, "qty": 2}]
    doc = {"merchant": {"name": "Old"}, "line_items": lines, "totals": {"total": 9}}
    df = spark.createDataFrame([(k, json.dumps(doc), "needs_review") for k in range(8)], "doc_id long, t string, status string")
    stored = df.select("doc_id", paths.with_defaults(F.from_json("t", RECORD)).alias("record"), "status")
    changes = [
        (0, "line_items[5].qty", "7"), (0, "merchant.name", "New 4111111111111111"), (0, "totals.total", None),
        (1, "totals.total", "9"), (2, "totals.total", "1"), (2, "line_items[0].qty", "7"), (3, "merchant.name", "X"), (3, "totals.tax", "abc"),
        (4, "line_items[5].position", "2"), (5, "line_items[5].position", "2"), (5, "line_items[2].position", "5"), (6, "no.path", "x"), (99, "totals.total", "1"),
        (0, "line_items[2].description_raw", "two"), (0, "meta.is_handwritten", "yes"),
    ]
    made = corrections.patched(stored, spark.createDataFrame(changes, "doc_id long, path string, new_value string"))
    got = {r["doc_id"]: r for r in made.collect()}
    assert {k: (r["verdict"], r["status"], r["n_changed"]) for k, r in got.items()} == {
        0: ("reviewed", "reviewed", 5), 1: ("reviewed", "reviewed", 0), 2: ("refused", "needs_review", 0), 3: ("refused", "needs_review", 0), 4: ("refused", "needs_review", 0),
        5: ("reviewed", "reviewed", 2), 6: ("refused", "needs_review", 0), 7: ("kept", "needs_review", 0), 99: ("unknown", None, 0),
    }
    r = got[0]["record"]
    assert (r["merchant"]["name"], r["totals"]["total"], r["meta"]["is_handwritten"]) == ("New ************1111", None, True)
    assert [(x["position"], str(x["qty"]), x["description_raw"]) for x in r["line_items"]] == [(5, "7.0000", "five"), (2, "2.0000", "two")]
    assert [x["position"] for x in got[5]["record"]["line_items"]] == [2, 5]
    assert all(got[k]["record"] == got[7]["record"] for k in (2, 3, 4, 6))


def test_votes_by_path(spark):
    run = lambda total, *lines: {"totals": {"total": total}, "line_items": [{"description_raw": x} for x in lines]}
    rows = [(1, 0, run(1, "a")), (1, 1, run(2, "a", "b")), (1, 2, run(2, "a")), (2, 0, run(1)), (2, 1, run(2)), (3, 7, run(5, "z"))]
    df = spark.createDataFrame([(i, n, json.dumps(d)) for i, n, d in rows], "doc_id long, run int, t string").select("doc_id", "run", paths.with_defaults(F.from_json("t", RECORD)).alias("record"))
    votes = attempts.path_votes(df)
    got = {(r["doc_id"], r["path"]): r for r in votes.collect()}
    of = lambda i, p: (got[i, p]["value"], got[i, p]["disputed"], got[i, p]["readings"])
    assert of(1, "totals.total") == ("2.0000", True, ["1.0000", "2.0000"]) and abs(got[1, "totals.total"]["agreement"] - 2 / 3) < 1e-9
    assert of(1, "line_items[0].description_raw") == ("a", False, None)
    assert of(1, "line_items[1].description_raw") == (None, True, [None, "b"])
    assert of(2, "totals.total") == (None, True, ["1.0000", "2.0000"]) and of(2, "line_items") == ("[]", False, None)
    assert of(3, "totals.total") == ("5.0000", False, None) and got[3, "totals.total"]["agreement"] is None
    lists = {r["doc_id"]: r["disputed"] for r in attempts.disputed_lists(votes).collect()}
    assert lists[2] == ["totals.total"] and lists[3] == [] and "totals.total" in lists[1]
    record = {r["doc_id"]: r["record"] for r in attempts.consensus(votes).collect()}
    assert str(record[1]["totals"]["total"]) == "2.0000" and record[2]["totals"]["total"] is None and record[3]["line_items"][0]["description_raw"] == "z"


def test_asking_again(spark):
    rows = [
        (1, 0, True, 0, 3, 0, ["R011"]), (1, 1, True, 0, 0, 0, []),  # sound at once: the second is never called
        (2, 0, False, 2, 1, 9, ["R001", "R010", "R012"]), (2, 1, True, 1, 0, 2, ["R010"]), (2, 2, True, 0, 0, 0, []),
        (3, 0, True, 1, 0, 1, ["R020"]), (3, 1, True, 2, 0, 0, ["R020", "R010"]), (3, 2, False, 5, 0, 0, ["R001"]), (3, 3, True, 0, 0, 0, []),
        (4, 5, None, None, None, None, None), (5, 0, True, 1, 1, 0, ["R020", "R011"]), (5, 1, True, 1, 1, 0, ["R022", "R011"]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, seq long, parsed boolean, n_error int, n_warn int, n_null int, rules array<string>")
    got = {r["doc_id"]: tuple(r)[1:] for r in attempts.repaired(df, most_repairs=2).collect()}
    assert got == {
        1: (["extract"], 1, 0, 0, 3, [], 1), 2: (["extract", "re_extract", "repair"], 3, 2, 0, 0, ["R001", "R010", "R012"], 0),
        3: (["extract", "repair", "repair"], 1, 0, 1, 0, [], 1), 4: (["extract"], 1, 5, 0, 0, [], 0), 5: (["extract", "repair"], 1, 0, 1, 1, [], 0),
    }


def test_spread_of_stored_results(spark):
    from tallymere.operators import repeats

    made = [{"metrics": {"a": 1, "b": None, "c": "x", "d": True, "e": 5, "g": None}, "counts": {"failed": 2}, "results": [{"receipt_id": "r2"}, {"receipt_id": "r1"}]}, {"metrics": {"a": 4.5, "b": None, "c": 2, "g": "no"}, "results": [{"receipt_id": "r1"}, {"no": 1}]}, {"metrics": {"a": 2, "b": None, "d": None}}, {}]
    df = spark.createDataFrame([("x", json.dumps(m)) for m in made], "run string, t string").select("run", F.parse_json("t").alias("result"))
    got = {r["key"]: tuple(r)[2:] for r in repeats.spread_stored(df, "run").collect()}
    assert got == {"a": (1.0, 4.5, 2.0, 3, 1), "b": (None, None, None, 0, 4), "c": (2.0, 2.0, 2.0, 1, 2), "e": (5.0, 5.0, 5.0, 1, 3)}
    assert {r["key"] for r in repeats.spread_stored(df).collect()} == set(got)
    for by in (("run",), ()):
        r = repeats.aggregate(df, *by).first()
        assert (r["n_repeats"], r["n_failed"], r["spread_omitted"], r["scored"]) == (4, 2, ["d", "g"], ["r1", "r2"])


def test_newest_results_file(spark, tmp_path):
    import os

    from tallymere.operators import repeats

    for name, text, at in (("a/1.json", '{"v":1}', 100), ("a/2.json", '{"v":2}', 300), ("b/3.json", '{"v":3}', 200), ("b/4.json", '{"v":4}', 200), ("b/5.txt", '{"v":5}', 900), ("b/6.json", "[1]", 50)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (at, at))
    files = repeats.stored_results(spark, f"file://{tmp_path}").select(F.regexp_extract("file_path", "/([ab])/", 1).alias("d"), "file_path", "modified", F.to_json("result").alias("t"))
    assert files.where("t is null").count() == 1
    assert {(r["d"], r["t"]) for r in repeats.newest(files, "d").collect()} == {("a", '{"v":2}'), ("b", '{"v":4}')}


def test_requests_and_their_hashes(spark):
    from tallymere.operators import prompts

    t = prompts.Templates()
    df = spark.createDataFrame([(None, None, [], None, "A {lines}", None, None), ("laser", 3, ["blurry", "glare"], True, "B", ["x {print}"], ['{"n":1}'])], "p string, n int, i array<string>, h boolean, m string, k array<string>, e array<string>")
    c = F.col
    made = prompts.extraction_prompt(c("p"), c("n"), c("i"), c("h"), c("m"), c("k"), c("e"))
    plain, full = (r[0] for r in df.select(made).collect())
    assert plain == t.extraction.format(hints="", examples="", print="unknown", lines="unknown", issues="nothing", handwriting="")
    shots = t.examples.format(n=1) + t.example.format(k=1, record='{"n":1}')
    assert full == t.extraction.format(hints=t.hints.format(merchant="B", lines="- x {print}"), examples=shots, print="laser", lines=3, issues="blurry, glare", handwriting=t.handwriting)
    again = [r[0] for r in df.select(prompts.repair_prompt(F.struct(c("m").alias("name"), c("p").alias("x")), F.lit(" \n"))).collect()]
    assert again[0] == t.repair.replace("{record}", '{"name":"A {lines}","x":null}').replace("{findings}", "(none)")
    assert prompts.bundle_hash() == prompts.bundle_hash(prompts.Templates()) != prompts.bundle_hash(prompts.Templates(triage="other"))
    schema = prompts.tool_schema()
    line = schema["properties"]["line_items"]["items"]
    assert line["properties"]["qty"]["type"] == ["number", "string", "null"] and line["properties"]["position"] == {"type": "integer", "default": 0}
    assert line["properties"]["modifiers"]["items"]["required"] == ["label"] and schema["properties"]["meta"]["properties"]["legibility"]["enum"][0] == "good"
    rung = df.select(prompts.rung_identity(F.lit("m"), F.lit(True)).alias("r")).select("r.*").first()
    assert tuple(rung) == ("1", prompts.bundle_hash(), "m", True)


def test_canonical_form(spark):
    from tallymere.operators import normalise

    docs = [
        {"merchant": {"name": "Ａ\x00 b\t", "address": None}, "receipt": {"date": "03/04/2026", "currency": "$"}, "line_items": [{"position": 1, "description_raw": " é x"}, {"position": 0, "description_raw": "y"}]},
        {"receipt": {"date": "13/04/26", "date_raw": "kept", "currency": " usd"}, "line_items": [{"position": 2, "description_raw": "p"}, {"position": 2, "description_raw": "q"}], "totals": {"total": 1.5}},
        {"receipt": {"date": "03/04/26", "date_raw": "printed"}}, {"receipt": {"date": "soon"}},
    ]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(9, None)], "doc_id long, t string").select("doc_id", F.from_json("t", RECORD).alias("record"))
    df = df.select("doc_id", F.when(F.col("record").isNotNull(), paths.with_defaults(F.col("record"))).alias("record"))
    got = {r["doc_id"]: r["record"] for r in normalise.normalised(df, None, F.lit("php")).collect()}
    assert got[0]["merchant"]["name"] == "A b" and (got[0]["receipt"]["date"], got[0]["receipt"]["date_raw"], got[0]["receipt"]["currency"]) == (None, "03/04/2026", "PHP")
    assert [(x["position"], x["description_raw"]) for x in got[0]["line_items"]] == [(0, "y"), (1, "é x")]
    assert (got[1]["receipt"]["date"], got[1]["receipt"]["date_raw"], got[1]["receipt"]["currency"]) == ("2026-04-13", "kept", "USD")
    assert [(x["position"], x["description_raw"]) for x in got[1]["line_items"]] == [(0, "p"), (1, "q")] and str(got[1]["totals"]["total"]) == "1.5000"
    assert (got[2]["receipt"]["date"], got[2]["receipt"]["date_raw"]) == (None, "printed") and got[3]["receipt"]["date"] == "soon" and got[9] is None
