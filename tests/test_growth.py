"""What queries deal out and store as their tables grow: no row a leaf, nothing worked out twice."""

import json
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tallymere import catalogue
from tallymere.operators import evaluation, paths
from tallymere.sources.record_schema import RECORD
from tallymere.sources.shared import sweeping

from .oracle import SF


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_rebuilt_without_a_row_a_leaf(spark):
    plan = plan_of(catalogue.QUERIES["record_rebuilt"](spark, SF))
    assert "Generate" not in plan and "leaves-" not in plan


def test_leaves_in_any_order_make_one_record(spark):
    doc = {"line_items": [{"position": k, "modifiers": [{"label": f"m{k}"}] * (k % 3), "bbox": [0.5] * (k % 2)} for k in range(12)], "meta": {"ambiguous_fields": ["a", "b"]}}
    df = spark.createDataFrame([(json.dumps(doc),)], "t string").select(F.from_json("t", RECORD).alias("r")).select(paths.with_defaults(F.col("r")).alias("r"))
    said = F.concat(paths.leaves(F.col("r")), F.array(*[F.struct(F.lit(p).alias("path"), F.lit("text").alias("kind"), F.lit(v).alias("value")) for p, v in (("line_items[3].sku", "b"), ("line_items[3].sku", "a"), ("nope[2].x", "1"), ("line_items[x].sku", "1"))]))
    # Of the repeated path, the null of the record itself, a and b, the greatest stays.
    got = df.select("r", paths.assembled(F.reverse(said)).alias("back")).first()
    want = got["r"].asDict(True)
    want["line_items"][3]["sku"] = "b"
    assert got["back"].asDict(True) == want


def test_votes_deal_no_leaves(spark):
    assert "Generate" not in plan_of(catalogue.QUERIES["path_votes"](spark, SF))


def test_whole_breakdown_joins_no_leaves(spark):
    plan = plan_of(catalogue.QUERIES["field_breakdown_whole"](spark, SF))
    assert "Generate" not in plan and "FullOuter" not in plan


def test_lines_meet_by_position(spark):
    kind = "array<struct<position:int,n:string>>"
    cases = [("[]", "[]"), ("[(0,a)]", "[]"), ("[(2,a),(0,b)]", "[(0,c),(1,d),(2,e)]"), ("[(1,a),(1,b)]", "[(1,c)]"), ("[(None,a)]", "[(None,b),(0,c)]")]
    read = lambda t: [(None if k == "None" else int(k), n) for k, n in (x.strip("()").split(",") for x in t[1:-1].split("),(") if x)]
    df = spark.createDataFrame([(read(p), read(t)) for p, t in cases], f"p {kind}, t {kind}")
    for r in df.select("*", evaluation.lines_met(F.col("p"), F.col("t")).alias("m")).collect():
        want = [(p["n"], t["n"]) for p in r["p"] for t in r["t"] if p["position"] is not None and p["position"] == t["position"]]
        want += [(p["n"], None) for p in r["p"] if p["n"] not in [a for a, _ in want]] + [(None, t["n"]) for t in r["t"] if t["n"] not in [b for _, b in want]]
        name = lambda x: None if x is None else x["n"]
        got = [(name(x["p"]), name(x["t"])) for x in r["m"]]
        assert len(got) == len(want) and set(got) == set(want)


def test_fuzzy_lines_are_gathered_once_a_side(spark):
    plan = plan_of(catalogue.QUERIES["line_item_f1_fuzzy"](spark, SF))
    assert "FlatMapGroupsInPandas" not in plan and plan.count("Join FullOuter") == 1


def test_similarity_bounds_lose_no_pair():
    words = ["", "A", "RED ANVIL", "RED  ANVIL", "BLUE ANVIL", "ANVIL RED", "LIGHT WIDGET " * 30, "LIGHT WIDGETS " * 30]
    for x in words:
        for y in words:
            ratio = SequenceMatcher(None, x, y).ratio()
            assert evaluation._met([x], [y], 0.6) == ([0, 0] if ratio >= 0.6 else [])


def test_repair_text_is_made_once(spark):
    plan = plan_of(catalogue.QUERIES["repair_prompt_top12"](spark, SF))
    assert not [x for x in plan.splitlines() if "Filter" in x and "array_join" in x]


def test_answers_are_parsed_once_for_what_is_saved(spark):
    assert plan_of(catalogue.QUERIES["extractions_saved"](spark, SF)).count("Union") == 1


def test_swept_writes_leave_no_shuffle_files(spark, tmp_path):
    kept = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = kept()
    with sweeping(spark):
        spark.range(1000).repartition(3, "id").write.parquet(str(tmp_path / "t"))
    deadline = time.time() + 10
    while kept() > before and time.time() < deadline:
        time.sleep(0.2)
    assert kept() <= before
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000
