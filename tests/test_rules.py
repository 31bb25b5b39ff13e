"""Each rule fires on a document changed for it and is silent on a clean one."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymere.operators import rules, scoring
from tallymere.operators.records import ITEM
from tallymere.operators.rules import RuleConfig, with_findings

MONEY = "decimal(14,4)"
SCHEMA = (
    f"doc_id long, merchant_id long, txn_date date, subtotal {MONEY}, tax {MONEY}, discount {MONEY}, total {MONEY}, merchant_name string, buyer_name string, buyer_tax_id string, date_text string, date_raw string, currency string,"
    f"tender {MONEY}, change {MONEY}, band_a {MONEY}, band_b {MONEY}, prices_include_tax boolean, is_refund boolean, is_handwritten boolean, n_ambiguous int, legibility string, n_issues int, estimate int, ocr_text string,"
    f"disputes_total boolean, disputes_address boolean, parse_failed boolean, line_items array<{ITEM}>"
)


def line(position, qty, price, total, text="ITEM", template=False, modifiers=()):
    dec = lambda x: None if x is None else D(str(x))
    return (position, text, dec(qty), dec(price), dec(total), [("promo", D(str(m))) for m in modifiers], template)


CLEAN = {
    "doc_id": 1, "merchant_id": 1, "txn_date": date(2026, 7, 20), "subtotal": D("847.50"), "tax": D("101.70"), "discount": D("0.00"), "total": D("949.20"), "merchant_name": "Corner Shop", "buyer_name": "TALLYMERE INC", "buyer_tax_id": "123-456-789",
    "date_text": "2026-07-20", "date_raw": None, "currency": "PHP", "tender": D("1000.00"), "change": D("50.80"), "band_a": None, "band_b": None, "prices_include_tax": None, "is_refund": False, "is_handwritten": False, "n_ambiguous": 0, "legibility": "good",
    "n_issues": 0, "estimate": 3, "ocr_text": None, "disputes_total": False, "disputes_address": False, "parse_failed": False,
    "line_items": [line(0, 1, "100.00", "100.00", "A"), line(1, 2, "125.00", "250.00", "B"), line(2, 5, "99.50", "497.50", "C")],
}


def found(spark, config=None, **changes):
    row = CLEAN | changes
    names = [c.strip().split(" ")[0] for c in SCHEMA.split(",")]
    df = spark.createDataFrame([tuple(row[f.name] for f in T._parse_datatype_string(SCHEMA))], SCHEMA)
    assert names
    return [(f["rule_id"], f["severity"]) for f in with_findings(df, config).first()["findings"]]


def test_clean_document_is_silent(spark):
    assert found(spark) == []


LINES = CLEAN["line_items"]
CASES = {
    "R001": [({"parse_failed": True}, "error")],
    "R010": [({"total": None, "tender": None}, "error")],
    "R011": [({"date_text": None}, "warn"), ({"date_text": None, "date_raw": "03/04/26"}, "info")],
    "R012": [({"merchant_name": "  "}, "warn"), ({"merchant_name": None}, "warn")],
    "R013": [({"line_items": []}, "warn")],
    "R014": [({"buyer_name": None}, "warn")],
    "R015": [({"buyer_tax_id": "999"}, "error"), ({"buyer_tax_id": "-", "buyer_name": "Somebody"}, "warn")],
    "R020": [({"line_items": LINES[:2]}, "error")],
    "R021": [({"line_items": [line(0, 1, "100.00", "100.00", "A"), line(1, 2, "125.00", "250.00", "B"), line(2, 5, "99.00", "497.50", "C")]}, "error")],
    "R022": [({"total": D("959.20"), "tender": None}, "error")],
    "R023": [({"change": D("40.80")}, "warn")],
    "R024": [({"subtotal": None, "line_items": LINES[:2]}, "warn")],
    "R025": [({"band_a": D("50.00"), "band_b": D("50.00")}, "warn")],
    "R030": [({"date_text": "2026-3-1"}, "error"), ({"date_text": "2026-02-30"}, "error")],
    "R031": [({"date_text": "2026-07-28"}, "error")],
    "R032": [({"date_text": "2010-01-01"}, "warn")],
    "R033": [({"currency": "XAF"}, "warn"), ({"currency": "$"}, "warn")],
    "R040": [({"total": D("-949.20"), "tender": None}, "error")],
    "R041": [({"total": D("2000000"), "tender": None}, "warn")],
    "R042": [({"line_items": [*LINES[:2], line(2, 1, "90.00", "90.00", "D"), line(3, 1, "50000.00", "50000.00", "E")]}, "warn")],
    "R043": [({"line_items": [line(0, 20000, "1.00", "20000.00", "A")]}, "warn"), ({"line_items": [line(0, 0, "1.00", "0.00", "A")]}, "warn")],
    "R044": [({"tax": D("500.00")}, "warn")],
    "R045": [({"discount": D("-900.00")}, "warn")],
    "R050": [({"line_items": [LINES[0], line(1, 1, "100.00", "100.00", "A")]}, "info")],
    "R051": [({"line_items": [line(1, 1, "100.00", "100.00", "A"), line(2, 2, "125.00", "250.00", "B")]}, "info")],
    "R052": [({"line_items": [*LINES, line(3, None, None, "847.50", "SUBTOTAL: 847.50")]}, "error"), ({"line_items": [*LINES, line(3, None, None, None, "Round off")]}, "warn")],
    "R053": [({"line_items": [*LINES[:2], line(2, 5, "99.50", "497.50", " ")]}, "warn")],
    "R060": [({"ocr_text": "corner shop 100.00"}, "warn")],
    "R061": [({"ocr_text": "somebody else 949.20"}, "info")],
    "R070": [({"disputes_total": True}, "warn"), ({"disputes_address": True}, "info")],
}


@pytest.mark.parametrize("rule_id,change,severity", [(r, c, s) for r, cases in CASES.items() for c, s in cases])
def test_rule_fires(spark, rule_id, change, severity):
    assert (rule_id, severity) in found(spark, **change)


def test_every_rule_has_a_case():
    assert set(CASES) == set(rules.REGISTRY) and len(rules.REGISTRY) == 30


def test_silent_where_inputs_are_missing(spark):
    assert not [f for f in found(spark, subtotal=None, total=None, tax=None, tender=None, line_items=[]) if f[0] not in ("R010", "R013")]


def test_template_rows_are_no_purchases(spark):
    blank = line(3, None, None, None, "PREMIUM 97", template=True)
    assert found(spark, line_items=[*LINES, blank]) == []


def test_tax_inclusive_lines_pass_without_a_flag_and_fail_with_it(spark):
    lines = [line(0, 1, "949.20", "949.20", "A")]
    assert found(spark, line_items=lines) == []
    assert ("R020", "error") in found(spark, line_items=lines, prices_include_tax=False)
    assert found(spark, line_items=lines, prices_include_tax=True) == []


def test_overlay_changes_a_tolerance(spark):
    change = {"total": D("949.40"), "tender": None}
    assert ("R022", "error") in found(spark, RuleConfig().overlay(tolerance={"R022": ("0", "0.02")}), **change)
    assert ("R022", "error") not in found(spark, RuleConfig().overlay(tolerance={"R022": ("0", "0.30")}), **change)


def test_confidence_is_clamped_and_routed(spark):
    df = spark.createDataFrame([tuple((CLEAN | {"total": None, "date_text": None, "merchant_name": None, "is_handwritten": True, "legibility": "poor", "n_ambiguous": 9})[f.name] for f in T._parse_datatype_string(SCHEMA))], SCHEMA)
    row = scoring.scored(with_findings(df)).first()
    assert (row["confidence"], row["status"], row["priority"]) == (D("0.000"), "needs_review", 0)
    df = spark.createDataFrame([tuple(CLEAN[f.name] for f in T._parse_datatype_string(SCHEMA))], SCHEMA)
    row = scoring.scored(with_findings(df)).first()
    assert (row["confidence"], row["status"], row["priority"], row["reasons"]) == (D("1.000"), "auto_approved", -1, [])


def test_summary_and_repair_text(spark):
    one = lambda r, s: F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit("m").alias("message"), F.array(F.lit("p")).alias("field_paths"))
    many = F.array(*[one("R020", "error")] * 9, *[one("R012", "warn")] * 5, one("R051", "info"))
    row = spark.range(1).select(many.alias("findings")).select(rules.summary_text().alias("s"), rules.repair_text().alias("r")).first()
    assert row["s"] == "9 error(s), 5 warning(s), 1 info: R012, R020, R051"
    assert row["r"].splitlines()[0] == "[R020] m" and row["r"].endswith("... and 2 further problems.") and len(row["r"].splitlines()) == 13


@pytest.mark.parametrize("rule_id,changes", [
    ("R012", {"merchant_name": "\t\n"}), ("R012", {"merchant_name": "　\xa0"}), ("R014", {"buyer_name": "\n"}), ("R053", {"line_items": [line(0, 1, "847.50", "847.50", "\t\r\n")]}),
    ("R052", {"line_items": [*LINES, line(3, None, None, None, "ＴＯＴＡＬ：８４７．５０", template=True)]}),
    ("R050", {"line_items": [*LINES[:2], line(2, 5, "99.50", "497.50", "Ｃａｆé"), line(3, 5, "99.50", "497.50", "Café")], "subtotal": D("1345.00"), "total": D("1446.70"), "tender": None}),
    ("R061", {"merchant_name": "ＣＯＲＮＥＲ ＳＨＯＰ", "ocr_text": "SOMETHING ELSE 949.20"}),
    ("R015", {"buyer_tax_id": None, "buyer_name": "Ｔａｌｌｙｍｅｒｅ Straße"}),
])
def test_texts_beyond_ascii_and_white_space(spark, rule_id, changes):
    assert rule_id in {r for r, _ in found(spark, **changes)}


@pytest.mark.parametrize("changes", [
    {"merchant_name": "ＣＯＲＮＥＲ ＳＨＯＰ", "ocr_text": "corner shop 949.20"}, {"buyer_tax_id": None, "buyer_name": "ＴＡＬＬＹＭＥＲＥ　Inc.\t"},
    {"currency": "PHP\n", "date_text": "2026-07-20\t"},
])
def test_forms_of_the_same_text_are_silent(spark, changes):
    assert found(spark, **changes) == []
