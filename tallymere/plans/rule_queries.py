"""Queries over the rules, the score and the routing, with SQL that states each rule over plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules, scoring
from ..operators.records import records
from ..operators.rules import RuleConfig, findings_table, with_findings
from ..sources.adapters import TODAY, sql

#: Thresholds near the data, so that the plausibility rules have something to find in it.
NARROW = RuleConfig().overlay(most_total="150000", price_outlier="1.2", most_qty="45", most_tax_rate="0.11")

_SUMS = """s as (select doc_id, cast(count(*) as int) as n_rows, cast(sum(case when not is_template_row then 1 else 0 end) as int) as n_purchases,
 case when sum(case when not is_template_row and line_total is null then 1 else 0 end) = 0 then sum(case when not is_template_row then line_total + modifier_amount end) end as line_sum
 from v_items group by doc_id),
h as (select v_headers.*, coalesce(n_rows, 0) as n_rows, coalesce(n_purchases, 0) as n_purchases, line_sum from v_headers left join s using (doc_id)),
p as (select * from v_items where not is_template_row),
d as (select *, upper(regexp_replace(regexp_replace(upper(description_raw), '[\\s:.\\-]*[-+]?[\\d,]+(?:[.,]\\d+)?\\s*$', ''), '[^A-Z0-9 ]+', ' ', 'g')) as raw_norm from v_items),
i as (select *, trim(regexp_replace(raw_norm, '\\s+', ' ', 'g')) as norm from d)"""


def _off(a: str, b: str, rel: str = "0.0002", floor: str = "0.02") -> str:
    return f"not coalesce(abs({a} - ({b})) <= greatest({floor}, {rel} * greatest(abs({a}), abs({b}))), false)"


def _fits_none(net: str, gross: str, rel: str, floor: str) -> str:
    use_net, use_gross = f"(prices_include_tax is distinct from true and ({net}) is not null)", f"(prices_include_tax is distinct from false and ({gross}) is not null)"
    return f"line_sum is not null and ({use_net} or {use_gross}) and not ({use_net} and not {_off('line_sum', net, rel, floor)}) and not ({use_gross} and not {_off('line_sum', gross, rel, floor)})"


_NUMBER = "regexp_replace(coalesce(buyer_tax_id, ''), '[^0-9]', '', 'g')"
_NAME = "lower(trim(buyer_name))"
_STRICT = "case when regexp_matches(trim(date_text), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') then try_cast(trim(date_text) as date) end"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"

#: For each rule, rows of (doc_id, severity): one for each finding.
RULE_SQL: dict[str, str] = {
    "R001": "select doc_id, 'error' as severity from h where parse_failed",
    "R010": "select doc_id, 'error' as severity from h where total is null",
    "R011": "select doc_id, case when coalesce(date_raw, '') <> '' then 'info' else 'warn' end as severity from h where date_text is null",
    "R012": "select doc_id, 'warn' as severity from h where trim(coalesce(merchant_name, '')) = ''",
    "R013": "select doc_id, 'warn' as severity from h where estimate <> 0 and n_rows = 0",
    "R014": "select doc_id, 'warn' as severity from h where trim(coalesce(buyer_name, '')) = ''",
    "R015": f"select doc_id, case when {_NUMBER} <> '' then 'error' else 'warn' end as severity from h where case when {_NUMBER} <> '' then {_NUMBER} <> '123456789' else buyer_name is not null and {_NAME} <> 'tallymere inc.' end",
    "R020": f"select doc_id, 'error' as severity from h where subtotal is not null and {_fits_none('subtotal', 'total', '0.0002', 'greatest(0.05, 0.01 * n_purchases)')}",
    "R021": f"select doc_id, 'error' as severity from p where qty is not null and unit_price is not null and line_total is not null and {_off('qty * unit_price', 'line_total', '0.0005', '0.05')}",
    "R022": f"select doc_id, 'error' as severity from h where subtotal is not null and total is not null and {_off('(subtotal + coalesce(tax, 0) - abs(coalesce(discount, 0)))', 'total')}",
    "R023": f"select doc_id, 'warn' as severity from h where tender is not null and total is not null and change is not null and {_off('(tender - total)', 'change')}",
    "R024": f"select doc_id, 'warn' as severity from h where subtotal is null and total is not null and {_fits_none('total - coalesce(tax, 0) + abs(coalesce(discount, 0))', 'total', '0.0005', 'greatest(0.10, 0.01 * n_purchases)')}",
    "R025": f"select doc_id, 'warn' as severity from h where band_a is not null and band_b is not null and tax is not null and {_off('(band_a + band_b)', 'tax')}",
    "R030": f"select doc_id, 'error' as severity from h where date_text is not null and {_STRICT} is null",
    "R031": f"select doc_id, 'error' as severity from h where {_STRICT} - date '{TODAY}' > 1",
    "R032": f"select doc_id, 'warn' as severity from h where date '{TODAY}' - {_STRICT} > 3650",
    "R033": f"select doc_id, 'warn' as severity from h where coalesce(currency, '') <> '' and upper(trim(currency)) not in {_IN(rules.FAMILIAR_CURRENCIES)}",
    "R040": "select doc_id, 'error' as severity from h where not is_refund and total <= 0",
    "R041": "select doc_id, 'warn' as severity from h where total is not null and abs(total) not between 0.01 and 150000",
    "R042": "select doc_id, 'warn' as severity from (select *, count(*) filter (unit_price > 0) over w as n, median(unit_price) filter (unit_price > 0) over w as med from p window w as (partition by doc_id)) where n >= 4 and unit_price > 0 and unit_price > 1.2 * med",
    "R043": "select doc_id, 'warn' as severity from p where qty is not null and not (qty > 0 and qty <= 45)",
    "R044": "select doc_id, 'warn' as severity from h where tax is not null and subtotal > 0 and not (tax >= 0 and tax <= 0.11 * subtotal)",
    "R045": "select doc_id, 'warn' as severity from h where abs(discount) > subtotal",
    "R050": """select doc_id, 'info' as severity from (select *, lag(norm) over w as n0, lag(qty) over w as q0, lag(unit_price) over w as u0, lag(line_total) over w as t0, lag(position) over w as p0
 from i where not is_template_row window w as (partition by doc_id order by position)) where p0 is not null and norm <> '' and norm = n0 and qty is not distinct from q0 and unit_price is not distinct from u0 and line_total is not distinct from t0""",
    "R051": "select doc_id, 'info' as severity from v_items group by doc_id having list_sort(list(position)) <> range(count(*))",
    "R052": f"select doc_id, case when norm in {_IN(rules.SUMMARY_ROWS)} then 'error' else 'warn' end as severity from i where norm in {_IN(rules.SUMMARY_ROWS + rules.SUMMARY_ROWS_PERHAPS)}",
    "R053": "select doc_id, 'warn' as severity from v_items where trim(coalesce(description_raw, '')) = ''",
    "R060": "select doc_id, 'warn' as severity from h where coalesce(ocr_text, '') <> '' and total is not null and not contains(regexp_replace(ocr_text, '[^0-9]', '', 'g'), regexp_replace(cast(cast(round_even(abs(total), 2) as decimal(14,2)) as varchar), '[^0-9]', '', 'g'))",
    "R061": """select doc_id, 'info' as severity from (select doc_id, list_distinct(string_split(upper(trim(regexp_replace(merchant_name, '\\s*[0-9]+\\s*$', ''))), ' ')) as mine,
 list_distinct(string_split(trim(regexp_replace(regexp_replace(regexp_replace(upper(ocr_text), '[\\s:.\\-]*[-+]?[\\d,]+(?:[.,]\\d+)?\\s*$', ''), '[^A-Z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) as theirs
 from h where coalesce(ocr_text, '') <> '' and trim(coalesce(merchant_name, '')) <> '') where len(list_intersect(mine, theirs)) * 10 < len(mine) * 6""",
    "R070": "select doc_id, 'warn' as severity from h where disputes_total union all select doc_id, 'info' from h where disputes_address",
}
_NARROW_RULES = ("R041", "R042", "R043", "R044")
_ALL = "f as (" + " union all ".join(f"select '{r}' as rule_id, doc_id, severity from ({q})" for r, q in RULE_SQL.items()) + ")"
_PER_DOC = """e as (select h.*, coalesce(n_error, 0) as n_error, coalesce(n_warn, 0) as n_warn, coalesce(n_info, 0) as n_info, ids from h left join
 (select doc_id, count(*) filter (severity = 'error') as n_error, count(*) filter (severity = 'warn') as n_warn, count(*) filter (severity = 'info') as n_info, string_agg(distinct rule_id, ', ' order by rule_id) as ids from f group by doc_id) using (doc_id))"""
_SCORE = """c as (select *, cast(round(least(1, greatest(0, 1.000
 - case when n_error > 0 then 0.35 else 0 end + greatest(-0.08 * n_warn, -0.30) - case legibility when 'fair' then 0.10 when 'poor' then 0.25 else 0 end
 + greatest(-0.03 * n_issues, -0.10) - case when is_handwritten then 0.15 else 0 end + greatest(-0.05 * n_ambiguous, -0.20)
 - case when total is null then 0.30 else 0 end - case when date_text is null then 0.10 else 0 end - case when merchant_name is null then 0.10 else 0 end
 + greatest(-0.06 * (cast(disputes_total as int) + cast(disputes_address as int)), -0.30))), 3) as decimal(4,3)) as confidence from e),
r as (select *, case when n_error > 0 and total is null then 'needs_review' when confidence >= 0.85 then 'auto_approved' else 'needs_review' end as status,
 cast(case when n_error > 0 and total is null then 0 when confidence >= 0.85 then -1 when confidence >= 0.60 then 2 else 1 end as int) as priority from c)"""
SCORED_SQL = f"with {_SUMS}, {_ALL}, {_PER_DOC}, {_SCORE}"


def _query(rule_id: str):
    def run(spark, sf_dir):
        config = NARROW if rule_id in _NARROW_RULES else RuleConfig()
        return findings_table(records(spark, sf_dir), config, (rule_id,)).groupBy("doc_id", "severity").agg(F.count(F.lit(1)).alias("n"))

    return run


QUERIES = {f"rule_{r.lower()}": _query(r) for r in RULE_SQL}
ORACLE_SQL = {f"rule_{r.lower()}": sql(f"with {_SUMS} select doc_id, severity, count(*) as n from ({q}) group by doc_id, severity") for r, q in RULE_SQL.items()}


def found(spark, sf_dir):
    return with_findings(records(spark, sf_dir), NARROW)


def query(name: str, text: str | None = None):
    def register(build):
        QUERIES[name] = build
        if text is not None:
            ORACLE_SQL[name] = sql(text)
        return build

    return register


@query("flagship_routing_summary", SCORED_SQL + " select status, priority, count(*) as n_docs, cast(sum(confidence) as decimal(24,3)) as sum_confidence, cast(sum(total) as decimal(24,4)) as sum_total from r group by status, priority")
def flagship_routing_summary(spark, sf_dir):
    s = scoring.scored(found(spark, sf_dir))
    return s.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("confidence").cast("decimal(24,3)").alias("sum_confidence"), F.sum("total").cast("decimal(24,4)").alias("sum_total"))


@query("rule_histogram", f"with {_SUMS}, {_ALL} select rule_id, severity, count(*) as n, count(distinct doc_id) as n_docs from f group by rule_id, severity")
def rule_histogram(spark, sf_dir):
    per_doc = findings_table(records(spark, sf_dir), NARROW).groupBy("doc_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("rule_id", "severity").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("report_counts", f"with {_SUMS}, {_ALL}, {_PER_DOC} select doc_id, n_error, n_warn, n_info, n_error > 0 as has_errors from e")
def report_counts(spark, sf_dir):
    n = rules.count_of
    return found(spark, sf_dir).select("doc_id", *[n(s).cast("long").alias(f"n_{s}") for s in ("error", "warn", "info")], (n("error") > 0).alias("has_errors"))


@query("report_summary_text", f"with {_SUMS}, {_ALL}, {_PER_DOC} select doc_id, n_error || ' error(s), ' || n_warn || ' warning(s), ' || n_info || ' info: ' || coalesce(ids, 'clean') as summary from e")
def report_summary_text(spark, sf_dir):
    return found(spark, sf_dir).select("doc_id", rules.summary_text().alias("summary"))


@query("repair_prompt_top12")
def repair_prompt_top12(spark, sf_dir):
    texts = found(spark, sf_dir).select("doc_id", rules.repair_text().alias("prompt"))
    # A filter would go below the text, to the rules, and run all of them again; an array of the one text doesn't.
    return texts.select("doc_id", F.explode(F.filter(F.array("prompt"), lambda x: x != "")).alias("prompt"))




@query("confidence_score", SCORED_SQL + " select doc_id, confidence from r")
def confidence_score(spark, sf_dir):
    return scoring.scored(found(spark, sf_dir)).select("doc_id", "confidence")


@query("confidence_reasons", SCORED_SQL + """, q as (select doc_id, unnest([
 {k: 0, reason: case when n_error > 0 then 'validation errors present' end}, {k: 1, reason: case when n_warn > 0 then n_warn || ' warning finding(s)' end},
 {k: 2, reason: case when legibility <> 'good' then 'legibility: ' || legibility end}, {k: 3, reason: case when n_issues > 0 then n_issues || ' triage issue(s)' end},
 {k: 4, reason: case when is_handwritten then 'handwritten receipt' end}, {k: 5, reason: case when n_ambiguous > 0 then n_ambiguous || ' ambiguous field(s)' end},
 {k: 6, reason: case when total is null then 'total is missing' end}, {k: 7, reason: case when date_text is null then 'date is missing' end},
 {k: 8, reason: case when merchant_name is null then 'merchant name is missing' end},
 {k: 9, reason: case when disputes_total or disputes_address then (cast(disputes_total as int) + cast(disputes_address as int)) || ' disputed field(s) across consistency runs' end}]) as x from r)
 select doc_id, cast(row_number() over (partition by doc_id order by x.k) - 1 as int) as pos, x.reason as reason from q where x.reason is not null""")
def confidence_reasons(spark, sf_dir):
    return scoring.scored(found(spark, sf_dir)).select("doc_id", F.posexplode_outer("reasons").alias("pos", "r")).where("r is not null").select("doc_id", "pos", "r.reason")


@query("route_decision", SCORED_SQL + " select doc_id, status, priority from r")
def route_decision(spark, sf_dir):
    return scoring.scored(found(spark, sf_dir)).select("doc_id", "status", "priority")


@query("status_counts", SCORED_SQL + " select status, count(*) as n from r group by status")
def status_counts(spark, sf_dir):
    return scoring.scored(found(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("auto_approval_rate", SCORED_SQL + " select cast(cast(round_even(count(*) filter (status = 'auto_approved') * 1.0000000000 / nullif(count(*), 0), 3) as decimal(12,3)) as varchar) as auto_approval_rate from r")
def auto_approval_rate(spark, sf_dir):
    s = scoring.scored(found(spark, sf_dir)).agg(F.count_if(F.col("status") == "auto_approved").alias("a"), F.count(F.lit(1)).alias("n"))
    return s.select(scoring.rate_even(F.col("a"), F.col("n"), 3).cast("string").alias("auto_approval_rate"))


@query("rule_catalogue", f"with {_SUMS}, f as (" + " union all ".join(f"select '{r}' as rule_id from ({q})" for r, q in RULE_SQL.items()) + "), n as (select rule_id, count(*) as n from f group by rule_id) select t.rule_id, severity, n.n from (values " + ", ".join(f"('{r}', '{s}')" for r, (s, _, _) in sorted(rules.REGISTRY.items())) + ") t(rule_id, severity) left join n on n.rule_id = t.rule_id")
def rule_catalogue(spark, sf_dir):
    """Every rule with its severity and how many findings it has; null for those that have none."""
    found = rules.findings_table(records(spark, sf_dir), NARROW).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return rules.catalogue(spark).select("rule_id", "severity").join(found, "rule_id", "left")
