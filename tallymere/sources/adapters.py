"""The ledger's views over the star-schema tables, as SQL that Spark and DuckDB both read.

Each view names base tables as {table} and other views by name. `frame` runs one in Spark, `sql` writes the same for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: The day that rules take for today.
TODAY = "2026-07-26"

#: Signs of 64 numbers as text; element_at counts from one in both engines.
_SIGNS = "concat(" + ", ".join(f"case when element_at(embedding, {k}) > 0 then '1' else '0' end" for k in range(1, 65)) + ")"
VIEWS: dict[str, str] = {
    "v_items": """
select l_orderkey as doc_id,
 cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 as int) as position,
 case when l_partkey % 53 = 0 then '' when l_partkey % 50 = 0 then 'TOTAL' when l_partkey % 97 = 0 then 'Discount 12.50' else p_name end as description_raw,
 cast(l_quantity as decimal(12,4)) as qty,
 cast(p_retailprice as decimal(14,4)) as unit_price,
 cast(case when l_partkey % 41 = 0 then null else cast(cast(l_quantity as decimal(12,4)) * cast(p_retailprice as decimal(14,4)) as decimal(14,4)) + case when (l_orderkey + l_partkey) % 37 = 0 then cast(5 as decimal(14,4)) else cast(0 as decimal(14,4)) end end as decimal(14,4)) as line_total,
 cast(case when l_suppkey % 9 = 0 then -1 else 0 end as decimal(14,4)) as modifier_amount,
 (l_returnflag = 'R' and l_linenumber = 7) as is_template_row
from {lineitem} join {part} on p_partkey = l_partkey""",
    "v_sums": """
select doc_id,
  cast(sum(case when not is_template_row then 1 else 0 end) as bigint) as n_purchases,
  cast(case when sum(case when not is_template_row and line_total is null then 1 else 0 end) = 0 and sum(case when not is_template_row then 1 else 0 end) > 0 then sum(case when not is_template_row then line_total + modifier_amount end) end as decimal(18,4)) as s,
  cast(coalesce(sum(case when not is_template_row then line_total + modifier_amount end), 0) as decimal(14,4)) as s0
  from v_items group by doc_id""",
    #: In v_docs and v_headers, a comment stands where records() has the array of lines pass through.
    "v_docs": """
select o_orderkey as doc_id, /*lines of x*/
 case when o_orderkey % 23 = 0 then null else o_custkey end as merchant_id,
 case when o_orderkey % 29 = 0 then null else cast(o_orderdate as date) end as txn_date,
 n_purchases, s as line_sum,
 case when o_orderkey % 7 = 0 then null else cast(s0 + case when o_orderkey % 11 = 0 then cast(50 as decimal(14,4)) else cast(0 as decimal(14,4)) end as decimal(14,4)) end as subtotal,
 case when o_orderkey % 13 = 0 then null else cast(round(s0 * cast(0.12 as decimal(4,2)), 2) as decimal(14,4)) end as tax,
 case when o_orderkey % 6 = 0 then cast(round(s0 * cast(0.05 as decimal(4,2)), 2) as decimal(14,4)) end as discount,
 case when o_orderkey % 31 = 0 then null else cast(s0 + case when o_orderkey % 13 = 0 then cast(0 as decimal(14,4)) else round(s0 * cast(0.12 as decimal(4,2)), 2) end - case when o_orderkey % 6 = 0 then round(s0 * cast(0.05 as decimal(4,2)), 2) else cast(0 as decimal(14,4)) end + case when o_orderkey % 10 = 0 then cast(1000 as decimal(14,4)) else cast(0 as decimal(14,4)) end as decimal(14,4)) end as total
from {orders} join v_sums x on x.doc_id = o_orderkey""",
    #: Everything the rules read but the lines: one row per order, those without lines too.
    "v_headers": """
select o_orderkey as doc_id, /*lines of d*/ d.merchant_id, d.txn_date, d.subtotal, d.tax, case when o_orderkey % 66 = 0 then cast(d.subtotal + 1 as decimal(14,4)) else d.discount end as discount, d.total,
 case when o_orderkey % 23 = 0 then null when o_orderkey % 47 = 0 then '  ' else concat('Customer Shop ', cast(o_custkey as string)) end as merchant_name,
 case when o_orderkey % 19 = 0 then null when o_orderkey % 17 = 0 then 'Other Traders' else 'Tallymere Inc.' end as buyer_name,
 case when o_orderkey % 3 = 0 then null when o_orderkey % 5 = 0 then '999-888-777' else '123-456-789' end as buyer_tax_id,
 case when o_orderkey % 29 = 0 then null when o_orderkey % 37 = 0 then '2026-3-1' when o_orderkey % 43 = 0 then '2031-01-01' when o_orderkey % 41 = 0 then '1985-06-30' else cast(cast(o_orderdate as date) as string) end as date_text,
 case when o_orderkey % 58 = 0 then '03/04/26' end as date_raw,
 case o_orderkey % 5 when 0 then 'PHP' when 1 then 'usd' when 2 then '$' when 3 then 'XAF' end as currency,
 case when o_orderkey % 4 = 0 then cast(d.total + 100 as decimal(14,4)) end as tender,
 case when o_orderkey % 4 = 0 then cast(case when o_orderkey % 16 = 0 then 90 else 100 end as decimal(14,4)) end as change,
 case when o_orderkey % 2 = 0 then cast(d.tax - 1 as decimal(14,4)) end as band_a,
 case when o_orderkey % 2 = 0 then cast(case when o_orderkey % 18 = 0 then 3 else 1 end as decimal(14,4)) end as band_b,
 case o_orderkey % 4 when 0 then true when 1 then false end as prices_include_tax,
 o_orderkey % 50 = 0 as is_refund, o_orderkey % 8 = 0 as is_handwritten, cast(o_orderkey % 5 as int) as n_ambiguous,
 case o_orderkey % 9 when 0 then 'fair' when 1 then 'poor' else 'good' end as legibility, cast(case when o_orderkey % 7 < 4 then 0 else o_orderkey % 7 - 3 end as int) as n_issues,
 cast(case when o_orderkey % 15 = 0 then 0 else 3 end as int) as estimate,
 case when o_orderkey % 3 <> 0 then concat(case when o_orderkey % 14 = 1 then 'SOMEONE ELSE ' else 'CUSTOMER SHOP ' end, cast(o_custkey as string), ' TOTAL ', case when o_orderkey % 22 = 1 then '0.00' else coalesce(cast(cast(d.total as decimal(14,2)) as string), '') end) end as ocr_text,
 o_orderkey % 12 = 0 as disputes_total, o_orderkey % 20 = 0 as disputes_address,
 o_orderkey % 61 = 0 as parse_failed
from {orders} left join v_docs d on d.doc_id = o_orderkey""",
    "v_receipts": """
select doc_id, merchant_id, txn_date, total, currency, case when doc_id % 23 = 0 then null else merchant_name end as merchant_name, is_handwritten, date_text, subtotal, tax, discount, buyer_name, buyer_tax_id,
 cast((doc_id * 7) % 101 / 100.0 as decimal(4,3)) as confidence,
 case when doc_id % 40 = 3 then 'pending' when doc_id % 40 = 5 then 'rejected' when doc_id % 40 = 7 then 'reviewed' when (doc_id * 7) % 101 >= 85 then 'auto_approved' else 'needs_review' end as status,
 cast(doc_id % 3 as int) as priority, txn_date is not null and doc_id % 5 = 0 as has_override, doc_id % 17 as created_rank
from v_headers""",
    #: Copies of every 40th document with larger ids, some without merchant or total.
    "v_receipts_dup": """
select doc_id, case when doc_id % 80 = 0 then null else merchant_id end as merchant_id, txn_date, case when doc_id % 200 = 0 then null else total end as total, 0 as created_rank from v_receipts
union all
select doc_id + 10000000, case when doc_id % 80 = 0 then null else merchant_id end, txn_date, case when doc_id % 200 = 0 then null else total end, 1 from v_receipts where doc_id % 40 = 0""",
    #: Hashes of 64 bits as hex text; copies of every image with 1 to 6 bits flipped.
    "v_hashes": """
select image_id, bits, case when image_id % 37 = 0 then 'needs_review' else 'pending' end as status from (
 select image_id, flips, 0 as copy, bits from v_phash union all
 select image_id + 1000000, flips, 1, concat(substr(bits, 1, 64 - cast(flips as int)), translate(substr(bits, 65 - cast(flips as int), cast(flips as int)), '01', '10')) from v_phash where image_id % 3 = 0) t""",
    "v_merchants": """
select c_custkey as merchant_id,
 concat(case when c_custkey % 97 = 0 then 'Shared Name' else c_name end, case c_custkey % 5 when 0 then ' INC.' when 1 then ', Ltd.' when 2 then ' Branch 12' when 3 then ' #7' else '' end) as canonical_name,
 case when c_custkey % 4 = 0 then null else concat('TIN-', cast(c_custkey as string)) end as tax_id,
 case when c_custkey % 10 = 0 then concat('Variant ', cast(c_custkey as string), ' Co') end as variant,
 case when c_nationkey % 2 = 0 then 'PHP' end as default_currency
from {customer}""",
    "v_text": """
select o_orderkey as doc_id,
 case o_orderkey % 6 when 0 then cast(cast(o_orderdate as date) as string) when 1 then strftime_dmy when 2 then strftime_mdy when 3 then '2026-13-45' when 4 then strftime_ymd else '  ' end as date_text,
 case o_orderkey % 7 when 0 then concat('$', whole, '.56') when 1 then concat('1.', lpad(cast(o_orderkey % 1000 as string), 3, '0'), ',56') when 2 then concat('(1,', lpad(cast(o_orderkey % 1000 as string), 3, '0'), '.5)') when 3 then '12O.00' when 4 then concat(whole, '.10-') when 5 then concat(' +', whole, ' ') else '' end as money_text,
 case o_orderkey % 5 when 0 then 'PHP' when 1 then ' usd ' when 2 then '$' when 3 then 'XAF' end as currency_text,
 case o_orderkey % 6 when 0 then '14:32:05' when 1 then '2:05 p.m.' when 2 then '25:00' when 3 then '9:7' when 4 then '12:30:59 AM' else '' end as time_text,
 concat('  ', o_orderpriority, case when o_orderkey % 2 = 0 then ': 1,234.50' else ' -  12 pcs' end) as description_text
from (select o_orderkey, o_orderdate, o_orderpriority, cast(o_orderkey % 900 + 1 as string) as whole,
  concat(lpad(cast(extract(day from o_orderdate) as string), 2, '0'), '/', lpad(cast(extract(month from o_orderdate) as string), 2, '0'), '/', cast(extract(year from o_orderdate) as string)) as strftime_dmy,
  concat(lpad(cast(extract(month from o_orderdate) as string), 2, '0'), '-', lpad(cast(extract(day from o_orderdate) as string), 2, '0'), '-', right(cast(extract(year from o_orderdate) as string), 2)) as strftime_mdy,
  concat(cast(extract(year from o_orderdate) as string), '.', cast(extract(month from o_orderdate) as string), '.', cast(extract(day from o_orderdate) as string)) as strftime_ymd
  from {orders}) t""",
    "v_phash": "select vec_id as image_id, vec_id % 7 as flips, " + _SIGNS + " as bits from {embeddings}",
    "v_queue_events": """
select event_id, ts, user_id, (user_id * 7) % 200 as receipt_id,
 case event_type when 'signup' then 'enqueue' when 'click' then 'claim' when 'purchase' then 'close' when 'error' then 'release' else 'view' end as action,
 cast(event_id % 3 as int) as priority
from {events}""",
    "v_runs": """
select conv_id as receipt_id, turn as attempt, case role when 'system' then 'triage' when 'user' then 'extract' else 'repair' end as pass_name,
 cast(length(coalesce(text, '')) as bigint) as input_tokens, cast(length(coalesce(text, '')) % 97 as bigint) as output_tokens
from {conversations}""",
    "v_eval": """
select d.doc_id, cast((n_chars % 101) / 100.0 as decimal(4,3)) as confidence, quality = 1 as critical_correct, cast(d.doc_id % 5 as int) as repeat_no, source as category
from {documents} d join {labels} l on l.doc_id = d.doc_id""",
    "v_votes": """
select o_orderkey as doc_id, run, case when o_orderkey % 4 = 0 and run = 2 then null when (o_orderkey + run) % 9 = 0 then concat('alt', cast(run as string)) else cast(o_custkey as string) end as value
from {orders} cross join (select 0 as run union all select 1 as run union all select 2 as run) r""",
    "v_uploads": """
select page_id, cast(length(html) * case when page_id % 31 = 0 then 20000 else 1 end * case when page_id % 29 = 0 then 0 else 1 end as bigint) as n_bytes,
 case page_id % 6 when 0 then 'FFD8FFE000104A46494600' when 1 then '89504E470D0A1A0A0000000D' when 2 then '255044462D312E37' when 3 then '524946460000000057454250' when 4 then '000000186674797068656963' else '3C68746D6C3E' end as head_hex,
 case page_id % 8 when 0 then 'a.JPG' when 1 then 'b.png' when 2 then 'c.pdf' when 3 then 'd.webp' when 4 then 'e.heic' when 5 then 'f.jpeg' when 6 then 'g.gif' else 'noext' end as file_name
from {pages}""",
    "v_corrections": """
select l_orderkey as doc_id, l_linenumber as seq, case l_linenumber % 6 when 0 then 'totals.total' when 1 then 'line_items[0].qty' when 2 then 'receipt.currency' when 3 then 'merchant.name' when 4 then 'meta.is_handwritten' else 'nope.field' end as path,
 case l_linenumber % 6 when 0 then case when l_orderkey % 5 = 0 then 'abc' else '12.50' end when 1 then '3' when 2 then case when l_orderkey % 11 = 0 then 'LONG' else 'PHP' end when 3 then 'New Name' when 4 then 'Yes' else '1' end as new_value
from {lineitem} where l_linenumber <= case when l_orderkey % 3 = 0 then 5 else 4 end""",
    #: Answers of two models to every document: fenced, plain, with prose, cut short, blank, without object, broken, empty. < and > become braces.
    "v_responses": """
select doc_id, rung, case rung when 0 then 'small' else 'large' end as model_id, (doc_id + rung) % 10 = 9 as call_failed,
 cast(cast(doc_id % 1000 as decimal(12,0)) * cast(0.000125 as decimal(6,6)) as decimal(18,6)) as cost_usd, (doc_id * 13 + rung) % 4000 as latency_ms, total_text,
 translate(case (doc_id + rung * 3) % 8 when 0 then concat('Here it is:', chr(10), '```json', chr(10), body, chr(10), '```', chr(10), 'Done <>.') when 1 then body when 2 then concat('The record: ', body, ' and a > brace') when 3 then substr(body, 1, 60)
  when 4 then '   ' when 5 then 'no object here' when 6 then replace(body, '"PHP"', 'PHP,,') else '<"merchant": <>, "totals": <"total": null>, "line_items": []>' end, '<>', concat(chr(123), chr(125))) as text
from (select doc_id, rung, total_text, concat('<"merchant": <"name": "Shop ', chr(92), '"<A', chr(92), '" ', cast(o_custkey as string), '">, "receipt": <', case when doc_id % 17 = 0 then '"date": 5, ' else '' end, '"currency": "PHP", >, "totals": <"total": ', total_text, ', "tax": null',
   case doc_id % 19 when 3 then ', "tax_breakdown": [<"rate": true>, <"base": "x1", "amount": 2>]' when 4 then ', "prices_include_tax": "Yes", "tax_breakdown": [<"amount": "1.50">]' when 5 then ', "prices_include_tax": 2, "change": " 7 "' else '' end, '>, "line_items": [<"position": 0, "qty": 1>,',
   case doc_id % 11 when 1 then ' <"position": 1, "line_total": "abc">,' when 2 then ' <"position": "2", "qty": 1.50, "modifiers": [<"label": "promo", "amount": "-1">, <"amount": 1>]>,' when 3 then ' <"position": null, "description_raw": 7, "is_template_row": "maybe", "bbox": [0.1, "x"]>,'
    when 4 then ' "row", <"position": 1.0, "bbox": null, "is_template_row": 1, "modifiers": [<"label": "a", "amount": 1e2>]>,' when 5 then ' <"position": 1.5, "modifiers": null, "sku": null, "unknown": [1]>,' else '' end, ']',
   case doc_id % 13 when 1 then ', "meta": <"legibility": "blurry", "ambiguous_fields": ["a", 1], "is_refund": null>' when 2 then ', "payment": null' when 3 then ', "meta": <"legibility": "poor", "notes": null>, "buyer": ["x"], "receipt_no": 7' when 4 then ', "payment": <"method": 3>' else '' end, '>') as body
 from (select o_orderkey as doc_id, o_custkey, case when o_orderkey % 7 = 0 then '"12,x"' else cast(cast(o_totalprice as decimal(14,2)) as string) end as total_text, 0 as rung from {orders}
  union all select o_orderkey, o_custkey, case when o_orderkey % 7 = 0 then '"12,x"' else cast(cast(o_totalprice as decimal(14,2)) as string) end, 1 from {orders}) o) b""",
    #: Image files and labels that share stems, and the manifest's entries.
    "v_images": "select page_id as file_id, cast(page_id % 701 as int) as stem, case page_id % 5 when 0 then '.jpg' when 1 then '.png' when 2 then '.webp' when 3 then '.jpeg' else '.txt' end as suffix from {pages}",
    "v_manifest": "select doc_id, case when doc_id % 9 = 0 then null else source end as category, doc_id % 6 = 0 as holdout from {documents} where doc_id % 4 <> 1",
    "v_corners": "select p_partkey as image_id, cast(p_size * 97 as int) as width, cast(p_partkey % 3001 + 1 as int) as height, p_size % 7 as a, p_partkey % 5 as b from {part}",
}


def _needed(text: str) -> list[str]:
    """The views that a text names, in an order that defines each before its use."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", text):
            out += [n for n in [*_needed(VIEWS[name]), name] if n not in out]
    return out


def sql(text: str) -> str:
    """A DuckDB query: `text` after the definitions of the views that it names; base tables may stand in braces."""
    views = _needed(text)
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in views)
    own = re.match(r"\s*with(\s+recursive)?\s", text, re.I)
    whole = text if not views else f"with{own[1] or ''} {ctes},\n{text[own.end():]}" if own else f"with {ctes}\n{text}"
    return re.sub(r"\{(" + "|".join(BASE) + r")\}", r"\1", whole).replace("element_at(", "list_extract(")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, view: str, lines: DataFrame | None = None) -> DataFrame:
    """A view as a DataFrame; only the columns and tables that the caller uses are read. `lines` stands for v_sums and adds
    its line_items to the view, so that the lines are gathered once."""
    views = _needed(view)
    text = "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in views) + f"\nselect * from {view}"
    if lines is not None:
        views = [v for v in views if v not in ("v_items", "v_sums")]
        text = "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in views) + f"\nselect * from {view}"
        text = re.sub(r"/\*lines of (\w)\*/", r"\1.line_items,", text).replace("v_sums", "{v_sums}")
    used = {t: table(spark, sf_dir, t) for t in BASE if "{" + t + "}" in text}
    return spark.sql(text, **used, **({} if lines is None else {"v_sums": lines}))
