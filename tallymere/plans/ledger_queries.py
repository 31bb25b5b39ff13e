"""Queries over receipts: listing, export, duplicates, merchants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import last4, redact_cards
from ..operators import dedupe, entities, listing, review
from ..operators.records import records
from ..sources.adapters import frame, sql, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def register(build):
        QUERIES[name] = build
        if text is not None:
            ORACLE_SQL[name] = sql(text)
        return build

    return register


_PAGE = "select doc_id, merchant_name, cast(txn_date as varchar) as date, cast(total as varchar) as total, currency, cast(confidence as varchar) as confidence, status, merchant_id"


@query("list_filtered_page", f"with q as (select * from v_receipts where status = 'needs_review' and txn_date >= date '1995-01-01' and txn_date <= date '1997-12-31' and confidence >= 0.3), k as (select *, row_number() over (order by created_rank, doc_id) as n from q) {_PAGE}, (select count(*) from k where n > 100) > 50 as has_more from k where n > 100 and n <= 150")
def list_filtered_page(spark, sf_dir):
    rows = listing.filtered(frame(spark, sf_dir, "v_receipts"), status="needs_review", since="1995-01-01", until="1997-12-31", least_confidence="0.3")
    paged = listing.page(rows, F.col("created_rank"), F.col("doc_id"), limit=50, offset=100)
    return listing.summary_columns(paged.select("*")).join(paged.select("doc_id", "has_more"), "doc_id")


@query("receipt_summaries", f"{_PAGE} from v_receipts")
def receipt_summaries(spark, sf_dir):
    return listing.summary_columns(frame(spark, sf_dir, "v_receipts"))


@query("export_scope", "select doc_id, status from v_receipts where status not in ('pending', 'rejected') and confidence >= 0.5")
def export_scope(spark, sf_dir):
    return listing.export_scope(frame(spark, sf_dir, "v_receipts"), least_confidence="0.5").select("doc_id", "status")


def _export_rows(spark, sf_dir):
    receipts = listing.export_scope(frame(spark, sf_dir, "v_receipts"))
    findings = frame(spark, sf_dir, "v_items").select("doc_id", F.when(F.col("line_total").isNull(), "error").otherwise("info").alias("severity"), (F.col("position") % 2 == 1).alias("resolved"))
    tasks = receipts.where("status = 'needs_review' and doc_id % 13 <> 0").select("doc_id", "priority")
    return listing.export_rows(receipts, frame(spark, sf_dir, "v_items"), findings, frame(spark, sf_dir, "v_merchants"), tasks)


_EXPORT = """with x as (select r.*, coalesce(m.canonical_name, r.merchant_name) as merchant, case when status = 'needs_review' and r.doc_id % 13 <> 0 then r.priority end as task_priority,
 coalesce(i.n_items, 0) as n_items, coalesce(i.open_error, false) as open_error
 from v_receipts r left join v_merchants m on m.merchant_id = r.merchant_id left join (select doc_id, count(*) filter (not is_template_row) as n_items, bool_or(line_total is null and position % 2 = 0) as open_error from v_items group by doc_id) i on i.doc_id = r.doc_id
 where status not in ('pending', 'rejected'))"""


@query("export_receipts_sheet", f"{_EXPORT} select doc_id, merchant, buyer_name, txn_date, currency, subtotal, tax, discount, total, n_items, is_handwritten, confidence, status, open_error from x")
def export_receipts_sheet(spark, sf_dir):
    return _export_rows(spark, sf_dir).select("doc_id", "merchant", "buyer_name", "txn_date", "currency", "subtotal", "tax", "discount", "total", "n_items", "is_handwritten", "confidence", "status", "open_error")


@query("export_line_sheet", "select i.doc_id, position, description_raw as description, qty, unit_price, line_total from v_items i join v_receipts r on r.doc_id = i.doc_id where not is_template_row and status not in ('pending', 'rejected')")
def export_line_sheet(spark, sf_dir):
    lines = frame(spark, sf_dir, "v_items").where(~F.col("is_template_row"))
    scope = listing.export_scope(frame(spark, sf_dir, "v_receipts")).select("doc_id")
    return lines.join(scope, "doc_id", "left_semi").select("doc_id", "position", F.col("description_raw").alias("description"), "qty", "unit_price", "line_total")


@query("needs_review_sheet", f"{_EXPORT} select row_number() over (order by coalesce(task_priority, 65536), coalesce(cast(txn_date as varchar), ''), doc_id) as pos, task_priority as priority, doc_id, merchant, txn_date, total, confidence from x where status = 'needs_review'")
def needs_review_sheet(spark, sf_dir):
    rows = _export_rows(spark, sf_dir).where("status = 'needs_review'")
    order = dict(zip(("_priority", "_date"), listing.review_order(), strict=False))
    sheet = review.numbered(rows.withColumns(order).select("_priority", "_date", "doc_id", "task_priority", "merchant", "txn_date", "total", "confidence"), "_priority", "_date", "doc_id")
    return sheet.select(F.col("n").cast("long").alias("pos"), F.col("task_priority").alias("priority"), "doc_id", "merchant", "txn_date", "total", "confidence")


@query("export_summary", f"""{_EXPORT}, y as (select *, coalesce(nullif(merchant, ''), '(unknown)') as m from x)
select 'receipts' as metric, cast(count(*) as varchar) as value from y union all select 'first_date', cast(min(txn_date) as varchar) from y union all select 'last_date', cast(max(txn_date) as varchar) from y
union all select 'auto_approval_rate', cast(cast(round(cast(count(*) filter (status = 'auto_approved') as decimal(18,10)) / count(*), 4) as decimal(12,4)) as varchar) from y
union all select 'avg_confidence', cast(cast(round(sum(confidence) / count(*), 3) as decimal(12,3)) as varchar) from y
union all select 'total_value', cast(cast(coalesce(sum(total), 0) as decimal(24,4)) as varchar) from y
union all select 'status:' || status, cast(count(*) as varchar) from y group by status
union all select 'merchant:' || m, cast(cast(sum(total) as decimal(24,4)) as varchar) from y group by m having count(total) > 0""")
def export_summary(spark, sf_dir):
    return listing.export_summary(_export_rows(spark, sf_dir))


@query("detail_flat", "select h.doc_id, h.buyer_name, cast(h.total as varchar) as total, i.position, i.description_raw, cast(i.line_total as varchar) as line_total from v_headers h left join v_items i on i.doc_id = h.doc_id")
def detail_flat(spark, sf_dir):
    nested = records(spark, sf_dir).select("doc_id", F.struct("buyer_name", "buyer_tax_id").alias("buyer"), F.struct(F.col("total").cast("string").alias("total")).alias("totals"), "line_items")
    return nested.select("doc_id", "buyer.buyer_name", "totals.total", F.explode_outer("line_items").alias("i")).select("doc_id", "buyer_name", "total", "i.position", "i.description_raw", F.col("i.line_total").cast("string").alias("line_total"))


# --- duplicates ---
_PAIRS = "with h as (select image_id as id, cast(bits as bit) as b, status from v_hashes), n as (select x.id as a, y.id as b, cast(bit_count(xor(x.b, y.b)) as int) as distance from h x join h y on x.id < y.id where bit_count(xor(x.b, y.b)) <= 5)"


def _hashes(spark, sf_dir):
    return frame(spark, sf_dir, "v_hashes").select(F.col("image_id").alias("id"), dedupe.hash_from_bits(F.col("bits")).alias("hash"), "status")


@query("phash_near_dups", f"{_PAIRS} select a, b, distance from n")
def phash_near_dups(spark, sf_dir):
    return dedupe.near_pairs(_hashes(spark, sf_dir)).select("a", "b", F.col("distance").cast("int").alias("distance"))


@query("phash_first_match", f"{_PAIRS}, m as (select b as id, min(a) as duplicate_of from n group by b) select m.id, duplicate_of from m join h on h.id = m.id where status = 'pending'")
def phash_first_match(spark, sf_dir):
    h = _hashes(spark, sf_dir)
    found = dedupe.first_match(h.select("id", "hash", F.lit(0).alias("created")))
    return found.join(h.where("status = 'pending'").select("id"), "id", "left_semi")


@query("hamming_histogram", f"{_PAIRS} select distance, count(*) as n from n group by distance")
def hamming_histogram(spark, sf_dir):
    return dedupe.distance_counts(_hashes(spark, sf_dir)).select(F.col("distance").cast("int").alias("distance"), "n")


@query("phash_members", f"{_PAIRS}, e as (select id, min(other) as class_id from (select id, id as other from h union all select b, a from n where distance = 0) group by id) select id, class_id from e")
def phash_members(spark, sf_dir):
    """Every image with the smallest id that has its hash."""
    return dedupe.class_members(_hashes(spark, sf_dir))


@query("phash_class_pairs", f"{_PAIRS}, e as (select id, min(other) as class_id from (select id, id as other from h union all select b, a from n where distance = 0) group by id), c as (select class_id, count(*) as n from e group by class_id) select a, b, distance, ca.n as n_a, cb.n as n_b from n join c ca on ca.class_id = a join c cb on cb.class_id = b where distance > 0")
def phash_class_pairs(spark, sf_dir):
    """Near pairs of different hashes, each hash by its smallest image; with phash_members these are all near pairs."""
    return dedupe.class_pairs(_hashes(spark, sf_dir)).withColumn("distance", F.col("distance").cast("int"))


_SEM = "select doc_id, first as duplicate_of from (select *, first_value(doc_id) over (partition by merchant_id, txn_date, total order by created_rank, doc_id) as first from v_receipts_dup where txn_date is not null and total is not null{}) t where doc_id <> first"


@query("semantic_dups", _SEM.format(" and merchant_id is not null"))
def semantic_dups(spark, sf_dir):
    return dedupe.semantic_duplicates(frame(spark, sf_dir, "v_receipts_dup"))


@query("semantic_dups_null_safe", _SEM.format(""))
def semantic_dups_null_safe(spark, sf_dir):
    return dedupe.semantic_duplicates(frame(spark, sf_dir, "v_receipts_dup"), null_merchants_match=True)


_LINKS = "l as (select o_orderkey as id, case when o_orderkey % 10 in (0, 1) then cast(o_orderkey / 10 as bigint) when o_orderkey % 1000 = 7 then o_orderkey + 2 when o_orderkey % 1000 = 9 then o_orderkey - 2 end as target from {orders})"


def _links(spark, sf_dir):
    k = F.col("o_orderkey")
    target = F.when((k % 10).isin(0, 1), F.round(k / 10).cast("long")).when(k % 1000 == 7, k + 2).when(k % 1000 == 9, k - 2)
    return table(spark, sf_dir, "orders").select(k.alias("id"), target.alias("target")).where("target is not null")


@query("dup_chain_roots", f"""with recursive {_LINKS.replace('{orders}', 'orders')}, e as (select * from l where target is not null),
w as (select id, target as pos, 1 as hops, [id] as seen from e union all select w.id, e.target, hops + 1, list_append(seen, w.pos) from w join e on e.id = w.pos where not list_contains(seen, w.pos)),
z as (select id, max(hops) as hops, arg_max(pos, hops) as last, bool_or(list_contains(seen, pos)) as cyclic from w group by id)
select id, case when not cyclic then last end as root, cast(case when not cyclic then hops end as bigint) as hops, cyclic from z""")
def dup_chain_roots(spark, sf_dir):
    return dedupe.link_roots(_links(spark, sf_dir))


# --- merchants ---
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({}), '#\\s*\\d+', ' ', 'g'), '[^a-z0-9_\\s]', ' ', 'g'), '\\b(inc|co|ltd)\\b', ' ', 'g'), '\\b(branch|store|br|outlet|loc|location)\\b(\\s+\\d+\\b)?', ' ', 'g'), '\\s+', ' ', 'g'))"
_MKEYS = f"mk as (select distinct merchant_id, {_KEY.format('name')} as key from (select merchant_id, canonical_name as name from v_merchants union all select merchant_id, variant from v_merchants where variant is not null)), uk as (select key, min(merchant_id) as found_id from mk where key <> '' group by key having count(*) = 1)"
_NAMES = "nm as (select doc_id, case when doc_id % 97 = 1 then 'SHARED NAME' when doc_id % 3 = 0 then 'Variant ' || cast(merchant_id as string) else 'CUSTOMER#' || lpad(cast(merchant_id as string), 9, '0') || ' Ltd' end as name, case when doc_id % 7 = 0 then 'TIN-' || cast(merchant_id % 50 as string) end as tax_id from v_receipts)"


def _names(spark, sf_dir):
    m = F.col("merchant_id").cast("string")
    name = F.when(F.col("doc_id") % 97 == 1, "SHARED NAME").when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Variant "), m)).otherwise(F.concat(F.lit("CUSTOMER#"), F.lpad(m, 9, "0"), F.lit(" Ltd")))
    return frame(spark, sf_dir, "v_receipts").select("doc_id", name.alias("name"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("TIN-"), (F.col("merchant_id") % 50).cast("string"))).alias("tax_id"))


@query("merchant_key", f"select merchant_id, {_KEY.format('canonical_name')} as key from v_merchants")
def merchant_key(spark, sf_dir):
    from ..functions.text import merchant_key as key

    return frame(spark, sf_dir, "v_merchants").select("merchant_id", key(F.col("canonical_name")).alias("key"))


@query("merchant_lookup", f"with {_MKEYS}, {_NAMES} select doc_id, found_id as merchant_id from (select doc_id, {_KEY.format('name')} as key from nm) q left join uk on uk.key = q.key")
def merchant_lookup(spark, sf_dir):
    return entities.lookup(_names(spark, sf_dir), frame(spark, sf_dir, "v_merchants"))


@query("merchant_resolve", f"with {_MKEYS}, {_NAMES}, tx as (select tax_id, min(merchant_id) as by_tax from v_merchants where tax_id is not null group by tax_id) select doc_id, coalesce(by_tax, found_id) as merchant_id from (select doc_id, tax_id, {_KEY.format('name')} as key from nm) q left join tx on tx.tax_id = q.tax_id left join uk on uk.key = q.key")
def merchant_resolve(spark, sf_dir):
    return entities.resolve(_names(spark, sf_dir), frame(spark, sf_dir, "v_merchants"))


@query("merchant_counts", f"with {_MKEYS}, {_NAMES} select found_id as merchant_id, count(distinct doc_id) as receipt_count from (select doc_id, {_KEY.format('name')} as key from nm) q join uk on uk.key = q.key group by found_id")
def merchant_counts(spark, sf_dir):
    found = merchant_lookup(spark, sf_dir).where("merchant_id is not null")
    return found.groupBy("merchant_id").agg(F.count_distinct("doc_id").alias("receipt_count"))


@query("merchant_register", f"with {_NAMES} select tax_id, min(name) as canonical_name from nm where name is not null and trim(name) <> '' and tax_id is not null and tax_id not in (select tax_id from v_merchants where tax_id is not null) group by tax_id")
def merchant_register(spark, sf_dir):
    return entities.register(_names(spark, sf_dir), frame(spark, sf_dir, "v_merchants"))


@query("merchant_confirm", f"with {_MKEYS}, {_NAMES}, q as (select m.merchant_id, nm.name, {_KEY.format('nm.name')} as key from nm join v_merchants m on m.tax_id = nm.tax_id where nm.name is not null), c as (select * from q where key <> '' and key not in (select key from mk)) select min(merchant_id) as merchant_id, min(name) as name from c group by key having count(distinct merchant_id) = 1")
def merchant_confirm(spark, sf_dir):
    return entities.confirm_variants(_names(spark, sf_dir).where("name is not null"), frame(spark, sf_dir, "v_merchants"))


@query("few_shot_topk", """with s as (select receipt_id, count(*) as n, min(attempt) as attempt from v_runs where pass_name = 'extract' group by receipt_id having count(*) = 1),
g as (select r.*, attempt, row_number() over (partition by merchant_id order by created_rank desc, doc_id) as rank from (select *, merchant_id % 20 as mm from v_receipts) r join s on s.receipt_id = r.doc_id where merchant_id is not null and doc_id not in (select doc_id from v_corrections))
select merchant_id, cast(rank as int) as rank, doc_id, attempt from g where rank <= 2""")
def few_shot_topk(spark, sf_dir):
    receipts = frame(spark, sf_dir, "v_receipts").withColumn("status", F.lit("reviewed"))
    return entities.few_shots(receipts, frame(spark, sf_dir, "v_runs"), frame(spark, sf_dir, "v_corrections"))


# --- card numbers ---
@query("pan_redaction")
def pan_redaction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redact_cards(F.col("text")).alias("text"))


_RUN = "'(^|[^0-9])[0-9]{13,19}([^0-9.]|$)'"


@query("pan_unseparated", "select o_orderkey as doc_id, 'card ' || repeat('*', 12) || right('4' || lpad(cast(o_orderkey as varchar), 15, '0'), 4) || ' end' as text, right('4' || lpad(cast(o_orderkey as varchar), 15, '0'), 4) as last4 from {orders}")
def pan_unseparated(spark, sf_dir):
    number = F.concat(F.lit("4"), F.lpad(F.col("o_orderkey").cast("string"), 15, "0"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), redact_cards(F.concat(F.lit("card "), number, F.lit(" end"))).alias("text"), last4(number).alias("last4"))
