"""Queries over the stored tables: batches of outcomes committed, repeated, read back and shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import persist, repeats, rules, serialise
from ..operators.records import records
from ..sources.adapters import frame, sql, table
from ..sources.shared import new_path
from ..sources.store import Store
from ..streaming import leases, queue
from .record_queries import _LEAVES, _PREDICTED, _predicted, nested
from .review_queries import _FOLD, _stream, _tasks
from .rule_queries import RULE_SQL, _SUMS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLE_SQL[name] = sql(oracle)
        return build

    return register


# --- two batches of outcomes: what was stored first, and later runs over a part of it and over new documents ---
def _outcome(rows: DataFrame, record: Column, status: Column, priority: Column, reason: str, confidence: str, duplicate_of: Column, n_runs: int) -> DataFrame:
    k = F.col("doc_id")
    finding = lambda rule, severity: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), F.concat(F.lit("card 4111 1111 1111 1111 of "), k.cast("string")).alias("message"), F.lit(False).alias("resolved_by_repair"))
    run = lambda n: F.struct(F.lit("extract" if n else "triage").alias("pass_name"), F.lit(n + 1).alias("attempt"), F.lit("large").alias("model_id"), F.sha2(k.cast("string"), 256).alias("prompt_hash"),
                             F.lit("paid 4111111111111111").alias("raw_response"), k.alias("input_tokens"), F.lit(n).cast("long").alias("output_tokens"), F.lit("0.001").cast("decimal(18,6)").alias("cost_usd"))
    made = rows.select("doc_id", record.alias("record"), status.alias("status"), priority.cast("int").alias("priority"), duplicate_of.cast("long").alias("duplicate_of"))
    r = F.col("record")
    fired = F.array_compact(F.array(F.when(r["totals"]["total"].isNull(), finding("R010", "error")), F.when(r["merchant"]["name"].isNull(), finding("R012", "warn"))))
    reasons = F.array(F.struct(F.lit("some penalty").alias("reason"), F.lit("-0.080").cast("decimal(6,3)").alias("penalty")))
    return made.select(
        "*", F.lit(confidence).cast("decimal(4,3)").alias("confidence"), F.lit(reason).alias("reason"), reasons.alias("reasons"), fired.alias("findings"), F.array(*[run(n) for n in range(n_runs)]).alias("runs"),
        F.lit(None).cast("long").alias("merchant_id"), F.concat(F.lit("k/"), k.cast("string")).alias("image_key"), F.lit("0000000000000000").alias("image_phash"),
    )


def _saved(spark, sf_dir) -> Store:
    k, r, none = F.col("doc_id"), F.col("record"), F.lit(None)
    whole = nested(spark, sf_dir)
    store = Store(spark, new_path(spark, "ledger"), persist.TABLES, buckets=8)
    old = whole.where(k % 3 != 1).join(frame(spark, sf_dir, "v_receipts").select("doc_id", "status"), "doc_id")
    first = _outcome(old, r, F.col("status"), F.when(F.col("status") == "needs_review", k % 3).otherwise(-1), "first", "0.500", none, 1)
    read = _predicted(k, r)
    method = F.when(k % 8 == 0, F.lit("VISA 4111111111111111")).otherwise(read["payment"]["method"])
    record = read.withField("payment.method", method).withField("receipt.currency", F.when(k % 50 == 8, F.lit("LONG")).otherwise(r["receipt"]["currency"]))
    status = F.when(k % 20 == 4, "rejected").when(k % 5 == 0, "auto_approved").otherwise("needs_review")
    priority = F.when(k % 20 == 4, -1).when(k % 5 == 0, -1).otherwise(k % 2)
    second = _outcome(whole.where(k % 4 < 2), record, status, priority, "second", "0.900", F.when(k % 20 == 4, k - 4), 2)
    persist.save_outcomes(store, "stored", 0, first)
    persist.save_outcomes(store, "runs", 0, second)
    store.vacuum(keep=1)  # nobody reads what was there before the second batch
    persist.save_outcomes(store, "runs", 0, second)  # a batch that comes again changes nothing
    return store


_SAVED = f"""with {_LEAVES}, {_PREDICTED}, st as (select doc_id, status from v_receipts where doc_id % 3 <> 1),
inc as (select doc_id, doc_id % 50 = 8 as long, case when doc_id % 20 = 4 then 'rejected' when doc_id % 5 = 0 then 'auto_approved' else 'needs_review' end as status, case when doc_id % 20 = 4 or doc_id % 5 = 0 then -1 else doc_id % 2 end as priority from v_headers where doc_id % 4 < 2),
al as (select coalesce(st.doc_id, inc.doc_id) as doc_id, st.status as old, inc.status as new, inc.priority, inc.long, inc.doc_id is not null as comes, st.doc_id is not null as was, inc.doc_id is not null and coalesce(st.status = 'reviewed', false) as refused from st full join inc on inc.doc_id = st.doc_id),
vd as (select *, comes and not refused as taken, comes and not refused and long as bad, comes and not refused and not long as fresh from al),
lf as (select vd.doc_id, path, kind, pl.value from vd join pl on pl.doc_id = vd.doc_id where fresh union all select vd.doc_id, path, kind, tl.value from vd join tl on tl.doc_id = vd.doc_id where not taken),
of as (select doc_id, max(value) filter (path = 'totals.total') as total, max(value) filter (path = 'merchant.name') as name, max(value) filter (path = 'receipt.date') as date, max(value) filter (path = 'receipt.date_raw') as raw, max(value) filter (path = 'receipt.currency') as currency,
  max(value) filter (path = 'payment.method') as method, max(value) filter (path = 'payment.card_last4') as card, count(*) filter (path like 'line_items[%].position') as n_items,
  string_agg(coalesce(value, 'null'), ',' order by try_cast(regexp_extract(path, '\\[(\\d+)\\]', 1) as int)) filter (path like 'line_items[%].line_total') as lines from lf group by doc_id),
it as (select vd.*, of.* exclude (doc_id), try_cast(date as date) as d from vd left join of using (doc_id)),
b as (select *, regexp_full_match(coalesce(date, ''), '\\d{{4}}-\\d{{2}}-\\d{{2}}') and d is not null as dated from it)"""
_NF = lambda total, name: f"({total} is null)::int + ({name} is null)::int"


@query("outcomes_saved", _SAVED + f""", f0 as (select doc_id, {_NF('total', 'merchant_name')} as n from v_headers where doc_id % 3 <> 1)
select b.doc_id, case when bad then 'needs_review' when fresh then new else old end as status, cast(case when bad then 0 when fresh then 0.9 else 0.5 end as decimal(4,3)) as confidence, case when fresh and b.doc_id % 20 = 4 then b.doc_id - 4 end as duplicate_of,
 cast(total as decimal(14,4)) as total, name as merchant_name_raw, case when dated then cast(d as varchar) end as txn_date, case when not dated and coalesce(raw, '') = '' and date <> '' then date else raw end as date_raw, currency,
 case when fresh and b.doc_id % 8 = 0 then 'VISA ************1111' else method end as payment_method, card as card_last4, case when not bad then '[some penalty -0.080]' end as reasons, coalesce(n_items, 0) as n_items, coalesce(lines, '') as lines,
 cast(coalesce(f0.n, 0) + case when fresh then {_NF('total', 'name')} else 0 end as bigint) as n_findings, cast(case when was then 1 else 0 end + case when fresh then 2 else 0 end as bigint) as n_runs,
 case when comes and not refused and not bad and new = 'auto_approved' then case when was and old = 'needs_review' then 'done' end when comes and (refused or bad or priority >= 0) then 'open' when was and old = 'needs_review' then 'open' end as task_state,
 cast(case when comes and (refused or bad) then 0 when comes and priority >= 0 and not (was and old = 'needs_review' and b.doc_id % 3 <= priority) then priority when was and old = 'needs_review' then b.doc_id % 3 end as int) as task_priority
from b left join f0 on f0.doc_id = b.doc_id""")
def outcomes_saved(spark, sf_dir):
    """Receipts with their lines, findings, calls and tasks after two batches of outcomes, the second of which came twice."""
    store = _saved(spark, sf_dir)
    manifest = store.manifest()
    read = lambda t: store.read(t, manifest=manifest)
    count = lambda t, name: read(t).groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    lines = read("line_items").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.array_sort(F.collect_list(F.struct("position", F.coalesce(F.col("line_total").cast("string"), F.lit("null")).alias("t")))).alias("l"))
    tasks = read("tasks").select("doc_id", F.col("state").alias("task_state"), F.col("priority").alias("task_priority"))
    rows = read("receipts")
    for other in (lines, count("findings", "n_findings"), count("runs", "n_runs"), tasks):
        rows = rows.join(other, "doc_id", "left")
    said = F.concat(F.lit("["), F.array_join(F.transform("confidence_reasons", lambda x: F.concat_ws(" ", x["reason"], x["penalty"])), ", "), F.lit("]"))
    return rows.select(
        "doc_id", "status", "confidence", "duplicate_of", "total", "merchant_name_raw", F.col("txn_date").cast("string").alias("txn_date"), "date_raw", "currency", "payment_method", "card_last4", said.alias("reasons"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_items",)], F.coalesce(F.array_join(F.transform("l", lambda x: x["t"]), ","), F.lit("")).alias("lines"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_findings", "n_runs")], "task_state", "task_priority",
    )


# --- jobs lent to workers ---
_JOBS = """with recursive ev as (select receipt_id as job_id, case action when 'claim' then 'take' when 'close' then 'done' else action end as kind, ts, row_number() over (partition by receipt_id order by ts, event_id) as n from v_queue_events where action in ('enqueue', 'claim', 'close')),
st as (select job_id, cast(0 as bigint) as n, cast(null as varchar) as status, cast(null as timestamp) as until, 0 as taken, 0 as requeued, 0 as landed, 0 as dups, 0 as stale from ev where n = 1
 union all select job_id, n, case when kind = 'enqueue' and now is null then 'queued' when kind = 'take' and now = 'queued' then 'taken' when kind = 'done' and now in ('queued', 'taken') then 'done' else now end,
  case when kind = 'take' and now = 'queued' then ts + interval 900 second when kind = 'done' and now in ('queued', 'taken') then null when over then null else until end,
  taken + case when kind = 'take' and now = 'queued' then 1 else 0 end, requeued + over::int, landed + case when kind = 'done' and now in ('queued', 'taken') then 1 else 0 end, dups + case when kind = 'enqueue' and now is not null then 1 else 0 end,
  stale + case when kind = 'take' and now is distinct from 'queued' or kind = 'done' and coalesce(now, '-') not in ('queued', 'taken') then 1 else 0 end
 from (select s.job_id, e.n, e.kind, e.ts, s.until, s.taken, s.requeued, s.landed, s.dups, s.stale, coalesce(s.status = 'taken' and s.until < e.ts, false) as over, case when s.status = 'taken' and s.until < e.ts then 'queued' else s.status end as now
  from st s join ev e on e.job_id = s.job_id and e.n = s.n + 1) x),
la as (select *, row_number() over (partition by job_id order by n desc) as k from st)"""


@query("stream_leases", _JOBS + """ select job_id, cast(taken as bigint) as n_taken, cast(requeued + coalesce(status = 'taken' and until < (select max(ts) from ev), false)::int as bigint) as n_requeued,
 cast(landed as bigint) as n_landed, cast(dups as bigint) as n_duplicate, cast(stale as bigint) as n_stale from la where k = 1""")
def stream_leases(spark, sf_dir):
    """What became of each job of the queue's events as a stream: how often it was taken, taken back after 900 seconds, and done."""
    kind = F.create_map(*[F.lit(x) for x in ("enqueue", "enqueue", "claim", "take", "close", "done")])
    events = _stream(spark, sf_dir).select(F.col("receipt_id").alias("job_id"), "event_id", "ts", F.try_element_at(kind, F.col("action")).alias("kind"), F.col("user_id").alias("worker"), F.lit("done").alias("result")).where("kind is not null")
    with leases.rocks(spark):
        out = queue.run_to_table(leases.lease_events(events), new_path(spark, "leases"), "append")
    count = lambda e: F.count_if(F.col("event") == e)
    return out.groupBy("job_id").agg(count("taken").alias("n_taken"), count("requeued").alias("n_requeued"), count("landed").alias("n_landed"), count("duplicate").alias("n_duplicate"), count("stale").alias("n_stale"))


# --- results of repeats as files ---
_RUNS = """with e as (select *, cast(doc_id // 1000 as bigint) as run from v_eval),
r as (select run, repeat_no, count(*) as n, count(*) filter (confidence < 0.05) as failed, count(*) filter (critical_correct) as good, count(*) filter (confidence >= 0.85) as up, count(*) filter (confidence >= 0.85 and critical_correct) as right_up from e group by all),
m as (select run, repeat_no, unnest([{'key': 'accuracy', 'v': good / n, 'said': true}, {'key': 'precision', 'v': case when up > 2 then right_up / up end, 'said': up > 2}, {'key': 'n', 'v': cast(n as double), 'said': true}, {'key': 'never', 'v': null, 'said': false},
  {'key': 'cost', 'v': null, 'said': true}, {'key': 'flag', 'v': null, 'said': true}, {'key': 'mixed', 'v': case when repeat_no = 0 then cast(good as double) end, 'said': repeat_no < 3}, {'key': 'some', 'v': case when repeat_no % 2 = 0 then cast(up as double) end, 'said': repeat_no % 2 = 0}], recursive := true) from r),
nr as (select run, count(*) as repeats from r group by run),
sp as (select m.run, key, min(v) as min, max(v) as max, quantile_disc(v, 0.5) as median, count(v) as n, max(repeats) - count(*) filter (said) as n_null, count(*) filter (said) as said from m join nr on nr.run = m.run group by all)"""


def _stored(spark, sf_dir) -> DataFrame:
    """The newest results file of every repeat of every run; of some repeats an older file lies beside it."""
    rows = frame(spark, sf_dir, "v_eval").withColumn("run", F.floor(F.col("doc_id") / 1000))
    up = F.col("confidence") >= F.lit("0.85").cast("decimal(4,3)")
    n = rows.groupBy("run", "repeat_no").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") < F.lit("0.05").cast("decimal(4,3)")).alias("failed"), F.count_if("critical_correct").alias("good"), F.count_if(up).alias("up"),
        F.count_if(up & F.col("critical_correct")).alias("right_up"), F.array_sort(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("receipt_id")))).alias("results"),
    )
    k, c = F.col("repeat_no"), F.col
    mixed = F.when(k == 0, c("good").cast("string")).when(k < 3, F.lit('"three"')).otherwise(F.lit("null"))
    metrics = F.struct(
        (c("good") / c("n")).alias("accuracy"), F.when(c("up") > 2, c("right_up") / c("up")).alias("precision"), c("n").alias("n"), F.lit(None).cast("double").alias("never"), F.lit("1.25").alias("cost"), F.lit(True).alias("flag"),
        F.parse_json(mixed).alias("mixed"), F.when(k % 2 == 0, c("up")).alias("some"),
    )
    made = n.select("run", "repeat_no", F.struct("failed").alias("counts"), metrics.alias("metrics"), "results")
    path = new_path(spark, "results")
    old = made.where(k % 2 == 1).withColumn("counts", F.struct((c("counts.failed") + 1).alias("failed")))
    for part, name in ((old, "0"), (made, "1")):
        part.repartition("run", "repeat_no").write.option("ignoreNullFields", "false").option("maxRecordsPerFile", 1).json(f"{path}/{name}")
    files = repeats.stored_results(spark, path).where("result is not null")
    of = lambda name: F.try_variant_get("result", f"$.{name}", "bigint").alias(name)
    newest = repeats.newest(files.select("file_path", "modified", F.to_json("result").alias("text"), of("run"), of("repeat_no")), "run", "repeat_no")
    return newest.select("run", "repeat_no", F.parse_json("text").alias("result"))


@query("repeats_spread", _RUNS + " select run, key, min, max, median, n, n_null from sp where n > 0 or said = 0")
def repeats_spread(spark, sf_dir):
    """The spread of every metric over the repeats of each run, as their results files say it."""
    return repeats.spread_stored(_stored(spark, sf_dir), "run")


@query("repeats_covered", _RUNS + """, ids as (select run, string_agg(distinct cast(doc_id as varchar), ' ' order by cast(doc_id as varchar)) as scored from e group by run), om as (select run, string_agg(key, ' ' order by key) as spread_omitted from sp where not (n > 0 or said = 0) group by run)
select r.run, count(*) as n_repeats, cast(sum(failed) as bigint) as n_failed, coalesce(max(spread_omitted), '') as spread_omitted, max(scored) as scored from r join ids on ids.run = r.run left join om on om.run = r.run group by r.run""")
def repeats_covered(spark, sf_dir):
    """What each run holds: repeats, failed documents, metrics without a spread, and the documents that any repeat covered."""
    return repeats.aggregate(_stored(spark, sf_dir), "run").withColumns({c: F.array_join(c, " ") for c in ("spread_omitted", "scored")})


# --- stored rows as they are shown ---
_MONEY = lambda c: f"cast({c} as varchar)"
_ITEM_JSON = f"""json_object('position', position, 'description_raw', description_raw, 'sku', null, 'qty', {_MONEY('qty')}, 'unit', case when position % 3 = 0 then 'pc' end, 'unit_price', {_MONEY('unit_price')}, 'line_total', {_MONEY('line_total')}, 'is_template_row', is_template_row,
 'modifiers', case when modifier_amount <> 0 then json_array(json_object('label', 'promo', 'amount', {_MONEY('modifier_amount')})) else json_array() end, 'bbox', case when (doc_id + position) % 10 = 0 then json_array(0.25::double, 0.5::double) end)"""
_CARD = "'card ************1111 of ' || doc_id"
_FOUND = f"json_object('rule_id', '{{r}}', 'severity', '{{s}}', 'message', {_CARD}, 'context', null, 'resolved_by_repair', false)"


@query("receipt_details", f"""with li as (select doc_id, to_json(list({_ITEM_JSON} order by position)) as lines from v_items group by doc_id),
h as (select *, regexp_full_match(coalesce(date_text, ''), '\\d{{4}}-\\d{{2}}-\\d{{2}}') and try_cast(date_text as date) is not null as dated from v_headers),
f as (select doc_id, list_filter([case when total is null then {_FOUND.format(r='R010', s='error')} end, case when merchant_name is null then {_FOUND.format(r='R012', s='warn')} end], lambda x: x is not null) as found from h)
select h.doc_id, cast(json_object('id', cast(h.doc_id as varchar), 'status', v.status, 'confidence', '0.500', 'confidence_reasons', json_array(json_object('reason', 'some penalty', 'penalty', '-0.080')), 'merchant_name_raw', h.merchant_name,
 'buyer', json_object('name', h.buyer_name, 'tax_id', h.buyer_tax_id), 'receipt_number', 'R-' || h.doc_id, 'txn_date', case when dated then cast(try_cast(h.date_text as date) as varchar) end,
 'date_raw', case when not dated and coalesce(date_raw, '') = '' and h.date_text <> '' then h.date_text else date_raw end, 'txn_time', case when h.doc_id % 6 = 2 then '14:30:00' end, 'currency', h.currency,
 'payment_method', case h.doc_id % 3 when 0 then 'cash' when 1 then 'card' end, 'card_last4', case when h.doc_id % 3 = 1 then lpad(cast(h.doc_id % 10000 as varchar), 4, '0') end, 'is_handwritten', h.is_handwritten, 'legibility', legibility, 'duplicate_of', null,
 'receipt_is_inconsistent', h.doc_id % 31 = 0, 'totals', json_object('subtotal', {_MONEY('h.subtotal')}, 'tax', {_MONEY('h.tax')}, 'discount', {_MONEY('h.discount')}, 'total', {_MONEY('h.total')}, 'tender', {_MONEY('tender')}, 'change', {_MONEY('change')}),
 'line_items', coalesce(lines, json_array()), 'findings', to_json(found)) as varchar) as detail
from h join v_receipts v on v.doc_id = h.doc_id join f on f.doc_id = h.doc_id left join li on li.doc_id = h.doc_id""")
def receipt_details(spark, sf_dir):
    """Every receipt with its lines and findings as one JSON object."""
    rows = nested(spark, sf_dir).join(frame(spark, sf_dir, "v_receipts").select("doc_id", "status"), "doc_id")
    first = _outcome(rows, F.col("record"), F.col("status"), F.lit(-1), "first", "0.500", F.lit(None), 1)
    return serialise.details(persist.receipt_rows(first), persist.item_rows(first), persist.finding_rows(first))


@query("receipt_list", """select doc_id, cast(json_object('id', cast(doc_id as varchar), 'status', status, 'confidence', cast(confidence as varchar), 'merchant_name_raw', merchant_name, 'txn_date', strftime(txn_date, '%Y-%m-%d'), 'currency', currency, 'total', cast(total as varchar)) as varchar) as summary from v_receipts""")
def receipt_list(spark, sf_dir):
    return frame(spark, sf_dir, "v_receipts").withColumnRenamed("merchant_name", "merchant_name_raw").select("doc_id", serialise.as_json(serialise.summary()).alias("summary"))


@query("corrections_pages", f"""{_FOLD}, asks as (select distinct user_id, receipt_id from v_queue_events where user_id is not null),
c as (select *, row_number() over (partition by doc_id order by seq, path, new_value) as k from (select distinct * from v_corrections)),
p as (select doc_id, count(*) as n, to_json(list(json_object('field_path', path, 'value_before', null, 'value_after', new_value, 'corrected_by', 'r' || seq) order by k) filter (k <= 3)) as rows from c group by doc_id),
a as (select asks.*, case when o_orderkey is null then 404 when asks.user_id % 10 <> 0 and tk.assigned_to is distinct from asks.user_id then 403 else 200 end as code from asks left join (select distinct o_orderkey from {{orders}}) o on o_orderkey = asks.receipt_id left join tk on tk.receipt_id = asks.receipt_id)
select user_id, a.receipt_id as doc_id, code, case when code = 200 then coalesce(cast(rows as varchar), '[]') end as corrections, case when code = 200 then coalesce(n, 0) > 3 end as has_more from a left join p on p.doc_id = a.receipt_id""")
def corrections_pages(spark, sf_dir):
    """The first page of three corrections that each asking user gets of a receipt: admins (ids that end in 0) see all, others what
    they hold now; unseen receipts (null) are told from those without corrections (an empty list)."""
    asks = frame(spark, sf_dir, "v_queue_events").where("user_id is not null").select("user_id", F.col("receipt_id").alias("doc_id")).distinct()
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(True).alias("known")).distinct()
    held = _tasks(spark, sf_dir).select(F.col("receipt_id").alias("doc_id"), "assigned_to")
    allowed = (F.col("user_id") % 10 == 0) | F.col("assigned_to").eqNullSafe(F.col("user_id"))
    all_ = asks.join(known, "doc_id", "left").join(held, "doc_id", "left").withColumn("allowed", allowed)
    rows = frame(spark, sf_dir, "v_corrections").distinct()
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "path", "new_value"))
    by = F.concat(F.lit("r"), F.col("seq").cast("string"))
    audit = rows.select("doc_id", n.alias("n"), "path", F.lit(None).cast("string").alias("value_before"), F.col("new_value").alias("value_after"), by.alias("corrected_by"))
    return serialise.correction_pages(all_.select("user_id", "doc_id", "known", "allowed"), audit, limit=3)


_FEW = ("R010", "R011", "R012", "R014")
_PATHS = {"R010": "totals.total", "R011": "receipt.date", "R012": "merchant.name", "R014": "buyer.name"}


@query("findings_lookups", f"with {_SUMS}, f as (" + " union all ".join(f"select doc_id, '{r}' as rule_id, severity, '{_PATHS[r]}' as path from ({RULE_SQL[r]})" for r in _FEW) + """)
select o_orderkey as doc_id, cast(count(*) filter (severity = 'error') as int) as n_error, cast(count(*) filter (severity = 'warn') as int) as n_warn, coalesce(bool_or(rule_id = 'R010'), false) as no_total, coalesce(string_agg(rule_id, ' ') filter (path = 'merchant.name'), '') as on_merchant
from (select distinct o_orderkey from {orders}) o left join f on f.doc_id = o_orderkey group by o_orderkey""")
def findings_lookups(spark, sf_dir):
    """Findings looked up by severity, by rule and by the path that they touch."""
    found = rules.with_findings(records(spark, sf_dir), only=_FEW)
    ids = lambda fs: F.array_join(F.transform(fs, lambda f: f["rule_id"]), " ")
    size = lambda s: F.size(serialise.by_severity("findings", s))
    return found.select("doc_id", size("error").alias("n_error"), size("warn").alias("n_warn"), serialise.fired("findings", "R010").alias("no_total"), ids(serialise.touching("findings", "merchant.name")).alias("on_merchant"))


@query("findings_stored", _SAVED + f""", n0 as (select doc_id, total is null as t, merchant_name is null as m from v_headers where doc_id % 3 <> 1),
al2 as (select b.doc_id, concat_ws(' ', case when n0.t then 'R010' end, case when n0.m then 'R012' end, case when fresh and total is null then 'R010' end, case when fresh and name is null then 'R012' end) as rules from b left join n0 on n0.doc_id = b.doc_id)
select doc_id, rules from al2 where rules <> ''""")
def findings_stored(spark, sf_dir):
    """The stored findings of each document, the oldest first."""
    by = _saved(spark, sf_dir).read("findings").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("commit_no", "seq", "rule_id"))).alias("f"))
    return by.select("doc_id", F.array_join(F.transform("f", lambda x: x["rule_id"]), " ").alias("rules"))
