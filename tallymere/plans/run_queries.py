"""Queries over model answers, runs, stored rows, golden sets, lists and image sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money
from ..operators import answers, attempts, review, rules, runs
from ..operators.records import records
from ..sources.adapters import frame, sql, table
from ..sources.record_schema import CHOICES, DEFAULTS, NULLABLE_LISTS, RECORD, REQUIRED, kind_of
from .review_queries import _FOLD, _tasks
from .rule_queries import NARROW, RULE_SQL, _SUMS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLE_SQL[name] = sql(oracle)
        return build

    return register


# --- answers and runs ---
#: The scan for the closing brace as recursion over the pieces of each answer.
_BLOB = r"""with recursive src as (select *, case when regexp_matches(text, '(?s)```(?:json)?\s*.*?```') then regexp_extract(text, '(?s)```(?:json)?\s*(.*?)```', 1) else text end as inn from v_responses),
op as (select doc_id, rung, case when strpos(inn, '{') > 0 then substr(inn, strpos(inn, '{')) end as o from src),
tk as (select doc_id, rung, regexp_extract_all(o, '[\\"{}]|[^\\"{}]+') as t from op where o is not null),
st as (select doc_id, rung, 0 as n, 0 as depth, false as q, false as e, 0 as seen, 0 as fin from tk union all
 select doc_id, rung, n + 1, depth + case when not q and x = '{' then 1 when not q and x = '}' then -1 else 0 end, case when x = '"' and not e then not q else q end, q and not e and x = chr(92),
  cast(seen + length(x) as int), case when not q and x = '}' and depth = 1 then cast(seen + length(x) as int) else 0 end from (select s.*, tk.t[s.n + 1] as x from st s join tk using (doc_id, rung) where s.fin = 0 and s.n < len(tk.t)) y),
ends as (select doc_id, rung, max(fin) as size from st group by all),
bl as (select doc_id, rung, case when trim(text) = '' then 'empty answer' when o is null then 'no object in the answer' when size = 0 then 'the object is cut short' end as blob_error,
 case when size > 0 then regexp_replace(substr(o, 1, size), ',\s*([}\]])', '\1', 'g') end as blob from v_responses join op using (doc_id, rung) left join ends using (doc_id, rung)),
va as (select *, coalesce(json_valid(blob), false) as valid from bl),
js as (select *, case when valid then blob else '{}' end as j from va),
kd(pattern, ord, kind, opt) as (values KINDS),
nd as (select doc_id, rung, substr(t.fullkey, 3) as path, t.type as type, t.value as v, t.value->>'$' as s, regexp_extract_all(t.fullkey, '\[(\d+)\]', 1) as ix from js, json_tree(js.j) t),
kn as (select nd.*, kind, opt, replace(replace(ord, '#1', lpad(coalesce(ix[1], ''), 6, '0')), '#2', lpad(coalesce(ix[2], ''), 6, '0')) as ord from nd join kd on kd.pattern = regexp_replace(path, '\[\d+\]', '[]', 'g')),
ft as (select *, opt and type = 'NULL' or case kind when 'text' then type = 'VARCHAR' when 'list' then type = 'ARRAY' when 'object' then type = 'OBJECT'
   when 'money' then num or type = 'VARCHAR' and NUMBER when 'number' then num or type = 'BOOLEAN' or type = 'VARCHAR' and NUMBER
   when 'int' then type = 'BOOLEAN' or (num or type = 'VARCHAR') and regexp_full_match(s, '\s*[-+]?\d+(\.0*)?\s*')
   when 'bool' then type = 'BOOLEAN' or num and regexp_full_match(s, '[01](\.0*)?') or type = 'VARCHAR' and lower(s) in ('true', 'false', '1', '0', 'yes', 'no', 'on', 'off', 't', 'f', 'y', 'n')
   else type = 'VARCHAR' and list_contains(string_split(kind, ', '), s) end as fits from (select *, type in ('BIGINT', 'UBIGINT', 'DOUBLE') as num from kn)),
er as (select doc_id, rung, ord, path, case kind when 'text' then 'not a text' when 'money' then 'not a number' when 'number' then 'not a number' when 'int' then 'not a whole number' when 'bool' then 'not true or false'
   when 'list' then 'not a list' when 'object' then 'not an object' else 'not one of ' || kind end as said from ft where not fits
 union all select doc_id, rung, ord || '00', path || '.label', 'missing' from kn where regexp_full_match(path, 'line_items\[\d+\]\.modifiers\[\d+\]') and type = 'OBJECT' and not json_exists(v, '$.label')),
f5 as (select doc_id, rung, said, min(ord) as first, string_agg(path, ', ' order by ord) as paths from (select *, row_number() over (partition by doc_id, rung order by ord) as k from er) where k <= 5 group by all),
e5 as (select doc_id, rung, string_agg(said || ': ' || paths, '; ' order by first) as wrong from f5 group by all),
re as (select js.*, case when blob_error is not null then blob_error when not valid then 'invalid JSON' else wrong end as error from js left join e5 using (doc_id, rung)),
rec as (select doc_id, rung, error, case when error is null then j->>'$.merchant.name' end as merchant_name, case when error is null then j->>'$.totals.total' end as total, case when error is null then j->>'$.receipt.currency' end as currency from re)"""


def _kinds(kind, pattern: str = "", order: str = "", depth: int = 1):
    """(pattern, order, kind, may be null) of every field of the schema and of the elements of its lists."""
    for n, f in enumerate(kind.fields):
        below, at = f"{pattern}.{f.name}" if pattern else f.name, f"{order}{n:02d}"
        name = kind_of(f.dataType)
        free = below in NULLABLE_LISTS or not (name in ("list", "object") or below in DEFAULTS or below in REQUIRED)
        yield below, at, ", ".join(CHOICES[below]) if below in CHOICES else name, free
        inner = f.dataType
        if name == "list":
            below, at, inner = below + "[]", f"{at}#{depth}", inner.elementType
            yield below, at, kind_of(inner), False
        if kind_of(inner) == "object":
            yield from _kinds(inner, below, at, depth + (name == "list"))


_BLOB = _BLOB.replace("KINDS", ", ".join(f"('{p}', '{o}', '{k}', {free})" for p, o, k, free in _kinds(RECORD))).replace("NUMBER", r"regexp_full_match(s, '\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*')")
_OUTCOMES = _BLOB + """, att as (select *, merchant_name is not null and not call_failed as good from v_responses join rec using (doc_id, rung)),
kk as (select *, row_number() over (partition by doc_id order by good desc, case when good then rung else -rung end) as k, count(*) over d as n_attempts, cast(sum(cost_usd) over d as decimal(18,6)) as cost, sum(latency_ms) over d as latency from att window d as (partition by doc_id)),
oc as (select doc_id, rung, model_id, call_failed as failed, not good as read_nothing, n_attempts, cost as cost_usd, cast(latency as bigint) as latency_ms, total from kk where k = 1)"""


def _answers(spark, sf_dir):
    return answers.with_record(frame(spark, sf_dir, "v_responses"))


def _outcomes(spark, sf_dir):
    return runs.outcomes(_answers(spark, sf_dir).withColumn("usable", F.coalesce(answers.has_content(), F.lit(False))))


@query("json_blob", _BLOB + " select doc_id, rung, blob, blob_error from bl")
def json_blob(spark, sf_dir):
    return answers.with_blob(frame(spark, sf_dir, "v_responses")).select("doc_id", "rung", "blob", "blob_error")


@query("parse_model_json", _BLOB + " select * from rec")
def parse_model_json(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", "rung", "error", F.col("record.merchant.name").alias("merchant_name"), F.col("record.totals.total").alias("total"), F.col("record.receipt.currency").alias("currency"))


@query("attempt_outcomes", _OUTCOMES + " select * exclude (total) from oc")
def attempt_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query("rung_counts", _OUTCOMES + " select model_id, count(*) as n_kept, count(*) filter (failed) as n_failed from oc group by model_id")
def rung_counts(spark, sf_dir):
    return _outcomes(spark, sf_dir).groupBy("model_id").agg(F.count(F.lit(1)).alias("n_kept"), F.count_if("failed").alias("n_failed"))


@query("batch_counts", _OUTCOMES + " select case when failed then 'failed' when read_nothing then 'needs_review' else 'processed' end as status, count(*) as n, cast(sum(cost_usd) as decimal(18,6)) as cost_usd, cast(sum(latency_ms) as bigint) as latency_ms from oc group by 1")
def batch_counts(spark, sf_dir):
    status = F.when(F.col("failed"), "failed").when(F.col("read_nothing"), "needs_review").otherwise("processed")
    return _outcomes(spark, sf_dir).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"), F.sum("latency_ms").alias("latency_ms"))


@query("response_cache", """select model_id || ':0.0:' || sha256(total_text) || ':' || cast(doc_id % 101 as varchar) as cache_key, count(*) as n_calls from v_responses where not call_failed group by 1""")
def response_cache(spark, sf_dir):
    """The keys under which sound answers at temperature 0 are kept, and how many calls each would have spared."""
    key = runs.cache_key(F.col("model_id"), F.lit(0.0), F.sha2("total_text", 256), (F.col("doc_id") % 101).cast("string"))
    return frame(spark, sf_dir, "v_responses").where("not call_failed").groupBy(key.alias("cache_key")).agg(F.count(F.lit(1)).alias("n_calls"))


# --- stored rows ---
@query("failures_landed", _OUTCOMES + """ select doc_id, case when failed and status <> 'reviewed' then 'needs_review' else status end as status,
 cast(case when failed and status <> 'reviewed' then 0 else confidence end as decimal(4,3)) as confidence, failed as queued from v_receipts join oc using (doc_id)""")
def failures_landed(spark, sf_dir):
    return runs.failures_landed(frame(spark, sf_dir, "v_receipts"), _outcomes(spark, sf_dir).where("failed"))


@query("extractions_saved", _OUTCOMES + """, inc as (select doc_id, cast(total as decimal(14,4)) as total from oc where not read_nothing)
select doc_id, case when i.doc_id is not null and status <> 'reviewed' then i.total else r.total end as total, cast(case when i.doc_id is not null and status <> 'reviewed' then 0.9 else confidence end as decimal(4,3)) as confidence,
 case when i.doc_id is null then 'kept' when status = 'reviewed' then 'refused' else 'updated' end as verdict from v_receipts r left join inc i using (doc_id)""")
def extractions_saved(spark, sf_dir):
    usable = F.coalesce(answers.has_content(), F.lit(False)).alias("usable")
    read = _answers(spark, sf_dir).select("doc_id", "rung", "model_id", "call_failed", "cost_usd", "latency_ms", usable, F.col("record.totals.total").cast("decimal(14,4)").alias("total"))
    kept = runs.outcomes(read, "total").where("not read_nothing").select("doc_id", "total", F.lit("0.9").cast("decimal(4,3)").alias("confidence"))
    return runs.saved(frame(spark, sf_dir, "v_receipts"), kept)


@query("reprocess_gate", """select doc_id, case status when 'auto_approved' then 'needs force' when 'reviewed' then 'run, not written' else 'run' end as gate,
 case status when 'reviewed' then 'run, not written' else 'run' end as forced from v_receipts""")
def reprocess_gate(spark, sf_dir):
    return frame(spark, sf_dir, "v_receipts").select("doc_id", runs.reprocess_gate("status").alias("gate"), runs.reprocess_gate("status", True).alias("forced"))


@query("corrections_route", f"""{_FOLD}, asks as (select distinct user_id, receipt_id from v_queue_events where user_id is not null), n as (select doc_id, count(*) as n from v_corrections group by doc_id),
a as (select asks.*, case when o_orderkey is null then 404 when asks.user_id % 10 <> 0 and tk.assigned_to is distinct from asks.user_id then 403 else 200 end as code from asks left join {{orders}} on o_orderkey = asks.receipt_id left join tk on tk.receipt_id = asks.receipt_id)
select user_id, receipt_id, code, case when code = 200 then least(coalesce(n, 0), 3) end as n_items, case when code = 200 then coalesce(n, 0) > 3 end as has_more from a left join n on n.doc_id = a.receipt_id""")
def corrections_route(spark, sf_dir):
    """What each asking user gets of a receipt's corrections, a page of three: unknown receipts before unseen ones before empty ones.

    Users whose id ends in 0 are admins; others see a receipt whose task names them now.
    """
    asks = frame(spark, sf_dir, "v_queue_events").where("user_id is not null").select("user_id", "receipt_id").distinct()
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("receipt_id"), F.lit(True).alias("known"))
    counts = frame(spark, sf_dir, "v_corrections").groupBy(F.col("doc_id").alias("receipt_id")).agg(F.count(F.lit(1)).alias("n"))
    all_ = asks.join(known, "receipt_id", "left").join(_tasks(spark, sf_dir).select("receipt_id", "assigned_to"), "receipt_id", "left").join(counts, "receipt_id", "left")
    admin, mine, n = F.col("user_id") % 10 == 0, F.col("assigned_to").eqNullSafe(F.col("user_id")), F.coalesce("n", F.lit(0))
    coded = all_.withColumn("code", F.when(F.col("known").isNull(), 404).when(~admin & ~mine, 403).otherwise(200))
    seen = F.col("code") == 200
    return coded.select("user_id", "receipt_id", "code", F.when(seen, F.least(n, F.lit(3))).alias("n_items"), F.when(seen, n > 3).alias("has_more"))


@query("findings_by_rule", f"with {_SUMS}, f as (" + " union all ".join(f"select doc_id, '{r}' as rule_id, severity from ({q})" for r, q in RULE_SQL.items()) + ") select doc_id, rule_id, severity, count(*) as n from f group by all")
def findings_by_rule(spark, sf_dir):
    found = rules.findings_table(records(spark, sf_dir), NARROW)
    return found.groupBy("doc_id", "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


# --- lists ---
@query("merchants_list", "select merchant_id, canonical_name, row_number() over (order by canonical_name, merchant_id) as n from v_merchants")
def merchants_list(spark, sf_dir):
    return review.numbered(frame(spark, sf_dir, "v_merchants").select("canonical_name", "merchant_id"), "canonical_name", "merchant_id")


@query("users_list", "select user_id, row_number() over (order by user_id) as n from (select distinct user_id from {events} where user_id is not null)")
def users_list(spark, sf_dir):
    return review.numbered(table(spark, sf_dir, "events").where("user_id is not null").select("user_id").distinct(), "user_id")


@query("pending_drain", "select created_rank, doc_id, row_number() over (order by created_rank, doc_id) as n from v_receipts where status = 'pending'")
def pending_drain(spark, sf_dir):
    return review.numbered(frame(spark, sf_dir, "v_receipts").where("status = 'pending'").select("created_rank", "doc_id"), "created_rank", "doc_id")


# --- golden set and repeats ---
SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
_RANK = "list_position([" + ", ".join(f"'{s}'" for s in SUFFIXES) + "], suffix)"


@query("golden_images", f"""with im as (select stem, suffix, file_id, row_number() over (partition by stem order by {_RANK}, file_id) as k from v_images where coalesce({_RANK}, 0) > 0)
select doc_id, suffix, file_id from (select distinct doc_id from {{labels}}) l left join im on im.stem = l.doc_id and k = 1""")
def golden_images(spark, sf_dir):
    """Each label's image: the file of the same stem whose suffix comes first; null where there is none."""
    rank = F.array_position(F.array(*map(F.lit, SUFFIXES)), F.col("suffix"))
    best = frame(spark, sf_dir, "v_images").where(rank > 0).groupBy(F.col("stem").alias("doc_id")).agg(F.min(F.struct(rank.alias("rank"), "file_id", "suffix")).alias("b"))
    return table(spark, sf_dir, "labels").select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", "b.suffix", "b.file_id")


@query("golden_composition", """with l as (select l.doc_id, category, holdout from (select distinct doc_id from {labels}) l left join v_manifest m on m.doc_id = l.doc_id)
select 'total' as metric, count(*) as n from l union all select 'holdout', count(*) filter (holdout) from l union all select 'meets_minimum', cast(count(*) >= 50 as bigint) from l
union all select 'category:' || category, count(*) from l where category is not null group by category""")
def golden_composition(spark, sf_dir):
    """Size and mix of the labelled set; entries without a label don't count."""
    mine = table(spark, sf_dir, "labels").select("doc_id").distinct().join(frame(spark, sf_dir, "v_manifest"), "doc_id", "left")
    whole = mine.agg(F.count(F.lit(1)).alias("total"), F.count_if("holdout").alias("holdout")).select(F.inline(F.array(
        F.struct(F.lit("total").alias("metric"), F.col("total").alias("n")), F.struct(F.lit("holdout").alias("metric"), F.col("holdout").alias("n")),
        F.struct(F.lit("meets_minimum").alias("metric"), (F.col("total") >= 50).cast("long").alias("n")))))
    return whole.union(mine.where("category is not null").groupBy(F.concat(F.lit("category:"), "category").alias("metric")).agg(F.count(F.lit(1)).alias("n")))


_PCT = "case when n = n_failed then 'n/a' else concat(cast((n_right * 2000 + n - n_failed) // (2 * (n - n_failed)) // 10 as varchar), '.', cast((n_right * 2000 + n - n_failed) // (2 * (n - n_failed)) % 10 as varchar), '%') end"


@query("repeats_aggregate", f"""with r as (select repeat_no, count(*) as n, count(*) filter (confidence < 0.05) as n_failed, count(*) filter (confidence >= 0.05 and critical_correct) as n_right from v_eval group by rollup (repeat_no))
select repeat_no, n as n_receipts, n_failed, n_right, {_PCT} as accuracy from r""")
def repeats_aggregate(spark, sf_dir):
    """Per repeat and over all (repeat_no null): documents, failed ones (confidence under 0.05) and accuracy over the rest as text."""
    failed = F.col("confidence") < money.dec("0.05")
    r = frame(spark, sf_dir, "v_eval").rollup("repeat_no").agg(F.count(F.lit(1)).alias("n_receipts"), F.count_if(failed).alias("n_failed"), F.count_if(~failed & F.col("critical_correct")).alias("n_right"))
    tenths = F.expr("(n_right * 2000 + n_receipts - n_failed) div (2 * (n_receipts - n_failed))")
    text = F.when(F.col("n_receipts") == F.col("n_failed"), "n/a").otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")))
    return r.select("*", text.alias("accuracy"))


# --- paths, currencies and sizes ---
@query("path_order", "select doc_id, string_agg('line_items[' || position || '].modifiers[' || cast(cast(qty as int) as varchar) || '].amount', ' ' order by position, qty) as paths from v_items group by doc_id")
def path_order(spark, sf_dir):
    """Each document's modifier paths, list places in the order of their numbers. One document's paths are one row."""
    path = F.concat(F.lit("line_items["), F.col("position").cast("string"), F.lit("].modifiers["), F.col("qty").cast("int").cast("string"), F.lit("].amount"))
    keyed = frame(spark, sf_dir, "v_items").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(runs.sort_key(path).alias("k"), path.alias("p")))).alias("ps"))
    return keyed.select("doc_id", F.array_join(F.transform("ps", lambda x: x["p"]), " ").alias("paths"))


@query("same_currency", "select doc_id, upper(trim(coalesce(currency, ''))) = upper(trim(coalesce(currency_text, ''))) as same from v_headers join v_text using (doc_id)")
def same_currency(spark, sf_dir):
    both = frame(spark, sf_dir, "v_headers").select("doc_id", "currency").join(frame(spark, sf_dir, "v_text").select("doc_id", "currency_text"), "doc_id")
    return both.select("doc_id", runs.same_currency(F.col("currency"), F.col("currency_text")).alias("same"))


_EDGE = "cast(case when greatest(width, height) <= 2048 then {e} else greatest(1, round_even({e} * (cast(2048 as double) / greatest(width, height)), 0)) end as int)"


@query("image_sizes", f"select image_id, {_EDGE.format(e='width')} as width, {_EDGE.format(e='height')} as height from v_corners")
def image_sizes(spark, sf_dir):
    return frame(spark, sf_dir, "v_corners").select("image_id", runs.fitted_size(F.col("width"), F.col("height")).alias("s")).select("image_id", "s.*")


@query("corner_order", """with p as (select image_id, unnest([width + b, a, b, width + a]) as x, unnest([height + a, b, height + b, a]) as y, unnest([0, 1, 2, 3]) as i from v_corners),
t as (select *, x || ',' || y as t from p)
select image_id, arg_min(t, (x + y) * 10 + i) || ' ' || arg_min(t, (y - x) * 10 + i) || ' ' || arg_min(t, -(x + y) * 10 + i) || ' ' || arg_min(t, (x - y) * 10 + i) as corners from t group by image_id""")
def corner_order(spark, sf_dir):
    points = F.expr("array(named_struct('x', width + b, 'y', height + a), named_struct('x', a, 'y', b), named_struct('x', b, 'y', height + b), named_struct('x', width + a, 'y', a))")
    best = F.transform(runs.ordered_corners(points), lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string")))
    return frame(spark, sf_dir, "v_corners").select("image_id", F.array_join(best, " ").alias("corners"))


# --- asking again ---
_CHECKED = _OUTCOMES + """, ck as (select v.doc_id, v.rung, error is null and not call_failed as ok, merchant_name as m, total as t, currency as c, coalesce(cast(json_array_length(j, '$.line_items') as int), 0) as lines from v_responses v join rec using (doc_id, rung) join js using (doc_id, rung)),
ev as (select doc_id, rung, ok, list_filter([case when not ok then 'R001' end, case when not ok or t is null then 'R010' end, case when not ok or trim(coalesce(m, '')) = '' then 'R012' end, case when not ok or lines = 0 then 'R013' end], lambda r: r is not null) as rules,
 cast(case when ok then (m is null)::int + (t is null)::int + (c is null)::int else 3 end as bigint) as n_null from ck),
rk as (select *, len(list_filter(rules, lambda r: r in ('R001', 'R010'))) as n_error, len(list_filter(rules, lambda r: r in ('R012', 'R013'))) as n_warn from ev)"""


@query("repair_rounds", _CHECKED + """, two as (select a.doc_id, a.n_error > 0 as again, a.ok as parsed, a.rules as first, a.n_error > 0 and row(b.n_error, b.n_warn, b.n_null) < row(a.n_error, a.n_warn, a.n_null) as second, a.n_error as e0, a.n_warn as w0, b.n_error as e1, b.n_warn as w1, b.rules as rules from rk a join rk b on b.doc_id = a.doc_id and a.rung = 0 and b.rung = 1)
select doc_id, case when not again then 'extract' when parsed then 'extract repair' else 'extract re_extract' end as passes, cast(case when second then 2 else 1 end as int) as kept_attempt, cast(case when second then 1 else 0 end as bigint) as kept_seq,
 cast(case when second then e1 else e0 end as bigint) as n_error, cast(case when second then w1 else w0 end as bigint) as n_warn, case when second then array_to_string(list_sort(list_filter(first, lambda r: not list_contains(rules, r))), ' ') else '' end as resolved,
 cast(case when again then 0 else 1 end as int) as n_not_called from two""")
def repair_rounds(spark, sf_dir):
    """What asking again once came to: a sound answer ends it, one that didn't parse is extracted anew, one with errors repaired."""
    a = _answers(spark, sf_dir)
    ok = F.col("error").isNull() & ~F.col("call_failed")
    name, total = F.col("record.merchant.name"), F.col("record.totals.total")
    lines = F.coalesce(F.size("record.line_items"), F.lit(0))
    fired = [("R001", ~ok), ("R010", ~ok | total.isNull()), ("R012", ~ok | (F.trim(F.coalesce(name, F.lit(""))) == "")), ("R013", ~ok | (lines <= 0))]
    ids = F.array_compact(F.array(*[F.when(on, r) for r, on in fired]))
    errors = F.size(F.filter("rules", lambda r: r.isin("R001", "R010")))
    nulls = F.when(ok, sum((c.isNull().cast("int") for c in (total, F.col("record.receipt.currency"))), name.isNull().cast("int"))).otherwise(3)
    given = a.select("doc_id", F.col("rung").alias("seq"), ok.alias("parsed"), nulls.alias("n_null"), ids.alias("rules")).withColumns({"n_error": errors, "n_warn": F.size("rules") - errors})
    made = attempts.repaired(given, most_repairs=1)
    return made.select("doc_id", F.array_join("passes", " ").alias("passes"), F.col("kept_attempt").cast("int").alias("kept_attempt"), "kept_seq", "n_error", "n_warn", F.array_join("resolved", " ").alias("resolved"), F.col("n_not_called").cast("int").alias("n_not_called"))
