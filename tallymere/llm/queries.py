"""The queries op1 to op10 and their SQL. Each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, conversation_repair, decontamination, exact_dedup, line_dedup, mixing, ngram_join, periodic_runs, quality_classifier, quality_rules, url_filters, warc
from .common import delete_path, new_path, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_groups(_table(spark, sf_dir, "documents"), n=4, percent=85)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_texts(_table(spark, sf_dir, "documents"), tokenizer_path())
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.turn", "t.role", F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.format_conversations(turns))
    return back.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


#: The digests and counts; formatted_chars by the same template. In texts, backslashes are doubled and control strings get one more.
OP3_SQL = r"""
with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations
 union all select -7, k, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(k, r)),
n as (select *, length(text) + length(text) - length(replace(text, chr(92), ''))
  + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<\|startoftext\|>|<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]')) + length(role) + 24 as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
from n group by conv_id
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive, files = new_path(spark, "archive"), new_path(spark, "warc")
    warc.write_archive(*warc.warc_records(_table(spark, sf_dir, "pages"), "page_id", "url", "html"), archive)
    warc.export_warc(warc.read_archive(spark, archive), files)
    delete_path(spark, archive)
    read = written(warc.parsed(warc.import_warc(spark, files)).drop("header", "content", "payload"), "warc-read")
    delete_path(spark, files)
    return warc.resolved(read).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n from pages),
o as (select *, min(page_id) over (partition by html) as owner from p)
select page_id, cast(n as bigint) as payload_bytes, sha256(html) as payload_digest,
 case when n >= 100 and page_id is distinct from owner then 'revisit' else 'response' end as record_type,
 case when n >= 100 and page_id is distinct from owner then owner end as refers_to
from o
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"), keep="max")


OP6_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
 doc_id is not distinct from max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as k from documents),
h as (select *, cast(('0x' || substr(md5(lag(md5(line)) over w || md5(line)), 1, 8)) as bigint) % 3 = 0 as cut from l window w as (partition by doc_id order by k)),
c as (select *, coalesce(sum(case when cut then 1 else 0 end) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as chunk from h),
t as (select doc_id, chunk, string_agg(line, chr(10) order by k) as body, count(*) as n, count(*) filter (regexp_matches(line, '[^\x20\x09-\x0D]')) >= 2 as multi from c group by doc_id, chunk),
r as (select *, not multi or row_number() over (partition by multi, body order by doc_id, chunk) = 1 as stays from t)
select doc_id, cast(sum(n) as bigint) as n_lines, count(*) as n_chunks, count(*) filter (not stays) as removed_chunks,
 cast(coalesce(sum(n) filter (not stays), 0) as bigint) as removed_lines, coalesce(string_agg(body, chr(10) order by chunk) filter (stays), '') as text
from r group by doc_id
"""


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_passages(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same rule with a sort: documents of a source in the order of their tickets up to what is left of the budget.
OP8_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
  cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as ticket from documents),
s as (select source, cast(sum(size) as bigint) as source_size, cast(list_extract([5, 2, 1], cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)) as double) as weight from d group by source),
c as (select *, source_size * 3.0::double as cap, cast(sum(source_size) over () as double) as total from s),
f as (select *, (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level from c),
g as (select *, (select f2.level from f f2 where f2.level * f2.weight <= f2.cap order by f2.cap / f2.weight limit 1) as fill from f),
t as (select source, source_size, case when fill is null then cap else least(cap, fill * weight) end as target from g),
w as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from t),
r as (select d.doc_id, d.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size as budget,
  sum(d.size) over (partition by d.source order by d.ticket) as through, sum(d.size) over (partition by d.source, d.ticket) as own
  from d join w on d.source is not distinct from w.source)
select doc_id, size, source_size, target,
 cast(size * least(3, whole + case when budget > 0 and (through <= budget or (budget - (through - own)) * 2 >= own and through - own <= budget) then 1 else 0 end) as bigint) as taken
from r
"""


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
with p as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
q as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
r(host, path, verdict) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m as (select page_id, r.host || r.path as rule, verdict, row_number() over (partition by page_id order by length(r.host || r.path) desc) as k
  from q join r on (q.host = r.host or ends_with(q.host, '.' || r.host)) and starts_with(q.path, r.path))
select q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, 'allow') as verdict from q left join m on m.page_id = q.page_id and m.k = 1
"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair_conversations(conversation_repair.damaged(turns), present=turns)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_tails(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = periodic_runs.strongest(F.col("runs"))
    found = periodic_runs.periodic_runs(docs).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(periodic_runs.as_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_bpe": op2_bpe,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_quality_rules": op4_quality_rules,
    "op9_quality_classifier": op9_quality_classifier,
    "op5_warc": op5_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op7_passage_dedup": op7_passage_dedup,
    "op8_mixing": op8_mixing,
    "op10_url_filters": op10_url_filters,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_decontamination": op12_decontamination,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {"op3_chat_formatting": OP3_SQL, "op5_warc": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_mixing": OP8_SQL, "op10_url_filters": OP10_SQL}
