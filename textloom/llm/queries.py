"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair, decontamination, exact_dedup, html_extraction, imatch, language_id, mixing, packing, simhash, substring_dedup,
    token_alignment, token_files, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Production parameters of the url filter.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
LISTED_LABELS = ["adult-x", "cheap-pills", "spam-farm"]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_extraction.extract(table(spark, folder, "pages"))


@query("op2_url_cascade", """
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages
), split as (
  select page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') as raw, coalesce(rest, '') as rest from parts
), named as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from split
), rules as (
  select * from (values ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
    ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')) r(rule, h, p, says)
), best as (
  select n.page_id, n.host, n.path, r.rule, r.says,
    row_number() over (partition by n.page_id order by length(r.rule) desc nulls last, length(r.h) desc) as k
  from named n left join rules r on (n.host = r.h or ends_with(n.host, '.' || r.h)) and starts_with(n.path, r.p)
)
select page_id, host, path, rule, coalesce(says,
  case when list_has_any(string_split(host, '.'), ['adult-x', 'cheap-pills', 'spam-farm']) then 'block' else 'allow' end) as verdict
from best where k = 1
""")
def url_cascade(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    cascade = url_filter.build(url_filter.listed_hosts(pages, LISTED_LABELS))
    return url_filter.judge(pages, cascade, RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op3_substring_dedup", r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), runs as (
  select doc_id, p, md5(array_to_string(ws[p : p + 34], ' ')) as h from w, unnest(range(1, greatest(len(ws) - 33, 1))) t(p)
), again as (
  select h from runs group by h having count(*) > 1
), covered as (
  select doc_id, list(distinct p + k) as c from runs join again using (h), range(0, 35) r(k) group by doc_id
), kept as (
  select w.doc_id, len(ws) as n, coalesce(len(c), 0) as gone,
    case when c is null then ws else
      list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: not list_contains(c, x[2])), lambda x: x[1]) end as k
  from w left join covered using (doc_id)
)
select doc_id, n::bigint as n_words, gone::bigint as n_removed, sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256 from kept
""")
def substring(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.repeated_spans(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op5_exact_dedup", """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
""")
def exact(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, folder, "documents"))


@query("op6_token_files")
def arrow_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


@query("op7_imatch")
def imatch_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprints(table(spark, folder, "documents"))


@query("op8_language_id")
def language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op9_simhash")
def simhash_components(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_mixing", r"""
with d as (
  select doc_id, source, coalesce(source, '') as src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n,
    md5(coalesce(doc_id::varchar, '')) as m from documents
), s as (select src, sum(n)::bigint as words from d group by src
), t as (select sum(words)::bigint as total, count(*) filter (words > 0) as cnt from s
), grid as (
  select a, ln(sum(p)) - sum(p * ln(p)) / sum(p) as h, max(p / words) / sum(p) * any_value(total) as rep, sum(p) as z
  from (select g.a, words, total, pow(words / total, g.a / 1024::double) as p from s, t, range(0, 1025) g(a) where words > 0) group by a
), by_entropy as (select max(a) as a from grid, t where h >= 0.95 * ln(cnt)
), chosen as (
  select case when (select rep from grid g where g.a = e.a) <= 4 then e.a
    else coalesce((select min(g.a) from grid g where g.a > e.a and g.rep <= 4), 1024) end as a from by_entropy e
), plan as (
  select src, case when words > 0 then round(pow(words / total, c.a / 1024::double) / g.z * total::double / words, 9) else 0 end as ratio,
    words // 32768 + 1 as blocks from s, t, chosen c join grid g on g.a = c.a
), b as (
  select d.*, ratio, (('0x' || substr(m, 1, 8))::bigint * blocks) >> 32 as block from d join plan using (src)
), r as (
  select *, row_number() over o - 1 as place, sum(n) over o as upto, sum(n) over (partition by src, block) as whole
  from b window o as (partition by src, block order by m, n rows unbounded preceding)
)
select doc_id, source, n as n_words, block::bigint as block, place::bigint as place,
  (floor(ratio) + case when ratio - floor(ratio) > 0 and upto - n / 2 <= (ratio - floor(ratio)) * whole then 1 else 0 end)::integer as copies
from r
""")
def temperature_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    found = mixing.assign(docs, mixing.weights(docs), drop_text=True)
    return found.select("doc_id", "source", F.col("_words").alias("n_words"), F.col("_block").alias("block"), F.col("_place").alias("place"), F.col("_copies").alias("copies"))


@query("op12_decontamination", r"""
with w as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
  select item_id::varchar as item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), windows as (
  select distinct item, least(len(ws), 10) as n, array_to_string(ws[p : p + 9], ' ') as g
  from b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) t(p) where len(ws) > 0
), runs as (
  select r, p, n, array_to_string(ws[p : p + n - 1], ' ') as g
  from w, (select distinct n from windows) l, unnest(range(1, len(ws) - n + 2)) t(p)
), hits as (select r, p, n, item from runs join windows using (n, g)
), words as (select r, count(distinct p + k)::bigint as n_hit from hits, unnest(range(0, n)) t(k) group by r
), items as (select r, count(item)::bigint as n_items, string_agg(item, ',' order by item) as list from (select distinct r, item from hits) group by r
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(list, '')) as items_sha256, n_hit is not null as contaminated
from w left join words using (r) left join items using (r)
""")
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _add(way: str, cost: str, edit: str) -> str:
    """SQL: a way (ten digits of cost, then edits) with an edit more."""
    return f"lpad((left({way}, 10)::bigint + {cost})::varchar, 10, '0') || substr({way}, 11) || '{edit}'"


# The twin keeps, for each of four states, the least way as text; costs are padded, so the least text is the cheapest way.
@query("op13_conversation_repair", f"""
with recursive crc as (
  select list(list_reduce([c::bigint] || range(0, 8), lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) order by c) as t
  from range(0, 256) r(c)
), keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
  from conversations
), harmed as (
  select *, xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(key) + 1), lambda i: ord(substr(key, i, 1))::bigint),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as harm from keyed, crc
), damaged as (
  select conv_id, turn, case when harm = 4 then 'user' else role end as role,
    case when harm = 1 then '' when harm = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when harm = 0 then [] when harm = 3 then [1, 2] else [1] end) as copy from harmed
), ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as k,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again,
    regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') as body, left(role, 1) as i from damaged
), rows_after as (
  select *, case when body = '' then 'b' when again > 1 then 'd' when right(body, 1) not in ('.', '!', '?') then 't' else '.' end as fault,
    lag(i) over (partition by conv_id order by k) as before from ordered
), faults as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'b') as blank,
    count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
    count(*) filter (k > 1 and before || i not in ('su', 'ua', 'au')) as illegal from rows_after group by conv_id
), ways as (
  select conv_id, 0::bigint as k, '0000000000' as t0, null::varchar as t1, null::varchar as t2, null::varchar as t3 from faults
  union all
  select conv_id, k, {_add('t0', '3', 'D')},
    least({_add('t1', '3', 'D')}, case when stays and i = 's' then {_add('t0', 'extra', 'K')} end),
    least({_add('i2', '3', 'D')}, case when stays and i = 'u' then least({_add('t0', 'extra', 'K')}, {_add('t1', 'extra', 'K')}, {_add('i3', 'extra', 'K')}) end,
      case when stays then least({_add('t0', 'extra + 2', 'R')}, {_add('t1', 'extra + 2', 'R')}, {_add('i3', 'extra + 2', 'R')}) end),
    least({_add('i3', '3', 'D')}, case when stays and i = 'a' then {_add('i2', 'extra', 'K')} end, case when stays then {_add('i2', 'extra + 2', 'R')} end)
  from (
    select w.conv_id, r.k, r.i, r.fault not in ('b', 'd') as stays, (r.fault = 't')::bigint as extra, w.t0, w.t1,
      least(w.t2, {_add('w.t0', '2', 'I')}, {_add('w.t1', '2', 'I')}, {_add('w.t3', '2', 'I')}) as i2, least(w.t3, {_add('w.t2', '2', 'I')}) as i3
    from ways w join rows_after r on r.conv_id is not distinct from w.conv_id and r.k = w.k + 1
  ) steps
), best as (
  select conv_id, least(t0, t3, {_add('t2', '2', 'I')}, {_add('t1', '4', 'II')}) as way
  from (select *, row_number() over (partition by conv_id order by k desc) as last from ways) where last = 1
), edits as (
  select conv_id, p, substr(way, 10 + p, 1) as edit, way from best, unnest(range(1, length(way) - 9)) t(p)
), placed as (
  select e.conv_id, p, edit, sum((edit <> 'I')::int) over o as k, sum((edit <> 'D')::int) over o as place
  from edits e window o as (partition by e.conv_id order by p)
), filled as (
  select p.conv_id, p.p, p.edit, p.place, r.role, r.text,
    max((p.place = 1 and p.edit = 'K' and r.i = 's')::int) over (partition by p.conv_id) as system
  from placed p left join rows_after r on r.conv_id is not distinct from p.conv_id and r.k = p.k and p.edit <> 'I'
), lines as (
  select conv_id, string_agg(case when edit = 'K' then role when (place - system) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by p)
    filter (edit <> 'D') as whole from filled group by conv_id
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(left(way, 10)::bigint, 0) as cost, coalesce(substr(way, 11), '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join faults f on f.conv_id is not distinct from c.conv_id
  left join best b on b.conv_id is not distinct from c.conv_id left join lines l on l.conv_id is not distinct from c.conv_id
""")
def repaired_conversations(spark: SparkSession, folder: str) -> DataFrame:
    harmed = conversation_repair.damaged(table(spark, folder, "conversations"))
    return conversation_repair.report(harmed, count=F.col("count"))


@query("op11_token_alignment")
def token_alignments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_alignment.report(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
