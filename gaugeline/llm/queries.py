"""The registered queries of the numbered operators, each over its whole table, and their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if text is not None:
            ORACLES[name] = text
        return run

    return keep


_PART = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = r"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t'), '<|next|>', '\n') as et,
             replace(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), '<|next|>', '\n'), ': ', '\c') as er,
             lag(role) over w as before, lead(role) over w as after
      from r window w as (partition by conv_id order by turn nulls first, role, text)),
l as (select *, case when before is null or before <> role then 6 + length(er) else 0 end + length(et)
               + case when after is null or after <> role then 8 else 8 end as n from e)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(n) as bigint) as formatted_chars
from l group by conv_id
"""


@query("op3_chat_formatting", _OP3)
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.chat import format_chats, read_back

    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_chats(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_OP9 = f"""
with d as (select doc_id, regexp_extract_all({_LOWER.format('text')}, {_PART}) as w from documents),
i as (select item_id, regexp_extract_all({_LOWER.format('text')}, {_PART}) as w from benchmark),
win as (select distinct item_id, array_to_string(w[s:s + 9], ' ') as g, least(len(w), 10) as n
        from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from i where len(w) > 0)),
ns as (select distinct n from win),
pos as (select doc_id, w, n, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) as s from d, ns),
hit as (select doc_id, s, pos.n, item_id from (select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') as g from pos) pos join win on win.g = pos.g and win.n = pos.n),
cover as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cover on cover.doc_id = d.doc_id left join its on its.doc_id = d.doc_id
"""


@query("op9_decontaminate", _OP9)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.decontaminate import find_leaks

    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return leaks.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


_OP10 = r"""
with s as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
src as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as place from s group by source),
w as (select *, cast((place - 1) % 3 + 1 as double) as weight, source_size * 3.0::double as lim from src),
r as (select *, lim / weight as ratio, sum(source_size) over () as total from w),
l as (select *, (total - (sum(lim) over (order by ratio, source nulls last) - lim)) / sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as level from r),
f as (select *, (select level from l where ratio >= level order by ratio, level limit 1) as found from l),
t as (select source, source_size, case place % 3 when 1 then 0.5::double when 2 then 0.0::double else -0.5::double end as slope,
             case when found is null or ratio < found then lim else weight * found end as target from f),
o as (select s.*, t.source_size, t.target, t.slope,
             coalesce(sum(size) over (partition by s.source order by md5('0:' || coalesce(cast(doc_id as varchar), '') || ':' || cast(size as varchar)), doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
      from s join t on s.source is not distinct from t.source),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as passes from o)
select doc_id, size, source_size, target,
       cast(case when size = 0 then 0 else size * (passes + case when before + size / 2.0::double <= target - passes * source_size then 1 else 0 end) end as bigint) as taken,
       case when taken > 0 then round(case when slope = 0 then (before + size / 2.0::double) / target
                 else (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * ((before + size / 2.0::double) / target))) / (2 * slope) end, 6) end as first_position
from p
"""


@query("op10_mixing", _OP10)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.mixing import mix

    first = F.round(F.get("positions", F.lit(0)), 6).alias("first_position")
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", first)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.langid import label_documents, train

    docs = table(spark, sf_dir, "documents")
    return label_documents(docs, train(docs, ~held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.lengths import length_counts, length_table

    return length_table(length_counts(table(spark, sf_dir, "documents")))


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.licenses import license_labels, scan_licenses

    return license_labels(scan_licenses(table(spark, sf_dir, "documents"))).drop("licenses")


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.quality import THRESHOLD, document_statistics, fit, score
    from gaugeline.session import cut_lineage

    stats = cut_lineage(document_statistics(table(spark, sf_dir, "documents")))
    scored = score(stats, fit(stats, table(spark, sf_dir, "labels"), ~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


NEAREST = 5


@query("op8_nearest_neighbours")
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.hnsw import build_index, search_index, usable
    from gaugeline.session import cut_lineage

    vectors = table(spark, sf_dir, "embeddings")
    index = cut_lineage(build_index(vectors, keep=NEAREST + 1))
    asked = usable(vectors.where(F.col("vec_id") % 50 == 0)).dropDuplicates(["vec_id", "vector"]).withColumnRenamed("vec_id", "query_id")
    return search_index(index, cut_lineage(asked), NEAREST)


@query("op4_near_duplicates")
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.hyperminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), limit=(85, 100))


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.suffixes import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), as_text=False)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))


_OP11 = r"""
with recursive crc as (select crc.*, kind from (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations) crc join (
      select k, (4294967295 - s) % 20 as kind from (
        select k, list_reduce(list_prepend(4294967295, list_transform(range(1, len(k) + 1), lambda i: cast(ascii(k[i]) as bigint))), lambda c, b:
          list_reduce(list_prepend(xor(c, b), [cast(0 as bigint), 0, 0, 0, 0, 0, 0, 0]), lambda v, j: case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end)) as s
        from (select distinct coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations))) u using (k)),
hurt as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then replace(replace(replace(text, '.', ''), '!', ''), '?', '') else text end as text
  from crc, (select unnest([1, 2]) as copy) where kind <> 0 and (copy = 1 or kind = 3)),
e as materialized (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n, substr(role, 1, 1) as ini,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as last from hurt),
f as materialized (select *, case when last = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
    when last not in ('.', '!', '?') then 'truncated' else '' end as fault, lag(ini) over (partition by conv_id order by i) as prev from e),
go as (
  select conv_id, max(n) + 1 as i, {'c': 0, 'a': ''} as c0, {'c': 10, 'a': 'II'} as c1, {'c': 5, 'a': 'I'} as c2, {'c': 0, 'a': ''} as c3 from f group by conv_id
  union all
  select conv_id, i, list_sort([b0, {'c': n2.c + 5, 'a': 'I' || n2.a}])[1], list_sort([b1, {'c': n2.c + 5, 'a': 'I' || n2.a}])[1], n2, n3 from (
    select *, list_sort([b2, {'c': b3.c + 5, 'a': 'I' || b3.a}])[1] as n2, list_sort([b3, {'c': b2.c + 5, 'a': 'I' || b2.a}])[1] as n3 from (
      select conv_id, i,
        list_sort([{'c': c0.c + 2, 'a': 'D' || c0.a}, {'c': c2.c + 1 + x, 'a': 'R' || c2.a},
                   case ini when 's' then {'c': c1.c + x, 'a': 'K' || c1.a} when 'u' then {'c': c2.c + x, 'a': 'K' || c2.a} else {'c': 1000000000, 'a': ''} end])[1] as b0,
        list_sort([{'c': c1.c + 2, 'a': 'D' || c1.a}, {'c': c2.c + 1 + x, 'a': 'R' || c2.a}, case ini when 'u' then {'c': c2.c + x, 'a': 'K' || c2.a} else {'c': 1000000000, 'a': ''} end])[1] as b1,
        list_sort([{'c': c2.c + 2, 'a': 'D' || c2.a}, {'c': c3.c + 1 + x, 'a': 'R' || c3.a}, case ini when 'a' then {'c': c3.c + x, 'a': 'K' || c3.a} else {'c': 1000000000, 'a': ''} end])[1] as b2,
        list_sort([{'c': c3.c + 2, 'a': 'D' || c3.a}, {'c': c2.c + 1 + x, 'a': 'R' || c2.a}, case ini when 'u' then {'c': c2.c + x, 'a': 'K' || c2.a} else {'c': 1000000000, 'a': ''} end])[1] as b3
      from (select g.conv_id, f.i, f.ini, c0, c1, c2, c3, case fault when '' then 0 when 'truncated' then 5 else 1000000 end as x
            from go g join f on f.conv_id is not distinct from g.conv_id and f.i = g.i - 1)))),
best as (select conv_id, c0.c as cost, c0.a as audit from go where i = 1),
chars as (select conv_id, audit[p] as ch, p, len(replace(audit[1:p], 'I', '')) as i from (select conv_id, audit, unnest(range(1, len(audit) + 1)) as p from best)),
outs as (select c.*, f.role, f.text, row_number() over (partition by c.conv_id order by p) as k, first_value(ch = 'K' and f.ini = 's') over (partition by c.conv_id order by p) as sys
         from chars c left join f on f.conv_id is not distinct from c.conv_id and f.i = c.i where ch <> 'D'),
fixed as (select conv_id, string_agg(case when ch = 'K' then role when (k - case when sys then 1 else 0 end) % 2 = 1 then 'user' else 'assistant' end || ':' || case when ch = 'I' then '' else text end, chr(10) order by p) as body
          from outs group by conv_id),
told as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
                count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where prev is not null and prev || ini not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate,
       cast(coalesce(truncated, 0) as bigint) as truncated, cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(cost, 0) as bigint) as cost,
       coalesce(audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join told t on t.conv_id is not distinct from o.conv_id
  left join best b on b.conv_id is not distinct from o.conv_id left join fixed x on x.conv_id is not distinct from o.conv_id
"""


@query("op11_conversation_repair", _OP11)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.repair import damage, repair_conversations

    repaired = repair_conversations(damage(table(spark, sf_dir, "conversations")), present="present")
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))


_OP12 = f"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER.format('text')}, {_PART}) as w from documents),
size as (select count(*) filter (where len(w) > 0) as nn, cast(coalesce(sum(len(w)), 0) as bigint) as ll from d),
t as (select r, doc_id, term, n, count(*) as tf from (select r, doc_id, len(w) as n, unnest(w) as term from d) group by all),
w as (select term, cast(floor(1000 * ln((2.0::double * any_value(nn) + 2) / (2.0::double * count(*) + 1))) as bigint) as weight from t, size group by term),
q as (select row_number() over () as item, item_id, regexp_extract_all({_LOWER.format('text')}, {_PART}) as words from benchmark),
s as (select item, item_id, r, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) as bigint) as score
      from (select item, item_id, unnest(words) as term from q) join w using (term) join t using (term), size group by all having score > 0),
k as (select *, cast(row_number() over (partition by item order by score desc, doc_id nulls first) as integer) as rank from s)
select item_id, rank, doc_id, score from k where rank <= 20
"""


@query("op12_lexical_search", _OP12)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_jaccard_join")
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugeline.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
