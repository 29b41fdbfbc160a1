"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.io import table
from quillspark.llm import chat, decontaminate, langid, neardup, packing, pagetext, quality, secrets, substring, wavelet

#: The conversation that each formatting run carries besides the table's own.
TRAP = "\\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_turns(turns.unionByName(trap)))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op6_pagetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat, op2_secrets, op3_packing, op4_quality, op5_substring, op6_pagetext, op7_decontaminate, op8_langid, op9_neardup, op10_tokens)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CONTROL = "</turn>|### (?:User|Assistant|System|=)"
_OP1 = f"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '{TRAP}' union all select -7, 1, 'assistant', '{TRAP}'
), c as (
    select *, len(regexp_extract_all(text, '{_CONTROL}')) as n_control, length(text) - length(replace(text, '\\', '')) as n_backslash,
        regexp_matches(text, '\\\\[\\\\#<:]') or ends_with(text, '\\') as paired,
        case role when 'user' then 4 when 'assistant' then 9 when 'system' then 6 else 1 + length(role) + len(regexp_extract_all(role, '[\\\\#<:]')) end as n_name
    from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    sum(14 + n_name + length(text) + case when paired then n_control + n_backslash else n_control end)::bigint as formatted_chars
from c group by conv_id"""
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
# A piece is a sentence with the blanks behind it; runs of five (or all of fewer) meet as texts.
_PIECE = "(?s).*?(?:(?:[.!?,;:][\"'')\\]}*#$%&|<>!?.,;:]*\\s+|\\n+)\\s*|$)"
_WORD = "[^\\x20\\x09-\\x0D]+"
_OP5 = f"""
with p as (select doc_id, list_filter(regexp_extract_all(text, '{_PIECE}'), lambda x: regexp_matches(x, '{_WORD}')) as s from documents),
s as (select doc_id, unnest(s) as t, generate_subscripts(s, 1) as i, len(s) as n from p),
w as (select *, regexp_extract_all(t, '{_WORD}') as w from s),
r as (select doc_id, i, least(5, n) as m, string_agg(array_to_string(w, ' '), chr(10)) over (partition by doc_id order by i rows between current row and 4 following) as r from w qualify i + least(5, n) - 1 <= n),
again as (select *, row_number() over (partition by r order by doc_id, i) as k from r),
gone as (select distinct doc_id, unnest(range(i, i + m)) as i, true as gone from again where k > 1),
f as (select doc_id, count(*) as n_sentences, count(gone) as n_removed, sum(len(w)) as n_words, coalesce(sum(len(w)) filter (where gone), 0) as n_words_removed, rtrim(coalesce(string_agg(t, '' order by i) filter (where gone is null), ''), E' \\t\\n\\r\\f\\v') as kept
    from w left join gone using (doc_id, i) group by doc_id)
select doc_id, coalesce(n_sentences, 0) as n_sentences, coalesce(n_removed, 0) as n_removed, coalesce(n_words, 0)::bigint as n_words, coalesce(n_words_removed, 0)::bigint as n_words_removed, case when n_removed > 0 then kept else text end as text
from documents left join f using (doc_id)"""
_OP7 = f"""
with d as (select doc_id, {_WORDS} as w from documents), i as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
sized as (select item_id, w, least(8, len(w)) as n from i where len(w) > 0),
item_windows as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as t from (select *, unnest(range(1, len(w) - n + 2)) as k from sized)),
sizes as (select distinct n from sized),
doc_windows as (select doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') as t from (select *, unnest(range(1, len(w) - n + 2)) as k from d join sizes on len(w) >= n)),
hits as (select doc_id, n, k, item_id from doc_windows join item_windows using (n, t)),
covered as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(k, k + n)) as place from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as ids from (select distinct doc_id, item_id::varchar as s from hits) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join covered using (doc_id) left join found using (doc_id)"""
_OP9 = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as materialized (select distinct doc_id, array_to_string(w[k:k + 4], ' ') as s from (select *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from d where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as materialized (select a, b from shared join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as b from d union select reach.a, links.b from reach join links on reach.b = links.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c as component_id, d.doc_id = c as kept
from d left join n using (doc_id) join (select a as doc_id, min(b) as c from reach group by a) using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; trained models and tokenizers it can't."""
    return {"op1_chat": _OP1, "op5_substring": _OP5, "op7_decontaminate": _OP7, "op9_neardup": _OP9}
