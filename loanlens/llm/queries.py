"""Registered queries of the training-data operators (production parameters,
whole tables) and their DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.llm import (
    conversation_trie, decontamination, hard_negatives, jaccard_join, line_dedup, lm_scoring, packing, quality_classifier, quality_rules, secret_scan,
    sharding, suffix_dedup, topk_search,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _over_documents(operator) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES: dict[str, Query] = {
    "op1_line_dedup": _over_documents(line_dedup.dedup_lines),
    "op2_lm_scoring": _over_documents(lm_scoring.score_documents),
    "op3_packing": _over_documents(packing.pack_documents),
    "op4_suffix_dedup": _over_documents(suffix_dedup.remove_repeats),
    "op5_jaccard_join": _over_documents(jaccard_join.jaccard_components),
    "op6_quality_classifier": _quality,
    "op7_topk_search": _topk,
    "op8_decontamination": lambda spark, sf_dir: decontamination.find_leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op9_secret_scan": _over_documents(secret_scan.scan_secrets),
    "op10_sharding": _over_documents(sharding.shard_documents),
    "op11_quality_rules": _over_documents(quality_rules.rule_documents),
    "op12_hard_negatives": lambda spark, sf_dir: hard_negatives.mine(
        table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, hard_negatives.relabelled()),
    "op13_conversation_trie": lambda spark, sf_dir: conversation_trie.prefix_trie(table(spark, sf_dir, "conversations")),
}

# distinct five-word shingles (as text) of a table's `text`, by its id
_SHINGLES = """
select {id}, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) as s
from (select {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') as w from {table}) where len(w) > 0"""

ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_join": "with recursive d as (" + _SHINGLES.format(id="doc_id", table="documents") + """),
t as (select doc_id, len(s) as n, unnest(s) as x from d),
links as (select a.doc_id as a, b.doc_id as b from t a join t b on a.x = b.x and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)
select o.doc_id, coalesce((select len(s) from d where d.doc_id = o.doc_id), 0) as n_shingles,
  least(o.doc_id, coalesce((select min(b) from reach where reach.a = o.doc_id), o.doc_id)) as component_id
from documents o""",
    "op8_decontamination": "with d as (" + _SHINGLES.format(id="doc_id", table="documents") + "), b as ("
    + _SHINGLES.format(id="item_id", table="benchmark") + """),
dx as (select doc_id, len(s) as n, unnest(s) as x from d), bx as (select item_id, len(s) as n, unnest(s) as x from b)
select dx.doc_id, bx.item_id, cast(bx.n as int) as item_shingles, cast(count(*) as int) as shared, count(*) / bx.n as containment,
  cast(dx.n as int) as doc_shingles
from dx join bx using (x) group by dx.doc_id, bx.item_id, bx.n, dx.n having 4 * count(*) >= 3 * bx.n""",
    "op7_topk_search": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), q as (select distinct vec_id, v from v where vec_id % 50 = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op11_quality_rules": f"""
with d as (select row_number() over () as rid, doc_id, coalesce(lang, '') as lang, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, regexp_replace(t, '[\\p{{Ll}}\\x20\\x09-\\x0D]+', '', 'g') as rest,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
win as (select rid, p, count(*) over (partition by rid, x) as c from (
  select rid, unnest(range(1, len(w) - 1)) as p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as x from w)),
cov as (select rid, count(distinct p + j) as n_repeat_words from win, range(3) as r(j) where c > 1 group by rid),
base as (select w.rid, doc_id, lang, w, len(w) as n_words, coalesce(length(array_to_string(w, '')), 0) as word_chars,
  length(rest) - length(regexp_replace(rest, '[#*$%&|<>]+', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, len(w) < {quality_rules.MIN_WORDS} or 100 * coalesce(n_repeat_words, 0) > 50 * len(w) as base_failed, rest
  from w left join cov using (rid)),
freq as (select lang, x, count(*) as n from (select lang, unnest(list_distinct(w)) as x from base where n_words >= {quality_rules.MIN_WORDS})
  where regexp_matches(x, '^\\p{{L}}+$') group by lang, x),
top as (select lang, x, row_number() over (partition by lang order by n desc, x) as k from freq qualify k <= {quality_rules.COMMON}),
sizes as (select lang, count(*) as docs from base where n_words >= {quality_rules.MIN_WORDS} group by lang),
langs as (select lang from sizes where docs >= {quality_rules.MIN_DOCS} and docs * {quality_rules.LANGUAGE_SHARE} >= (select sum(docs) from sizes)
  and lang in (select lang from top)),
hits as (select b.rid, t.k, len(list_filter(b.w, lambda v: v = t.x)) / b.n_words as share from base b join langs using (lang) join top t using (lang) where n_words > 0),
words as (select rid, k, share from hits union all select rid, 0, 1 - sum(share) from hits group by rid),
counts as (select rid, lang, word_chars, length(rest) as r,
  length(rest) - length(regexp_replace(rest, '\\p{{Lu}}+', '', 'g')) as c1, length(rest) - length(regexp_replace(rest, '[\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]+', '', 'g')) as c2,
  length(rest) - length(regexp_replace(rest, '\\p{{Nd}}+', '', 'g')) as c3, n_symbols as c4, length(rest) - length(regexp_replace(rest, '[.,;:!?]+', '', 'g')) as c5
  from base join langs using (lang) where n_words > 0),
chars as (select rid, unnest(range(7)) as k, unnest([word_chars - r, c1, c2, c3, c4, c5, r - c1 - c2 - c3 - c4 - c5]) / word_chars as share from counts),
both_bins as (select 1 as which, * from words union all select 2, * from chars),
means as (select lang, which, k, avg(share) as q from both_bins join base using (rid) where not base_failed group by all),
js as (select rid, which, sqrt(greatest(sum((case when share > 0 then share * log2(2 * share / (share + q)) else 0 end)
  + (case when q > 0 then q * log2(2 * q / (share + q)) else 0 end)) / 2, 0)) as js
  from both_bins join base using (rid) join means using (lang, which, k) group by rid, which),
far as (select rid, max(case when which = 2 then js end) as js_chars, max(case when which = 1 then js end) as js_words from js group by rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(js_chars <= {quality_rules.MAX_CHARS} + {quality_rules.SLACK_CHARS} / sqrt(n_words)
    and js_words <= {quality_rules.MAX_WORDS} + {quality_rules.SLACK_WORDS} / sqrt(n_words), true) as kept,
  round(js_chars, 6) as js_chars, round(js_words, 6) as js_words
from base left join far using (rid)""",
    "op12_hard_negatives": """
with v as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
    list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), a as (select row_number() over () as aid, * from (select distinct * from v where vec_id % 50 = 0)),
s as (
  select a.aid, a.vec_id as anchor_id, c.vec_id, c.label = a.label as same,
    cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) as bigint) as score
  from a join v c on c.vec_id <> a.vec_id and len(c.v) = len(a.v)
), p as (select *, row_number() over (partition by aid order by score desc, vec_id) as place from s where same qualify place <= 5),
n as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
    cast(row_number() over (partition by p.aid, p.place order by n.score desc, n.vec_id) as int) as rank
  from p join s n on n.aid = p.aid and not n.same and 100 * n.score between 50 * p.score and 95 * p.score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3""",
    "op13_conversation_trie": """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null
), c as (
  select conv_id, count(*) as own, conv_id - conv_id % 5 as base, xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::bigint)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 as h
  from t group by conv_id
), r as (
  select c.conv_id, t.pos, t.role, t.text from c join t on t.conv_id = c.base where t.pos < c.h
  union all
  select c.conv_id, t.pos - c.h + least(c.h, coalesce(b.own, 0)), t.role, t.text
  from c join t on t.conv_id = c.conv_id left join c b on b.conv_id = c.base where t.pos >= c.h
), s as (
  select c.conv_id, coalesce(list(struct_pack(role := r.role, text := r.text) order by r.pos) filter (where r.pos is not null), []) as seq
  from c left join r on r.conv_id = c.conv_id group by c.conv_id
), m as (select conv_id, unnest(range(len(seq) + 1)) as d, len(seq) as whole, seq from s),
n as (
  select list_slice(seq, 1, d) as p, d, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where d = whole), '')) as ends_sha256
  from m group by list_slice(seq, 1, d), d
), k as (select list_slice(p, 1, d - 1) as p, count(*) as n_children from n where d > 0 group by 1),
w as (select n.*, coalesce(n_children, 0) as n_children, case when d = 0 then 0 else (n_convs - 1) * strlen(n.p[d].text) end as saved from n left join k using (p)),
u as (select list_slice(p, 1, above) as p, sum(saved) as saved_tokens, count(*) filter (where n_children = 0) as n_leaves
  from (select *, unnest(range(d + 1)) as above from w) group by 1)
select w.conv_id, w.d as depth, x.conv_id as parent_conv_id, w.n_convs, w.n_children, u.n_leaves, cast(u.saved_tokens as bigint) as saved_tokens, w.ends_sha256
from w join u using (p) left join n x on w.d > 0 and x.d = w.d - 1 and x.p = list_slice(w.p, 1, w.d - 1)""",
}
