"""One query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm.conversation_trie import rebuilt_trie
from recordloom.llm.main_text import main_text
from recordloom.llm.mixing import mix_digest
from recordloom.llm.near_duplicates import NearDup, near_duplicates
from recordloom.llm.packing import pack_digest
from recordloom.llm.personal_data import personal_data_digest
from recordloom.llm.phrases import phrases
from recordloom.llm.quality import quality
from recordloom.llm.sharding import balanced_shards
from recordloom.llm.token_counts import token_counts
from recordloom.llm.toxicity import toxicity
from recordloom.llm.url_filter import url_verdicts
from recordloom.llm.vector_search import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def add(function):
        QUERIES[key] = function
        if oracle:
            ORACLES[key] = oracle
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"))


@query("op2_balanced_shards")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return balanced_shards(table(spark, folder, "documents"))


@query("op3_quality_rules")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_toxicity_chain")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_main_text")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))


@query("op6_personal_data")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data_digest(table(spark, folder, "documents"))


@query("op7_source_mix")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return mix_digest(table(spark, folder, "documents"))


EXACT_TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id as query_id, min(e) as e from v where vec_id % 50 = 0 group by vec_id),
s as (select query_id, vec_id, cast(list_inner_product(q.e, v.e) as bigint) as score from q join v on query_id <> vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query("op8_exact_top_k", EXACT_TOP_K)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), every=50, k=5)


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pack_digest(table(spark, folder, "documents"))


@query("op10_minhash_near_duplicates")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"), NearDup(words=2, percent=80))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


COLLOCATIONS = r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
g as (
  select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
  from w, range(1, 5) t(k) where len(ws) >= k),
f as (select lang, k, phrase, count(*) as a, string_split(phrase, ' ') as ws from g group by lang, k, phrase having count(*) >= 30),
n as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
c as (
  select lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') as head, array_to_string(ws[j + 1:], ' ') as tail
  from f, range(1, 4) t(j) where j < k),
s as (
  select c.lang, c.phrase, c.a, c.j, h.a as l, t.a as r, cast((2000000::hugeint * c.a) // (h.a + t.a) as bigint) as score
  from c join f h on h.lang = c.lang and h.phrase = c.head join f t on t.lang = c.lang and t.phrase = c.tail),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inside as (
  select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, max(a) as longer
  from f, range(2, 4) t(m), range(1, 4) u(i) where m < k and i + m - 1 <= k group by 1, 2),
ranked as (
  select b.*, row_number() over (partition by b.lang order by b.score desc, b.a desc, encode(b.phrase)) as rank
  from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase where i.longer is null or 100 * i.longer < 80 * b.a)
select r.lang, rank, phrase, a, l, r.r, n, score from ranked r join n on n.lang = r.lang where rank <= 2000
"""


@query("op11_collocations", COLLOCATIONS)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return phrases(table(spark, folder, "documents"))


# The checksum is written out bit by bit, as the dialect has none: a byte is mixed in, then eight shifts (-1) follow.
PREFIX_TRIE = """
with t as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, encode(coalesce(role, '')), encode(coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
ids as (select c, count(*) as len from t group by c),
bits as (
  select c, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(cast(c as varchar), ''),
    lambda x: [cast(ascii(x) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, e: case when e >= 0 then xor(x, e) when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) as state from ids),
h as (select c, c - c % 5 as head, xor(state, 4294967295) % 9 as h from bits),
rows_ as (
  select h.c, 0 as own, t.pos, t.role, t.text from h join t on t.c = h.head and t.pos <= h.h
  union all select h.c, 1, t.pos, t.role, t.text from h join t on t.c = h.c and t.pos > h.h),
seqs as (select c, list({'r': role, 't': text} order by own, pos) as s from rows_ group by c),
full_ as (select ids.c, coalesce(s, []) as s, coalesce(len(s), 0) as n from ids left join seqs on seqs.c = ids.c),
m as (select c, d, s[1:d] as p, n from full_, lateral (select unnest(range(0, n + 1)) as d)),
nodes as (
  select d, p, min(c) as conv_id, count(*) as n_convs, coalesce(strlen(p[d].t), 0) as size,
    sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (n = d), '')) as ends_sha256
  from m group by d, p),
kids as (select d - 1 as d, p[1:d - 1] as p, count(*) as n from nodes where d > 0 group by 1, 2),
full_nodes as (
  select x.*, coalesce(k.n, 0) as n_children, parent.conv_id as parent_conv_id
  from nodes x left join kids k on k.d = x.d and k.p = x.p left join nodes parent on parent.d = x.d - 1 and parent.p = x.p[1:x.d - 1]),
sums as (
  select a as d, p[1:a] as p, cast(sum(case when n_children = 0 then 1 else 0 end) as bigint) as n_leaves,
    cast(sum((n_convs - 1) * size) as bigint) as saved_tokens
  from full_nodes, lateral (select unnest(range(0, d + 1)) as a) group by 1, 2)
select x.conv_id, x.d as depth, x.parent_conv_id, x.n_convs, x.n_children, s.n_leaves, s.saved_tokens, x.ends_sha256
from full_nodes x join sums s on s.d = x.d and s.p = x.p
"""


@query("op12_prefix_trie", PREFIX_TRIE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return rebuilt_trie(table(spark, folder, "conversations"))


@query("op13_url_verdicts")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return url_verdicts(table(spark, folder, "pages")).drop("log_odds")
