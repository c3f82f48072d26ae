"""Registered queries of the corpus operators, with their production parameters, and their equivalent SQL."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallygrid.llm import (bpe_index, column_suffix, decontaminate, hard_negatives, hidden_markov, host_paths, line_bloom,
                           pstable, quality_trees, simhash_pivot, spelling, token_windows, wavelet)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("op1_host_path_extraction")
def op1(spark, d):
    return host_paths.extract(table(spark, d, "pages"))


@query("op2_bpe_pair_index")
def op2(spark, d):
    return bpe_index.digest(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_simhash_pivot_tables")
def op3(spark, d):
    return simhash_pivot.near_duplicates(table(spark, d, "documents"))


@query("op4_simhash_window_decontamination")
def op4(spark, d):
    return decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op5_multiprobe_pstable_search")
def op5(spark, d):
    return pstable.nearest(table(spark, d, "embeddings"))


@query("op6_column_suffix_dedup", """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
p as (select doc_id, x, unnest(range(0, length(x) // 2)) as i from h),
s as (select doc_id, i, substr(x, 2 * i + 1, 2) as b, case when i + 100 <= length(x) // 2 then sha256(substr(x, 2 * i + 1, 200)) end as g from p),
c as (select doc_id, i, b, g is not null and row_number() over (partition by g order by doc_id, i) > 1 as again from s),
m as (select *, max(again::int) over (partition by doc_id order by i rows between 99 preceding and current row) = 1 as gone from c),
t as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as head from m),
k as (select doc_id, count(*) as n_bytes, count(*) filter (where gone) as n_removed, count(*) filter (where head) as n_spans, coalesce(string_agg(b, '' order by i) filter (where not gone), '') as kept from t group by doc_id)
select documents.doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from documents left join k using (doc_id)""")
def op6(spark, d):
    return column_suffix.digest(column_suffix.remove_repeats(table(spark, d, "documents")))


@query("op7_wavelet_token_shards")
def op7(spark, d):
    return wavelet.digest(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op8_bloom_line_dedup", """
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, i, ls[i] as line, trim(translate(ls[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as key
      from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from t)),
bad as (select key from l where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
m as (select l.*, bad.key is not null as gone from l left join bad on l.key = bad.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id""")
def op8(spark, d):
    return line_bloom.digest(line_bloom.drop_lines(table(spark, d, "documents")))


@query("op9_histogram_trees_quality")
def op9(spark, d):
    return quality_trees.classify(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op10_token_window_dedup", r"""
with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from t),
s as (select doc_id, i, w[i] as word, case when i + 34 <= len(w) then sha256(array_to_string(w[i:i + 34], ' ')) end as g from p),
c as (select *, case when g is not null then count(*) over (partition by g) > 1 else false end as again from s),
m as (select *, max(again::int) over (partition by doc_id order by i rows between 34 preceding and current row) = 1 as gone from c),
k as (select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (where not gone), '') as kept from m group by doc_id)
select documents.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents left join k using (doc_id)""")
def op10(spark, d):
    return token_windows.digest(token_windows.remove_repeats(table(spark, d, "documents")))


@query("op11_hidden_markov_scores")
def op11(spark, d):
    return hidden_markov.scores(table(spark, d, "documents"))


@query("op12_partenum_spelling_variants", r"""
with recursive tab as (select list(c order by n) as k from (select n, list_reduce(list_concat([n], range(0, 8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as c from (select unnest(range(0, 256)) as n))),
runs as (select doc_id, r, count(*) as m from (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r from documents) where length(r) >= 6 group by all),
x as (select doc_id, r, m, hex(encode(doc_id || ':' || r)) as b from runs),
h as (select r, m, case when doc_id is null then 1 else xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(0, length(b) // 2), lambda i: ('0x' || substr(b, 2 * i + 1, 2))::bigint)), lambda a, y: xor(a >> 8, k[(xor(a, y) & 255) + 1])), 4294967295) end as h from x, tab),
w as (select word, sum(m)::bigint as n from (select m, case when h % 199 = 0 then substr(r, 1, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end as word from h) where length(word) >= 6 group by word having sum(m) >= 5),
p as (select word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) as hole, substr(word, 1, i - 1) || substr(word, i + 1) as less from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
near as (select a.word, b.word as other from p a join p b on a.hole = b.hole and a.word <> b.word
         union select p.word, w.word from p join w on p.less = w.word union select w.word, p.word from p join w on p.less = w.word),
best as (select near.word, count(*) as n_near, min({'m': -w.n, 'o': near.other}) as b from near join w on near.other = w.word group by near.word),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when -b.m >= 5 * w.n then b.o end as form, case when -b.m >= 5 * w.n then -b.m end as form_n from w left join best using (word)),
chain as (select word, word as here, 0 as step from f union all select chain.word, f.form, step + 1 from chain join f on chain.here = f.word where f.form is not null)
select f.word, form, root, n, n_near::bigint as n_near, form_n::bigint as form_n from f join (select word, arg_max(here, step) as root from chain group by word) using (word)""")
def op12(spark, d):
    return spelling.variants(table(spark, d, "documents"))


@query("op13_threshold_hard_negatives", """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
           from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select * from s where same qualify row_number() over (partition by a order by score desc, b) <= 5)
select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.a, p.b order by s.score desc, s.b)::int as rank, s.b as negative_id, p.score as positive_score, s.score as negative_score
from p join s on p.a = s.a and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score
qualify row_number() over (partition by p.a, p.b order by s.score desc, s.b) <= 5""")
def op13(spark, d):
    return hard_negatives.mine(table(spark, d, "embeddings"))
