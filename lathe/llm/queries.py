"""The thirteen operators' queries and the pipeline, with SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op13_cross_tokenizer
from .bitslices import op12_exact_topk
from .fingerprints import op8_fingerprints
from .huffman import op10_token_ids
from .jaccard import op9_jaccard_join
from .lm import op4_lm_scoring
from .mixing import op5_mixing
from .neighbours import op6_embedding_dedup
from .packing import op3_packing
from .pii import op1_pii
from .search import op11_ranked_search
from .substrings import op7_substring_dedup
from .toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_mixing": op5_mixing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_fingerprints": op8_fingerprints,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_ids": op10_token_ids,
    "op11_ranked_search": op11_ranked_search,
    "op12_exact_topk": op12_exact_topk,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}
WORDS = r"list_filter(string_split_regex({}, '[ \t-\r]+'), lambda x: x <> '')"
TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Smallest id that links (a, b), given both ways, lead to from each of ``nodes`` (id).
REACH = "reach(id, to_id) as (select id, id from nodes union select r.id, l.b from reach r join links l on r.to_id = l.a)"

ORACLE_SQL: dict[str, str] = {
    "op6_embedding_dedup": f"""
with recursive nodes as (select vec_id as id from embeddings),
v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select vec_id, e, sqrt(list_inner_product(e, e)) as size from v where len(e) > 0 and list_inner_product(e, e) > 0),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.95),
{REACH}
select id as vec_id, (select count(*) from links where a = id) as n_links, min(to_id) as component_id, id = min(to_id) as kept from reach group by id""",
    "op7_substring_dedup": f"""
with d as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
starts as (select doc_id, w, unnest(generate_series(1, len(w) - 19)) as i from d where len(w) >= 20),
windows as (select doc_id, i, row_number() over (partition by array_to_string(w[i:i+19], ' ') order by doc_id, i) as place from starts),
gone as (select distinct doc_id, unnest(generate_series(i, i + 19)) as i from windows where place > 1),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
kept as (select words.doc_id, string_agg(word, ' ' order by words.i) as body, count(*) as n from words anti join gone on gone.doc_id = words.doc_id and gone.i = words.i group by 1)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(body, '')) as kept_sha256 from d left join kept using (doc_id)""",
    "op9_jaccard_join": f"""
with recursive d as (select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) end as s from d),
nodes as (select doc_id as id from sets),
parts as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
links as (select x.doc_id as a, y.doc_id as b from parts x join parts y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
{REACH}
select id as doc_id, (select len(s) from sets where doc_id = id)::bigint as n_shingles, min(to_id) as component_id from reach group by id""",
    "op11_ranked_search": f"""
with terms as (select 'd' as kind, doc_id as id, {TERMS} as w from documents union all select 'q', item_id, {TERMS} from benchmark),
d as (select id, len(w)::bigint as n, w from terms where kind = 'd' and len(w) > 0),
corpus as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from d),
asked as (select id, unnest(list_distinct(w)) as term from terms where kind = 'q'),
postings as (select id, n, term, count(*)::bigint as tf from (select id, n, unnest(w) as term from d) where term in (select term from asked) group by all),
weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as weight from postings, corpus group by term, n_docs),
scored as (select a.id as item_id, p.id as doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::bigint as score from asked a join postings p using (term) join weights using (term), corpus group by 1, 2)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from scored where score > 0 qualify rank <= 50""",
    "op12_exact_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q))
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s qualify rank <= 5""",
}
