"""Queries over the text index: tokens, ranking, fusion, chunking, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieval as r
from tessera.plans.matrix_queries import rounded
from tessera.session import table

# The questions asked of the index.
QUESTIONS = {1: "batch correction of donors across marker ranking", 2: "differential expression by pseudobulk aggregation", 3: "quality filtering of fragile fractions in thymus", 4: "umbrales de células en núcleos"}
WEIGHTS = {"sops": 1.3, "best_practices": 1.2, "papers": 1.1, "marker_db": 0.9}


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "collection", "source", "stem", "section")


def _questions(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(QUESTIONS.items()), "query_id int, query string")


def tokenize(s, d):
    return _docs(s, d).select("id", F.explode(r.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_docs"))


def bm25_topk(s, d):
    return rounded(r.bm25(_docs(s, d), _questions(s)).select("query_id", "id", "rank", "score"), "score")


def hash_embed(s, d):
    v = r.hash_vectors(_docs(s, d))
    return rounded(v.groupBy("i").agg(F.count("*").alias("n"), F.sum("w").alias("total")), "total")


def cosine_topk(s, d):
    q = r.hash_vectors(_questions(s), "query_id", "query")
    return rounded(r.cosine_top(r.hash_vectors(_docs(s, d)), q, chunks=_docs(s, d), asked=_questions(s)).select("query_id", "id", "rank", "score"), "score")


def rrf_fuse(s, d):
    docs, q = _docs(s, d), _questions(s)
    f = r.rrf([r.bm25(docs, q), r.cosine_top(r.hash_vectors(docs), r.hash_vectors(q, "query_id", "query"), chunks=docs, asked=q)])
    return f.select("query_id", "id", F.round("rrf", 7).alias("rrf"))


def hybrid_retrieve(s, d):
    return rounded(r.hybrid(_docs(s, d), _questions(s), weights=WEIGHTS), "score")


def query_expand(s, d):
    return _questions(s).select("query_id", r.expand(F.col("query")).alias("query"))


def section_boost(s, d):
    hits = r.bm25(_docs(s, d), _questions(s)).join(_docs(s, d), "id")
    return rounded(r.section_boost(hits).select("query_id", "id", "section", "score"), "score")


def dedup_hits(s, d):
    hits = r.bm25(_docs(s, d), _questions(s)).join(_docs(s, d), "id")
    return r.dedup(hits, 6).select("query_id", "id", "rank")


def structured_lookup(s, d):
    m = table(s, d, "marker_catalog").select(F.col("row_id").alias("id"), "tissue", F.concat_ws(" ", "name", "tissue", F.array_join("positive", " ")).alias("text"), F.lit("marker").alias("kind"))
    return rounded(r.lookup(m, "memory progenitor pbmc", "pbmc").select("id", "tissue", "score"), "score")


def chunk_fixed(s, d):
    return r.chunk_fixed(_docs(s, d), 900, 120)


def chunk_semantic(s, d):
    return r.chunk_semantic(_docs(s, d), 900, 120)


def sanitize_html(s, d):
    return _docs(s, d).select("id", r.sanitize(F.col("text")).alias("text"))


def split_sections(s, d):
    p = table(s, d, "parsed_papers").where("markdown is not null").select(F.col("paper_id").alias("id"), F.col("markdown").alias("text"))
    return r.split_sections(p).select("id", "section", F.length("text").alias("n_chars"))


def token_overlap(s, d):
    q = QUESTIONS[3]
    return rounded(_docs(s, d).select("id", r.overlap(F.lit(q), F.col("text")).alias("overlap")), "overlap")


_RX = "'([a-z0-9_]+|[一-鿿])'"
_TOK = f"regexp_extract_all(lower({{0}}), {_RX}, 1)"
_Q = "qq(query_id, query) as (values " + ", ".join(f"({k}, '{v}')" for k, v in QUESTIONS.items()) + ")"
_D = "d as (select doc_id as id, coalesce(text, '') as text, collection, source, stem, section from documents)"
_POST = f"""{_D}, {_Q}, tk as (select id, unnest({_TOK.format('text')}) as token from d), ln as (select id, count(*) as len from tk group by 1), po as (select id, token, count(*) as tf from tk group by all),
 st as (select (select count(*) from d) as n, (select sum(len) from ln) / (select count(*) from d) as avgdl), df as (select token, count(*) as df from po group by 1),
 rw as (select token, ln(n - df + 0.5) - ln(df + 0.5) as raw from df, st), mi as (select avg(raw) as m from rw),
 qt as (select query_id, token, count(*) as qn from (select query_id, unnest({_TOK.format('query')}) as token from qq) group by all),
 bs as (select query_id, id, sum(qn * (case when raw < 0 then 0.25 * m else raw end) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * len / avgdl))) as score from po join qt using (token) join rw using (token) join ln using (id), st, mi group by all),
 bm as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from bs qualify rank <= 24)"""
_BUCKET = "(('0x' || substr(md5(token), {0}, 8))::bigint % 384)::int"
_VEC = f"""hv as (select id, i, sum(w) as w from (select id, {_BUCKET.format(1)} as i, 1.0::double as w from tk union all select id, {_BUCKET.format(9)}, 0.5 from tk) group by all),
 hn as (select id, i, w / sqrt(sum(w * w) over (partition by id)) as w from hv),
 qv as (select query_id, i, sum(w) as w from (select query_id, {_BUCKET.format(1)} as i, qn::double as w from qt union all select query_id, {_BUCKET.format(9)}, 0.5 * qn from qt) group by all),
 qh as (select query_id, i, w / sqrt(sum(w * w) over (partition by query_id)) as w from qv),
 cs as (select query_id, id, sum(hn.w * qh.w) as score from hn join qh using (i) group by all),
 ct as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from cs qualify rank <= 24)"""
_WEIGHT = "case section when 'methods' then 1.35 when 'results' then 1.3 when 'abstract' then 1.2 when 'introduction' then 1.05 else 1.0 end"
_EXP = "query || " + " || ".join(f"case when contains(lower(query), '{a}') then ' {b}' else '' end" for a, b in r.PHRASES.items())

SQL = {
    "tokenize": f"with {_D}, tk as (select id, unnest({_TOK.format('text')}) as token from d) select token, count(*) as n, count(distinct id) as n_docs from tk group by 1",
    "bm25_topk": f"with {_POST} select query_id, id, rank::int as rank, round(score, 4) as score from bm",
    "hash_embed": f"with {_POST}, {_VEC} select i, count(*) as n, round(sum(w), 4) as total from hn group by 1",
    "cosine_topk": f"with {_POST}, {_VEC} select query_id, id, rank::int as rank, round(score, 4) as score from ct",
    "rrf_fuse": f"with {_POST}, {_VEC} select query_id, id, round(sum(1.0 / (60 + rank)), 7)::double as rrf from (select query_id, id, rank from bm union all select query_id, id, rank from ct) group by all",
    "hybrid_retrieve": (f"with {_POST}, {_VEC}".replace(_Q, _Q.replace("qq(", "q0(") + f", qq as (select query_id, {_EXP} as query from q0)"))
    + f", rf as (select query_id, id, sum(1.0 / (60 + rank))::double as rrf from (select query_id, id, rank from bm union all select query_id, id, rank from ct) group by all), ov as (select query_id, rf.id, (rrf + 0.15 * len(list_intersect({_TOK.format('query')}, {_TOK.format('text')})) / len(list_distinct({_TOK.format('query')}))) * case collection when 'sops' then 1.3 when 'best_practices' then 1.2 when 'papers' then 1.1 when 'marker_db' then 0.9 else 1.0 end as score, source, text from rf join d on d.id = rf.id join qq using (query_id)), dd as (select * from ov qualify row_number() over (partition by query_id, source, substr(text, 1, 96) order by round(score, 9) desc, id) = 1) select query_id, id, round(score, 4) as score, (row_number() over (partition by query_id order by round(score, 9) desc, id))::int as rank from dd qualify rank <= 6",
    "query_expand": f"with {_Q} select query_id, {_EXP} as query from qq",
    "section_boost": f"with {_POST} select query_id, id, section, round(score * {_WEIGHT}, 4) as score from bm join d using (id)",
    "dedup_hits": f"with {_POST}, x as (select * from bm join d using (id) qualify row_number() over (partition by query_id, source, substr(text, 1, 96) order by round(score, 9) desc, id) = 1) select query_id, id, (row_number() over (partition by query_id order by round(score, 9) desc, id))::int as rank from x qualify rank <= 6",
    "structured_lookup": "with m as (select row_id as id, tissue, lower(concat_ws(' ', name, tissue, array_to_string(positive, ' '))) || ' ' || row_id as t from marker_catalog), s as (select *, case when contains(t, 'memory progenitor pbmc') then 3.0 else 0 end + case when contains(t, 'memory') then 1.0 else 0 end + case when contains(t, 'progenitor') then 1.0 else 0 end + case when contains(t, 'pbmc') then 1.0 else 0 end as s from m), z as (select id, tissue, case when tissue = 'pbmc' or contains(t, 'pbmc') then s + 1.5 else s * 0.35 end as score from s) select id, tissue, round(score, 4)::double as score from z where score > 0 order by score desc, id limit 8",
    "token_overlap": f"with {_D} select id, round(len(list_intersect({_TOK.format(repr(QUESTIONS[3]))}, {_TOK.format('text')})) / len(list_distinct({_TOK.format(repr(QUESTIONS[3]))})), 4) as overlap from d",
    "chunk_fixed": "with t as (select doc_id as id, regexp_replace(regexp_replace(coalesce(text, ''), '\\n{3,}', E'\\n\\n', 'g'), '^\\s+|\\s+$', '', 'g') as t from documents), s as (select id, t, unnest(case when length(t) = 0 then [] when length(t) <= 900 then [0] else range(0, length(t) - 120, 780) end) as a from t), c as (select id, (a // 780)::int as chunk_index, regexp_replace(substr(t, a::bigint + 1, 900), '^\\s+|\\s+$', '', 'g') as text from s) select * from c where text <> ''",
}

QUERIES = {f.__name__: f for f in (tokenize, bm25_topk, hash_embed, cosine_topk, rrf_fuse, hybrid_retrieve, query_expand, section_boost, dedup_hits, structured_lookup, chunk_fixed, chunk_semantic, sanitize_html, split_sections, token_overlap)}
