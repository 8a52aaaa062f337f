"""Queries over routing rules, reviewer's options and learned embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import embedding, retrieval, routing
from tessera.plans import views
from tessera.plans.evidence_queries import _embed
from tessera.plans.matrix_queries import _logged, _qc, _selected, rounded
from tessera.plans.text_queries import _D, _POST, _docs, _questions
from tessera.session import table

OPTIONS = {"lenient": 7, "recommended": 5, "strict": 4}
# Components of the pipeline's embedding and of its imputation.
N_PCS, N_IMPUTE = 40, 50


def intent_rules(s, d):
    x = table(s, d, "documents").select(F.array_join(routing.intents(F.col("text")), ",").alias("intents"))
    return x.groupBy("intents").agg(F.count("*").alias("n"))


def deg_preference(s, d):
    x = routing.deg_preference(table(s, d, "documents").select("doc_id", "text"), "text")
    return x.groupBy("engine", "marker_method", "cross_validate").agg(F.count("*").alias("n"))


def notes_for(s, d):
    x = table(s, d, "documents").select(F.array_join(routing.notes_for(F.col("text")), ",").alias("notes"))
    return x.groupBy("notes").agg(F.count("*").alias("n"))


def mt_options(s, d):
    return routing.filter_options(_qc(s, d), "sample", OPTIONS)


def inspect_data(s, d):
    return routing.inspect(views.matrix(s, d), views.obs(s, d), views.var(s, d), "sample", "condition")


def retrieve_fused(s, d):
    """Notes of best practice first, then what BM25 finds elsewhere."""
    docs = _docs(s, d)
    hits = retrieval.bm25(docs, _questions(s)).join(docs, "id")
    first = hits.where("collection = 'best_practices'").withColumn("r", F.expr("row_number() over (partition by query_id order by rank)")).where("r <= 3")
    return routing.fused([first, hits.where("collection <> 'best_practices'")], 6).select("query_id", "id", "rank", "part")


def match_figures(s, d):
    f = table(s, d, "documents").select(F.concat(F.lit("figures/"), "stem", F.lit("_"), "section", F.lit(".png")).alias("path"), "section").where("path is not null").distinct()
    figs = f.select("path", F.when(F.col("section") == "abstract", "abstract").alias("kind"))
    want = s.createDataFrame([(1, "abstract"), (2, "methods"), (3, "results"), (3, "discussion"), (4, "umap")], "slot int, kind string")
    return routing.match_figures(figs, want)


def pca_embed(s, d):
    return embedding.pca(_embed(s, d), N_PCS)[0]


def kmeans_clusters(s, d):
    return embedding.kmeans(_embed(s, d), 10).select("id", "label", "cluster")


def impute_low_rank(s, d):
    return rounded(embedding.impute_low_rank(_logged(s, d), _selected(s, d), N_IMPUTE), "value")


def doublet_scores(s, d):
    return rounded(embedding.simulated_doublets(_embed(s, d), 0.05), "score")


_M = lambda c, ps: "(" + " or ".join(f"regexp_matches({c}, '(?i){p}')" for p in ps) + ")"
_T = "coalesce(text, '')"
_HIT = {k: _M(_T, p) + (f" and not {_M(_T, routing.NOT_DEG)}" if k == "deg" else "") for k, p in routing.INTENTS.items()}
_IN = lambda c, ws: "(" + " or ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_R = lambda p: f"regexp_matches(q, '{p}')"

SQL = {
    "intent_rules": "with a as (select list_filter([" + ", ".join(f"case when {h} then '{k}' end" for k, h in _HIT.items()) + "], lambda x: x is not null) as i from documents), b as (select case when len(i) = 0 then ['qc', 'clustering', 'annotation'] else i end as i from a), c as (select case when list_has_any(i, ['clustering', 'annotation', 'deg']) and not list_contains(i, 'enrichment') then list_append(i, 'enrichment') else i end as i from b) select array_to_string(i, ',') as intents, count(*) as n from c group by 1",
    "deg_preference": "with q as (select lower(coalesce(text, '')) as q from documents), a as (select q, "
    + f"{_R('t\\s*检验|t[-_ ]?test|\\bttest\\b')} as t from q), b as (select q, case when {_R('\\bdeseq2?\\b')} then 'deseq2' when {_R('\\bedger\\b')} then 'edger' when t and {_R('pseudobulk|组间|condition')} then 'ttest' end as engine, case when {_R('\\bmast\\b')} then 'mast' when t then 't-test' when {_R('wilcox|秩和|mann[- ]?whitney')} then 'wilcoxon' end as marker_method from a), "
    + f"c as (select engine, marker_method, case when {_R('交叉验证|cross[-\\s]?valid|多种(检验|方法)|共识基因')} then true when {_R('只用|仅用|only\\s+(use\\s+)?')} and (engine is not null or marker_method is not null) then false when marker_method = 'mast' and {_R('wilcox|t[-_ ]?test|deseq|edger')} then true when {_R('wilcox')} and {_R('t[-_ ]?test|t检验')} then true end as cross_validate from b) select engine, marker_method, cross_validate, count(*) as n from c group by all",
    "notes_for": "with a as (select list_filter([" + ", ".join(f"case when {_IN('lower(' + _T + ')', w)} then '{k}' end" for k, w in routing.NOTES.items()) + "], lambda x: x is not null) as i from documents) select array_to_string(list_concat(['qc', 'doublet-detection'], i), ',') as notes, count(*) as n from a group by 1",
    "mt_options": f"with {views.QC}, k as (select sample, median(pct_counts_mt) as m, mad(pct_counts_mt) as d from q group by 1), op(option, nmads) as (values " + ", ".join(f"('{k}', {v}.0::double)" for k, v in OPTIONS.items()) + ") select q.sample, option, nmads, round(100 * avg(case when d > 0 and pct_counts_mt > m + nmads * d then 1.0 else 0.0 end), 2) as est_remove_pct from q join k using (sample), op group by all",
    "inspect_data": f"with {views.SQL}, a as (select count(*) as n_cells, count(distinct sample) as n_samples from o), g as (select count(*) as n_genes from v), e as (select count(*) as n_entries from m), r as (select min(n) as n_replicates from (select count(distinct sample) as n from o group by condition)), c as (select count(distinct sample) > 1 and count(distinct sample) = count(distinct condition) and count(distinct (sample, condition)) = count(distinct sample) as confounded from o), s as (select case when count(*) filter (gene_name like 'MT-%') > count(*) filter (gene_name like 'mt-%') then 'human' when count(*) filter (gene_name like 'mt-%') > count(*) filter (gene_name like 'MT-%') then 'mouse' else 'unknown' end as species from v) select *, n_samples > 1 and not confounded as need_batch_correction from a, g, e, r, c, s",
    "retrieve_fused": f"with {_POST}, h as (select bm.*, d.source, d.text, d.collection from bm join d using (id)), p as (select *, 0 as part from h where collection = 'best_practices' qualify row_number() over (partition by query_id order by rank) <= 3 union all select *, 1 from h where collection <> 'best_practices'), x as (select * from p qualify row_number() over (partition by query_id, source, substr(text, 1, 96) order by part, round(score, 9) desc, id) = 1) select query_id, id, part, (row_number() over (partition by query_id order by part, round(score, 9) desc, id))::int as rank from (select * exclude (rank) from x) qualify rank <= 6",
}

QUERIES = {f.__name__: f for f in (intent_rules, deg_preference, notes_for, mt_options, inspect_data, retrieve_fused, match_figures, pca_embed, kmeans_clusters, impute_low_rank, doublet_scores)}
