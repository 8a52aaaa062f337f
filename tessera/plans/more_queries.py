"""Queries of selection, routing, literature, doublet calls, sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import cells, graph, retrieval, routing, stats, summaries
from tessera.plans import views
from tessera.plans.evidence_queries import _edges, _embed
from tessera.plans.matrix_queries import _logged, _parts, _qc, rounded
from tessera.plans.text_queries import _docs
from tessera.session import run_dir, table
from tessera.sources import readers


def concat_auto(s, d):
    return cells.concat_samples(_parts(s, d), "auto").groupBy("sample").agg(F.countDistinct("cell_id").alias("n_cells"), F.countDistinct("gene_id").alias("n_genes"), F.sum("value").alias("total"))


def top_variance(s, d):
    return rounded(stats.top_variance(views.matrix(s, d), views.obs(s, d).count()), "variance")


def factorize(s, d):
    return stats.factorize(views.obs(s, d).select("cell_id", "sample"), "sample").groupBy("sample", "code").agg(F.count("*").alias("n"))


def genes_of_groups(s, d):
    """The cells' clusters by their genes' totals as ranked markers."""
    t = views.matrix(s, d).join(views.obs(s, d).select("cell_id", "cluster"), "cell_id").groupBy("cluster", "gene_id").agg(F.sum("value").alias("t"))
    ranked = t.withColumn("rank", F.expr("row_number() over (partition by cluster order by t desc, gene_id)"))
    return stats.genes_of_groups(ranked)


def hvg_counts(s, d):
    return rounded(cells.hvg_counts(views.matrix(s, d), views.obs(s, d)), "mean", "variance", "variance_norm")


def hvg_counts_batched(s, d):
    return cells.hvg_counts(views.matrix(s, d), views.obs(s, d), 500, "batch").select("gene_id", "n_batches", "rank", "highly_variable")


def hvg_moments(s, d):
    """What the counts-based choice stands on: means and variances over all cells, zeros included."""
    return rounded(cells.hvg_counts(views.matrix(s, d), views.obs(s, d)).select("gene_id", "mean", "variance"), "mean", "variance")


def resolution_sweep(s, d):
    e = _embed(s, d)
    _, scores = graph.resolution_sweep(_edges(s, d), e.select("id", "vec"))
    return graph.choose_resolution(scores)


def knn_per_batch(s, d):
    return rounded(graph.knn_per_batch(_embed(s, d), 3), "distance")


def root_cell(s, d):
    """Genes of stem cells by stand-in: the smallest class of parts."""
    v = views.var(s, d).withColumn("gene_name", F.when(F.col("p_size") == 1, "KIT").otherwise(F.col("gene_name")))
    return graph.root_cell(views.matrix(s, d), v, views.obs(s, d))


def detect_doublets(s, d):
    q = _qc(s, d).select("cell_id", "total_counts", "n_genes_by_counts")
    a = q.select("cell_id", (F.col("total_counts") > 150).alias("doublet"), (F.col("total_counts") / 400).alias("score"))
    b = q.select("cell_id", (F.col("n_genes_by_counts") > 5).alias("doublet"), (F.col("n_genes_by_counts") / 8).alias("score"))
    return cells.detect_doublets(q, {"scrublet": a, "sim": b}, ["scrublet", "scdblfinder"])[1]


def notes_for_route(s, d):
    x = table(s, d, "documents").select(F.array("collection", "section").alias("steps"), "text")
    return x.groupBy(F.array_join(routing.notes_for_route(F.col("steps"), F.col("text")), ",").alias("notes")).agg(F.count("*").alias("n"))


def skills_for(s, d):
    x = table(s, d, "documents").select(F.array_join(routing.skills_for(F.col("text"), F.array("section")), ",").alias("skills"))
    return x.groupBy("skills").agg(F.count("*").alias("n"))


def skill_kinds(s, d):
    return table(s, d, "documents").groupBy(routing.skill_kind(F.col("stem"), F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


def first_sentences(s, d):
    return table(s, d, "documents").select("doc_id", retrieval.first_sentence(F.col("text")).alias("line"))


def phase_queries(s, d):
    o = views.obs(s, d).select(F.element_at(F.array(*map(F.lit, ("qc", "annotation", "interpret", "none"))), (F.col("cell_id") % 4 + 1).cast("int")).alias("phase"), F.when(F.col("cell_id") % 3 > 0, F.col("cell_type")).alias("user_query"), F.lower("condition").alias("tissue"), F.lit("").alias("platform"))
    return retrieval.phase_queries(o).groupBy("query").agg(F.count("*").alias("n"))


def chunk_sections(s, d):
    p = table(s, d, "parsed_papers").select(F.col("paper_id").alias("id"), F.col("markdown").alias("text"))
    return retrieval.chunk_sections(p)


def claim_table(s, d):
    """Each state's claim with the terms that its own pathways enrich."""
    st = table(s, d, "cell_states").select(F.col("row_id").alias("state_no"), "name", "markers", "pathways", "citations")
    lab = st.where("name is not null").select(F.concat_ws("#", "name", F.col("state_no").cast("string")).alias("label"), "state_no")
    terms = lab.join(st, "state_no").select("label", F.posexplode("pathways").alias("i", "p")).where("i > 0 and p.id is not null").select("label", F.col("p.id").alias("term"), ((F.col("i") + 1) / 100.0).alias("pval"), ((F.col("i") + 1) / 50.0).alias("fdr"))
    return routing.assembled_claims(lab, st, terms).select("label", "state_no", "pathway_id", "pval", "fdr", F.size("citations").alias("n_citations"))


def metric_lines(s, d):
    logs = table(s, d, "documents").select("doc_id", F.concat_ws("\n", "text", F.concat(F.lit("n_chars="), "n_chars", F.lit(" lang="), F.coalesce(F.replace("lang", F.lit(" "), F.lit("_")), F.lit("none")))).alias("text"))
    return summaries.metric_lines(logs).where("name in ('n_chars', 'lang')").groupBy("name", "value").agg(F.count("*").alias("n"))


def _scratch(s, name):
    return f"{run_dir(s)}/{name}-{uuid.uuid4().hex}"


def source_chunks(s, d):
    """The chunk index written by collection, rewritten for one of them, and read back for two."""
    docs, path = _docs(s, d).select("id", "collection", F.length("text").alias("n")).where("collection is not null"), _scratch(s, "chunks")
    readers.write_chunks(docs, path)
    readers.write_chunks(docs.where("collection = 'sops'").withColumn("n", F.col("n") + 1), path)
    return readers.load_chunks(s, path, ["sops", "papers"]).groupBy("collection").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n_chars"))


def source_catalog_csv(s, d):
    """The marker catalog as a table of text with joined lists, read back for one tissue by another name."""
    m, path = table(s, d, "marker_catalog"), _scratch(s, "catalog") + ".csv"
    flat = m.where("name is not null and name not like '%,%' and name not like '%\"%'").select("tissue", F.trim("name").alias("name"), "cl_id", "source", *(F.array_join(c, "|").alias(c) for c in ("lineage", "positive", "negative")))
    readers.write_result(flat, path, "csv")
    back = readers.read_marker_catalog(s, path, "Blood")
    return back.groupBy("tissue").agg(F.count("*").alias("n"), F.sum(F.size("positive")).alias("n_positive"), F.sum(F.size("negative")).alias("n_negative"))


def sink_de_csv(s, d):
    """A result table as CSV and its genes read back by adjusted p."""
    p, path = table(s, d, "part"), _scratch(s, "de")
    readers.write_result(p.select(F.col("p_name").alias("names"), (F.pmod(F.col("p_partkey") * 7919, F.lit(1009)) / 1009.0).alias("padj"), F.array("p_size").alias("left_out")), path, "csv")
    return readers.genes_from_table(s.read.option("header", True).csv(path), 50)


_IN = lambda c, ws: "(" + " or ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_LIST = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_O = f"with {views.SQL}"
_T = "coalesce(text, '')"

SQL = {
    "concat_auto": "with p as (select l_returnflag as sample, l_orderkey as c, l_partkey as g, sum(l_quantity) as value from lineitem where l_returnflag in ('A', 'N', 'R') group by all), i as (select g from p group by 1 having count(distinct sample) = 3) select sample, count(distinct c) as n_cells, count(distinct g) as n_genes, sum(value) as total from p where g in (select g from i) group by 1",
    "top_variance": f"{_O}, n as (select count(*)::double as n from o), gv as (select gene_id, (sum(value * value) - sum(value) * sum(value) / any_value(n)) / any_value(n) as raw from m, n group by 1) select gene_id, round(raw, 4) as variance from gv order by round(raw, 9) desc, gene_id limit 80",
    "factorize": f"{_O} select sample, (dense_rank() over (order by sample) - 1)::int as code, count(*) as n from o group by sample",
    "genes_of_groups": f"{_O}, t as (select cluster, gene_id, sum(value) as t from m join o using (cell_id) group by all), r as (select *, row_number() over (partition by cluster order by t desc, gene_id) as rank from t), f as (select * from r where rank <= greatest(10, floor(100 / (select count(distinct cluster) from r)))), z as (select cluster, sum(count(*)) over (order by cluster) - count(*) as before from f group by cluster) select gene_id, (before + rank)::bigint as at from f join z using (cluster) where before < 100",
    "hvg_moments": f"{_O}, n as (select count(*)::double as n from o), g as (select gene_id, sum(value) as s, sum(value * value) as q from m group by 1) select gene_id, round(s / n, 4) as mean, round((q - n * (s / n) * (s / n)) / (n - 1), 4) as variance from g, n",
    "knn_per_batch": "with e as (select vec_id as id, embedding as vec, label from embeddings), nb as (select q.id as query, b.id as neighbor, b.label, list_distance(q.vec::double[], b.vec::double[]) as distance from e q join e b on q.id <> b.id) select query, neighbor, label, (row_number() over (partition by query, label order by round(distance, 9), neighbor))::int as rank, round(distance, 4) as distance from nb qualify row_number() over (partition by query, label order by round(distance, 9), neighbor) <= 3",
    "root_cell": f"{_O}, x as (select o.cell_id, coalesce(sum(value) filter (p_size = 1), 0) as s from o left join m using (cell_id) left join v using (gene_id) group by 1) select cell_id from x order by s desc, cell_id limit 1",
    "detect_doublets": f"with {views.QC}, c as (select total_counts > 150 as a, n_genes_by_counts > 5 as b, n_genes_by_counts / 8 > 0.8 as sure from q), t as (select *, case when a and b and sure then 'high' when a or b then 'low' else 'none' end as t from c) select 'ok' as status, 'scrublet,sim' as methods, count(*) filter (t = 'high') as n_high_conf, count(*) filter (t = 'low') as n_low_conf, count(*) filter (t = 'none') as n_singlet, count(*) filter (t <> 'none') / count(*) as rate, round(count(*) filter (t = 'high') / count(*), 4) as rate_high_conf, round(count(*) filter (t = 'low') / count(*), 4) as rate_low_conf, round(avg(case when a = b then 1.0 else 0.0 end), 4) as agreement, count(*) filter (a <> b) as n_discordant from t",
    "notes_for_route": "with x as (select lower(coalesce(collection, '')) as a, lower(coalesce(section, '')) as b, lower(" + _T + ") as t from documents), y as (select list_concat(['qc', 'doublet-detection'], " + ", ".join(f"case when contains({c}, '{k}') then {_LIST(v)} else [] end" for c in "ab" for k, v in routing.STEP_NOTES) + ", " + ", ".join(f"case when {_IN('t', w)} then ['{k}'] else [] end" for k, w in routing.NOTES.items()) + f") as l from x) select array_to_string({_ORDERED.format('l')}, ',') as notes, count(*) as n from y group by 1",
    "skills_for": f"with x as (select lower(concat_ws(' ', text, coalesce(section, ''))) as t, lower(section) as s from documents) select array_to_string(list_concat({_LIST(routing.CORE_SKILLS)}, " + ", ".join(f"case when {_IN('t', w)}" + (f" or s in ({', '.join(repr(e) for e in ex)})" if ex else "") + f" then ['{k}'] else [] end" for k, w, ex in routing.SKILL_WORDS) + "), ',') as skills, count(*) as n from x group by 1",
    "skill_kinds": "with x as (select lower(concat_ws(' ', stem, text)) as t from documents) select case " + " ".join(f"when {_IN('t', w)} then '{k}'" for k, w in routing.SKILL_KINDS.items()) + " else 'other' end as kind, count(*) as n from x group by 1",
    "first_sentences": r"with x as (select doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x0b\x1c-\x1f\x85\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) as t from documents), y as (select doc_id, case when contains(t, '. ') then split_part(t, '. ', 1) || '.' when contains(t, '; ') then split_part(t, '; ', 1) when contains(t, '。') then split_part(t, '。', 1) when contains(t, '；') then split_part(t, '；', 1) else t end as o from x) select doc_id, regexp_replace(substr(o, 1, 220), '[ ,;:]+$', '') || case when length(o) > 220 then '…' else '' end as line from y",
    "phase_queries": f"{_O}, p as (select ['qc', 'annotation', 'interpret', 'none'][cell_id % 4 + 1] as phase, case when cell_id % 3 > 0 then cell_type end as u, lower(condition) as t from o) select concat_ws(' ', u, t, case phase " + " ".join(f"when '{k}' then '{v}'" for k, v in retrieval.PHASE_QUERIES.items() if k != "plan") + f" else '{retrieval.PHASE_QUERIES['plan']}' end) as query, count(*) as n from p group by 1",
    "claim_table": "with l as (select name || '#' || row_id as label, row_id as state_no, pathways, citations from cell_states where name is not null), t as (select label, state_no, unnest(pathways) as p, generate_subscripts(pathways, 1) as i from l), b as (select label, arg_min(struct_pack(id := p.id, i := i), i) as x from t where i > 1 and p.id is not null group by 1) select l.label, l.state_no, coalesce(x.id, pathways[1].id) as pathway_id, (x.i / 100.0)::double as pval, (x.i / 50.0)::double as fdr, coalesce(len(citations), -1)::int as n_citations from l left join b using (label)",
    "source_chunks": "select collection, count(*) as n_chunks, sum(length(coalesce(text, '')) + case when collection = 'sops' then 1 else 0 end)::bigint as n_chars from documents where collection in ('sops', 'papers') group by 1",
    "source_catalog_csv": "select tissue, count(*) as n, sum(coalesce(len(list_filter(positive, lambda g: g is not null)), 0))::bigint as n_positive, sum(coalesce(len(list_filter(negative, lambda g: g is not null)), 0))::bigint as n_negative from marker_catalog where tissue = 'pbmc' and name is not null and name not like '%,%' and name not like '%\"%' group by 1",
    "sink_de_csv": "select p_name as gene from part order by ((p_partkey * 7919) % 1009) / 1009.0, p_name limit 50",
}

QUERIES = {f.__name__: f for f in (
    concat_auto, top_variance, factorize, genes_of_groups, hvg_counts, hvg_counts_batched, hvg_moments, resolution_sweep, knn_per_batch, root_cell, detect_doublets, notes_for_route, skills_for, skill_kinds,
    first_sentences, phase_queries, chunk_sections, claim_table, metric_lines, source_chunks, source_catalog_csv, sink_de_csv,
)}
