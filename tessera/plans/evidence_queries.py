"""Queries over labels, evidence, embeddings, events and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ids import term_number
from tessera.operators import audits, graph, labels, provenance
from tessera.operators.summaries import composition, histogram, in_and_out, modes, nearest_rank, trend
from tessera.plans import views
from tessera.plans.matrix_queries import rounded
from tessera.session import table

# The weights of a publication's items.
WEIGHTS = {"qc": 20, "batch_correction": 15, "doublet_detection": 10, "markers": 15, "deg": 10, "figures": 10, "annotation": 10, "evidence": 10}
# Patterns that the test table's texts hold, for the generic audit.
RULES = {"pval_threshold": ("warn", r"p < 0\.0\d+"), "version_pin": ("info", r"version \d+\.\d+"), "percent": ("info", r"\d+(?:\.\d+)?%"), "url": ("warn", r"https?://[^ \n]+")}


SCRIPT = [
    "sc.pl.violin(adata)", "sc.pl.scatter(adata)", "x = median_abs_deviation(v, side=\"high\")", *audits.LOCKED, "calculate_qc_metrics(log1p=True)", "adata = adata[adata.obs.pct_mt < 5]", "detect_doublets(adata)",
    "remove_ambient(method='soupx_python')", "os.system('ls')", "subprocess.run(['ls'])", "eval (x)", "pickle.loads(b)", "import harmony", "umap looks well mixed", "sc.tl.leiden(adata, use='umap')", "celltypist.annotate(Immune_All_Low.pkl)",
    "cluster_deg()", "fuse_annotation()", "azimuth", "positive negative", "dual_ok", "raise SystemExit(0)", "cell_type_l1", "pseudobulk_de(confirmatory=True) # fdr", "sc.tl.rank_genes_groups(adata)", "sc.pp.scale(adata)", "paga", "seed = 0", "__import__('x')",
]


def _embed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def knn_topk(s, d):
    """Queries: every row whose id is divisible by 50, against all rows."""
    e = _embed(s, d)
    return rounded(graph.knn(e.where("id % 50 = 0"), e, 10).select("query", "neighbor", "rank", "distance"), "distance")


def _edges(s, d, k=15):
    e = _embed(s, d)
    return graph.knn(e, e, k)


def ilisi(s, d):
    e = _embed(s, d)
    return rounded(graph.ilisi(_edges(s, d, 30), e.select("id", "label"), e.select("label").distinct().count()), "ilisi")


def pca_batch_r2(s, d):
    return rounded(graph.batch_r2(_embed(s, d)), "r2")


def silhouette_exact(s, d):
    per = graph.silhouette(_embed(s, d))
    return rounded(per.groupBy("label").agg(F.count("*").alias("n"), F.avg("s").alias("silhouette")), "silhouette")


def lsh_knn(s, d):
    """Inverted-file search of the same queries. It visits as many cells as the table needs; the tests
    hold its recall against ``knn_topk`` to 0.9 on the embeddings themselves."""
    e = _embed(s, d)
    c = graph.ivf_fit(e)
    return graph.ivf_search(e.where("id % 50 = 0"), e, c, 10, graph.ivf_probes(e, c, 10)).select("query", "neighbor", "rank")


def paga_edges(s, d):
    return rounded(graph.cluster_graph(_edges(s, d), _embed(s, d).select("id", "label")), "weight")


def path_like(s, d):
    lab = _embed(s, d).select("id", "label")
    return rounded(graph.path_like(graph.cluster_graph(_edges(s, d), lab), lab), "path_like")


def elongation(s, d):
    p = table(s, d, "embeddings").select("label", F.get("embedding", 0).cast("double").alias("x"), F.get("embedding", 1).cast("double").alias("y"))
    return rounded(graph.elongation(p), "elongation")


def modularity_clusters(s, d):
    return graph.modularity_clusters(_edges(s, d))


def harmonized(s, d):
    return graph.harmonize(_embed(s, d)).select("id", "label", "vec")


def resolution_choice(s, d):
    """Customers' segments as resolutions: balance as silhouette, nations as clusters."""
    c = table(s, d, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("a"), F.stddev_pop("c_acctbal").alias("m"), F.countDistinct("c_nationkey").alias("n_clusters"))
    scores = c.select((F.length("c_mktsegment") / 10.0 + F.ascii("c_mktsegment") / 1000.0).alias("resolution"), F.col("a").alias("silhouette"), F.col("m").alias("marker"), "n_clusters")
    return rounded(graph.choose_resolution(scores).select("resolution", "score"), "resolution", "score")


def batch_dominance(s, d):
    return rounded(graph.batch_dominance(views.obs(s, d)), "dominance")


def doublet_tiers(s, d):
    from tessera.operators.cells import doublet_tiers as tiers

    li = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", (F.col("l_quantity") > 40).alias("a"), (F.col("l_discount") > 0.07).alias("b"), (F.col("l_tax") * 12.5).alias("score"))
    return tiers(li, "a", "b", "score").groupBy("tier", "discordant").agg(F.count("*").alias("n"))


def doublet_agreement(s, d):
    from tessera.operators.cells import doublet_agreement as agree

    return rounded(agree(table(s, d, "lineitem").select((F.col("l_quantity") > 40).alias("a"), (F.col("l_discount") > 0.07).alias("b")), "a", "b"), "agreement")


def doublet_rates(s, d):
    from tessera.operators.cells import doublet_rate

    return rounded(views.obs(s, d).groupBy("sample").agg(F.count("*").alias("n")).select("sample", "n", doublet_rate(F.col("n") * 20).alias("rate")), "rate")


def cluster_mode(s, d):
    return modes(views.obs(s, d), "cluster", "cell_type")


def selection_composition(s, d):
    o = views.obs(s, d)
    return composition(o, o.where("condition = 'ASIA'").select("cell_id"), "cluster")


def selection_summary(s, d):
    o = views.obs(s, d)
    return rounded(in_and_out(views.matrix(s, d), o, o.where("condition = 'ASIA'").select("cell_id")), "mean_in", "mean_rest")


def value_histogram(s, d):
    h = histogram(table(s, d, "events"), "event_type", "value", 24)
    return h.withColumns({c: F.round(c, 7) for c in ("lo", "hi")})


def trend_bins(s, d):
    e = table(s, d, "events").select("event_type", F.unix_timestamp("ts").cast("double").alias("t"), "value")
    return rounded(trend(e, "event_type", "t", "value", 12), "mean")


def nearest_rank_pct(s, d):
    return rounded(nearest_rank(table(s, d, "events"), "event_type", "value", [0.05, 0.5, 0.95]), "p5", "p50", "p95")


def label_fusion(s, d):
    o = views.obs(s, d)
    m = F.when(F.col("cluster") == "1-URGENT", "CD8 T").when(F.col("cluster") == "2-HIGH", "B cells").when(F.col("cluster") == "3-MEDIUM", "unknown").otherwise("NK")
    a = F.when(F.col("cell_type") == "BUILDING", "CD8 T cells").when(F.col("cell_type") == "MACHINERY", "B cell").when(F.col("cell_type") == "FURNITURE", "natural killer").otherwise("none")
    g = F.when(F.col("batch") == "O", "CD8+ T").when(F.col("batch") == "F", "B lymphocyte").otherwise("Monocytes")
    x = o.select("cell_id", m.alias("marker_label"), a.alias("auto_label"), g.alias("deg_label"))
    return labels.fuse(x, ["marker_label", "auto_label", "deg_label"], "marker_label").groupBy("marker_label", "auto_label", "deg_label", "cell_type", "annotation_status", "annotation_n_agree", "annotation_n_sources").agg(F.count("*").alias("n"))


def ensemble_labels(s, d):
    o = views.obs(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("cell_id"), (F.col("o_totalprice") % 100 / 100).alias("conf")), "cell_id")
    return labels.ensemble(o.withColumn("second", F.when(F.col("batch") == "P", F.col("cluster"))), "cell_type", "conf", "second").groupBy("cell_type", "method").agg(F.count("*").alias("n"))


def catalog_flatten(s, d):
    m = table(s, d, "marker_catalog")
    return m.select("row_id", "tissue", F.explode(F.array_distinct(F.coalesce("positive", F.array().cast("array<string>")))).alias("gene")).groupBy("tissue", "gene").agg(F.countDistinct("row_id").alias("n_types"))


def _catalog(s, d):
    """The entries of all tissues, numbered in the order of the table; only exact repeats are one
    entry, and rows without markers stay."""
    m = table(s, d, "marker_catalog").where("name is not null")
    m = m.groupBy("tissue", "name", "cl_id", "source", "lineage", "positive", "negative").agg(F.min("row_id").alias("pos_no"))
    return m.select("tissue", F.col("name").alias("type"), "pos_no", F.coalesce(F.size("lineage"), F.lit(0)).alias("depth"), F.array_distinct(F.coalesce("positive", F.array().cast("array<string>"))).alias("positive"), F.array_distinct(F.coalesce("negative", F.array().cast("array<string>"))).alias("negative"))


def _means(s, d):
    """Mean expression of genes in clusters, one a tissue: how often its catalog names a gene."""
    m = table(s, d, "marker_catalog")
    per = m.groupBy("tissue").agg(F.count("*").alias("n"))
    c = m.select("tissue", F.explode("positive").alias("gene")).groupBy("tissue", "gene").agg(F.count("*").alias("c"))
    return c.join(per, "tissue").select(F.col("tissue").alias("cluster"), "tissue", "gene", (F.col("c") * 40.0 / F.col("n")).alias("mean"))


def marker_scores(s, d):
    return rounded(labels.marker_scores(_means(s, d), _catalog(s, d)), "score")


def best_types(s, d):
    return rounded(labels.best_type(labels.marker_scores(_means(s, d), _catalog(s, d))).select("cluster", "type", "dual_ok", "score"), "score")


def dual_validation(s, d):
    w = table(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("p"), F.slice("embedding", 5, 3).alias("n"))
    x = w.select("vec_id", F.transform("p", lambda v: v.cast("double")).alias("pos_means"), F.transform("n", lambda v: v.cast("double")).alias("neg_means"))
    return labels.dual_validation(x).select("vec_id", "n_pos_pass", "n_neg_pass", "dual_ok")


def deg_catalog_labels(s, d):
    m = _means(s, d)
    top = m.withColumn("r", F.expr("row_number() over (partition by cluster order by mean desc, gene)")).where("r <= 25")
    return rounded(labels.catalog_labels(top.select("cluster", "tissue", "gene"), _catalog(s, d)), "share")


def ontology_ids(s, d):
    cat = table(s, d, "cl_subset").select(F.lower(F.trim("name")).alias("name"), term_number("id").alias("cl_id"), F.col("row_id").alias("pos"))
    return labels.ontology_ids(table(s, d, "cell_states").select("row_id", F.col("name").alias("cell_type")), cat).select("row_id", "cell_ontology_id")


def lineage_levels(s, d):
    return labels.lineage_levels(table(s, d, "marker_catalog").select("row_id", "lineage"), "lineage", 3).drop("lineage")


def evidence_claims(s, d):
    c = table(s, d, "cell_states").select("row_id", "markers", F.get("pathways", 0)["id"].alias("pathway_id"), F.when(F.size("pathways") > 0, F.lit(0.01)).alias("pval"), "citations")
    return labels.validate_claims(c).select("row_id", "n_markers", "has_pathway", "has_literature", "ok")


def match_states(s, d):
    st = table(s, d, "cell_states").select(F.col("row_id").alias("state_no"), "name", "aliases")
    l = table(s, d, "marker_catalog").select(F.col("name").alias("label")).where("label is not null").distinct()
    return labels.match_states(l, st)


def audit_rules(s, d):
    return labels.audit(table(s, d, "documents"), RULES)


def _scripts(s, d):
    """Texts as scripts: each document with calls and words that the rules look for, by its number."""
    lines = F.array(*map(F.lit, SCRIPT))
    pick = F.array_join(F.filter(lines, lambda l, i: F.pmod(F.col("doc_id") * (2 * i + 3), F.lit(7)) < 3), "\n")
    n = F.col("doc_id")
    facts = {"tissue": F.when(n % 3 == 0, "brain").otherwise("pbmc"), "has_model": n % 2 == 0, "n_samples": (n % 4).cast("int"), "need_batch_correction": n % 5 < 2, "force_pseudobulk": n % 3 == 1, "confounded": n % 11 == 0, "wants_trajectory": n % 6 == 0}
    return table(s, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), pick).alias("text"), *(c.alias(k) for k, c in facts.items()))


def policy_violations(s, d):
    return audits.violations(_scripts(s, d), "doc_id").select("doc_id", "found")


def audit_code_qc(s, d):
    return audits.audit_code(_scripts(s, d), "qc", "doc_id")


def audit_code_downstream(s, d):
    return audits.audit_code(_scripts(s, d), "downstream", "doc_id")


def audit_execution(s, d):
    m = views.obs(s, d).groupBy("sample").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("k"))
    x = m.select("sample", F.when(F.col("n") % 3 != 0, (F.col("n") % 100) / 100.0).alias("ilisi"), F.when(F.col("n") % 4 != 0, (F.col("n") % 70) / 70.0).alias("kbet"), ((F.col("n") % 11) / 11.0).alias("r2"), ((F.col("n") % 20) / 20.0).alias("mix"), (F.col("n") % 50).cast("double").alias("pct_removed"), ((F.col("n") % 17) / 100.0).alias("doublet_rate"))
    return labels.audit_run(x).select("sample", "integration", "overfiltered", "many_doublets")


def publication_score(s, d):
    items = list(WEIGHTS)
    o = views.obs(s, d)
    status = lambda i: F.when((F.col("n") + i) % 5 == 0, "missing").when((F.col("n") + i) % 17 == 0, "fail").otherwise("pass")
    x = o.groupBy(F.col("sample").alias("run")).agg(F.count("*").alias("n")).select("run", F.explode(F.array(*(F.struct(F.lit(k).alias("item"), status(i).alias("status")) for i, k in enumerate(items)))).alias("i")).select("run", "i.item", "i.status")
    return labels.publication_score(x, WEIGHTS)


def manifest_merge(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("phase"), F.col("user_id").alias("step"), "event_id", "ts", "value")
    return provenance.merge_manifest(e, "step", ["ts", "event_id"]).select("step", "phase", "event_id", "value")


def index_freshness(s, d):
    docs = table(s, d, "documents")
    src = docs.select("collection", F.col("ingested_at").alias("changed_at"))
    idx = docs.where("chunk_index = 0").select("collection", F.col("ingested_at").alias("built_at"))
    return provenance.fresh(src, idx)


def snapshot_fork(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("thread"), F.expr("cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int)").alias("step"), F.col("o_orderstatus").alias("phase"), F.col("o_orderkey").cast("string").alias("matrix_path"))
    return provenance.fork(o, "7", "7-branch", 3).where("thread in ('7', '7-branch')").select("thread", "step", "phase", "matrix_path")


def cache_keys(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", provenance.cache_key(F.col("p_partkey").cast("string"), F.col("p_brand"), F.col("p_type")).alias("key"))


def matrix_fingerprint(s, d):
    return provenance.fingerprint(views.matrix(s, d)).select("n_cells", "n_genes", "n_entries", "digest")


def volcano_points(s, d):
    from tessera.operators.stats import rank_genes_ttest
    from tessera.plans.matrix_queries import _logged

    r = rank_genes_ttest(_logged(s, d), views.obs(s, d))
    p = F.greatest("pval", F.lit(1e-300))
    return rounded(r.select("cluster", "gene_id", (F.col("mean_in") - F.col("mean_rest")).alias("effect"), (-F.log10(p)).alias("height"), (F.col("pval") <= 0.05).alias("significant")), "effect", "height")


_KNN = """e as (select vec_id as id, embedding as vec, label from embeddings),
 nb as (select q.id as query, b.id as neighbor, list_distance(q.vec::double[], b.vec::double[]) as distance from e q join e b on q.id <> b.id {where}),
 kn as (select *, row_number() over (partition by query order by round(distance, 9), neighbor) as rank from nb qualify rank <= {k})"""
_ALL = "with " + _KNN.format(where="", k=15)
_PAGA = _ALL + """, x as (select a.label as a, b.label as b, count(*) as n from kn join e a on a.id = query join e b on b.id = neighbor group by all),
 dg as (select c, sum(o) as o, sum(i) as i from (select a as c, sum(n) as o, 0 as i from x group by 1 union all select b, 0, sum(n) from x group by 1) group by 1),
 un as (select least(a, b) as a, greatest(a, b) as b, sum(n) as n from x where a <> b group by 1, 2),
 pg as (select u.a, u.b, least(1.0, u.n / ((p.o * q.i + q.o * p.i) / (select sum(n) from x))) as weight from un u join dg p on p.c = u.a join dg q on q.c = u.b)"""
_OBS = f"with {views.SQL}"
_CAT = """ct as (select tissue, name as type, min(row_id) as pos_no, coalesce(len(lineage), 0) as depth, list_distinct(coalesce(positive, [])) as positive, list_distinct(coalesce(negative, [])) as negative
   from marker_catalog where name is not null group by tissue, name, cl_id, source, lineage, positive, negative),
 me as (select tissue as cluster, tissue, gene, c * 40.0 / n as mean from (select tissue, gene, count(*) as c from (select tissue, unnest(positive) as gene from marker_catalog) group by all) join (select tissue, count(*) as n from marker_catalog group by 1) using (tissue))"""
_SCORE = f"""with {_CAT}, gn as (select distinct pos_no, tissue, gene, up from (select pos_no, tissue, unnest(positive) as gene, true as up from ct union all select pos_no, tissue, unnest(negative), false from ct)),
 sz as (select pos_no, count(*) filter (up) as np, count(*) filter (not up) as nn from gn group by 1),
 mt as (select cluster, pos_no, sum(case when up then mean else 0 end) as sp, sum(case when not up then mean else 0 end) as sn, count(*) filter (up and mean >= 0.1) as hit, count(*) filter (not up and mean > 0.5) as miss from me join gn using (tissue, gene) group by all),
 sc as (select cluster, type, pos_no, hit >= 2 and (nn = 0 or nn - miss >= 1) as dual_ok, sp / np - case when nn > 0 then sn / nn else 0 end + 0.01 * depth + case when hit >= 2 and (nn = 0 or nn - miss >= 1) then 1 else 0 end as score from mt join sz using (pos_no) join ct using (pos_no) where np >= 2)"""
_CANON = "regexp_replace(trim(replace(regexp_replace(lower(trim({0})), '\\s+', ' ', 'g'), ' cells', ' cell')), 's$', '')"

SQL = {
    "knn_topk": f"with {_KNN.format(where='where q.id % 50 = 0', k=10)} select query, neighbor, rank::int as rank, round(distance, 4) as distance from kn",
    "ilisi": f"{_ALL.replace('rank <= 15', 'rank <= 30')}, c as (select query, label, count(*) as c from kn join e on id = neighbor group by all), p as (select query, c / sum(c) over (partition by query) as p from c), h as (select query, -sum(p * ln(p + 1e-12)) / ln((select count(distinct label) from e)) as h from p group by 1) select round(avg(h), 4) as ilisi from h",
    "pca_batch_r2": "with l as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pc from embeddings), y as (select label, pc, x - avg(x) over (partition by pc) as y from l where pc <= 20), g as (select pc, label, count(*) as n, sum(y) as s, sum(y * y) as q from y group by all), r as (select pc, sum(case when label <> (select max(label) from embeddings) then s * s / n else 0 end) as ex, sum(q) as sst from g group by 1) select round(avg(greatest(0, least(1, ex / sst))), 4) as r2 from r where sst > 1e-12",
    "silhouette_exact": "with e as (select vec_id as id, embedding::double[] as vec, label from embeddings), d as (select a.id, a.label, b.label as other, sum(list_distance(a.vec, b.vec)) as s, count(*) as n from e a, e b group by all), p as (select id, label, max(case when label = other and n > 1 then s / (n - 1) end) as a, min(case when label <> other then s / n end) as b from d group by all) select label, count(*) as n, round(avg(case when a is null or b is null then 0 else (b - a) / greatest(a, b, 1e-300) end), 4) as silhouette from p group by 1",
    "paga_edges": f"{_PAGA} select a, b, round(weight, 4) as weight from pg",
    "path_like": f"{_PAGA}, dd as (select l, count(*) as d from (select a as l from pg where weight >= 0.05 union all select b from pg where weight >= 0.05) group by 1) select round(avg(case when coalesce(d, 0) between 1 and 2 then 1.0 else 0.0 end), 4)::double as path_like from (select distinct label as l from embeddings) left join dd using (l)",
    "elongation": "with c as (select label, avg(embedding[1]::double) as x, avg(embedding[2]::double) as y from embeddings group by 1), m as (select sum(x * x) - sum(x) * sum(x) / count(*) as a, sum(y * y) - sum(y) * sum(y) / count(*) as b, sum(x * y) - sum(x) * sum(y) / count(*) as c from c), e as (select (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + c * c) as hi, (a + b) / 2 - sqrt((a - b) * (a - b) / 4 + c * c) as lo from m) select round(case when lo > 1e-12 then sqrt(hi / lo) end, 4) as elongation from e",
    "resolution_choice": "with c as (select length(c_mktsegment) / 10.0 + ascii(c_mktsegment) / 1000.0 as resolution, avg(c_acctbal) as a, stddev_pop(c_acctbal) as m, count(distinct c_nationkey) as k from customer group by c_mktsegment), s as (select resolution, 0.45 * (a - min(a) over ()) / (max(a) over () - min(a) over ()) + 0.35 * (m - min(m) over ()) / (max(m) over () - min(m) over ()) + 0.2 * case when k < 3 then 0.1 * k / 3 when k > 25 then greatest(0, 1 - 0.05 * (k - 25)) else 1.0 end as score from c) select round(resolution, 4)::double as resolution, round(score, 4) as score from s order by score desc, resolution limit 1",
    "batch_dominance": f"{_OBS}, c as (select cluster, sample, count(*) as n from o group by all), t as (select cluster, max(n) / sum(n) as t from c group by 1) select round(avg(t), 4) as dominance from t",
    "doublet_tiers": "with x as (select l_quantity > 40 as a, l_discount > 0.07 as b, l_tax * 12.5 as s from lineitem), t as (select case when a and b and s > 0.8 then 'high_conf' when a or b then 'low_conf' else 'singlet' end as tier from x) select tier, tier = 'low_conf' as discordant, count(*) as n from t group by all",
    "doublet_agreement": "with x as (select l_quantity > 40 as a, l_discount > 0.07 as b from lineitem) select count(*) filter (a and b) as n_both, count(*) filter (a <> b) as n_discordant, round(avg(case when a = b then 1.0 else 0.0 end), 4) as agreement from x",
    "doublet_rates": f"{_OBS}, n as (select sample, count(*) as n from o group by 1) select sample, n, round(least(0.10, greatest(0.005, 0.008 * n * 20 / 1000.0)), 4)::double as rate from n",
    "cluster_mode": f"{_OBS}, c as (select cluster, cell_type, count(*) as n from o group by all) select cluster, cell_type as mode, n from (select *, row_number() over (partition by cluster order by n desc, cell_type) as r from c) where r = 1",
    "selection_composition": f"{_OBS} select cluster as value, count(*) filter (condition = 'ASIA') as n_in, count(*) filter (condition <> 'ASIA') as n_rest from o group by 1",
    "selection_summary": f"{_OBS}, n as (select count(*) filter (condition = 'ASIA') as a, count(*) filter (condition <> 'ASIA') as b from o), x as (select gene_id, sum(case when condition = 'ASIA' then value else 0 end) as sa, sum(case when condition <> 'ASIA' then value else 0 end) as sb from m join o using (cell_id) group by 1) select gene_id, round(sa / a, 4) as mean_in, round(sb / b, 4) as mean_rest from x, n",
    "value_histogram": "with r as (select event_type, min(value) as lo, case when max(value) <= min(value) then min(value) + 1 else max(value) end as hi from events where value is not null group by 1), b as (select event_type, least(23, floor((value - lo) / ((hi - lo) / 24)))::int as bin, lo, hi from events join r using (event_type) where value is not null) select event_type, bin, round(lo + bin * (hi - lo) / 24, 7) as lo, round(lo + (bin + 1) * (hi - lo) / 24, 7) as hi, count(*) as n from b group by event_type, bin, b.lo, b.hi",
    "trend_bins": "with e as (select event_type, floor(epoch(ts))::double as t, value from events where value is not null), r as (select event_type, min(t) as lo, max(t) as hi from e group by 1), b as (select event_type, floor((t - lo) / ((hi - lo) / 11))::int as bin, value from e join r using (event_type) where hi > lo and t < hi) select event_type, bin, count(*) as n, round(avg(value), 4) as mean from b group by all",
    "nearest_rank_pct": "with l as (select event_type, list_sort(list(value)) as v from events where value is not null group by 1) select event_type, " + ", ".join(f"round(v[1 + round_even({q} * (len(v) - 1), 0)::int], 4) as p{n}" for q, n in ((0.05, 5), (0.5, 50), (0.95, 95))) + " from l",
    "ensemble_labels": f"{_OBS}, x as (select o.*, (o_totalprice % 100) / 100 as conf, case when batch = 'P' then cluster end as second from o join orders on o_orderkey = cell_id), y as (select case when conf >= 0.8 then cell_type else coalesce(second, cell_type) end as cell_type, case when conf >= 0.8 then 'celltypist' when second is not null then 'second_model' else 'celltypist_low_conf' end as method from x) select cell_type, method, count(*) as n from y group by all",
    "catalog_flatten": "select tissue, gene, count(distinct row_id) as n_types from (select row_id, tissue, unnest(list_distinct(positive)) as gene from marker_catalog) where gene is not null group by all",
    "marker_scores": f"{_SCORE} select cluster, type, pos_no, dual_ok, round(score, 4) as score from sc",
    "best_types": f"{_SCORE} select cluster, type, dual_ok, round(score, 4) as score from (select *, row_number() over (partition by cluster order by round(score, 9) desc, pos_no) as r from sc) where r = 1",
    "dual_validation": "with x as (select vec_id, len(list_filter(embedding[1:4]::double[], lambda v: v >= 0.1)) as p, len(list_filter(embedding[5:7]::double[], lambda v: v <= 0.5)) as n from embeddings) select vec_id, p::int as n_pos_pass, n::int as n_neg_pass, p >= 2 and n >= 1 as dual_ok from x",
    "deg_catalog_labels": f"with {_CAT}, tp as (select cluster, tissue, upper(gene) as gene from (select *, row_number() over (partition by cluster order by mean desc, gene) as r from me) where r <= 25), ty as (select tissue, type, pos_no, len(positive) as n, upper(unnest(positive)) as gene from ct where len(positive) >= 2), h as (select cluster, type, pos_no, count(*) / n as s from (select distinct * from tp) join ty using (tissue, gene) group by cluster, type, pos_no, n), b as (select * from (select *, row_number() over (partition by cluster order by round(s, 9) desc, pos_no) as r from h) where r = 1) select cluster, case when coalesce(s, 0) >= 0.25 then type else 'unknown' end as deg_label, round(coalesce(s, 0), 4)::double as share from (select distinct cluster from tp) left join b using (cluster)",
    "ontology_ids": f"with c0 as (select lower(trim(name)) as name, try_cast(nullif(regexp_extract(id, '([0-9]+)', 1), '') as bigint) as no, row_id from cl_subset), c as (select name, arg_max(no, row_id) as no from c0 where no is not null group by 1), x as (select row_id, lower(trim(name)) as a, {_CANON.format('lower(trim(name))')} as b from cell_states) select x.row_id, coalesce(p.no, q.no) as cell_ontology_id from x left join c p on p.name = x.a left join c q on q.name = x.b",
    "lineage_levels": "select row_id, coalesce(lineage[1], 'unknown') as cell_type_l1, coalesce(lineage[2], 'unknown') as cell_type_l2, coalesce(lineage[3], 'unknown') as cell_type_l3 from marker_catalog",
    "evidence_claims": "with x as (select row_id, len(list_distinct(list_filter(list_transform(coalesce(markers, []), lambda g: upper(trim(g))), lambda g: g <> '')))::int as n_markers, coalesce(trim(pathways[1].id) <> '', false) and len(pathways) > 0 as has_pathway, coalesce(len(list_filter(citations, lambda c: coalesce(regexp_matches(c.doi, '10\\.[0-9]{4,9}/[-._;()/:a-zA-Z0-9]+'), false) or coalesce(regexp_full_match(c.pmid, '[0-9]+'), false))) > 0, false) as has_literature from cell_states) select *, n_markers >= 2 and has_pathway and has_literature as ok from x",
    "match_states": "with l as (select distinct name as label, lower(trim(name)) as key from marker_catalog where name is not null), k as (select lower(a) as key, min(row_id) as no from (select row_id, name as a from cell_states union all select row_id, unnest(aliases) from cell_states) where a is not null group by 1), ex as (select label, no from l join k using (key)), nm as (select lower(name) as nm, min(row_id) as no from cell_states where name <> '' group by 1), ins as (select label, min(no) as no from l join nm on contains(' ' || key || ' ', ' ' || nm || ' ') where label not in (select label from ex) group by 1) select label, no as state_no, 'exact' as how from ex union all select label, no, 'inside' from ins",
    "audit_rules": "with r(rule, severity, rx) as (values " + ", ".join(f"('{k}', '{s}', '{x.replace(chr(92) + 'n', chr(92) + 'n')}')" for k, (s, x) in RULES.items()) + ") select doc_id, rule, severity, regexp_extract(text, rx, 0) as found from documents, r where regexp_extract(text, rx, 0) <> ''",
    "audit_execution": f"{_OBS}, c as (select sample, count(*) as n from o group by 1), x as (select sample, case when n % 3 <> 0 then (n % 100) / 100.0 end as ilisi, case when n % 4 <> 0 then (n % 70) / 70.0 end as kbet, (n % 11) / 11.0 as r2, (n % 20) / 20.0 as mix, n % 50 as rem, (n % 17) / 100.0 as dr from c) select sample, case when ilisi < 0.8 then 'poor_mixing_ilisi' when kbet < 0.5 then 'poor_mixing_kbet' when ilisi is null and kbet is null and r2 > 0.5 then 'batch_variance' when mix >= 0.95 then 'cluster_of_one_batch' else 'ok' end as integration, rem > 30 as overfiltered, dr > 0.10 as many_doublets from x",
    "publication_score": f"{_OBS}, c as (select sample as run, count(*) as n from o group by 1), w(i, wt) as (values " + ", ".join(f"({i}, {w})" for i, w in enumerate(WEIGHTS.values())) + "), x as (select run, wt, case when (n + i) % 5 = 0 then 'missing' when (n + i) % 17 = 0 then 'fail' else 'pass' end as s from c, w) select run, sum(case when s = 'pass' then wt when s = 'missing' then wt // 2 else 0 end)::bigint as score, case when count(*) filter (s = 'fail') > 0 then 'FAIL' else 'PASS' end as verdict from x group by 1",
    "manifest_merge": "select user_id as step, event_type as phase, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "index_freshness": "with s as (select collection, max(ingested_at) as newest, count(*) as n_sources from documents where collection is not null group by 1), i as (select collection, max(ingested_at) as built from documents where chunk_index = 0 group by 1) select collection, newest, n_sources, built, coalesce(built >= newest, false) as fresh from s left join i using (collection)",
    "snapshot_fork": "with o as (select o_custkey::varchar as thread, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as step, o_orderstatus as phase, o_orderkey::varchar as matrix_path from orders) select * from o where thread = '7' union all select '7-branch', step, phase, matrix_path from o where thread = '7' and step <= 3",
    "cache_keys": "select p_partkey, substr(sha256(concat_ws('||', p_partkey::varchar, p_brand, p_type)), 1, 24) as key from part",
}

_KEY = "case {0} when 'CD8 T' then 'cd8' when 'CD8 T cells' then 'cd8' when 'CD8+ T' then 'cd8' when 'B cells' then 'b' when 'B cell' then 'b' when 'B lymphocyte' then 'b' when 'NK' then 'nk' when 'natural killer' then 'nk' when 'Monocytes' then 'mono' end"
SQL["label_fusion"] = f"""{_OBS}, l as (select case cluster when '1-URGENT' then 'CD8 T' when '2-HIGH' then 'B cells' when '3-MEDIUM' then 'unknown' else 'NK' end as m,
   case cell_type when 'BUILDING' then 'CD8 T cells' when 'MACHINERY' then 'B cell' when 'FURNITURE' then 'natural killer' else 'none' end as a,
   case batch when 'O' then 'CD8+ T' when 'F' then 'B lymphocyte' else 'Monocytes' end as g from o),
 k as (select m, a, g, {_KEY.format("m")} as km, {_KEY.format("a")} as ka, {_KEY.format("g")} as kg from l),
 z as (select *, case when km is null then 0 else 1 + (ka is not distinct from km)::int + (kg is not distinct from km)::int end as nm, case when ka is null then 0 else 1 + (km is not distinct from ka)::int + (kg is not distinct from ka)::int end as na, 1 + (km is not distinct from kg)::int + (ka is not distinct from kg)::int as ng from k),
 b as (select *, greatest(nm, na, ng) as n, (km is not null)::int + (ka is not null)::int + 1 as src, case when km is not null and nm = greatest(nm, na, ng) then km when ka is not null and na = greatest(nm, na, ng) then ka else kg end as best from z),
 w as (select *, case when km = best then m when ka = best then a else g end as winner from b)
 select m as marker_label, a as auto_label, g as deg_label, case when km is not null and n >= 2 and km = best then m when km is not null and n >= 2 then 'mixed' when km is not null then m when n >= 2 then winner || '|unvalidated' else 'low_conf' end as cell_type,
   case when km is not null and n >= 2 and km = best then 'fused' when km is not null and n >= 2 then 'conflict_mixed' when km is not null then 'marker_only' when n >= 2 then 'auto_consensus' else 'insufficient' end as annotation_status,
   n::int as annotation_n_agree, src::int as annotation_n_sources, count(*) as n from w group by all"""

QUERIES = {f.__name__: f for f in (
    knn_topk, ilisi, pca_batch_r2, silhouette_exact, lsh_knn, paga_edges, path_like, elongation, modularity_clusters, harmonized, resolution_choice, batch_dominance, doublet_tiers, doublet_agreement, doublet_rates,
    cluster_mode, selection_composition, selection_summary, value_histogram, trend_bins, nearest_rank_pct, label_fusion, ensemble_labels, catalog_flatten, marker_scores, best_types, dual_validation,
    deg_catalog_labels, ontology_ids, lineage_levels, evidence_claims, match_states, audit_rules, audit_execution, publication_score, manifest_merge, index_freshness, snapshot_fork, cache_keys, matrix_fingerprint, volcano_points,
)}

_SCRIPTS = "sc0 as (select doc_id, coalesce(text, '') || E'\\n' || array_to_string(list_filter([" + ", ".join("'" + x.replace("'", "''") + "'" for x in SCRIPT) + "], lambda l, i: (doc_id * (2 * (i - 1) + 3)) % 7 < 3), E'\\n') as text from documents), sc as (select doc_id, text, lower(text) as low, case when doc_id % 3 = 0 then 'brain' else 'pbmc' end as tissue, doc_id % 2 = 0 as has_model, doc_id % 4 as n_samples, doc_id % 5 < 2 as need_batch_correction, doc_id % 3 = 1 as force_pseudobulk, doc_id % 11 = 0 as confounded, doc_id % 6 = 0 as wants_trajectory from sc0)"
_CALLS = "with " + _SCRIPTS + ", r(rx) as (values " + ", ".join(f"('{p}')" for p in audits.BLOCKED) + ") select doc_id, regexp_extract(text, rx, 0) as found from sc, r where regexp_extract(text, rx, 0) <> ''"


def _audit_sql(phase: str) -> str:
    one = lambda w: w.replace("regexp_like(", "regexp_matches(").replace("\\\\", "\\")
    return f"with {_SCRIPTS} " + " union all ".join(f"select doc_id, '{r}' as rule, '{sev}' as severity from sc where {one(w)}" for r, own, sev, w in audits.RULES if own in ("", phase))


SQL |= {"policy_violations": _CALLS, "audit_code_qc": _audit_sql("qc"), "audit_code_downstream": _audit_sql("downstream")}
QUERIES |= {f.__name__: f for f in (policy_violations, audit_code_qc, audit_code_downstream)}
SQL["matrix_fingerprint"] = f"{_OBS} select count(distinct cell_id) as n_cells, count(distinct gene_id) as n_genes, count(*) as n_entries, bit_xor(('0x' || substr(md5(cell_id || '|' || gene_id || '|' || value::double), 1, 15))::bigint) as digest from m"
