"""Queries over the matrix that the order tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import cells, stats
from tessera.plans import views
from tessera.session import materialize, table

R = 4  # digits to which results are rounded on both sides
N_HVG = 2000
CYCLE = ["MT-G1", "MT-G2", "RPL5", "RPL8", "HBA9", "HBA10", "G11", "G12"]


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), R) + F.lit(0.0) for c in cols})


def _qc(s: SparkSession, d: str) -> DataFrame:
    return cells.qc_metrics(views.matrix(s, d), views.obs(s, d), views.var(s, d))


def qc_metrics(s, d):
    return rounded(_qc(s, d).select("cell_id", "total_counts", "n_genes_by_counts", "total_counts_mt", "pct_counts_mt", "log1p_total_counts", "log1p_n_genes_by_counts"), "pct_counts_mt", "log1p_total_counts", "log1p_n_genes_by_counts")


def qc_gene_metrics(s, d):
    n = views.obs(s, d).count()
    return rounded(cells.gene_metrics(views.matrix(s, d), n), "mean_counts", "pct_dropout")


def _flagged(df: DataFrame) -> DataFrame:
    return df.where("outlier").select("cell_id", "sample")


def qc_mad_outliers(s, d):
    return _flagged(cells.outliers(_qc(s, d), "mad", nmads=3))


def qc_mad_scaled_outliers(s, d):
    return _flagged(cells.outliers(_qc(s, d), "mad", nmads=2, mad_scale=1.4826))


def qc_percentile_outliers(s, d):
    return _flagged(cells.outliers(_qc(s, d), "percentile"))


def qc_hybrid_outliers(s, d):
    return _flagged(cells.outliers(_qc(s, d), "hybrid", nmads=3))


def qc_hard_caps(s, d):
    return _flagged(cells.outliers(_qc(s, d), "none", hard={"pct_mt": 60, "n_genes_min": 1, "n_genes_max": 6}))


def qc_removed(s, d):
    """Per sample how many cells the filter takes, and whether that is too many."""
    flagged = cells.outliers(_qc(s, d), "mad", nmads=3)
    per = flagged.groupBy("sample").agg(F.count("*").alias("n_cells"), F.sum(F.col("outlier").cast("bigint")).alias("n_removed"))
    return per.select("*", F.round(100 * F.col("n_removed") / F.col("n_cells"), R).alias("pct_removed"), (100 * F.col("n_removed") / F.col("n_cells") > 30).alias("overfiltered"))


def gene_composition(s, d):
    return cells.gene_composition(views.var(s, d), CYCLE)


def species_vote(s, d):
    return cells.species_vote(views.var(s, d))


def gene_flags(s, d):
    return cells.gene_flags(views.var(s, d)).select("gene_id", "gene_name", "is_mt", "is_ribo", "is_hb")


def filter_genes_min_cells(s, d):
    m = cells.genes_in_cells(views.matrix(s, d), 25)
    return m.groupBy("gene_id").agg(F.count("*").alias("n_cells"))


def sanitize_bounds(s, d):
    m = cells.in_bounds(views.matrix(s, d), views.var(s, d).where("p_size <= 25"))
    return m.agg(F.count("*").alias("n_entries"), F.sum("value").alias("total"))


def _parts(s, d):
    li = table(s, d, "lineitem")
    return {k: cells.sparse(li.where(F.col("l_returnflag") == k).select(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), F.col("l_quantity").alias("value"))) for k in ("A", "N", "R")}


def concat_inner(s, d):
    return cells.concat_samples(_parts(s, d)).groupBy("sample").agg(F.countDistinct("cell_id").alias("n_cells"), F.countDistinct("gene_id").alias("n_genes"), F.sum("value").alias("total"))


def concat_outer(s, d):
    return cells.concat_samples(_parts(s, d), "outer").select("sample", "cell_id", "gene_id", "value")


def layer_detect(s, d):
    return rounded(cells.detect_layer(views.matrix(s, d), views.var(s, d).count()), "sparsity", "integer_like")


def _logged(s, d):
    return cells.normalize_log1p(views.matrix(s, d))


def normalize_cp10k_log1p(s, d):
    return rounded(_logged(s, d), "value")


def ambient_subtract(s, d):
    return rounded(cells.remove_ambient(views.matrix(s, d), views.obs(s, d), allow_heuristic=True), "value")


def ambient_global(s, d):
    return rounded(cells.remove_ambient(views.matrix(s, d), views.obs(s, d), "decontx_heuristic", allow_heuristic=True), "value")


def hvg_dispersion(s, d):
    n = views.obs(s, d).count()
    return rounded(cells.hvg_dispersion(_logged(s, d), n, n_top=200), "mean", "dispersion", "dispersion_norm").drop("highly_variable")


def _selected(s, d):
    """The highly variable genes, as many as the pipeline takes, written once as a table."""
    hv = cells.hvg_dispersion(_logged(s, d), views.obs(s, d).count(), n_top=N_HVG)
    return materialize(hv.where("highly_variable").select("gene_id"), "genes")


def pearson_residuals(s, d):
    return rounded(cells.pearson_summary(views.matrix(s, d), _selected(s, d), views.obs(s, d)), "mean", "top")


def scale_clip(s, d):
    return rounded(cells.scale_summary(_logged(s, d), views.obs(s, d), _selected(s, d)), "top", "low")


def cell_cycle(s, d):
    obs, v = views.obs(s, d), views.var(s, d)
    n, g = obs.count(), v.count()
    lg = _logged(s, d)
    a = cells.set_score(lg, obs, v.where("p_size <= 2"), n, g, "s_score")
    b = cells.set_score(lg, obs, v.where("p_size between 3 and 4"), n, g, "g2m_score")
    return rounded(a.join(b, "cell_id").withColumn("phase", cells.cycle_phase(F.col("s_score"), F.col("g2m_score"))), "s_score", "g2m_score")


def cycle_regressed(s, d):
    q = _qc(s, d).select("cell_id", F.col("log1p_total_counts").alias("x1"), F.col("pct_counts_mt").alias("x2"))
    r = cells.regress_out(_logged(s, d), q, "x1", "x2")
    return rounded(r.groupBy("gene_id").agg(F.sum("value").alias("total")), "total")


def pseudobulk_counts(s, d):
    return stats.pseudobulk(views.matrix(s, d), views.obs(s, d))


def pseudobulk_groups(s, d):
    return stats.group_sizes(views.obs(s, d), 60)


def replicates_by_condition(s, d):
    return stats.replicates(views.obs(s, d))


def confounding_check(s, d):
    return stats.confounding(views.obs(s, d))


def _two(s, d):
    """Every cell, its region as one of two conditions, since the tests compare two."""
    return views.obs(s, d).withColumn("condition", F.when(F.col("condition") <= "ASIA", "ASIA").otherwise("EUROPE"))


def pseudobulk_welch(s, d):
    w = stats.pseudobulk_welch(views.matrix(s, d), _two(s, d))
    return rounded(w.select("cell_type", "gene_id", "logFC", "t", "df", "group_a", "group_b"), "logFC", "t", "df")


def pseudobulk_de(s, d):
    return rounded(stats.pseudobulk_de(views.matrix(s, d), _two(s, d)).select("cell_type", "gene_id", "logFC", "pval", "fdr", "group_a", "group_b"), "logFC", "pval", "fdr")


def bh_fdr(s, d):
    p = table(s, d, "customer").select("c_custkey", "c_mktsegment", (F.pmod(F.col("c_custkey") * 7919, F.lit(1000)) / 1000.0).alias("pval"))
    return rounded(stats.bh_fdr(p, ["c_mktsegment"]), "fdr")


def sig_overlap_jaccard(s, d):
    p = table(s, d, "part")
    return stats.jaccard(p.where("p_size <= 20").select(F.col("p_brand").alias("gene_id")), p.where("p_size >= 15 and p_brand < 'Brand#4'").select(F.col("p_brand").alias("gene_id"))).select("n_a", "n_b", "n_overlap", "jaccard", F.array_join("shared", ",").alias("shared"))


def rank_genes_ttest(s, d):
    r = stats.rank_genes_ttest(_logged(s, d), views.obs(s, d))
    return rounded(r.select("cluster", "gene_id", "mean_in", "mean_rest", "t", "df"), "mean_in", "mean_rest", "t", "df")


def rank_genes_wilcoxon(s, d):
    r = stats.rank_genes_wilcoxon(views.matrix(s, d), views.obs(s, d))
    return rounded(r.select("cluster", "gene_id", "rank_sum", "z"), "rank_sum", "z")


def top_markers_per_cluster(s, d):
    r = stats.bh_fdr(stats.rank_genes_ttest(_logged(s, d), views.obs(s, d)), ["cluster"])
    return rounded(stats.top_markers(r, fdr=1.0).select("cluster", "gene_id", "rank", "t"), "t")


def marker_interpretability(s, d):
    obs, lg = views.obs(s, d), _logged(s, d)
    sizes = obs.groupBy("cluster").agg(F.count("*").alias("n"))
    hv = lg.groupBy("gene_id").agg(F.sum(F.col("value") * F.col("value")).alias("q")).orderBy(F.desc(F.round("q", 6)), "gene_id").limit(200).select("gene_id")
    means = lg.join(hv, "gene_id", "left_semi").join(obs.select("cell_id", "cluster"), "cell_id").groupBy("cluster", "gene_id").agg(F.sum("value").alias("s"))
    grid = sizes.crossJoin(F.broadcast(hv)).join(means, ["cluster", "gene_id"], "left")  # clusters times at most 200 genes
    sd = grid.groupBy("gene_id").agg(F.stddev_pop(F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("sd"))
    return rounded(sd.orderBy(F.desc("sd")).limit(20).agg(F.avg("sd").alias("score")), "score")


def ora_hypergeom(s, d):
    v = views.var(s, d)
    query = v.where("p_size <= 12 and term < 'Brand#3'").select(F.col("gene_name").alias("gene"))
    out = stats.ora(query, v.select("term", F.col("gene_name").alias("gene")))
    return rounded(out.select("term", "overlap", "set_size", "query_size", "n_background", "pval", "fdr"), "pval", "fdr")


_FLAG = lambda body: f"with {views.QC}, {body}"
_MAD = """k as (select sample, median(pct_counts_mt) as a1, mad(pct_counts_mt) * {s} as b1, median(log1p_total_counts) as a2, mad(log1p_total_counts) * {s} as b2, median(log1p_n_genes_by_counts) as a3, mad(log1p_n_genes_by_counts) * {s} as b3 from q group by 1)"""
_MADC = """(b1 > 0 and pct_counts_mt > a1 + {n} * b1 or b2 > 0 and abs(log1p_total_counts - a2) > {n} * b2 or b3 > 0 and abs(log1p_n_genes_by_counts - a3) > {n} * b3)"""
_PCT = """p as (select sample, quantile_cont(n_genes_by_counts, 0.02) as g1, quantile_cont(n_genes_by_counts, 0.98) as g2, quantile_cont(total_counts, 0.02) as c1, quantile_cont(total_counts, 0.98) as c2, quantile_cont(pct_counts_mt, 0.98) as m2 from q group by 1)"""
_PCTC = "(n_genes_by_counts < g1 or n_genes_by_counts > g2 or total_counts < c1 or total_counts > c2 or pct_counts_mt > m2)"
_LG = f"with {views.SQL}, lg as (select cell_id, gene_id, ln(1 + value * 1e4 / sum(value) over (partition by cell_id)) as value from m)"
_WELCH = """two as (select * replace (case when condition <= 'ASIA' then 'ASIA' else 'EUROPE' end as condition) from o),
 gs as (select sample, condition, cell_type from two group by all having count(*) >= 10),
 ct as (select cell_type from (select cell_type, condition, count(distinct sample) as n from gs group by all) group by 1 having count(*) = 2 and min(n) >= 2),
 kg as (select * from gs where cell_type in (select cell_type from ct)),
 pb as (select sample, condition, cell_type, gene_id, sum(value) as c from m join two using (cell_id) join kg using (sample, condition, cell_type) group by all),
 lx as (select *, ln(1 + c * 1e6 / sum(c) over (partition by sample, condition, cell_type)) as x from pb),
 nn as (select cell_type, sum(case when condition = 'ASIA' then 1 else 0 end) as na, sum(case when condition = 'EUROPE' then 1 else 0 end) as nb from kg group by 1),
 sm as (select cell_type, gene_id, sum(case when condition = 'ASIA' then x else 0 end) as sa, sum(case when condition = 'ASIA' then x * x else 0 end) as qa, sum(case when condition = 'EUROPE' then x else 0 end) as sb, sum(case when condition = 'EUROPE' then x * x else 0 end) as qb from lx group by all),
 mm as (select *, sa / na as ma, sb / nb as mb, greatest(0, qa - na * (sa / na) * (sa / na)) / (na - 1) / na as ea, greatest(0, qb - nb * (sb / nb) * (sb / nb)) / (nb - 1) / nb as eb from sm join nn using (cell_type))"""

# The genes of the largest normalised dispersion, N_HVG of them, as the operators take them.
_HV = f"""{_LG}, n as (select count(*) as n from o), hs as (select gene_id, sum(exp(value) - 1) as s, sum((exp(value) - 1) * (exp(value) - 1)) as q from lg group by 1),
 hv as (select gene_id, s / n as mu, (q - n * (s / n) * (s / n)) / (n - 1) as va from hs, n), he as (select gene_id, ln(1 + mu) as mean, case when va > 0 then ln(va / mu) end as dispersion from hv),
 hb as (select *, least(19, floor((mean - min(mean) over ()) / ((max(mean) over () - min(mean) over ()) / 20)))::int as bin from he), ht as (select bin, avg(dispersion) as m0, stddev_samp(dispersion) as sd0 from hb group by 1),
 sel as (select gene_id from hb join ht using (bin) order by round(case when sd0 > 0 then (dispersion - m0) / sd0 when dispersion is not null then 1.0 end, 9) desc nulls last, gene_id limit {N_HVG})"""

SQL = {
    "qc_metrics": f"with {views.QC} select cell_id, total_counts::double as total_counts, n_genes_by_counts, total_counts_mt::double as total_counts_mt, round(pct_counts_mt, 4)::double as pct_counts_mt, round(log1p_total_counts, 4) as log1p_total_counts, round(log1p_n_genes_by_counts, 4) as log1p_n_genes_by_counts from q",
    "qc_gene_metrics": f"with {views.SQL} select gene_id, count(*) as n_cells_by_counts, sum(value) as total_counts, round(sum(value) / (select count(*) from o), 4) as mean_counts, round(100 - 100.0 * count(*) / (select count(*) from o), 4) as pct_dropout from m group by 1",
    "qc_mad_outliers": _FLAG(f"{_MAD.format(s=1)} select cell_id, q.sample from q join k using (sample) where {_MADC.format(n=3)}"),
    "qc_mad_scaled_outliers": _FLAG(f"{_MAD.format(s=1.4826)} select cell_id, q.sample from q join k using (sample) where {_MADC.format(n=2)}"),
    "qc_percentile_outliers": _FLAG(f"{_PCT} select cell_id, q.sample from q join p using (sample) where {_PCTC}"),
    "qc_hybrid_outliers": _FLAG(f"{_MAD.format(s=1)}, {_PCT} select cell_id, q.sample from q join k using (sample) join p using (sample) where {_MADC.format(n=3)} or {_PCTC}"),
    "qc_hard_caps": f"with {views.QC} select cell_id, sample from q where pct_counts_mt > 60 or n_genes_by_counts < 1 or n_genes_by_counts > 6",
    "qc_removed": _FLAG(f"{_MAD.format(s=1)}, f as (select q.sample, {_MADC.format(n=3)} as outlier from q join k using (sample)) select sample, count(*) as n_cells, count(*) filter (outlier) as n_removed, round(100.0 * count(*) filter (outlier) / count(*), 4) as pct_removed, 100.0 * count(*) filter (outlier) / count(*) > 30 as overfiltered from f group by 1"),
    "gene_composition": f"with {views.SQL}, c as (select count(*) as n_genes, count(*) filter (gene_name ~ '^(MT|mt|Mt|mT)[-.].*') as n_mt, count(*) filter (regexp_matches(upper(gene_name), '^RP[SL]')) as n_ribo, count(*) filter (upper(gene_name) like 'HB%' and upper(gene_name) not like 'HBP%') as n_hb, count(*) filter (upper(gene_name) in ({', '.join(repr(x) for x in CYCLE)})) as n_cycle from v) select *, n_hb >= 3 as has_hb, n_cycle >= 2 as has_cycle, round(n_mt / n_genes, 4) as mt_fraction from c",
    "species_vote": f"with {views.SQL}, c as (select count(*) filter (gene_name like 'MT-%') as human, count(*) filter (gene_name like 'mt-%') as mouse from v) select *, case when human > mouse then 'human' when mouse > human then 'mouse' else 'unknown' end as species from c",
    "gene_flags": f"with {views.SQL} select gene_id, gene_name, gene_name like 'MT-%' as is_mt, regexp_matches(upper(gene_name), '^RP[SL]') as is_ribo, regexp_matches(gene_name, '(?i)^HB[^(P)]') as is_hb from v",
    "filter_genes_min_cells": f"with {views.SQL} select gene_id, count(*) as n_cells from m group by 1 having count(*) >= 25",
    "sanitize_bounds": f"with {views.SQL} select count(*) as n_entries, sum(value) as total from m where gene_id in (select gene_id from v where p_size <= 25)",
    "concat_inner": "with p as (select l_returnflag as sample, l_orderkey as c, l_partkey as g, sum(l_quantity) as value from lineitem where l_returnflag in ('A', 'N', 'R') group by all), i as (select g from p group by 1 having count(distinct sample) = 3) select sample, count(distinct c) as n_cells, count(distinct g) as n_genes, sum(value) as total from p where g in (select g from i) group by 1",
    "concat_outer": "select l_returnflag as sample, l_returnflag || '_' || l_orderkey as cell_id, l_partkey as gene_id, sum(l_quantity) as value from lineitem where l_returnflag in ('A', 'N', 'R') group by all",
    "layer_detect": f"with {views.SQL}, f as (select distinct cell_id from m order by 1 limit 256), x as (select * from m where cell_id in (select cell_id from f)), a as (select count(distinct cell_id) as n_cells, count(*) as nnz, max(value) as x_max, avg(case when abs(value - round(value)) <= 1e-6 then 1.0 else 0.0 end) as w from x) select n_cells, 0.0::double as x_min, x_max, round(1 - nnz / (n_cells * (select count(*) from v)), 4) as sparsity, round(w, 4) as integer_like, 'counts' as layer from a",
    "normalize_cp10k_log1p": f"{_LG} select cell_id, gene_id, round(value, 4) as value from lg",
    "ambient_subtract": f"with {views.SQL}, u as (select o.cell_id, coalesce(sum(value), 0) as umi from o left join m using (cell_id) group by 1), low as (select cell_id from u order by umi, cell_id limit (select greatest(10, floor(0.02 * count(*)))::bigint from u)), g as (select gene_id, sum(value) as a from m where cell_id in (select cell_id from low) group by 1), pr as (select gene_id, a / (select sum(a) from g) as p from g), r as (select least(0.25, greatest(0.02, 0.05 + 0.15 * (1 - quantile_cont(umi, 0.1) / quantile_cont(umi, 0.9)))) as rho from u), x as (select cell_id, gene_id, greatest(0, value - rho * umi * coalesce(p, 0)) as value from m join u using (cell_id) left join pr using (gene_id), r) select cell_id, gene_id, round(value, 4)::double as value from x where value > 0",
    "ambient_global": f"with {views.SQL}, u as (select cell_id, sum(value) as umi from m group by 1), g as (select gene_id, sum(value) as a from m group by 1), pr as (select gene_id, a / (select sum(a) from g) as p from g), x as (select cell_id, gene_id, greatest(0, value - 0.1 * umi * p) as value from m join u using (cell_id) join pr using (gene_id)) select cell_id, gene_id, round(value, 4)::double as value from x where value > 0",
    "hvg_dispersion": f"{_LG}, n as (select count(*) as n from o), s as (select gene_id, sum(exp(value) - 1) as s, sum((exp(value) - 1) * (exp(value) - 1)) as q from lg group by 1), mv as (select gene_id, s / n as mu, (q - n * (s / n) * (s / n)) / (n - 1) as va from s, n), e as (select gene_id, ln(1 + mu) as mean, case when va > 0 then ln(va / mu) end as dispersion from mv), b as (select *, least(19, floor((mean - min(mean) over ()) / ((max(mean) over () - min(mean) over ()) / 20)))::int as bin from e), t as (select bin, avg(dispersion) as m, stddev_samp(dispersion) as sd from b group by 1) select gene_id, round(mean, 4) as mean, round(dispersion, 4) as dispersion, round(case when sd > 0 then (dispersion - m) / sd when dispersion is not null then 1.0 end, 4) as dispersion_norm from b join t using (bin)",
    "pearson_residuals": f"{_HV}, mm as (select * from m where gene_id in (select gene_id from sel)), nc as (select cell_id, sum(value) as nc from mm group by 1), ng as (select gene_id, sum(value) as ng from mm group by 1), t as (select sum(value) as t, (select count(*) from o) as nn from mm), gr as (select o.cell_id, ng.gene_id, coalesce(nc, 0) * ng / t as mu, nn from o left join nc using (cell_id), ng, t), z as (select gr.gene_id, case when mu > 0 then (coalesce(value, 0) - mu) / sqrt(mu + mu * mu / 100) else 0 end as z, nn from gr left join mm on mm.cell_id = gr.cell_id and mm.gene_id = gr.gene_id) select gene_id, round(avg(greatest(-sqrt(nn), least(sqrt(nn), z))), 4) + 0.0 as mean, round(max(greatest(-sqrt(nn), least(sqrt(nn), z))), 4) + 0.0 as top from z group by 1",
    "scale_clip": f"{_HV}, st as (select gene_id, sum(value) as s, sum(value * value) as q, count(*) as k, max(value) as hi, min(value) as lo from lg where gene_id in (select gene_id from sel) group by 1), z as (select gene_id, n, s / n as mu, sqrt((q - s * s / n) / (n - 1)) as sd, hi, case when k < n then 0 else lo end as lo from st, n) select gene_id, n, round(least(10, (hi - mu) / sd), 4) as top, round(greatest(-10, (lo - mu) / sd), 4) as low from z",
    "cycle_regressed": f"with {views.QC}, lg as (select cell_id, gene_id, ln(1 + value * 1e4 / sum(value) over (partition by cell_id)) as value from m), cov as (select cell_id, log1p_total_counts as x1, pct_counts_mt as x2 from q), g as (select gene_id, sum(value) as y, sum(value * x1) as y1, sum(value * x2) as y2, count(*) as k, sum(x1) as k1, sum(x2) as k2 from lg join cov using (cell_id) group by 1), a as (select count(*) as n, sum(x1) as s1, sum(x2) as s2, sum(x1 * x1) as s11, sum(x2 * x2) as s22, sum(x1 * x2) as s12 from cov), c as (select g.*, n, s1, s2, s11 - s1 * s1 / n as c11, s22 - s2 * s2 / n as c22, s12 - s1 * s2 / n as c12, y1 - y * s1 / n as cy1, y2 - y * s2 / n as cy2 from g, a), b as (select *, (cy1 * c22 - cy2 * c12) / (c11 * c22 - c12 * c12) as b1, (cy2 * c11 - cy1 * c12) / (c11 * c22 - c12 * c12) as b2 from c) select gene_id, round(y - k * (y / n) - b1 * (k1 - k * s1 / n) - b2 * (k2 - k * s2 / n), 4) as total from b",
    "pseudobulk_counts": f"with {views.SQL} select sample, condition, cell_type, gene_id, sum(value) as count from m join o using (cell_id) group by all",
    "pseudobulk_groups": f"with {views.SQL} select sample, condition, cell_type, count(*) as n_cells, count(*) >= 60 as kept from o group by all",
    "replicates_by_condition": f"with {views.SQL}, p as (select condition, count(distinct sample) as n_samples from o group by 1) select condition, n_samples, min(n_samples) over () as n_replicates from p",
    "confounding_check": f"with {views.SQL}, p as (select count(distinct sample) as n_batches, count(distinct condition) as n_conditions, count(distinct (sample, condition)) as n_pairs from o) select *, n_batches > 1 and n_batches = n_conditions and n_pairs = n_batches as confounded from p",
    "pseudobulk_welch": f"with {views.SQL}, {_WELCH} select cell_type, gene_id, round(mb - ma, 4) + 0.0 as logFC, round(case when ea + eb > 1e-18 then (mb - ma) / sqrt(ea + eb) end, 4) + 0.0 as t, round(case when ea + eb > 1e-18 then (ea + eb) * (ea + eb) / (ea * ea / (na - 1) + eb * eb / (nb - 1)) end, 4) as df, 'ASIA' as group_a, 'EUROPE' as group_b from mm",
    "bh_fdr": "with p as (select c_custkey, c_mktsegment, ((c_custkey * 7919) % 1000) / 1000.0 as pval from customer), r as (select *, count(*) over (partition by c_mktsegment) as m, row_number() over (partition by c_mktsegment order by pval, c_custkey) as rn from p) select c_custkey, c_mktsegment, pval::double as pval, round(least(1.0, min(pval * m / rn) over (partition by c_mktsegment order by rn desc rows between unbounded preceding and current row)), 4)::double as fdr from r",
    "sig_overlap_jaccard": "with a as (select distinct p_brand as g from part where p_size <= 20), b as (select distinct p_brand as g from part where p_size >= 15 and p_brand < 'Brand#4'), i as (select g from a intersect select g from b), c as (select (select count(*) from a) as n_a, (select count(*) from b) as n_b, (select count(*) from i) as n_overlap) select n_a, n_b, n_overlap, round(n_overlap / (n_a + n_b - n_overlap), 4) as jaccard, coalesce((select string_agg(g, ',' order by g) from i), '') as shared from c",
    "rank_genes_ttest": f"{_LG}, n as (select count(*) as n from o), c as (select cluster, count(*) as n1 from o group by 1), s as (select cluster, gene_id, sum(value) as s, sum(value * value) as q from lg join o using (cell_id) group by all), t as (select gene_id, sum(s) as ts, sum(q) as tq from s group by 1), x as (select c.cluster, t.gene_id, n1, n - n1 as n2, coalesce(s, 0) as s, coalesce(q, 0) as q, ts, tq from t cross join c cross join n left join s on s.gene_id = t.gene_id and s.cluster = c.cluster), y as (select *, s / n1 as m1, (ts - s) / n2 as m2, (q - n1 * (s / n1) * (s / n1)) / (n1 - 1) / n1 as v1, (tq - q - n2 * ((ts - s) / n2) * ((ts - s) / n2)) / (n2 - 1) / n2 as v2 from x) select cluster, gene_id, round(m1, 4) as mean_in, round(m2, 4) as mean_rest, round(case when v1 + v2 > 1e-18 then (m1 - m2) / sqrt(v1 + v2) end, 4) + 0.0 as t, round(case when v1 + v2 > 1e-18 then (v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)) end, 4) as df from y",
    "rank_genes_wilcoxon": f"with {views.SQL}, n as (select count(*) as n from o), c as (select cluster, count(*) as n1 from o group by 1), k as (select gene_id, count(*) as nnz from m group by 1), r as (select m.gene_id, cluster, n - nnz + rank() over (partition by m.gene_id order by value) - 1 + (count(*) over (partition by m.gene_id, value) + 1) / 2 as r from m join o using (cell_id) join k using (gene_id), n), s as (select gene_id, cluster, sum(r) as rs, count(*) as k from r group by all), t as (select gene_id, sum(c * c * c - c) as ties from (select gene_id, value, count(*)::double as c from m group by all) group by 1), x as (select c.cluster, k.gene_id, coalesce(rs, 0) + (n1 - coalesce(s.k, 0)) * ((n - nnz + 1) / 2) as w, n1::double as n1, n::double as n, ties + (n - nnz)::double * (n - nnz) * (n - nnz) - (n - nnz) as ties from k cross join c cross join n join t using (gene_id) left join s on s.gene_id = k.gene_id and s.cluster = c.cluster), z as (select *, sqrt(n1 * (n - n1) / 12 * ((n + 1) - ties / (n * (n - 1)))) as sd from x) select cluster, gene_id, round(w, 4)::double as rank_sum, round(case when sd > 0 then (w - n1 * (n + 1) / 2) / sd else 0 end, 4) + 0.0 as z from z",
    "marker_interpretability": f"{_LG}, hv as (select gene_id from lg group by 1 order by round(sum(value * value), 6) desc, gene_id limit 200), c as (select cluster, count(*) as n from o group by 1), s as (select cluster, gene_id, sum(value) as s from lg join o using (cell_id) group by all), x as (select hv.gene_id, stddev_pop(coalesce(s, 0) / n) as sd from hv cross join c left join s on s.gene_id = hv.gene_id and s.cluster = c.cluster group by 1) select round(avg(sd), 4) as score from (select sd from x order by sd desc limit 20)",
    "ora_hypergeom": f"with {views.SQL}, qs as (select distinct upper(gene_name) as g from v where p_size <= 12 and term < 'Brand#3'), ss as (select distinct term, upper(gene_name) as g from v), bg as (select g from qs union select g from ss), k as (select (select count(*) from qs) as n, (select count(*) from bg) as nb), h as (select term, count(*) as set_size, count(*) filter (g in (select g from qs)) as overlap from ss group by 1), e as (select term, overlap, set_size, n, nb, unnest(range(overlap, least(set_size, n) + 1)) as i from h, k where overlap >= 2), p as (select term, overlap, set_size, n, nb, least(1.0, sum(exp(lgamma(set_size + 1) - lgamma(i + 1) - lgamma(set_size - i + 1) + lgamma(nb - set_size + 1) - lgamma(n - i + 1) - lgamma(nb - set_size - n + i + 1) - lgamma(nb + 1) + lgamma(n + 1) + lgamma(nb - n + 1)))) as pval from e where n - i <= nb - set_size group by all), r as (select *, row_number() over (order by pval, term) as rn, count(*) over () as m from p) select term, overlap, set_size, n as query_size, nb as n_background, round(pval, 4) as pval, round(least(1.0, min(pval * m / rn) over (order by rn desc rows between unbounded preceding and current row)), 4) as fdr from r",
}

_T = SQL["rank_genes_ttest"].replace("round(case when v1 + v2 > 1e-18 then (m1 - m2) / sqrt(v1 + v2) end, 4) + 0.0 as t", "case when v1 + v2 > 1e-18 then (m1 - m2) / sqrt(v1 + v2) end as t")
SQL["top_markers_per_cluster"] = f"select cluster, gene_id, rank::int as rank, round(t, 4) + 0.0 as t from (select *, row_number() over (partition by cluster order by round(t, 9) desc nulls last, gene_id) as rank from ({_T})) where rank <= 25"

QUERIES = {f.__name__: f for f in (
    qc_metrics, qc_gene_metrics, qc_mad_outliers, qc_mad_scaled_outliers, qc_percentile_outliers, qc_hybrid_outliers, qc_hard_caps, qc_removed, gene_composition, species_vote, gene_flags, filter_genes_min_cells,
    sanitize_bounds, concat_inner, concat_outer, layer_detect, normalize_cp10k_log1p, ambient_subtract, ambient_global, hvg_dispersion, pearson_residuals, scale_clip, cell_cycle, cycle_regressed,
    pseudobulk_counts, pseudobulk_groups, replicates_by_condition, confounding_check, pseudobulk_welch, pseudobulk_de, bh_fdr, sig_overlap_jaccard, rank_genes_ttest, rank_genes_wilcoxon,
    top_markers_per_cluster, marker_interpretability, ora_hypergeom,
)}
