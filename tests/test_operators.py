import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.special import t_two_sided
from tessera.operators import cells, graph, labels, retrieval, stats
from tessera.plans import dag


def one(df):
    return df.first().asDict()


def test_doublets(spark):
    df = spark.createDataFrame([(True, True, 0.85), (True, False, 0.3), (False, True, 0.5), (True, True, 0.75), (False, False, 0.1)], "a boolean, b boolean, s double")
    assert [r.tier for r in cells.doublet_tiers(df, "a", "b", "s").collect()] == ["high_conf", "low_conf", "low_conf", "low_conf", "singlet"]
    single = spark.createDataFrame([(True, 0.9), (True, 0.5), (False, 0.1)], "a boolean, s double")
    assert [r.tier for r in cells.doublet_tiers(single, "a", first_score="s").collect()] == ["high_conf", "low_conf", "singlet"]
    ab = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "a boolean, b boolean")
    assert one(cells.doublet_agreement(ab, "a", "b")) == {"n_both": 1, "n_discordant": 2, "agreement": 0.5}
    assert one(cells.doublet_agreement(ab.limit(0), "a", "b"))["agreement"] == 1.0
    r = one(spark.range(1).select(cells.doublet_rate(F.lit(1000)).alias("a"), cells.doublet_rate(F.lit(20000)).alias("b")))
    assert r == {"a": 0.008, "b": 0.10}


def test_labels_agree(spark):
    pairs = [("CD8 T", "CD8 T cells", True), ("B cell", "NK", False), ("unknown", "B cell", False), ("T cell", "CD8 T", False), ("Fibroblasts", "fibroblast", True), (None, "x", False)]
    df = spark.createDataFrame(pairs, "a string, b string, w boolean")
    assert all(r.w == r.got for r in df.withColumn("got", labels.labels_agree(F.col("a"), F.col("b"))).collect())


def test_fusion(spark):
    rows = [("CD8 T", "CD8 T cells", "unknown"), ("B cell", "NK", "NK cells"), (None, "NK", "nk cell"), ("T cell", "", None), (None, "B cell", "NK"), (None, None, "na")]
    got = labels.fuse(spark.createDataFrame(rows, "m string, a string, d string"), ["m", "a", "d"], "m").select("cell_type", "annotation_status", "annotation_n_agree").collect()
    assert [tuple(r) for r in got] == [("CD8 T", "fused", 2), ("mixed", "conflict_mixed", 2), ("NK|unvalidated", "auto_consensus", 2), ("T cell", "marker_only", 1), ("low_conf", "insufficient", 1), ("unknown", "insufficient", 0)]


def test_claims(spark):
    rows = [(["PDCD1"], None, None, []), (["PDCD1", "havcr2", "HAVCR2"], "GX:1", 1e-4, [(None, "123")]), (["A", "B"], "x", 0.1, [("10.1038/nri3156).", None)]), (None, "x", 0.1, None)]
    df = spark.createDataFrame(rows, "markers array<string>, pathway_id string, pval double, citations array<struct<doi: string, pmid: string>>")
    assert [(r.n_markers, r.ok) for r in labels.validate_claims(df).collect()] == [(1, False), (2, True), (2, True), (0, False)]
    assert one(spark.range(1).select(labels.doi(F.lit("see 10.1038/nri3156).")).alias("d")))["d"] == "10.1038/nri3156"


def test_mad_of_zero_flags_none(spark):
    qc = spark.createDataFrame([(i, "s", 10.0 if i else 99.0, 1.0, 1.0, 1, 1.0) for i in range(9)], "cell_id bigint, sample string, pct_counts_mt double, log1p_total_counts double, log1p_n_genes_by_counts double, n_genes_by_counts bigint, total_counts double")
    assert cells.outliers(qc, "mad").where("outlier").count() == 0
    assert cells.outliers(qc, "percentile", by=None).where("outlier").count() == 1


def test_layers(spark):
    f = lambda v: cells.detect_layer(spark.createDataFrame([(i, i, x) for i, x in enumerate(v)], "cell_id bigint, gene_id bigint, value double"), 50).first().layer
    assert f([80.0, 3.0]) == "counts" and f([1.5, 0.2, 2.2]) == "log1p" and f([-1.0, 2.0]) == "scaled"
    m = spark.createDataFrame([(1, 1, 1.0)], "cell_id bigint, gene_id bigint, value double")
    with pytest.raises(ValueError):
        cells.normalize_log1p(m, layer="scaled")
    assert cells.normalize_log1p(m, layer="log1p") is m


def test_ambient_needs_leave(spark):
    m = spark.createDataFrame([(i, g, 5.0) for i in range(20) for g in range(3)], "cell_id bigint, gene_id bigint, value double")
    c = m.select("cell_id").distinct()
    assert cells.remove_ambient(m, c) is m
    assert cells.remove_ambient(m, c, allow_heuristic=True).where("value < 5").count() == 60


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.5, None, float("nan"), 0.04]
    df = spark.createDataFrame([(i, "g", x) for i, x in enumerate(p)], "id int, g string, pval double")
    got = {r.id: r.fdr for r in stats.bh_fdr(df, ["g"]).collect()}
    v = sorted((1.0 if x is None or x != x else x, i) for i, x in enumerate(p))
    want, acc = {}, 1.0
    for rank in range(len(v), 0, -1):
        acc = min(acc, v[rank - 1][0] * len(v) / rank)
        want[v[rank - 1][1]] = acc
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_t_tail():
    # Textbook values: t(0.975; 10) = 2.228139, t(0.995; 2.5) by symmetry of the tail.
    assert abs(t_two_sided(np.array([2.2281388519649385]), np.array([10.0]))[0] - 0.05) < 1e-10
    assert abs(t_two_sided(np.array([1.0]), np.array([1.0]))[0] - 0.5) < 1e-12
    assert t_two_sided(np.array([0.0]), np.array([3.0]))[0] == 1.0


def test_ora(spark):
    sets = spark.createDataFrame([("A", g) for g in "abcd"] + [("B", g) for g in "cdxyz"], "term string, gene string")
    q = spark.createDataFrame([(g,) for g in ["A", "b ", "c", "c"]], "gene string")
    rows = {r.term: r for r in stats.ora(q, sets).collect()}
    want = sum(math.comb(4, i) * math.comb(3, 3 - i) for i in (3,)) / math.comb(7, 3)
    assert set(rows) == {"A"} and abs(rows["A"].pval - want) < 1e-12 and rows["A"].overlap == 3


def test_jaccard_and_significant(spark):
    a, b = (spark.createDataFrame([(g,) for g in s], "gene_id string") for s in ("ABC", "BCD"))
    r = one(stats.jaccard(a, b))
    assert (r["n_overlap"], r["jaccard"]) == (2, 0.5)
    de = spark.createDataFrame([("A", ".2"), ("B", "NA"), ("C", "0.01"), ("", "0.01"), ("D", None)], "gene_id string, fdr string")
    assert [r.gene_id for r in stats.significant(de).collect()] == ["C"]


def test_confirmatory_refuses_t_test(spark):
    m = spark.createDataFrame([(1, 1, 1.0)], "cell_id bigint, gene_id bigint, value double")
    with pytest.raises(ValueError):
        stats.pseudobulk_de(m, m, confirmatory=True)


def test_wilcoxon_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.poisson(1.0, (30, 4)).astype(float)
    lab = np.array(["a", "b", "c"])[np.arange(30) % 3]
    m = spark.createDataFrame([(i, g, float(x[i, g])) for i in range(30) for g in range(4) if x[i, g]], "cell_id int, gene_id int, value double")
    o = spark.createDataFrame([(i, str(lab[i])) for i in range(30)], "cell_id int, cluster string")
    got = {(r.cluster, r.gene_id): r.rank_sum for r in stats.rank_genes_wilcoxon(m, o).collect()}
    for g in range(4):
        order = np.sort(x[:, g])
        rank = np.array([(np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2 for v in x[:, g]])
        for c in "abc":
            assert abs(got[c, g] - rank[lab == c].sum()) < 1e-9


def test_knn_in_blocks_and_index_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)) + np.repeat(rng.normal(size=(8, 8)) * 4, 50, axis=0)
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(400)], "id bigint, vec array<double>")
    q = df.where("id % 50 = 0")
    got = {(r.query, r.rank): r.neighbor for r in graph.knn(q, df, 5, block=3, blocks=3).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1): int(j) for i in range(0, 400, 50) for r, j in enumerate(np.argsort(d[i])[:5])}
    assert got == want
    near = {(r.query, r.neighbor) for r in graph.ivf_search(q, df, graph.ivf_fit(df, 16), 5, probes=6).collect()}
    assert len(near & {(k[0], v) for k, v in want.items()}) / len(want) >= 0.9


def test_modularity_finds_two_groups(spark):
    e = [(a, b) for g in (0, 10) for a in range(g, g + 6) for b in range(g, g + 6) if a < b] + [(0, 10)]
    got = {r.id: r.cluster for r in graph.modularity_clusters(spark.createDataFrame(e, "query bigint, neighbor bigint"), 12).collect()}
    assert len({got[i] for i in range(1, 6)}) == 1 and len({got[i] for i in range(11, 16)}) == 1 and got[1] != got[11]


def test_harmony_brings_batches_together(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 4)) + [5, 0, 0, 0], rng.normal(size=(60, 4)) + [5, 3, 0, 0]])
    df = spark.createDataFrame([(i, int(i >= 60), x[i].tolist()) for i in range(120)], "id bigint, label int, vec array<double>")
    before, after = (graph.batch_r2(d).first().r2 for d in (df, graph.harmonize(df, k=2)))
    assert after < before / 2


def test_sections_and_cleaning(spark):
    text = "Intro line\n1. INTRODUCTION\nbody a\n2. DATA DESCRIPTION\nbody b\nSUMMARY\nshort\nReferences\n[1] x"
    got = {r.section: r.text for r in retrieval.split_sections(spark.createDataFrame([(1, text)], "id int, text string")).collect()}
    assert got == {"title": "Intro line", "introduction": "body a", "methods": "body b", "abstract": "short"}
    s = one(spark.createDataFrame([("single<sub>-</sub>cell 10\x03 Genomics a&nbsp;b so\u00adft x<br>y",)], "t string").select(retrieval.sanitize(F.col("t")).alias("t")))["t"]
    assert s == "single-cell 10x Genomics a\u00a0b soft x\ny"


def test_chunks(spark):
    text = "# A\n\n" + "x" * 150 + "\n\n# B\n\n" + "y" * 150
    parts = retrieval.semantic_chunks(text, 200, 20)
    assert any("x" * 150 in p for p in parts) and any("y" * 150 in p for p in parts) and all(len(p) <= 200 for p in parts)
    assert retrieval.semantic_chunks(None, 200, 20) == [] and retrieval.semantic_chunks(" \n", 10, 0) == []
    long = "".join(chr(97 + i % 26) for i in range(1000))
    got = retrieval.chunk_fixed(spark.createDataFrame([(1, long), (2, None), (3, "")], "id int, text string"), 300, 50).orderBy("chunk_index").collect()
    assert [r.text for r in got] == [long[i : i + 300] for i in range(0, 850, 250)]


def test_plan_order():
    steps = dag.order(["annotate"], "harmony")
    assert steps.index("harmony") < steps.index("neighbors") and dag.check(steps, "harmony") == []
    assert dag.check(["pca"]) and "the QC step is missing" in dag.check(["pca"])


def test_integrator_choice():
    assert graph.choose_integrator(10, 1, False) == "none" and graph.choose_integrator(200_000, 3, False) == "scvi"
    assert graph.choose_integrator(10, 3, True) == "none" and graph.choose_integrator(10, 3, False) == "harmony"
    assert graph.continuity(10, 5, 0.9, 3.0)["decision"] == "skip" and graph.continuity(60, 5, 0.9, 3.0)["decision"] == "run"


def test_mtx(spark, tmp_path):
    from tessera.sources import readers

    d = tmp_path / "run1" / "outs" / "filtered_feature_bc_matrix"
    d.mkdir(parents=True)
    (d / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n2 3 4\n1 1 5\n2 3 1\n9 1 7\n1 2 0\n")
    (d / "barcodes.tsv").write_text("AA\nCC\nGG\n")
    (d / "features.tsv").write_text("E1\tCD3D\tGene Expression\nE2\tCD3D\tGene Expression\n")
    m, c, g = readers.read_mtx(spark, str(tmp_path / "run1"))
    assert sorted(map(tuple, m.collect())) == [("AA", "CD3D", 5.0), ("GG", "CD3D-1", 1.0)] and c.count() == 3 and g.count() == 2
    assert readers.discover_samples(str(tmp_path)) == [("run1", str(d))] and readers.platform(str(d)) == "10x"
    with pytest.raises(NotImplementedError):
        readers.read_matrix(spark, "x.h5ad")


def test_marker_catalog(spark, tmp_path):
    import json

    from tessera.sources import readers

    (tmp_path / "c.json").write_text(json.dumps({"source": "x", "tissues": {"pbmc": [{"name": "T", "cl_id": "CL:1", "positive": ["A", "B"]}], "liver": []}}))
    got = readers.read_marker_catalog(spark, str(tmp_path / "c.json"), "Blood").collect()
    assert [(r.name, r.positive) for r in got] == [("T", ["A", "B"])]
    assert readers.read_marker_catalog(spark, str(tmp_path / "c.json"), "spleen").count() == 0
    (tmp_path / "c.csv").write_text("tissue,name,positive\npbmc,T,A|B;C\n")
    assert readers.read_marker_catalog(spark, str(tmp_path / "c.csv")).first().positive == ["A", "B", "C"]
    (tmp_path / "r.json").write_text(json.dumps({"tissues": {"pbmc": [{"name": "T", "cl_id": "CL:1"}]}}))
    (tmp_path / "s.json").write_text(json.dumps({"states": [{"name": "S", "id": "1"}]}))
    assert [tuple(r)[:3] for f in ("r", "s") for r in readers.read_records(spark, str(tmp_path / f"{f}.json"), f).collect()] == [("r", "T", "CL:1"), ("s", "S", "1")]


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 9), ("d", 150), ("e", 5000)) for v in np.round(rng.exponential(3, n), 1 if k == "e" else 6)] + [("f", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    asked = {f"q{int(100 * p)}": ("v", p) for p in (0.0, 0.02, 0.1, 0.5, 0.9, 0.98, 1.0)}
    got = {r.k: r for r in cells.quantiles(df, ["k"], asked).collect()}
    assert set(got) == set("abcde")
    for k in got:
        v = [x for g, x in rows if g == k]
        assert all(abs(got[k][a] - np.quantile(v, p)) < 1e-9 for a, (_, p) in asked.items())


def test_counts_selection_follows_its_definition(spark):
    rng = np.random.default_rng(2)
    x = rng.poisson(rng.gamma(2, 2, 40) * np.ones((60, 1)) * np.where(np.arange(40) < 4, rng.gamma(0.5, 2, (60, 1)), 1))
    m = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(60) for j in range(40) if x[i, j]], "cell_id int, gene_id int, value double")
    obs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(60)], "cell_id int, batch string")
    got = {r.gene_id: r for r in cells.hvg_counts(m, obs, 5).collect()}
    mean, var = x.mean(0), x.var(0, ddof=1)
    sd = np.sqrt(10 ** cells._trend(np.log10(mean), np.log10(var)))
    want = [1 / (59 * sd[j] ** 2) * (60 * mean[j] ** 2 + (c := np.minimum(x[:, j], sd[j] * 60**0.5 + mean[j])) @ c - 2 * c.sum() * mean[j]) for j in range(40)]
    assert all(abs(got[j].variance_norm - want[j]) < 1e-6 for j in got)
    assert sum(r.highly_variable for r in got.values()) == 5 and got[int(np.argmax(want))].rank == 1
    assert sum(r.highly_variable for r in cells.hvg_counts(m, obs, 5, "batch").collect()) == 5
    hv, how = cells.select_hvg(m, obs, "counts", 5, "batch")
    assert how == "counts" and hv.where("highly_variable").count() == 5
    hv, how = cells.select_hvg(cells.normalize_log1p(m), obs, "log1p", 5, "batch")
    assert how == "dispersion" and hv.where("highly_variable").count() == 5


def test_cycle_needs_three_genes_of_either_set(spark):
    m = spark.createDataFrame([(i, j, 1.0 + (i * j) % 3) for i in range(6) for j in range(12)], "cell_id int, gene_id int, value double")
    obs = m.select("cell_id").distinct()
    var = spark.createDataFrame([(j, g) for j, g in enumerate(["MCM5", "PCNA", "TYMS", "HMGB2", "CDK1", "x", "y", "z", "u", "v", "w", "t"])], "gene_id int, gene_name string")
    assert {(r.s_score, r.phase) for r in cells.cell_cycle(m, obs, var).collect()} == {(0.0, "G1")}
    assert cells.cell_cycle(m, obs, var, sets=(["MCM5", "PCNA", "TYMS"], ["HMGB2", "CDK1", "x"])).where("s_score <> 0").count() > 0
    assert cells.cycle_genes("mouse")[0][0] == "Mcm5"
    flat = spark.createDataFrame([(i, 0.1 * i, 0.2, "S" if i < 1 else "G1") for i in range(6)], "cell_id int, s_score double, g2m_score double, phase string")
    assert cells.regress_cycle(m, flat)[1] and not cells.regress_cycle(m, flat, tissue="tumor")[1] and not cells.regress_cycle(m, flat.withColumn("phase", F.lit("G1")))[1]


def test_detect_doublets(spark):
    c = spark.createDataFrame([(f"c{i}", i) for i in range(5)], "cell_id string, no int")
    a = spark.createDataFrame([(f"c{i}", v, 0.5) for i, v in enumerate([True, True, False, True, False])], "cell_id string, doublet boolean, score double")
    b = spark.createDataFrame([(f"c{i}", v, s) for i, (v, s) in enumerate([(True, 0.85), (False, 0.3), (True, 0.5), (True, 0.75), (False, 0.1)])], "cell_id string, doublet boolean, score double")
    tiers, info = cells.detect_doublets(c, {"scrublet": a, "sim": b})
    assert [r.tier for r in tiers.orderBy("cell_id").collect()] == ["high_conf", "low_conf", "low_conf", "low_conf", "singlet"]
    assert one(info) == {"status": "ok", "methods": "scrublet,sim", "n_high_conf": 1, "n_low_conf": 3, "n_singlet": 1, "rate": 0.8, "rate_high_conf": 0.2, "rate_low_conf": 0.6, "agreement": 0.6, "n_discordant": 2}
    assert one(cells.detect_doublets(c, {"scrublet": a}, ["scrublet", "scdblfinder"])[1])["status"] == "partial"
    assert one(cells.detect_doublets(c, {})[1])["status"] == "failed" and one(cells.detect_doublets(c.limit(0), {})[1])["rate"] == 0.0
    rows = [("c0", 0.9, "doublet", 0), ("c1", 0.1, "singlet", 1)]
    s = spark.createDataFrame(rows, "barcode string, score double, class string, no int")
    assert cells.scores_by_barcode(c, s) is None and cells.scores_by_barcode(c.limit(2), s).count() == 2
    assert cells.scores_by_barcode(c.where("no < 2"), s.withColumn("barcode", F.lit("?"))).where("doublet").collect()[0].cell_id == "c0"
    assert cells.doublet_methods("auto", "brain") == ["scrublet", "scdblfinder"] and cells.doublet_methods(n_samples=1) == ["scrublet"] and cells.doublet_methods("scrublet", "brain", 4) == ["scrublet"]


def test_concat_falls_back_to_all_genes(spark):
    a, b = (spark.createDataFrame([(1, g, 1.0)], "cell_id int, gene_id string, value double") for g in ("g1", "g2"))
    assert cells.concat_samples({"a": a, "b": b}).count() == 0 and cells.concat_samples({"a": a, "b": b}, "auto").count() == 2
    assert cells.concat_samples({"a": a.union(b), "b": b}, "auto").count() == 2


def test_resolvers_and_order():
    assert [stats.marker_method(x) for x in ("t_test", "t test", "TTEST", "edger", None, "mast", "auto")] == ["t-test", "t-test", "t-test", "wilcoxon", "wilcoxon", "mast", "wilcoxon"]
    assert [stats.other_engine(x) for x in (None, "auto", "deseq2", "ttest", "edger")] == ["deseq2", "deseq2", "edger", "edger", "deseq2"]
    assert stats.confirmatory_engine("wilcoxon") == "auto" and stats.confirmatory_engine("edgeR") == "edger" and stats.cross_validates("off") is False and stats.cross_validates("off", True) and stats.cross_validates(None)
    assert dag.order(["pseudobulk_deg", "trajectory"], "harmony") == ["qc", "normalize", "hvg", "pca", "harmony", "neighbors", "leiden", "umap", "annotate", "trajectory", "pseudobulk_deg"]
    assert dag.order(["qc"], "scvi")[-1] == "scvi" and dag.route([])[-1] == "annotate" and "impute_magic" in dag.route(["qc"], imputation="magic")


def test_resolution_prior_and_continuity(spark):
    rows = [(0.2, 0.9, None, 2), (0.4, 0.5, None, 5), (0.6, 0.4, None, 30)]
    s = spark.createDataFrame(rows, "resolution double, silhouette double, marker double, n_clusters int")
    best = graph.choose_resolution(s).first()
    assert best.resolution == 0.2 and abs(best.score - (0.55 + 0.45 * 0.1 * 2 / 3)) < 1e-12
    flat = graph.choose_resolution(s.withColumn("silhouette", F.lit(0.3))).first()
    assert flat.resolution == 0.4 and abs(flat.score - 0.45) < 1e-12
    assert graph.continuity(60, 2, 0.5, 2.5, True) == {"decision": "run", "score": 3, "confidence": "high"}
    assert graph.continuity(60, 20, 0.1, None) == {"decision": "skip", "score": 0, "confidence": "moderate"} and graph.continuity(60, 20, 0.1, None, forced=True)["confidence"] == "low"
    assert graph.trajectory_candidate("thymus")["candidate"] and not graph.trajectory_candidate("pbmc")["candidate"] and graph.trajectory_candidate("pbmc", query="RNA velocity")["candidate"]


def test_sweep_gives_more_clusters_at_higher_resolution(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.3, (12, 2)) for c in ((0, 0), (3, 0), (30, 0), (33, 0))])
    e = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<double>")
    labels, scores = graph.resolution_sweep(graph.knn(e, e, 14), e, [0.02, 1.0], rounds=8)
    n = {r.resolution: r.n_clusters for r in scores.collect()}
    assert n[0.02] < n[1.0] and graph.choose_resolution(scores).count() == 1
    assert labels.groupBy("resolution").count().select("count").distinct().count() == 1
    b = e.withColumn("label", F.col("id") % 2)
    per = graph.knn_per_batch(b, 2)
    assert per.groupBy("query").agg(F.countDistinct("label").alias("n")).where("n = 2").count() == 48


def test_distances_of_rows_that_nearly_coincide():
    x = np.array([[1e4, 0.0], [1e4, 1e-3], [0.0, 0.0]])
    assert np.allclose(graph._squared(x, x), ((x[:, None] - x[None]) ** 2).sum(-1), rtol=1e-9, atol=0)


def test_root_embedding_and_codes(spark):
    m = spark.createDataFrame([(1, 1, 1.0), (2, 1, 3.0), (3, 2, 9.0)], "cell_id int, gene_id int, value double")
    obs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "cell_id int, cluster string")
    var = spark.createDataFrame([(1, "Kit"), (2, "x")], "gene_id int, gene_name string")
    assert graph.root_cell(m, var, obs).first().cell_id == 2 and graph.root_cell(m, var.where("gene_id = 2"), obs).first().cell_id == 3
    there = spark.createDataFrame([(1, "X_pca"), (1, "X_scVI"), (2, "X_scVI")], "id int, rep string")
    assert {r.rep for r in graph.pick_embedding(there).collect()} == {"X_scVI"} and graph.pick_embedding(there, "X_pca").count() == 1
    assert [r.code for r in stats.factorize(obs, "cluster").orderBy("cell_id").collect()] == [0, 0, 1]
    assert [r.gene_id for r in stats.top_variance(m, 3, 1).collect()] == [2]
    ranked = spark.createDataFrame([(c, f"{c}{r}", r) for c in "ab" for r in range(1, 21)], "cluster string, gene_id string, rank int")
    assert stats.genes_of_groups(ranked, n=10).count() == 10 and stats.genes_of_groups(ranked, n=24).count() == 24


def test_diffusion_keeps_constants(spark):
    from tessera.operators import embedding

    e = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(8)], "id bigint, vec array<double>")
    m = spark.createDataFrame([(i, 1, 2.0) for i in range(8)] + [(0, 2, 8.0)], "cell_id bigint, gene_id int, value double")
    out = embedding.impute_diffusion(m, graph.knn(e, e, 3), 2).collect()
    assert all(abs(r.value - 2) < 1e-9 for r in out if r.gene_id == 1) and len([r for r in out if r.gene_id == 2]) > 1
