import numpy as np
from pyspark.sql import functions as F

from tessera.operators import embedding, routing, summaries


def test_pca_signs_and_kmeans(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 4)) * [5, 2, 1, 0.1] + np.repeat([[0, 0, 0, 0], [30, 0, 0, 0]], 40, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    got, pc = embedding.pca(df, 2)
    assert (pc[np.abs(pc).argmax(0), range(2)] > 0).all() and len(got.first().vec) == 2
    c = {r.id: r.cluster for r in embedding.kmeans(df, 2).collect()}
    assert len({c[i] for i in range(40)}) == 1 and c[0] != c[79]


def test_doublets_by_simulation(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(120, 3)) + [8, 0, 0], rng.normal(size=(120, 3)) + [0, 8, 0], rng.normal(size=(10, 3)) + [8, 8, 0]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    s = {r.id: r.score for r in embedding.simulated_doublets(df, 0.05).collect()}
    assert len(s) == 250 and np.mean([s[i] for i in range(240, 250)]) > np.mean([s[i] for i in range(240)])
    assert {r.doublet for r in embedding.simulated_doublets(df.limit(5), 0.05).collect()} == {False}


def test_imputation_keeps_what_is_there(spark):
    rng = np.random.default_rng(2)
    base = rng.poisson(3, (40, 1)) * np.ones((1, 6)) + 1.0
    base[5, 2] = 0
    m = spark.createDataFrame([(i, g, float(base[i, g])) for i in range(40) for g in range(6) if base[i, g]], "cell_id bigint, gene_id bigint, value double")
    got = {(r.cell_id, r.gene_id): r.value for r in embedding.impute_low_rank(m, m, 2).collect()}
    assert all(got[i, g] >= base[i, g] - 1e-9 for i in range(40) for g in range(6) if base[i, g])


def test_requests(spark):
    q = spark.createDataFrame([("degradation of cells",), ("DEG between condition vs control, leiden",), ("RNA velocity",), (None,), ("only use DESeq2 pseudobulk",), ("t-test and wilcoxon",)], "query string")
    got = [r.i for r in q.select(routing.intents(F.col("query")).alias("i")).collect()]
    assert got[0] == ["qc", "clustering", "annotation", "enrichment"] and got[1] == ["clustering", "deg", "enrichment"] and got[2] == ["trajectory"] and got[3] == got[0]
    p = routing.deg_preference(q).collect()
    assert (p[4].engine, p[4].cross_validate) == ("deseq2", False) and (p[5].marker_method, p[5].cross_validate) == ("t-test", True)


def test_figures(spark):
    f = spark.createDataFrame([("a/qc_violin_1.png", None), ("b/umap.png", "umap"), ("c/x_umap.png", None)], "path string, kind string")
    w = spark.createDataFrame([(1, "violin"), (1, "qc_violin"), (2, "umap"), (3, "heatmap")], "slot int, kind string")
    assert sorted(map(tuple, routing.match_figures(f, w).collect())) == [(1, "a/qc_violin_1.png", "qc_violin"), (2, "b/umap.png", "umap")]


def test_nearest_rank_and_modes(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 5, 5]] + [("b", None), ("b", 7.0)], "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in summaries.nearest_rank(df, "g", "v", [0.5, 0.95]).collect()}
    assert got == {"a": (3.0, 5.0), "b": (7.0, 7.0)}
    m = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c")], "k string, v string")
    assert sorted(map(tuple, summaries.modes(m, "k", "v").collect())) == [("x", "a", 1), ("y", "c", 1)]
