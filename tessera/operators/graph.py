"""Neighbours, batch mixing, clusters and trajectories over embeddings ``(id, vec, ...)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import discard, materialize


def knn(queries: DataFrame, base: DataFrame, k: int, drop_self: bool = True, block: int = 2048, blocks: int | None = None) -> DataFrame:
    """(query, neighbor, rank, distance): exact Euclidean neighbours of a stated query set against
    all rows, block by block.

    Queries come in blocks of ``block`` rows and the base in ``blocks`` parts; each task holds one of
    either and returns ``k`` candidates a query, so what is shuffled is the blocks and the
    candidates, not pairs. Ties in distance go to the smaller id.
    """
    if blocks is None:
        blocks = max(1, -(-base.count() // 50_000))
    nq = max(1, -(-queries.count() // block))
    side = lambda df, n, m, own, other: df.select(F.col("id").alias(f"{own}_id"), F.col("vec").cast("array<double>").alias(f"{own}_vec"), F.pmod(F.xxhash64("id"), F.lit(n)).alias(own)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(m - 1).cast("bigint"))))
    a, b = side(queries, nq, blocks, "qb", "bb").groupBy("qb", "bb"), side(base, blocks, nq, "bb", "qb").groupBy("qb", "bb")

    def near(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query": [], "neighbor": [], "distance": []})
        r = r.sort_values("bb_id")
        x, y, ids, asked = np.stack(q["qb_vec"]), np.stack(r["bb_vec"]), r["bb_id"].to_numpy(), q["qb_id"].to_numpy()
        out = []
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            d = _squared(part, y)
            for i, row in enumerate(d):
                me = asked[at + i]
                if drop_self:
                    row[ids == me] = np.inf
                m = min(k, len(row))
                edge = np.partition(row, m - 1)[m - 1]
                best = np.flatnonzero(row <= edge)
                best = best[np.lexsort((ids[best], row[best]))][:m]
                best = best[np.isfinite(row[best])]
                out.append(pd.DataFrame({"query": me, "neighbor": ids[best], "distance": np.sqrt(np.maximum(row[best], 0))}))
        return pd.concat(out)

    kind = dict(base.dtypes)["id"]
    found = a.cogroup(b).applyInPandas(near, f"query {kind}, neighbor {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", 9), "neighbor"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by dot products, for blocks of any width. Where that loses digits (rows that
    nearly coincide) they are worked out again by differences."""
    xx, yy = (x * x).sum(1)[:, None], (y * y).sum(1)[None]
    d = np.maximum(xx - 2 * (x @ y.T) + yy, 0)
    i, j = np.nonzero(d < 1e-6 * (xx + yy))
    for at in range(0, len(i), 65_536):
        a, b = i[at : at + 65_536], j[at : at + 65_536]
        d[a, b] = ((x[a] - y[b]) ** 2).sum(1)
    return d


def ivf_fit(base: DataFrame, cells: int = 32, sample: int = 20_000, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids of an inverted-file index, fitted on at most ``sample`` rows (by hash order)."""
    rows = base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("vec").toPandas()
    x = np.stack(rows["vec"]).astype(float)
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return c


def ivf_probes(base: DataFrame, centroids: np.ndarray, k: int, recall: float = 0.95, sample: int = 256, seed: int = 7) -> int:
    """How many cells a query must visit to meet ``recall`` of its ``k`` true neighbours, measured
    against exact search on at most ``sample`` rows (by hash order), as it depends on the data."""
    asked = base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select("id", "vec")
    pairs = knn(asked, base, k).select("query", "neighbor")
    pairs = pairs.join(asked.select(F.col("id").alias("query"), F.col("vec").alias("qv")), "query").join(base.select(F.col("id").alias("neighbor"), F.col("vec").alias("bv")), "neighbor").select("qv", "bv").toPandas()
    if not len(pairs):
        return len(centroids)
    far = lambda v: ((np.stack(v).astype(float)[:, None] - centroids[None]) ** 2).sum(-1)
    turn = far(pairs["qv"]).argsort(axis=1, kind="stable").argsort(axis=1)[range(len(pairs)), far(pairs["bv"]).argmin(1)]
    return int(np.sort(turn)[int(np.ceil(recall * len(turn))) - 1]) + 1


def ivf_search(queries: DataFrame, base: DataFrame, centroids: np.ndarray, k: int, probes: int = 8) -> DataFrame:
    """Approximate neighbours: every base row sits in its nearest cell, each query visits ``probes``."""
    def assign(df: DataFrame, m: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                if len(p):
                    x = np.stack(p["vec"]).astype(float)
                    order = np.argsort(((x[:, None] - centroids[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :m]
                    yield pd.DataFrame({"id": p["id"], "vec": p["vec"], "cell": list(order)})

        return df.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(run, f"id {dict(df.dtypes)['id']}, vec array<double>, cell array<int>").withColumn("cell", F.explode("cell"))

    q = assign(queries, probes).select(F.col("id").alias("query"), F.col("vec").alias("qv"), "cell")
    b = assign(base, 1).select(F.col("id").alias("neighbor"), F.col("vec").alias("bv"), "cell")
    d = F.sqrt(F.aggregate(F.zip_with("qv", "bv", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    met = q.join(b, "cell").where("query <> neighbor").select("query", "neighbor", d.alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", 9), "neighbor"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def ilisi(edges: DataFrame, labels: DataFrame, n_batches: int) -> DataFrame:
    """Mean normalised entropy of the batches among each row's neighbours; 1 with under two batches."""
    if n_batches < 2:
        return edges.sparkSession.range(1).select(F.lit(1.0).alias("ilisi"))
    c = edges.join(labels.select(F.col("id").alias("neighbor"), "label"), "neighbor").groupBy("query", "label").agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy("query"))
    h = c.withColumn("p", p).groupBy("query").agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-12)) / F.log(F.lit(float(n_batches)))).alias("h"))
    return h.agg(F.avg("h").alias("ilisi"))


def batch_r2(embed: DataFrame, most: int = 20) -> DataFrame:
    """Mean over components of the share of variance that batch dummies without intercept explain:
    the prediction is the batch's mean, zero for the last label; constant components are left out."""
    n = embed.agg(F.max("label").alias("last"))
    long = embed.select("label", F.posexplode("vec").alias("pc", "x")).where(F.col("pc") < most).withColumn("x", F.col("x").cast("double"))
    mean = long.groupBy("pc").agg(F.avg("x").alias("m"))
    g = long.join(F.broadcast(mean), "pc").withColumn("y", F.col("x") - F.col("m")).groupBy("pc", "label").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    per = g.crossJoin(F.broadcast(n)).groupBy("pc").agg(F.sum(F.when(F.col("label") != F.col("last"), F.col("s") * F.col("s") / F.col("n")).otherwise(0.0)).alias("explained"), F.sum("q").alias("sst"))
    return per.where("sst > 1e-12").agg(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("explained") / F.col("sst")))).alias("r2"))


def batch_dominance(obs: DataFrame, cluster: str = "cluster", batch: str = "sample") -> DataFrame:
    """Mean over clusters of the largest batch's share."""
    c = obs.groupBy(cluster, batch).agg(F.count("*").alias("n"))
    top = c.groupBy(cluster).agg((F.max("n") / F.sum("n")).alias("top"))
    return top.agg(F.avg("top").alias("dominance"))


def silhouette(embed: DataFrame, sample: int | None = None) -> DataFrame:
    """Mean silhouette (Euclidean) per label and over all. Distances of each row to every cluster are
    summed block by block; ``sample`` bounds the rows by hash order, as the sweep's scoring does."""
    rows = embed.select("id", "label", F.col("vec").cast("array<double>").alias("vec"))
    if sample:
        rows = rows.orderBy(F.xxhash64("id"), "id").limit(sample)
    blocks = max(1, -(-rows.count() // 20_000))
    own = rows.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    left, right = own.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).groupBy("a", "b"), own.withColumnRenamed("a", "b").withColumn("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).groupBy("a", "b")

    def sums(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "label": [], "other": [], "s": [], "n": []})
        u, v, lab = np.stack(x["vec"]), np.stack(y["vec"]), y["label"].to_numpy()
        names, inv = np.unique(lab, return_inverse=True)
        out = []
        for at in range(0, len(u), 256):
            d = np.sqrt(_squared(u[at : at + 256], v))
            s = np.stack([d[:, inv == j].sum(1) for j in range(len(names))], 1)
            part = x.iloc[at : at + 256]
            out.append(pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), len(names)), "label": np.repeat(part["label"].to_numpy(), len(names)), "other": np.tile(names, len(part)), "s": s.ravel(), "n": np.tile(np.bincount(inv), len(part))}))
        return pd.concat(out)

    kinds = dict(rows.dtypes)
    s = left.cogroup(right).applyInPandas(sums, f"id {kinds['id']}, label {kinds['label']}, other {kinds['label']}, s double, n bigint").groupBy("id", "label", "other").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    mine = F.col("label") == F.col("other")
    per = s.groupBy("id", "label").agg(F.max(F.when(mine & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("a"), F.min(F.when(~mine, F.col("s") / F.col("n"))).alias("b"))
    return per.select("id", "label", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300))).alias("s"))


def choose_resolution(scores: DataFrame, least: int = 3, most: int = 25) -> DataFrame:
    """``scores(resolution, silhouette, marker, n_clusters)``: min-max normalised silhouette and marker
    score (0 where all are equal) and a prior on the number of clusters: a tenth of its share of
    ``least`` below that, 1 up to ``most``, 0.05 less for each cluster beyond; best first, ties to the
    smaller resolution. A sweep has few resolutions, so its one window is small."""
    w = Window.partitionBy()
    norm = lambda c: F.when(F.max(c).over(w) > F.min(c).over(w), (F.coalesce(c, F.min(c).over(w)) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w))).otherwise(0.0)
    n = F.coalesce("n_clusters", F.lit(0))
    prior = F.when(n < least, 0.1 * n / max(least, 1)).when(n > most, F.greatest(F.lit(0.0), 1.0 - 0.05 * (n - most))).otherwise(1.0)
    s = F.when(F.count("marker").over(w) == 0, 0.55 * norm("silhouette") + 0.45 * prior).otherwise(0.45 * norm("silhouette") + 0.35 * norm("marker") + 0.20 * prior)
    return scores.withColumn("score", s).orderBy(F.desc(F.round("score", 12)), "resolution").limit(1)


def cluster_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, weight) between clusters: neighbour links over those expected from the degrees."""
    lab = lambda s, c: labels.select(F.col("id").alias(c), F.col("label").alias(s))
    e = edges.join(lab("a", "query"), "query").join(lab("b", "neighbor"), "neighbor")
    n = e.groupBy("a", "b").agg(F.count("*").alias("n"))
    out, inn = n.groupBy("a").agg(F.sum("n").alias("out")), n.groupBy("b").agg(F.sum("n").alias("in"))
    total = n.agg(F.sum("n").alias("all"))
    both = n.where("a < b").select("a", "b", "n").unionByName(n.where("a > b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))
    deg = out.join(inn, out.a == inn.b).select(out.a.alias("c"), "out", "in")
    x = both.join(deg.select(F.col("c").alias("a"), F.col("out").alias("oa"), F.col("in").alias("ia")), "a").join(deg.select(F.col("c").alias("b"), F.col("out").alias("ob"), F.col("in").alias("ib")), "b").crossJoin(F.broadcast(total))
    expected = (F.col("oa") * F.col("ib") + F.col("ob") * F.col("ia")) / F.col("all")
    return x.select("a", "b", F.least(F.lit(1.0), F.col("n") / expected).alias("weight"))


def path_like(graph: DataFrame, labels: DataFrame, least: float = 0.05) -> DataFrame:
    """Share of clusters with one or two links of weight ``least`` or more."""
    links = graph.where(F.col("weight") >= least)
    deg = links.select(F.col("a").alias("label")).unionByName(links.select(F.col("b").alias("label"))).groupBy("label").agg(F.count("*").alias("d"))
    all_ = labels.select("label").distinct().join(deg, "label", "left")
    return all_.agg(F.avg(F.coalesce(F.col("d").between(1, 2), F.lit(False)).cast("double")).alias("path_like"))


def elongation(points: DataFrame, label: str = "label", x: str = "x", y: str = "y") -> DataFrame:
    """Ratio of the singular values of the clusters' centroids in the plane."""
    c = points.groupBy(label).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    m = c.agg(F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n"))
    a, b, c2 = F.col("xx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("yy") - F.col("sy") * F.col("sy") / F.col("n"), F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")
    root = F.sqrt((a - b) * (a - b) / 4 + c2 * c2)
    hi, lo = (a + b) / 2 + root, (a + b) / 2 - root
    return m.select(F.when(lo > 1e-12, F.sqrt(hi / lo)).alias("elongation"))


def continuity(n_cells: int, n_clusters: int | None, path: float | None = None, stretch: float | None = None, velocity: bool = False, forced: bool = False) -> dict:
    """Whether a trajectory is worth running: an additive score of its signs. ``path`` is None where
    there is no cluster graph, ``n_clusters`` where nothing was clustered."""
    if n_cells < 40 or n_clusters is None:
        return {"decision": "run" if forced else "skip", "score": 0, "confidence": "low" if forced else "none"}
    signs = [
        1 if n_clusters >= 3 else -1,
        0 if path is None else 2 if path >= 0.45 else -1 if path < 0.2 else 0,
        int(stretch is not None and stretch >= 2),
        int(velocity),
    ]
    score = sum(signs)
    return {"decision": "run" if forced or score >= 2 else "skip", "score": score, "confidence": "high" if score >= 3 else "low" if forced else "moderate"}


# Tissues of continuous and of discrete cells, words that ask for a trajectory, genes of stem cells.
CONTINUOUS = {"embryo", "development", "developing", "hematopoiesis", "bone_marrow", "marrow", "thymus", "differentiation", "reprogramming"}
DISCRETE = {"pbmc", "blood", "immune"}
ASKS_TRAJECTORY = ("轨迹", "伪时间", "命运", "分化", "palantir", "scvelo", "velocity", "monocle", "pseudotime")
STEM_GENES = ("KIT", "PROM1", "SOX2", "POU5F1", "NANOG", "CD34", "EPCAM")


def trajectory_candidate(tissue: str | None = None, layers: list[str] | None = None, query: str | None = None) -> dict:
    """Whether a trajectory is to be looked at: asked for, or spliced layers, or a continuous tissue."""
    t, q = (tissue or "default").lower(), (query or "").lower()
    velocity = not {"spliced", "unspliced"}.isdisjoint(x.lower() for x in layers or [])
    asked = any(k in q for k in ASKS_TRAJECTORY)
    return {"candidate": asked or velocity or t in CONTINUOUS and t not in DISCRETE, "velocity": velocity}


def root_cell(lognorm: DataFrame, var: DataFrame, obs: DataFrame, by: str = "cluster", name: str = "gene_name") -> DataFrame:
    """(cell_id): where a trajectory begins: the cell of the largest mean over the stem genes, the first
    of equals; without such genes the first cell of the smallest cluster (of equals the last by name)."""
    stem = var.where(F.upper(name).isin(*STEM_GENES)).select("gene_id")
    score = lognorm.join(stem, "gene_id", "left_semi").groupBy("cell_id").agg(F.sum("value").alias("s"))
    smallest = obs.groupBy(by).agg(F.count("*").alias("n"), F.min("cell_id").alias("first")).orderBy("n", F.desc(by)).limit(1)
    best = obs.select("cell_id").join(score, "cell_id", "left").agg(F.max(F.struct(F.coalesce("s", F.lit(0.0)).alias("s"), (-F.col("cell_id")).alias("c"))).alias("b"))
    has = stem.agg((F.count("*") > 0).alias("has"))
    return best.crossJoin(F.broadcast(smallest)).crossJoin(F.broadcast(has)).select(F.when(F.col("has"), -F.col("b.c")).otherwise(F.col("first")).alias("cell_id"))


# Embeddings in the order in which one is taken.
EMBEDDINGS = ("X_pca_harmony", "X_scVI", "X_scanorama", "X_pca")


def pick_embedding(there: DataFrame, asked: str | None = None, rep: str = "rep") -> DataFrame:
    """The rows of the first embedding that is there: the one asked for, else by the fixed order."""
    names = [*([asked] if asked else []), *EMBEDDINGS]
    place = F.array_position(F.array(*map(F.lit, names)), F.col(rep))
    best = there.where(place > 0).agg(F.min(place).alias("__p"))
    return there.withColumn("__o", place).crossJoin(F.broadcast(best)).where("__o = __p").drop("__o", "__p")


def modularity_clusters(edges: DataFrame, rounds: int = 10, resolution: float = 1.0) -> DataFrame:
    """(id, cluster) by label moves over an undirected neighbour graph: in each round every second
    node, by hash, takes the neighbouring label with the largest gain in modularity, whose expected
    links count ``resolution`` times: a larger one gives more and smaller clusters."""
    e = edges.select(F.least("query", "neighbor").alias("u"), F.greatest("query", "neighbor").alias("v")).distinct().where("u <> v")
    e = materialize(e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    deg = materialize(e.groupBy("u").agg(F.count("*").alias("deg")), "degrees")
    out = _moves(e, deg, rounds, resolution)
    discard(e), discard(deg)
    return out


def _moves(e: DataFrame, deg: DataFrame, rounds: int, resolution: float) -> DataFrame:
    m2 = deg.agg(F.sum("deg")).first()[0] or 1
    lab = deg.select(F.col("u").alias("id"), F.col("u").alias("cluster"), "deg")
    for r in range(rounds):
        tot = lab.groupBy("cluster").agg(F.sum("deg").alias("tot"))
        near = e.join(lab.select(F.col("id").alias("v"), "cluster"), "v").groupBy("u", "cluster").agg(F.count("*").alias("k")).join(tot, "cluster")
        own = lab.select(F.col("id").alias("u"), F.col("cluster").alias("mine"), "deg")
        gain = near.join(own, "u").withColumn("g", F.col("k") - resolution * F.col("deg") * (F.col("tot") - F.when(F.col("cluster") == F.col("mine"), F.col("deg")).otherwise(0)) / m2)
        best = gain.groupBy("u").agg(F.max(F.struct(F.round("g", 9), -F.col("cluster"))).alias("b"))
        new = lab.join(best, lab.id == best.u, "left").select("id", F.when((F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0) & F.col("b").isNotNull(), -F.col("b.col2")).otherwise(F.col("cluster")).alias("cluster"), "deg")
        old, lab = lab, materialize(new, "labels")
        discard(old)
    return lab.select("id", "cluster")


def resolution_sweep(edges: DataFrame, embed: DataFrame, resolutions: list[float] = [0.2, 0.4, 0.6, 0.8, 1.0], rounds: int = 10, sample: int = 5000, markers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((resolution, id, cluster), (resolution, silhouette, marker, n_clusters)): the clusters at every
    resolution and their scores, for :func:`choose_resolution`. The silhouette takes at most ``sample``
    rows, as the score's definition does; ``markers(resolution, marker)`` is joined if given."""
    e = edges.select(F.least("query", "neighbor").alias("u"), F.greatest("query", "neighbor").alias("v")).distinct().where("u <> v")
    e = materialize(e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    deg = materialize(e.groupBy("u").agg(F.count("*").alias("deg")), "degrees")
    labels = scores = None
    for r in resolutions:
        lab = _moves(e, deg, rounds, r).select(F.lit(float(r)).alias("resolution"), "id", "cluster")
        rows = materialize(embed.select("id", "vec").join(lab.select("id", F.col("cluster").alias("label")), "id"), "labelled")
        s = silhouette(rows, sample).agg(F.avg("s").alias("silhouette"))
        row = s.crossJoin(lab.agg(F.countDistinct("cluster").alias("n_clusters"))).select(F.lit(float(r)).alias("resolution"), "silhouette", "n_clusters")
        labels, scores = (lab, row) if labels is None else (labels.unionByName(lab), scores.unionByName(row))
    scores = scores.withColumn("marker", F.lit(None).cast("double")) if markers is None else scores.join(markers, "resolution", "left")
    return labels, scores.select("resolution", "silhouette", "marker", "n_clusters")


def knn_per_batch(embed: DataFrame, k: int = 3, batch: str = "label") -> DataFrame:
    """(query, neighbor, batch, rank, distance): the ``k`` nearest of every batch for every row, so that
    no batch is without links to the others. A search per batch, of which there are few."""
    out = None
    for r in embed.select(batch).distinct().orderBy(batch).collect():
        part = knn(embed, embed.where(F.col(batch) == r[0]), k).select("query", "neighbor", F.lit(r[0]).alias(batch), "rank", "distance")
        out = part if out is None else out.unionByName(part)
    return out


def harmonize(embed: DataFrame, k: int = 8, rounds: int = 3, sigma: float = 0.1, ridge: float = 1.0, seed: int = 3) -> DataFrame:
    """Batch-corrected embeddings: soft clusters on the sphere, then each cluster's batch offset (a
    ridge-shrunk difference of batch and cluster mean) is taken off by membership. Only sums per
    (cluster, batch) reach the driver, as many as clusters times batches."""
    now = embed.select("id", "label", F.col("vec").cast("array<double>").alias("vec"))
    c = ivf_fit(now, k, seed=seed)
    kinds = dict(now.dtypes)

    def soft(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        u, w = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        r = -2 * (1 - u @ w.T) / sigma
        r = np.exp(r - r.max(1, keepdims=True))
        return r / r.sum(1, keepdims=True)

    for _ in range(rounds):
        def sums(batches: Iterator[pd.DataFrame], c: np.ndarray = c) -> Iterator[pd.DataFrame]:
            for p in batches:
                if len(p):
                    x = np.stack(p["vec"])
                    r = soft(x, c)
                    for lab in p["label"].unique():
                        at = (p["label"] == lab).to_numpy()
                        for j in range(len(c)):
                            yield pd.DataFrame({"j": [j], "label": [lab], "n": [r[at, j].sum()], "s": [(r[at, j : j + 1] * x[at]).sum(0)]})

        part = now.mapInPandas(sums, f"j int, label {kinds['label']}, n double, s array<double>").select("j", "label", "n", F.posexplode("s").alias("i", "s")).groupBy("j", "label", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        t = part.toPandas()
        dim = int(t["i"].max()) + 1
        off: dict = {}
        for j, g in t.groupby("j"):
            per = {lab: (q["n"].iat[0], q.sort_values("i")["s"].to_numpy()) for lab, q in g.groupby("label")}
            n, s = sum(v[0] for v in per.values()), sum(v[1] for v in per.values())
            c[j] = s / max(n, 1e-12)
            for lab, (nb, sb) in per.items():
                off[j, lab] = (sb - nb * c[j]) / (nb + ridge)

        def shift(batches: Iterator[pd.DataFrame], c: np.ndarray = c.copy(), off: dict = off) -> Iterator[pd.DataFrame]:
            for p in batches:
                if len(p):
                    x = np.stack(p["vec"])
                    r = soft(x, c)
                    o = np.stack([np.stack([off.get((j, lab), np.zeros(dim)) for j in range(len(c))]) for lab in p["label"]])
                    yield pd.DataFrame({"id": p["id"], "label": p["label"], "vec": list(x - (r[:, :, None] * o).sum(1))})

        now = materialize(now.mapInPandas(shift, f"id {kinds['id']}, label {kinds['label']}, vec array<double>"), "harmony")
    return now


def choose_integrator(n_cells: int, n_samples: int, confounded: bool, asked: str = "auto") -> str:
    if asked not in ("auto", ""):
        return asked
    if n_samples <= 1 or confounded:
        return "none"
    return "scvi" if n_cells >= 100_000 or n_samples >= 8 else "harmony"
