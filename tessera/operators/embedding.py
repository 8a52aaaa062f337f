"""Linear embeddings, clusters, imputation and simulated doublets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.cells import quantiles
from tessera.operators.graph import knn
from tessera.session import materialize


def pca(embed: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """``embed`` with ``vec`` replaced by its first ``k`` components, and the components. Each has its
    largest loading positive, so signs don't depend on the run."""
    rows = embed.withColumn("__v", array_to_vector(F.col("vec").cast("array<double>")))
    pc = PCA(k=k, inputCol="__v", outputCol="__p").fit(rows).pc.toArray()
    pc = pc * np.sign(pc[np.abs(pc).argmax(0), range(pc.shape[1])])
    held = embed.sparkSession.sparkContext.broadcast(pc)  # k columns of one number a dimension

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v) @ held.value) if len(v) else [], dtype=object)

    return embed.withColumn("vec", project(F.col("vec").cast("array<double>"))), pc


def kmeans(embed: DataFrame, k: int, seed: int = 1) -> DataFrame:
    rows = embed.withColumn("__v", array_to_vector(F.col("vec").cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(rows).transform(rows).drop("__v")


def cell_vectors(matrix: DataFrame, genes: DataFrame) -> tuple[DataFrame, list]:
    """(id, i, x): a cell's stored values over selected genes by their places, and the genes in order."""
    names = [r[0] for r in genes.select("gene_id").distinct().orderBy("gene_id").collect()]
    at = matrix.sparkSession.createDataFrame([(g, i) for i, g in enumerate(names)], f"gene_id {dict(matrix.dtypes)['gene_id']}, i int")
    e = matrix.join(F.broadcast(at), "gene_id").groupBy(F.col("cell_id").alias("id")).agg(F.collect_list(F.struct("i", F.col("value").cast("double").alias("x"))).alias("e"))
    return e.select("id", F.col("e.i").alias("i"), F.col("e.x").alias("x")), names


def impute_low_rank(matrix: DataFrame, genes: DataFrame, k: int = 8) -> DataFrame:
    """Values of the selected genes from the first ``k`` components, zero below the median of a gene's
    stored values (a layer of its own; the counts stay as they are).

    Products are summed for pairs of genes that a cell holds, zeros follow from the number of cells;
    what reaches the driver is bounded by the pairs of selected genes.
    """
    cells, names = cell_vectors(matrix, genes)
    cells, size = materialize(cells, "cells"), len(names)
    kinds = dict(matrix.dtypes)
    result = f"cell_id {kinds['cell_id']}, gene_id {kinds['gene_id']}, value double"
    n = cells.count()
    if not n:
        return matrix.sparkSession.createDataFrame([], result)
    long = cells.select("i", "x", F.explode(F.arrays_zip("i", "x")).alias("a"))
    per = long.groupBy(F.col("a.i").alias("i")).agg(F.sum("a.x").alias("s"), F.median("a.x").alias("low")).toPandas()
    mean, low = np.zeros(size), np.zeros(size)
    mean[per["i"]], low[per["i"]] = per["s"] / n, per["low"]
    pairs = long.select(F.col("a").alias("a"), F.explode(F.arrays_zip("i", "x")).alias("b")).where("a.i <= b.i").groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("s")).toPandas()
    gram = np.zeros((size, size))
    gram[pairs["i"], pairs["j"]] = gram[pairs["j"], pairs["i"]] = pairs["s"]
    pc = np.linalg.eigh(gram - n * np.outer(mean, mean))[1][:, ::-1][:, : min(k, size)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.array(names)
        for p in batches:
            for at in range(0, len(p), 512):
                part = p.iloc[at : at + 512]
                x = np.zeros((len(part), size))
                x[np.repeat(np.arange(len(part)), part["i"].map(len)), np.concatenate(part["i"].to_numpy())] = np.concatenate(part["x"].to_numpy())
                y = (x - mean) @ pc @ pc.T + mean
                y = np.where((x == 0) & (y < low), 0.0, np.where(x > 0, np.maximum(y, x), y))
                r, c = np.nonzero(y > 0)
                yield pd.DataFrame({"cell_id": part["id"].to_numpy()[r], "gene_id": ids[c], "value": y[r, c]})

    return cells.mapInPandas(run, result)


def simulated_doublets(embed: DataFrame, rate: float, k: int = 15, seed: int = 0) -> DataFrame:
    """(id, score, doublet): nearness to sums of pairs of cells in a linear embedding. Pairs are
    neighbours in hash order within hash buckets, a quarter of the cells; the call is the upper
    ``rate`` of the scores. Under eight cells nothing is called."""
    n = embed.count()
    if n < 8:
        return embed.select("id", F.lit(0.0).alias("score"), F.lit(False).alias("doublet"))
    h = F.xxhash64("id", F.lit(seed))
    w = Window.partitionBy(F.pmod(h, F.lit(max(1, n // 256)))).orderBy(h, "id")
    v = F.col("vec").cast("array<double>")
    pairs = embed.select("id", v.alias("vec"), F.lead(v).over(w).alias("other"), F.row_number().over(w).alias("r"))
    sims = pairs.where((F.col("other").isNotNull()) & (F.pmod("r", F.lit(4 if n >= 256 else 2)) == 1)).select("id", F.zip_with("vec", "other", lambda a, b: a + b).alias("vec"))
    near = knn(embed.select("id", "vec"), sims, k, drop_self=False).groupBy(F.col("query").alias("id")).agg((1 / (1 + F.avg("distance"))).alias("score"))
    near = materialize(near, "scores")
    cut = quantiles(near, [], {"cut": ("score", 1 - rate)})
    return near.crossJoin(F.broadcast(cut)).select("id", "score", (F.col("score") >= F.col("cut")).alias("doublet"))


def simulated_doublets_by_sample(embed: DataFrame, sample: str, k: int = 15, seed: int = 0) -> DataFrame:
    """:func:`simulated_doublets` within each sample, at the rate its number of cells leads one to expect;
    a run per sample, of which there are few."""
    out = None
    for name, n in embed.groupBy(sample).agg(F.count("*").alias("n")).orderBy(sample).collect():
        part = simulated_doublets(embed.where(F.col(sample) == name), min(0.10, max(0.005, 0.008 * n / 1000)), k, seed).withColumn(sample, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def impute_diffusion(lognorm: DataFrame, edges: DataFrame, steps: int = 3) -> DataFrame:
    """Values smoothed along the neighbour graph ``(query, neighbor, rank, distance)``: a Gaussian kernel
    as wide as each cell's farthest neighbour, made symmetric, rows summing to one, walked ``steps``
    times (a layer of its own; the counts stay as they are). A step is a join and a group-by of the
    stored values; nothing is made dense but by the walk itself."""
    wide = edges.groupBy("query").agg(F.max("distance").alias("w"))
    half = edges.join(wide, "query").select(F.col("query").alias("a"), F.col("neighbor").alias("b"), (0.5 * F.exp(-F.pow(F.col("distance") / F.greatest("w", F.lit(1e-12)), 2))).alias("k"))
    own = half.select("a").union(half.select("b")).distinct().select(F.col("a"), F.col("a").alias("b"), F.lit(1.0).alias("k"))
    both = half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "k")).unionByName(own).groupBy("a", "b").agg(F.sum("k").alias("k"))
    total = both.groupBy("a").agg(F.sum("k").alias("t"))
    p = materialize(both.join(total, "a").select("a", "b", (F.col("k") / F.col("t")).alias("p")), "walk")
    now = lognorm
    for _ in range(steps):
        now = materialize(p.join(now, p.b == now.cell_id).groupBy(F.col("a").alias("cell_id"), "gene_id").agg(F.sum(F.col("p") * F.col("value")).alias("value")), "imputed")
    return now
