"""Cell-by-gene operators on a long matrix ``(cell_id, gene_id, value)`` without zeros.

Zeros are implicit and count: means over cells are sums over the number of cells. Per-gene and
per-cell tables are small beside the matrix; joins on their keys are left to the planner, which
broadcasts them only below its size threshold.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize

# Default limits of the QC filter.
PERCENTILES = {"n_genes_low": 2, "n_genes_high": 98, "total_counts_low": 2, "total_counts_high": 98, "pct_mt_high": 98}


def sparse(entries: DataFrame) -> DataFrame:
    """Canonical long form: duplicates summed, zeros and nulls dropped."""
    return entries.groupBy("cell_id", "gene_id").agg(F.sum("value").alias("value")).where("value <> 0")


def in_bounds(matrix: DataFrame, var: DataFrame) -> DataFrame:
    """Entries whose gene is known; zeros dropped."""
    return matrix.where("value <> 0").join(var.select("gene_id"), "gene_id", "left_semi")


def gene_flags(var: DataFrame, name: str = "gene_name", mt_prefix: str = "MT-") -> DataFrame:
    n = F.col(name)
    return var.withColumns({"is_mt": n.startswith(mt_prefix), "is_ribo": F.upper(n).rlike("^RP[SL]"), "is_hb": n.rlike("(?i)^HB[^(P)]")})


def gene_composition(var: DataFrame, cycle: list[str], name: str = "gene_name") -> DataFrame:
    """One row: how many genes are mitochondrial, ribosomal, haemoglobin and of the cell cycle."""
    n = F.col(name)
    count = lambda c: F.sum(c.cast("bigint"))
    row = var.agg(
        F.count("*").alias("n_genes"), count(n.rlike("^(?i:MT)[-.]")).alias("n_mt"), count(F.upper(n).rlike("^RP[SL]")).alias("n_ribo"),
        count(F.upper(n).rlike("^HB") & ~F.upper(n).rlike("^HBP")).alias("n_hb"), count(F.upper(n).isin(cycle)).alias("n_cycle"),
    )
    return row.select("*", (F.col("n_hb") >= 3).alias("has_hb"), (F.col("n_cycle") >= 2).alias("has_cycle"), F.round(F.col("n_mt") / F.col("n_genes"), 4).alias("mt_fraction"))


def species_vote(var: DataFrame, name: str = "gene_name") -> DataFrame:
    votes = var.agg(F.sum(F.col(name).startswith("MT-").cast("bigint")).alias("human"), F.sum(F.col(name).startswith("mt-").cast("bigint")).alias("mouse"))
    return votes.select("*", F.when(F.col("human") > F.col("mouse"), "human").when(F.col("mouse") > F.col("human"), "mouse").otherwise("unknown").alias("species"))


def qc_metrics(matrix: DataFrame, obs: DataFrame, var: DataFrame) -> DataFrame:
    """Per cell: counts, genes, mitochondrial counts and share, log1p forms. Cells without entries stay."""
    per = (
        matrix.join(gene_flags(var).select("gene_id", "is_mt"), "gene_id")
        .groupBy("cell_id")
        .agg(F.sum("value").alias("t"), F.count("*").alias("g"), F.sum(F.when(F.col("is_mt"), F.col("value")).otherwise(0.0)).alias("m"))
    )
    z = lambda c, k: F.coalesce(c, F.lit(0).cast(k))
    out = obs.join(per, "cell_id", "left").withColumns({"total_counts": z("t", "double"), "n_genes_by_counts": z("g", "bigint"), "total_counts_mt": z("m", "double")}).drop("t", "g", "m")
    return out.withColumns({
        "pct_counts_mt": F.when(F.col("total_counts") > 0, 100 * F.col("total_counts_mt") / F.col("total_counts")).otherwise(0.0),
        "log1p_total_counts": F.log1p("total_counts"), "log1p_n_genes_by_counts": F.log1p("n_genes_by_counts"),
    })


def gene_metrics(matrix: DataFrame, n_cells: int) -> DataFrame:
    per = matrix.groupBy("gene_id").agg(F.count("*").alias("n_cells_by_counts"), F.sum("value").alias("total_counts"))
    return per.withColumns({"mean_counts": F.col("total_counts") / F.lit(n_cells), "pct_dropout": 100 - 100 * F.col("n_cells_by_counts") / F.lit(n_cells)})


def quantiles(df: DataFrame, keys: list[str], asked: dict[str, tuple[str, float]], near: float = 0.005) -> DataFrame:
    """Exact, linearly interpolated quantiles: (keys, alias…) of ``asked = {alias: (column, p)}``. Null
    values don't count. A sketch brackets each quantile within ``near`` of its rank; then values below
    the bracket are only counted, and those within it are counted by distinct value and ranked. So no
    group is gathered in a task, whatever its size."""
    names = [f"__k{i}" for i in range(len(keys) or 1)]  # names of our own, whatever the keys are called
    group = [F.col(k).alias(n) for k, n in zip(keys, names)] or [F.lit(1).alias(names[0])]
    rows = df.select(*group, *(F.col(c).cast("double").alias(f"__v_{a}") for a, (c, _) in asked.items()))
    side = lambda a, p: F.percentile_approx(f"__v_{a}", [max(0.0, p - near), min(1.0, p + near)], 2_000)  # off by 1 / 2,000 at most
    marks = rows.groupBy(*(F.col(k).alias(f"{k}m") for k in names)).agg(*(F.struct(side(a, p).alias("b"), F.count(f"__v_{a}").alias("n")).alias(f"__m_{a}") for a, (_, p) in asked.items()))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"{k}m")) for k in names))
    met = rows.join(F.broadcast(marks) if not keys else marks, same).select(*names, *(c for a in asked for c in (f"__v_{a}", f"__m_{a}")))
    wanted = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(p).alias("p"), F.col(f"__v_{a}").alias("v"), F.col(f"__m_{a}.n").alias("n"), F.get(f"__m_{a}.b", 0).alias("lo"), F.get(f"__m_{a}.b", 1).alias("hi")) for a, (_, p) in asked.items())))
    x = met.select(*names, wanted.alias("w")).select(*names, "w.*").where("v is not null")
    # What lies outside is two rows: how many, and the value next to the bracket (in small groups the
    # rank may be one step outside).
    zone = F.when(F.col("v") < F.col("lo"), -1).when(F.col("v") > F.col("hi"), 1).otherwise(0).alias("z")
    c = x.groupBy(*names, "a", "p", "n", zone, F.when(F.col("v").between(F.col("lo"), F.col("hi")), F.col("v")).alias("u")).agg(F.count("*").alias("k"), F.max("v").alias("top"), F.min("v").alias("low"))
    c = c.withColumn("v", F.when(F.col("z") < 0, F.col("top")).otherwise(F.col("low")))
    ranked = c.withColumn("to", F.sum("k").over(Window.partitionBy(*names, "a").orderBy("v")))
    at = F.col("p") * (F.col("n") - 1)
    pick = lambda r: F.min(F.when(F.col("to") >= r + 1, F.col("v")))
    q = ranked.groupBy(*names, "a").agg(pick(F.floor(at)).alias("x"), pick(F.ceil(at)).alias("y"), F.first(at - F.floor(at)).alias("f"))
    value = F.col("x") + (F.coalesce("y", "x") - F.col("x")) * F.col("f")
    out = q.groupBy(*names).agg(*(F.max(F.when(F.col("a") == a, value)).alias(a) for a in asked))
    return out.select(*(F.col(n).alias(k) for k, n in zip(keys, names)), *asked)


def outliers(qc: DataFrame, method: str = "mad", nmads: float = 5, by: str | None = "sample", limits: dict | None = None, mad_scale: float = 1.0, hard: dict | None = None) -> DataFrame:
    """``qc`` with ``outlier``. Limits are worked out per sample, a row each, and joined back.

    ``mad``: high side of the mitochondrial share, both sides of the logged counts and genes, at the
    median plus or minus ``nmads`` MADs; a MAD of zero flags none. ``percentile``: outside the linear
    percentiles. ``hybrid``: either. ``hard`` adds fixed caps (pct_mt, n_genes_min, n_genes_max).
    """
    keys = [by] if by else []
    lim = PERCENTILES | {k: v for k, v in (limits or {}).items() if v}
    flag = F.lit(False)
    # Three steps read the cells' metrics, which are a join and a group-by of the matrix.
    qc = out = materialize(qc, "qc")
    back = lambda df, stats: df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    if method in ("mad", "hybrid"):
        cols = {"mt": "pct_counts_mt", "c": "log1p_total_counts", "g": "log1p_n_genes_by_counts"}
        out = back(out, quantiles(qc, keys, {f"med_{k}": (c, 0.5) for k, c in cols.items()}))
        off = out.select(*keys, *(F.abs(F.col(c) - F.col(f"med_{k}")).alias(k) for k, c in cols.items()))
        mads = quantiles(off, keys, {f"mad_{k}": (k, 0.5) for k in cols})
        out = back(out, mads.select(*keys, *((F.lit(mad_scale) * F.col(f"mad_{k}")).alias(f"mad_{k}") for k in cols)))
        for k, c in cols.items():
            far = F.col(c) > F.col(f"med_{k}") + nmads * F.col(f"mad_{k}")
            if k != "mt":
                far = far | (F.col(c) < F.col(f"med_{k}") - nmads * F.col(f"mad_{k}"))
            flag = flag | (far & (F.col(f"mad_{k}") > 0))
    if method in ("percentile", "hybrid"):
        p = {"g_lo": ("n_genes_by_counts", "n_genes_low"), "g_hi": ("n_genes_by_counts", "n_genes_high"), "c_lo": ("total_counts", "total_counts_low"), "c_hi": ("total_counts", "total_counts_high"), "m_hi": ("pct_counts_mt", "pct_mt_high")}
        out = back(out, quantiles(qc, keys, {f"p_{a}": (c, lim[k] / 100) for a, (c, k) in p.items()}))
        for a, (c, _) in p.items():
            flag = flag | (F.col(c) < F.col(f"p_{a}") if a.endswith("lo") else F.col(c) > F.col(f"p_{a}"))
    for k, v in (hard or {}).items():
        flag = flag | {"pct_mt": F.col("pct_counts_mt") > v, "n_genes_min": F.col("n_genes_by_counts") < v, "n_genes_max": F.col("n_genes_by_counts") > v}[k]
    return out.withColumn("outlier", flag).select(*qc.columns, "outlier")


def genes_in_cells(matrix: DataFrame, min_cells: int = 3) -> DataFrame:
    """The matrix with genes that occur in ``min_cells`` cells or more."""
    return matrix.join(matrix.groupBy("gene_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_cells).select("gene_id"), "gene_id", "left_semi")


def concat_samples(parts: dict[str, DataFrame], how: str = "inner") -> DataFrame:
    """Samples one below the other: cells get ``sample_`` before their id; ``inner`` keeps genes that
    every sample has, ``outer`` all (absent entries are zeros, so nothing is filled in), ``auto`` those of
    ``inner`` or, where that leaves none, of ``outer``."""
    both = None
    for label, m in parts.items():
        rows = m.select(F.lit(label).alias("sample"), F.concat_ws("_", F.lit(label), F.col("cell_id").cast("string")).alias("cell_id"), "gene_id", "value")
        both = rows if both is None else both.unionByName(rows)
    if how == "outer":
        return both
    shared = both.select("sample", "gene_id").distinct().groupBy("gene_id").agg(F.count("*").alias("n")).where(F.col("n") == len(parts)).select("gene_id")
    if how == "auto" and shared.isEmpty():
        return both  # no gene is shared by all samples: all of them are kept
    return both.join(shared, "gene_id", "left_semi")


def detect_layer(matrix: DataFrame, n_genes: int, log1p: bool = False, normalized: bool = False, probe: int = 256) -> DataFrame:
    """One row: what the values of the first cells (by id) look like. The probe is the feature."""
    cells = matrix.select("cell_id").distinct().orderBy("cell_id").limit(probe)
    s = matrix.join(cells, "cell_id", "left_semi").agg(
        F.countDistinct("cell_id").alias("n_cells"), F.count("*").alias("nnz"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.avg((F.abs(F.col("value") - F.round("value")) <= 1e-6).cast("double")).alias("whole"),
    )
    size = F.col("n_cells") * n_genes
    sparsity = 1 - F.col("nnz") / size
    low = F.when(F.col("nnz") < size, F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))
    layer = (
        F.when(low < 0, "scaled").when(F.lit(log1p), "log1p").when(F.lit(normalized), "normalized").when(F.col("hi") > 20, "counts").when(F.col("whole") >= 0.9, "counts").when(F.col("hi") <= 20, "log1p").otherwise("unknown")
    )
    return s.select("n_cells", low.alias("x_min"), F.col("hi").alias("x_max"), F.round(sparsity, 6).alias("sparsity"), F.round("whole", 6).alias("integer_like"), layer.alias("layer"))


def normalize_log1p(matrix: DataFrame, target: float = 1e4, layer: str = "counts") -> DataFrame:
    """ln(1 + value scaled to ``target`` per cell); log1p passes unchanged, scaled values are refused."""
    if layer == "log1p":
        return matrix
    if layer == "scaled":
        raise ValueError("scaled values can't be normalised; restore the counts first")
    if layer == "normalized":
        return matrix.withColumn("value", F.log1p("value"))
    w = Window.partitionBy("cell_id")
    return matrix.withColumn("value", F.log1p(F.col("value") * target / F.sum("value").over(w)))


def normalize_expression(matrix: DataFrame, method: str = "log1p", **kw) -> tuple[DataFrame, str]:
    """The matrix by ``none``, ``log1p`` or ``pearson``, and the method that was really used;
    ``sctransform`` has no counterpart here and falls back to ``pearson``, which the name tells."""
    if method == "none":
        return matrix, "none"
    if method == "log1p":
        return normalize_log1p(matrix, **kw), "log1p"
    if method in ("pearson", "sctransform"):
        return pearson_residuals(matrix, **kw), "pearson" if method == "pearson" else "pearson (for sctransform)"
    raise ValueError(f"no such normalisation: {method}")


def pearson_residuals(matrix: DataFrame, genes: DataFrame, cells: DataFrame, theta: float = 100.0) -> DataFrame:
    """Analytic residuals (x - mu) / sqrt(mu + mu²/theta), clipped at sqrt(n); dense by nature, so
    only for the ``genes`` given (a few thousand selected ones)."""
    m = matrix.join(genes.select("gene_id"), "gene_id", "left_semi")
    per_cell, per_gene = m.groupBy("cell_id").agg(F.sum("value").alias("nc")), m.groupBy("gene_id").agg(F.sum("value").alias("ng"))
    total = m.agg(F.sum("value").alias("total"))
    n = cells.agg(F.count("*").alias("n"))
    # Every cell meets every selected gene: the result itself has that many rows.
    grid = cells.select("cell_id").join(per_cell, "cell_id", "left").join(F.broadcast(per_gene.crossJoin(total).crossJoin(n)))
    x = grid.join(m, ["cell_id", "gene_id"], "left")
    mu = F.coalesce("nc", F.lit(0.0)) * F.col("ng") / F.col("total")
    z = F.when(mu > 0, (F.coalesce("value", F.lit(0.0)) - mu) / F.sqrt(mu + mu * mu / theta)).otherwise(0.0)
    top = F.sqrt(F.col("n").cast("double"))
    return x.select("cell_id", "gene_id", F.greatest(-top, F.least(top, z)).alias("value"))


def pearson_summary(matrix: DataFrame, genes: DataFrame, cells: DataFrame, theta: float = 100.0) -> DataFrame:
    """(gene_id, mean, top) of :func:`pearson_residuals` without its rows: a zero's residual depends on
    the cell's total alone, so zeros are counted per gene and distinct total, and of single entries
    only the stored ones are met. Totals of counts repeat, so that is far less than all cells."""
    m = matrix.join(genes.select("gene_id"), "gene_id", "left_semi")
    per_cell, per_gene = m.groupBy("cell_id").agg(F.sum("value").alias("nc")), m.groupBy("gene_id").agg(F.sum("value").alias("ng"))
    one = m.agg(F.sum("value").alias("total")).crossJoin(cells.agg(F.count("*").alias("n")))
    all_ = cells.select("cell_id").join(per_cell, "cell_id", "left").select("cell_id", F.coalesce("nc", F.lit(0.0)).alias("nc"))
    mu = F.col("nc") * F.col("ng") / F.col("total")
    top = F.sqrt(F.col("n").cast("double"))
    z = lambda v: F.greatest(-top, F.least(top, F.when(mu > 0, (v - mu) / F.sqrt(mu + mu * mu / theta)).otherwise(0.0)))
    genes_ = F.broadcast(per_gene.crossJoin(one))
    stored = m.join(all_, "cell_id").join(genes_, "gene_id").groupBy("gene_id", "nc").agg(F.count("*").alias("k"), F.sum(z(F.col("value"))).alias("s"), F.max(z(F.col("value"))).alias("hi"))
    grid = all_.groupBy("nc").agg(F.count("*").alias("c")).crossJoin(genes_).join(stored, ["gene_id", "nc"], "left")
    zeros = F.col("c") - F.coalesce("k", F.lit(0))
    zero = z(F.lit(0.0))
    return grid.groupBy("gene_id").agg((F.sum(F.coalesce("s", F.lit(0.0)) + zeros * zero) / F.first("n")).alias("mean"), F.max(F.greatest("hi", F.when(zeros > 0, zero))).alias("top"))


def hvg_dispersion(lognorm: DataFrame, n_cells: int, n_top: int = 2000, n_bins: int = 20) -> DataFrame:
    """Genes by normalised dispersion (variance over mean of the unlogged values, z-scored within
    bins of mean); zeros count. ``highly_variable`` marks the first ``n_top``, ties by gene id."""
    v = F.exp("value") - 1
    per = lognorm.groupBy("gene_id").agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    mean = F.col("s") / n_cells
    var = (F.col("q") - n_cells * mean * mean) / (n_cells - 1)
    per = per.select("gene_id", F.log1p(mean).alias("mean"), F.log(F.when((mean > 0) & (var > 0), var / mean)).alias("dispersion"))
    edges = per.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    per = per.crossJoin(F.broadcast(edges))  # a single row
    width = (F.col("hi") - F.col("lo")) / n_bins
    per = per.withColumn("bin", F.when(width > 0, F.least(F.lit(n_bins - 1), F.floor((F.col("mean") - F.col("lo")) / width))).otherwise(0).cast("int"))
    stats = per.groupBy("bin").agg(F.avg("dispersion").alias("m"), F.stddev_samp("dispersion").alias("sd"))
    out = per.join(stats, "bin").withColumn("dispersion_norm", F.when(F.col("sd") > 0, (F.col("dispersion") - F.col("m")) / F.col("sd")).otherwise(F.when(F.col("dispersion").isNotNull(), 1.0)))
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("dispersion_norm", 9)), "gene_id"))
    return out.select("gene_id", "mean", "dispersion", "dispersion_norm", (rank <= n_top).alias("highly_variable"))


def _trend(x: np.ndarray, y: np.ndarray, span: float = 0.3, knots: int = 256) -> np.ndarray:
    """A local quadratic fit of y on x with tricube weights over the nearest ``span`` of the points,
    worked out at ``knots`` quantiles of x and interpolated between them."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    n, near = len(xs), max(3, int(np.ceil(span * len(xs))))
    at = np.unique(xs[np.linspace(0, n - 1, min(knots, n)).astype(int)])
    fit = np.empty(len(at))
    for i, c in enumerate(at):
        lo = int(np.clip(np.searchsorted(xs, c) - near, 0, max(0, n - near)))
        while lo + near < n and xs[lo + near] - c < c - xs[lo]:
            lo += 1
        px, py = xs[lo : lo + near] - c, ys[lo : lo + near]
        far = max(np.abs(px).max(), 1e-12) * 1.000001
        w = np.sqrt((1 - (np.abs(px) / far) ** 3) ** 3)
        fit[i] = np.linalg.lstsq(np.stack([np.ones_like(px), px, px * px], 1) * w[:, None], py * w, rcond=None)[0][0]
    return np.interp(x, at, fit)


def hvg_counts(counts: DataFrame, obs: DataFrame, n_top: int = 2000, batch: str | None = None, span: float = 0.3) -> DataFrame:
    """(gene_id, mean, variance, variance_norm, n_batches, rank, highly_variable): genes by the variance
    of their counts after it is standardised by the trend of variance over mean, values clipped at the
    root of the number of cells; zeros count. With ``batch`` each batch ranks its genes, and genes are
    taken by the median of the ranks they have among a batch's first ``n_top``, then by in how many
    batches they are, then by id. Only a gene's moments, not its cells, meet in the trend's task."""
    cells = obs.select("cell_id", (F.col(batch) if batch else F.lit("all")).alias("__b"))
    n = cells.groupBy("__b").agg(F.count("*").alias("n"))
    m = counts.join(cells, "cell_id")
    per = m.groupBy("__b", "gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).join(F.broadcast(n), "__b")
    mean = F.col("s") / F.col("n")
    per = per.select("__b", "gene_id", "n", mean.alias("mean"), ((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)).alias("variance"))

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        ok = ((p["variance"] > 0) & (p["mean"] > 0)).to_numpy()
        sd = np.zeros(len(p))
        if ok.any():
            sd[ok] = np.sqrt(10 ** _trend(np.log10(p["mean"].to_numpy()[ok]), np.log10(p["variance"].to_numpy()[ok]), span))
        return p.assign(sd=sd)

    fitted = materialize(per.groupBy("__b").applyInPandas(fit, f"__b {dict(per.dtypes)['__b']}, gene_id {dict(per.dtypes)['gene_id']}, n bigint, mean double, variance double, sd double"), "trend")
    top = F.col("sd") * F.sqrt(F.col("n").cast("double")) + F.col("mean")
    v = F.least(F.col("value").cast("double"), top)
    sums = m.join(fitted, ["__b", "gene_id"]).where("sd > 0").groupBy("__b", "gene_id").agg(F.sum(v).alias("cs"), F.sum(v * v).alias("cq"))
    x = fitted.join(sums, ["__b", "gene_id"], "left")
    norm = (F.col("n") * F.col("mean") * F.col("mean") + F.col("cq") - 2 * F.col("cs") * F.col("mean")) / ((F.col("n") - 1) * F.col("sd") * F.col("sd"))
    x = x.withColumn("variance_norm", F.coalesce(norm, F.lit(0.0)))
    x = x.withColumn("r", F.row_number().over(Window.partitionBy("__b").orderBy(F.desc(F.round("variance_norm", 9)), "gene_id")))
    inside = F.when(F.col("r") <= n_top, F.col("r"))
    genes = x.groupBy("gene_id").agg(F.avg("mean").alias("mean"), F.avg("variance").alias("variance"), F.avg("variance_norm").alias("variance_norm"), F.count(inside).alias("n_batches"), F.median(inside).alias("mid"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("mid"), F.desc("n_batches"), "gene_id"))
    return genes.withColumn("rank", rank).select("gene_id", "mean", "variance", "variance_norm", "n_batches", "rank", ((F.col("rank") <= n_top) & F.col("mid").isNotNull()).alias("highly_variable"))


def hvg_dispersion_batched(lognorm: DataFrame, obs: DataFrame, batch: str, n_top: int = 2000, n_bins: int = 20) -> DataFrame:
    """(gene_id, dispersion_norm, n_batches, highly_variable): genes by dispersion within each batch;
    first those that are variable in most batches, then by their mean over the batches, ties by id."""
    sizes = obs.groupBy(batch).agg(F.count("*").alias("n")).orderBy(batch).collect()  # a row a batch
    every = None
    for b, n in sizes:
        one = lognorm.join(obs.where(F.col(batch) == b).select("cell_id"), "cell_id", "left_semi")
        part = hvg_dispersion(one, n, n_top, n_bins).select("gene_id", "dispersion_norm", "highly_variable")
        every = part if every is None else every.unionByName(part)
    g = every.groupBy("gene_id").agg((F.sum(F.coalesce("dispersion_norm", F.lit(0.0))) / len(sizes)).alias("dispersion_norm"), F.count_if("highly_variable").alias("n_batches"))
    rank = F.row_number().over(Window.orderBy(F.desc("n_batches"), F.desc(F.round("dispersion_norm", 9)), "gene_id"))
    return g.withColumn("highly_variable", rank <= n_top)


def select_hvg(matrix: DataFrame, obs: DataFrame, layer: str, n_top: int = 2000, batch: str | None = None, flavor: str = "counts") -> tuple[DataFrame, str]:
    """(gene_id, highly_variable) and the way they were chosen: by counts where ``layer`` has them,
    else by dispersion of logged values; by batch if there are two or more."""
    several = batch is not None and obs.select(batch).distinct().limit(2).count() > 1
    if flavor == "counts" and layer == "counts":
        return hvg_counts(matrix, obs, n_top, batch if several else None).select("gene_id", "highly_variable"), "counts"
    logged = normalize_log1p(matrix, layer=layer)
    hv = hvg_dispersion_batched(logged, obs, batch, n_top) if several else hvg_dispersion(logged, obs.count(), n_top)
    return hv.select("gene_id", "highly_variable"), "dispersion"


def scale_clip(matrix: DataFrame, cells: DataFrame, genes: DataFrame, clip: float = 10.0) -> DataFrame:
    """z-scores of the selected genes over all cells, zeros included, clipped."""
    n = cells.agg(F.count("*").alias("n"))
    m = matrix.join(genes.select("gene_id"), "gene_id", "left_semi")
    stats = m.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).crossJoin(n)
    sd = F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    stats = stats.select("gene_id", (F.col("s") / F.col("n")).alias("mu"), sd.alias("sd"))
    grid = cells.select("cell_id").join(F.broadcast(stats)).join(m, ["cell_id", "gene_id"], "left")
    z = F.when(F.col("sd") > 0, (F.coalesce("value", F.lit(0.0)) - F.col("mu")) / F.col("sd")).otherwise(0.0)
    return grid.select("cell_id", "gene_id", F.greatest(F.lit(-clip), F.least(F.lit(clip), z)).alias("value"))


def scale_summary(matrix: DataFrame, cells: DataFrame, genes: DataFrame, clip: float = 10.0) -> DataFrame:
    """(gene_id, n, top, low) of :func:`scale_clip` without its rows: the score rises with the value,
    and all zeros of a gene share one."""
    n = cells.agg(F.count("*").alias("n"))
    m = matrix.join(genes.select("gene_id"), "gene_id", "left_semi").join(cells.select("cell_id", F.lit(True).alias("own")), "cell_id", "left")
    v = F.when(F.col("own"), F.col("value"))
    per = m.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count(v).alias("k"), F.max(v).alias("hi"), F.min(v).alias("lo")).crossJoin(F.broadcast(n))
    sd = F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    zero = F.when(F.col("k") < F.col("n"), F.lit(0.0))
    z = lambda x: F.greatest(F.lit(-clip), F.least(F.lit(clip), F.when(F.col("sd") > 0, (x - F.col("s") / F.col("n")) / F.col("sd")).otherwise(0.0)))
    return per.withColumn("sd", sd).select("gene_id", "n", z(F.greatest("hi", zero)).alias("top"), z(F.least("lo", zero)).alias("low"))


def ambient_rho(umi: DataFrame) -> DataFrame:
    """One row: how much of each cell's counts is ambient, from the spread of the totals."""
    q = quantiles(umi, [], {"q10": ("umi", 0.1), "q90": ("umi", 0.9)})
    rho = F.when(F.col("q90") <= 0, 0.05).otherwise(F.greatest(F.lit(0.02), F.least(F.lit(0.25), 0.05 + 0.15 * (1 - F.col("q10") / F.greatest("q90", F.lit(1e-9))))))
    return q.select("q10", "q90", F.coalesce(rho, F.lit(0.05)).alias("rho"))


def remove_ambient(matrix: DataFrame, cells: DataFrame, method: str = "soupx_heuristic", allow_heuristic: bool = False, share: float = 0.02) -> DataFrame:
    """Counts less the expected ambient part, never below zero. Only with ``allow_heuristic``; else
    unchanged. ``soupx_heuristic`` takes the profile of the cells with the fewest counts (2 %, ten at
    least; ties by id), ``decontx_heuristic`` that of all cells at a fixed tenth."""
    if not allow_heuristic:
        return matrix
    umi = cells.select("cell_id").join(matrix.groupBy("cell_id").agg(F.sum("value").alias("u")), "cell_id", "left").select("cell_id", F.coalesce("u", F.lit(0.0)).alias("umi"))
    if method == "decontx_heuristic":
        low, rho = matrix, matrix.sparkSession.range(1).select(F.lit(0.1).alias("rho"))
    else:
        n = max(10, int(share * cells.count()))
        low = matrix.join(umi.orderBy("umi", "cell_id").limit(n).select("cell_id"), "cell_id", "left_semi")
        rho = ambient_rho(umi).select(F.greatest(F.lit(0.01), F.least(F.lit(0.5), F.col("rho"))).alias("rho"))
    sums = low.groupBy("gene_id").agg(F.sum("value").alias("a"))
    profile = sums.crossJoin(F.broadcast(low.agg(F.sum("value").alias("all")))).select("gene_id", (F.col("a") / F.col("all")).alias("p"))
    out = matrix.join(profile, "gene_id", "left").join(umi, "cell_id").crossJoin(F.broadcast(rho))
    return out.select("cell_id", "gene_id", F.greatest(F.lit(0.0), F.col("value") - F.col("rho") * F.col("umi") * F.coalesce("p", F.lit(0.0))).alias("value")).where("value > 0")


def set_score(lognorm: DataFrame, cells: DataFrame, genes: DataFrame, n_cells: int, n_genes: int, name: str, n_bins: int = 25, per_bin: int = 50) -> DataFrame:
    """Mean of a gene set less the mean of control genes from the same bins of mean expression,
    chosen by hash order, so the result is the same on every run."""
    means = lognorm.groupBy("gene_id").agg((F.sum("value") / n_cells).alias("mean"))
    bins = means.withColumn("bin", F.ntile(n_bins).over(Window.orderBy("mean", "gene_id")))
    own = bins.join(genes.select("gene_id"), "gene_id", "left_semi")
    rest = bins.join(genes.select("gene_id"), "gene_id", "left_anti").join(own.select("bin").distinct(), "bin", "left_semi")
    control = rest.withColumn("r", F.row_number().over(Window.partitionBy("bin").orderBy(F.xxhash64("gene_id"), "gene_id"))).where(F.col("r") <= per_bin)
    role = own.select("gene_id", F.lit(1).alias("own")).unionByName(control.select("gene_id", F.lit(0).alias("own")))
    sizes = role.agg(F.sum("own").alias("n1"), F.sum(1 - F.col("own")).alias("n0"))
    per = lognorm.join(role, "gene_id").groupBy("cell_id").agg(F.sum(F.col("value") * F.col("own")).alias("s1"), F.sum(F.col("value") * (1 - F.col("own"))).alias("s0"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = cells.select("cell_id").join(per, "cell_id", "left").crossJoin(F.broadcast(sizes))
    return out.select("cell_id", (z("s1") / F.col("n1") - F.when(F.col("n0") > 0, z("s0") / F.col("n0")).otherwise(0.0)).alias(name))


# Genes of the S and G2/M phases of the human cell cycle; the mouse's are written capitalised.
S_GENES = (
    "MCM5 PCNA TYMS FEN1 MCM2 MCM4 RRM1 UNG GINS2 MCM6 CDCA7 DTL PRIM1 UHRF1 HELLS RFC2 RPA2 NASP RAD51AP1 GMNN WDR76 SLBP CCNE2 UBR7 POLD3 MSH2 ATAD5 RAD51 "
    "RRM2 CDC45 CDC6 EXO1 TIPIN DSCC1 BLM CASP8AP2 USP1 CLSPN POLA1 CHAF1B BRIP1 E2F8"
).split()
G2M_GENES = (
    "HMGB2 CDK1 NUSAP1 UBE2C BIRC5 TPX2 TOP2A NDC80 CKS2 NUF2 CKS1B MKI67 TMPO CENPF TACC3 SMC4 CCNB2 CKAP2L CKAP2 AURKB BUB1 KIF11 ANP32E TUBB4B GTSE1 KIF20B HJURP CDCA3 HN1 "
    "CDC20 TTK CDC25C KIF2C RANGAP1 NCAPD2 DLGAP5 CDCA2 CDCA8 ECT2 KIF23 HMMR AURKA PSRC1 ANLN LBR CKAP5 CENPE CTCF NEK2 G2E3 GAS2L3 CBX5 CENPA"
).split()


def cycle_genes(species: str = "human") -> tuple[list[str], list[str]]:
    mouse = str(species).lower() == "mouse"
    return tuple([g.capitalize() if mouse else g for g in genes] for genes in (S_GENES, G2M_GENES))


def cell_cycle(lognorm: DataFrame, cells: DataFrame, var: DataFrame, species: str = "human", sets: tuple[list[str], list[str]] | None = None, name: str = "gene_name") -> DataFrame:
    """(cell_id, s_score, g2m_score, phase). With under three genes of either set nothing is scored:
    zeros and G1 throughout."""
    s, g = (var.where(F.col(name).isin(genes)).select("gene_id") for genes in sets or cycle_genes(species))
    if s.limit(3).count() < 3 or g.limit(3).count() < 3:
        return cells.select("cell_id", F.lit(0.0).alias("s_score"), F.lit(0.0).alias("g2m_score"), F.lit("G1").alias("phase"))
    n, n_genes = cells.count(), var.count()
    both = set_score(lognorm, cells, s, n, n_genes, "s_score").join(set_score(lognorm, cells, g, n, n_genes, "g2m_score"), "cell_id")
    return both.withColumn("phase", cycle_phase(F.col("s_score"), F.col("g2m_score")))


def regress_cycle(lognorm: DataFrame, cycle: DataFrame, mode: str = "auto", tissue: str | None = None) -> tuple[DataFrame, bool]:
    """The matrix without what the cycle's scores explain, and whether that was done: ``always``, or by
    ``auto`` where 15 % of the cells or more are cycling and the tissue's own biology isn't the cycle."""
    share = cycle.agg(F.avg((F.col("phase") != "G1").cast("double"))).first()[0] or 0.0
    do = mode == "always" or mode == "auto" and (tissue or "").lower() not in ("embryo", "tumor") and share >= 0.15
    return (regress_out(lognorm, cycle, "s_score", "g2m_score") if do else lognorm), do


def cycle_phase(s: Column, g2m: Column) -> Column:
    return F.when(F.greatest(s, g2m) < 0, "G1").when(s >= g2m, "S").otherwise("G2M")


def regress_out(lognorm: DataFrame, cells: DataFrame, x1: str, x2: str) -> DataFrame:
    """Residuals of each gene on two covariates of ``cells`` and an intercept, for stored entries.

    The 3 x 3 normal equations need, per gene, only sums over its stored entries, and sums over all
    cells once, so nothing is densified before the residual itself.
    """
    a = cells.agg(F.count("*").alias("n"), F.sum(x1).alias("s1"), F.sum(x2).alias("s2"), F.sum(F.col(x1) * F.col(x1)).alias("s11"), F.sum(F.col(x2) * F.col(x2)).alias("s22"), F.sum(F.col(x1) * F.col(x2)).alias("s12"))
    m = lognorm.join(cells.select("cell_id", x1, x2), "cell_id")
    g = m.groupBy("gene_id").agg(F.sum("value").alias("y"), F.sum(F.col("value") * F.col(x1)).alias("y1"), F.sum(F.col("value") * F.col(x2)).alias("y2")).crossJoin(F.broadcast(a))
    # Centred sums make it a 2 x 2 system.
    c = lambda p, q, r: F.col(p) - F.col(q) * F.col(r) / F.col("n")
    c11, c22, c12, cy1, cy2 = c("s11", "s1", "s1"), c("s22", "s2", "s2"), c("s12", "s1", "s2"), c("y1", "y", "s1"), c("y2", "y", "s2")
    det = c11 * c22 - c12 * c12
    g = g.select("gene_id", F.when(det != 0, (cy1 * c22 - cy2 * c12) / det).otherwise(0.0).alias("b1"), F.when(det != 0, (cy2 * c11 - cy1 * c12) / det).otherwise(0.0).alias("b2"), (F.col("y") / F.col("n")).alias("my"), (F.col("s1") / F.col("n")).alias("m1"), (F.col("s2") / F.col("n")).alias("m2"))
    fit = F.col("my") + F.col("b1") * (F.col(x1) - F.col("m1")) + F.col("b2") * (F.col(x2) - F.col("m2"))
    return m.join(g, "gene_id").select("cell_id", "gene_id", (F.col("value") - fit).alias("value"))


def doublet_rate(n: Column) -> Column:
    return F.least(F.lit(0.10), F.greatest(F.lit(0.005), 0.008 * n / 1000.0))


def doublet_tiers(df: DataFrame, first: str, second: str | None = None, second_score: str | None = None, first_score: str | None = None, high: float = 0.8) -> DataFrame:
    """``tier`` and ``discordant``. Two methods: high where both call it and the second is sure, low
    where one calls it or the second isn't sure; one method: split by its score."""
    a = F.col(first)
    if second is None:
        tier = F.when(a & (F.col(first_score) > high), "high_conf").when(a, "low_conf").otherwise("singlet")
    else:
        b = F.col(second)
        tier = F.when(a & b & (F.col(second_score) > high), "high_conf").when(a | b, "low_conf").otherwise("singlet")
    return df.withColumn("tier", tier).withColumn("discordant", F.col("tier") == "low_conf")


def doublet_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    row = df.agg(F.sum((F.col(a) & F.col(b)).cast("bigint")).alias("n_both"), F.sum((F.col(a) != F.col(b)).cast("bigint")).alias("n_discordant"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))
    return row.select(F.coalesce("n_both", F.lit(0)).alias("n_both"), F.coalesce("n_discordant", F.lit(0)).alias("n_discordant"), F.round(F.coalesce("agreement", F.lit(1.0)), 6).alias("agreement"))


def without_doublets(df: DataFrame, which: str = "high_conf") -> DataFrame:
    return df.where("tier = 'singlet'" if which == "all" else "tier <> 'high_conf'")


# Tissues where doublets are cross-checked.
COMPLEX_TISSUES = {"tumor", "brain", "heart", "kidney", "liver", "embryo"}


def doublet_methods(asked: str | None = None, tissue: str | None = None, n_samples: int | None = None) -> list[str]:
    """The methods to run: a second one if asked for, with several samples, or in a complex tissue."""
    req = (asked or "auto").strip().lower()
    second = req in ("both", "scdblfinder", "cross") or req != "scrublet" and ((n_samples or 1) > 1 or (tissue or "default").lower() in COMPLEX_TISSUES)
    return ["scrublet", "scdblfinder"] if second else ["scrublet"]


def choose_ambient(asked: str | None = None) -> str:
    """The ambient method: the one asked for by name, none by itself, as no outside program is bound."""
    req = (asked or "auto").lower()
    return req if req in ("soupx", "decontx", "soupx_heuristic", "decontx_heuristic") else "none"


def scores_by_barcode(cells: DataFrame, scores: DataFrame, barcode: str = "barcode") -> DataFrame | None:
    """``scores(barcode, score, class, no)`` of another program on the cells ``(cell_id, no)``: by barcode
    if every cell has one, else by place if there are as many rows as cells, else None: scores of a
    part of the cells aren't taken."""
    last = scores.groupBy(F.col(barcode).cast("string").alias("__b")).agg(F.max_by("score", "no").alias("score"), F.max_by("class", "no").alias("class"))
    value = [F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), (F.lower(F.coalesce("class", F.lit(""))) == "doublet").alias("doublet")]
    if cells.join(last, F.col("cell_id").cast("string") == F.col("__b"), "left_anti").isEmpty():
        return cells.join(last, F.col("cell_id").cast("string") == F.col("__b")).select("cell_id", *value)
    if scores.count() == cells.count():
        return cells.join(scores.select("no", "score", "class"), "no").select("cell_id", *value)
    return None


def detect_doublets(cells: DataFrame, calls: dict[str, DataFrame], wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Tiers per cell and a summary row. ``calls`` has ``(cell_id, doublet, score)`` of each method that
    ran, the first method first; the final score is the largest of them. Status is ``ok``, ``partial``
    where a second method was wanted and only one ran, ``failed`` where none did."""
    names = list(calls)[:2]
    x = cells.select("cell_id")
    for i, n in enumerate(names):
        x = x.join(calls[n].select("cell_id", F.col("doublet").alias(f"__c{i}"), F.col("score").alias(f"__s{i}")), "cell_id", "left").na.fill({f"__s{i}": 0.0}).withColumn(f"__c{i}", F.coalesce(f"__c{i}", F.lit(False)))
    if not names:
        x = x.withColumns({"tier": F.lit("singlet"), "doublet_score": F.lit(0.0), "discordant": F.lit(False)})
        agree, differ = F.lit(0.0), F.lit(0).cast("bigint")
    elif len(names) == 1:
        x = doublet_tiers(x, "__c0", first_score="__s0").withColumn("doublet_score", F.col("__s0"))
        agree, differ = F.lit(1.0), F.lit(0).cast("bigint")
    else:
        x = doublet_tiers(x, "__c0", "__c1", "__s1").withColumn("doublet_score", F.greatest("__s0", "__s1"))
        agree, differ = F.coalesce(F.avg((F.col("__c0") == F.col("__c1")).cast("double")), F.lit(1.0)), F.count_if(F.col("__c0") != F.col("__c1"))
    status = "failed" if not names else "partial" if len(names) == 1 and len(wanted or names) > 1 else "ok"
    tier = lambda t: F.count_if(F.col("tier") == t)
    share = lambda c: F.coalesce(F.try_divide(c, F.count("*")), F.lit(0.0))
    info = x.agg(
        F.lit(status).alias("status"), F.lit(",".join(names)).alias("methods"), tier("high_conf").alias("n_high_conf"), tier("low_conf").alias("n_low_conf"), tier("singlet").alias("n_singlet"),
        share(F.count_if(F.col("tier") != "singlet")).alias("rate"), F.round(share(tier("high_conf")), 4).alias("rate_high_conf"), F.round(share(tier("low_conf")), 4).alias("rate_low_conf"),
        F.round(agree, 4).alias("agreement"), differ.alias("n_discordant"),
    )
    return x.select("cell_id", "tier", (F.col("tier") != "singlet").alias("predicted"), "doublet_score", "discordant"), info


def second_method(columns: list[str]) -> str | None:
    """The second method of doublets that is there: the outside one before the simulation."""
    return next((c for c in ("scdblfinder", "sim") if c in columns), None)


def counts_layer(layers: dict[str, DataFrame], values: DataFrame) -> DataFrame:
    """The counts: a layer of that name, else the raw matrix, else the values if one exceeds 50; without
    any it is refused."""
    for name in ("counts", "raw"):
        if name in layers:
            return layers[name]
    if (values.agg(F.max("value")).first()[0] or 0) > 50:
        return values
    raise ValueError("no counts: neither a layer, nor a raw matrix, nor values above 50")
