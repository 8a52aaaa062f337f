"""Differential statistics: pseudobulk, tests, false-discovery control, over-representation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.special import hypergeom_tail, t_pvalue, z_pvalue

GROUP = ["sample", "condition", "cell_type"]


def pseudobulk(matrix: DataFrame, obs: DataFrame) -> DataFrame:
    """Counts summed per (sample, condition, cell_type) and gene. Long, never pivoted."""
    return matrix.join(obs.select("cell_id", *GROUP), "cell_id").groupBy(*GROUP, "gene_id").agg(F.sum("value").alias("count"))


def group_sizes(obs: DataFrame, min_cells: int = 10) -> DataFrame:
    return obs.groupBy(*GROUP).agg(F.count("*").alias("n_cells")).withColumn("kept", F.col("n_cells") >= min_cells)


def replicates(obs: DataFrame) -> DataFrame:
    """Samples per condition, and the least of them on every row."""
    per = obs.groupBy("condition").agg(F.countDistinct("sample").alias("n_samples"))
    return per.crossJoin(F.broadcast(per.agg(F.min("n_samples").alias("n_replicates"))))


def confounding(obs: DataFrame, batch: str = "sample", condition: str = "condition") -> DataFrame:
    row = obs.agg(F.countDistinct(batch).alias("n_batches"), F.countDistinct(condition).alias("n_conditions"), F.countDistinct(F.struct(batch, condition)).alias("n_pairs"))
    return row.withColumn("confounded", (F.col("n_batches") > 1) & (F.col("n_batches") == F.col("n_conditions")) & (F.col("n_pairs") == F.col("n_batches")))


def blocks(obs: DataFrame, min_cells: int = 10, min_replicates: int = 2) -> DataFrame:
    """(cell_type, a, b): cell types with exactly two conditions, each with enough samples."""
    groups = group_sizes(obs, min_cells).where("kept")
    per = groups.groupBy("cell_type", "condition").agg(F.countDistinct("sample").alias("n"))
    both = per.groupBy("cell_type").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.min("condition").alias("a"), F.max("condition").alias("b"))
    return both.where((F.col("k") == 2) & (F.col("least") >= min_replicates)).select("cell_type", "a", "b")


def pseudobulk_welch(matrix: DataFrame, obs: DataFrame, min_cells: int = 10, min_replicates: int = 2) -> DataFrame:
    """Welch's t of ln(1 + CPM) between a cell type's two conditions: (cell_type, gene_id, logFC, t,
    df, pval, group_a, group_b). Samples without a gene's counts enter as zeros."""
    pairs = blocks(obs, min_cells, min_replicates)
    kept = group_sizes(obs, min_cells).where("kept").select(*GROUP).join(pairs, "cell_type").where("condition in (a, b)")
    bulk = pseudobulk(matrix, obs).join(kept, GROUP)
    w = Window.partitionBy(*GROUP)
    logged = bulk.withColumn("x", F.log1p(F.col("count") * 1e6 / F.sum("count").over(w)))
    n = kept.groupBy("cell_type", "condition").agg(F.count("*").alias("n"))
    sums = logged.groupBy("cell_type", "gene_id", "condition", "a", "b").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    side = F.col("condition") == F.col("b")
    wide = sums.groupBy("cell_type", "gene_id", "a", "b").agg(*(F.sum(F.when(c, F.col(v)).otherwise(0.0)).alias(f"{v}_{k}") for k, c in (("a", ~side), ("b", side)) for v in ("s", "q")))
    na = pairs.join(n, "cell_type").groupBy("cell_type").agg(F.sum(F.when(F.col("condition") == F.col("a"), F.col("n"))).alias("n_a"), F.sum(F.when(F.col("condition") == F.col("b"), F.col("n"))).alias("n_b"))
    x = wide.join(na, "cell_type")
    for k in "ab":
        x = x.withColumn(f"m_{k}", F.col(f"s_{k}") / F.col(f"n_{k}"))
        x = x.withColumn(f"e_{k}", F.greatest(F.lit(0.0), (F.col(f"q_{k}") - F.col(f"n_{k}") * F.col(f"m_{k}") * F.col(f"m_{k}")) / (F.col(f"n_{k}") - 1)) / F.col(f"n_{k}"))
    se = F.col("e_a") + F.col("e_b")
    x = x.withColumns({"logFC": F.col("m_b") - F.col("m_a"), "t": F.when(se > 1e-18, (F.col("m_b") - F.col("m_a")) / F.sqrt(se)),
        "df": F.when(se > 1e-18, se * se / (F.col("e_a") * F.col("e_a") / (F.col("n_a") - 1) + F.col("e_b") * F.col("e_b") / (F.col("n_b") - 1)))})
    return x.select("cell_type", "gene_id", "logFC", "t", "df", F.coalesce(F.nanvl(t_pvalue("t", "df"), F.lit(None).cast("double")), F.lit(1.0)).alias("pval"), F.col("a").alias("group_a"), F.col("b").alias("group_b"))


def pseudobulk_de(matrix: DataFrame, obs: DataFrame, engine: str = "ttest", confirmatory: bool = False, engines: dict[str, Callable[[DataFrame], DataFrame]] | None = None, **kw) -> DataFrame:
    """DE rows of the chosen engine; a t-test is refused where a confirmatory result is asked for.
    ``engines`` plugs in others: each takes the pseudobulk counts and returns the same columns."""
    if engine in (engines or {}):
        return bh_fdr(engines[engine](pseudobulk(matrix, obs)), ["cell_type"])
    if engine != "ttest":
        raise ValueError(f"no engine {engine!r} is plugged in")
    if confirmatory:
        raise ValueError("a t-test isn't accepted for a confirmatory result; plug in a count-model engine")
    # Every gene of the matrix is a test of every cell type; those it never shows have a p of 1.
    genes = matrix.agg(F.countDistinct("gene_id").alias("n"))
    return bh_fdr(pseudobulk_welch(matrix, obs, **kw), ["cell_type"], tests=genes).where("not (fdr > 0.2 and abs(logFC) < 0.25)")


def bh_fdr(df: DataFrame, by: list[str], p: str = "pval", into: str = "fdr", tests: DataFrame | None = None) -> DataFrame:
    """Benjamini-Hochberg within each group; a null or NaN p counts as 1. ``tests``, one row with a
    number, says how many tests a group has where those without a row all had a p of 1."""
    v = F.coalesce(F.nanvl(F.col(p), F.lit(1.0)), F.lit(1.0))
    ranked = df.withColumn("__p", v).withColumn("__m", F.count("*").over(Window.partitionBy(*by)))
    # Tied p-values take the last of their ranks, which the running minimum would give them anyway.
    ranked = ranked.withColumn("__r", F.count("*").over(Window.partitionBy(*by).orderBy("__p").rangeBetween(Window.unboundedPreceding, 0)))
    down = Window.partitionBy(*by).orderBy(F.desc("__p")).rangeBetween(Window.unboundedPreceding, 0)
    if tests is not None:
        ranked = ranked.crossJoin(F.broadcast(tests.select(F.col(tests.columns[0]).alias("__t")))).withColumn("__m", F.greatest("__m", "__t")).drop("__t")
    return ranked.withColumn(into, F.least(F.lit(1.0), F.min(F.col("__p") * F.col("__m") / F.col("__r")).over(down))).drop("__p", "__m", "__r")


def significant(de: DataFrame, fdr: float = 0.05, gene: str = "gene_id") -> DataFrame:
    """Rows at or under the limit; a value that is no number is skipped, a missing one counts as 1."""
    text = F.col("fdr").cast("string")
    value = F.when(F.col("fdr").isNull(), 1.0).otherwise(text.try_cast("double"))
    return de.where((value <= fdr) & (F.trim(F.col(gene).cast("string")) != ""))


def jaccard(a: DataFrame, b: DataFrame, gene: str = "gene_id", keep: int = 200) -> DataFrame:
    """One row: sizes, overlap, Jaccard (4 digits) and the first shared genes in order."""
    x, y = a.select(gene).distinct(), b.select(gene).distinct()
    both = x.join(y, gene).select(gene)
    first = both.orderBy(gene).limit(keep).agg(F.sort_array(F.collect_list(F.col(gene).cast("string"))).alias("shared"))
    n = x.agg(F.count("*").alias("n_a")).crossJoin(y.agg(F.count("*").alias("n_b"))).crossJoin(both.agg(F.count("*").alias("n_overlap")))
    union = F.col("n_a") + F.col("n_b") - F.col("n_overlap")
    return n.crossJoin(first).withColumn("jaccard", F.when(union > 0, F.round(F.col("n_overlap") / union, 4)).otherwise(0.0))


def rank_genes_ttest(lognorm: DataFrame, obs: DataFrame, by: str = "cluster") -> DataFrame:
    """One group against the rest by Welch's t over all cells, zeros included."""
    groups = obs.groupBy(by).agg(F.count("*").alias("n1"))
    n = obs.agg(F.count("*").alias("n"))
    per = lognorm.join(obs.select("cell_id", by), "cell_id").groupBy(by, "gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    every = per.groupBy("gene_id").agg(F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    x = every.crossJoin(F.broadcast(groups.crossJoin(n))).join(per, [by, "gene_id"], "left").na.fill(0.0, ["s", "q"])
    n1, n2 = F.col("n1"), F.col("n") - F.col("n1")
    m1, m2 = F.col("s") / n1, (F.col("ts") - F.col("s")) / n2
    v1, v2 = (F.col("q") - n1 * m1 * m1) / (n1 - 1) / n1, (F.col("tq") - F.col("q") - n2 * m2 * m2) / (n2 - 1) / n2
    se = v1 + v2
    x = x.select(by, "gene_id", m1.alias("mean_in"), m2.alias("mean_rest"), F.when(se > 1e-18, (m1 - m2) / F.sqrt(se)).alias("t"), F.when(se > 1e-18, se * se / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1))).alias("df"))
    return x.withColumn("pval", F.coalesce(F.nanvl(t_pvalue("t", "df"), F.lit(1.0)), F.lit(1.0)))


def rank_genes_wilcoxon(lognorm: DataFrame, obs: DataFrame, by: str = "cluster") -> DataFrame:
    """One group against the rest by rank sums. The zeros of a gene are one tied block, so only its
    stored values are ranked: equal values are counted first, ranks come from a running count of the
    distinct values, not of the cells."""
    n = obs.agg(F.count("*").alias("n"))
    groups = obs.groupBy(by).agg(F.count("*").alias("n1"))
    m = lognorm.join(obs.select("cell_id", by), "cell_id").select("gene_id", by, "value")
    counts = m.groupBy("gene_id", "value").agg(F.count("*").alias("c"))
    nnz = counts.groupBy("gene_id").agg(F.sum("c").alias("nnz"))
    w = Window.partitionBy("gene_id").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    # Negative values come before the zeros.
    ranks = counts.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))).join(nnz, "gene_id").crossJoin(F.broadcast(n))
    zeros = F.col("n") - F.col("nnz")
    ranks = ranks.select("gene_id", "value", (F.col("before") + F.when(F.col("value") > 0, zeros).otherwise(0) + (F.col("c") + 1) / 2).alias("r"), "c")
    below = counts.groupBy("gene_id").agg(F.sum(F.when(F.col("value") < 0, F.col("c")).otherwise(0)).alias("neg"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties")).join(nnz, "gene_id")
    per = m.groupBy("gene_id", "value", by).agg(F.count("*").alias("k")).join(ranks, ["gene_id", "value"]).groupBy("gene_id", by).agg(F.sum(F.col("r") * F.col("k")).alias("rs"), F.sum("k").alias("k"))
    x = below.crossJoin(F.broadcast(groups.crossJoin(n))).join(per, ["gene_id", by], "left").na.fill(0, ["rs", "k"])
    z0 = (F.col("n") - F.col("nnz")).cast("double")
    rank_sum = F.col("rs") + (F.col("n1") - F.col("k")) * (F.col("neg") + (z0 + 1) / 2)
    nn, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    ties = F.col("ties") + z0 * z0 * z0 - z0
    sd = F.sqrt(n1 * (nn - n1) / 12.0 * ((nn + 1) - ties / (nn * (nn - 1))))
    out = x.select(by, "gene_id", rank_sum.alias("rank_sum"), F.when(sd > 0, (rank_sum - n1 * (nn + 1) / 2) / sd).otherwise(0.0).alias("z"))
    return out.withColumn("pval", z_pvalue("z"))


def top_markers(ranked: DataFrame, by: str = "cluster", score: str = "t", k: int = 25, fdr: float = 0.05) -> DataFrame:
    """The first ``k`` genes of each group at or under the limit, best score first, ties by gene."""
    w = Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), "gene_id")
    return ranked.where(F.col("fdr") <= fdr).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distinct_markers(top: DataFrame, by: str = "cluster") -> DataFrame:
    """Markers of all groups, each where it comes first by group and rank."""
    return top.groupBy("gene_id").agg(F.min(F.struct(by, "rank")).alias("f")).select("gene_id", F.col(f"f.{by}").alias(by), F.col("f.rank").alias("rank"))


def ora(query: DataFrame, sets: DataFrame, background: DataFrame | None = None, min_overlap: int = 2, gene: str = "gene", most: int | None = None) -> DataFrame:
    """Over-representation of ``query(gene)`` in ``sets(term, gene)``: hypergeometric tail, BH over the
    terms that reach ``min_overlap``. Without a background it is the query and all members."""
    up = lambda df, *keep: df.select(*keep, F.upper(F.trim(F.col(gene).cast("string"))).alias("g")).where("g <> ''").distinct()
    q, s = up(query), up(sets, "term")
    bg = up(background) if background is not None else q.unionByName(s.select("g")).distinct()
    q, s = q.join(bg, "g", "left_semi"), s.join(bg, "g", "left_semi")
    sizes = s.groupBy("term").agg(F.count("*").alias("set_size"))
    hit = s.join(q, "g").groupBy("term").agg(F.count("*").alias("overlap"), F.sort_array(F.collect_list("g")).alias("genes")).where(F.col("overlap") >= min_overlap)
    n = q.agg(F.count("*").alias("query_size")).crossJoin(bg.agg(F.count("*").alias("n_background")))
    out = hit.join(sizes, "term").crossJoin(F.broadcast(n))
    c = lambda k: F.col(k).cast("bigint")
    out = out.withColumn("pval", hypergeom_tail(c("overlap"), c("set_size"), c("query_size"), c("n_background")))
    # All terms are one family; a term list is short, so its single window is too.
    out = bh_fdr(out.withColumn("__f", F.lit(1)), ["__f"]).drop("__f").withColumn("method", F.lit("ora_hypergeom"))
    return out if most is None else out.orderBy("pval", F.desc("overlap"), "term").limit(most)


def score_groups(df: DataFrame, by: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user's function per group, as a grouped map."""
    return df.groupBy(by).applyInPandas(fn, schema)


# Names under which people choose a test of markers, and what each stands for.
_MARKER_TESTS = {"wilcoxon": "wilcoxon", "t-test": "t-test", "ttest": "t-test", "t_test": "t-test", "t test": "t-test", "mast": "mast"}
_OFF, _CELL_LEVEL = {"off", "false", "0", "no", "none"}, {"ttest", "t-test", "wilcoxon", "mast"}


def _said(asked: object) -> str:
    return str("auto" if asked is None or asked == "" else asked).strip().lower()


def marker_method(asked: str | None) -> str:
    """The test of markers: the one asked for, Wilcoxon for anything else."""
    return _MARKER_TESTS.get(_said(asked), "wilcoxon")


def other_marker_method(method: str) -> str:
    """The test that markers are cross-checked with."""
    return "t-test" if method == "wilcoxon" else "wilcoxon"


def other_engine(engine: str | None) -> str:
    """The engine that pseudobulk results are cross-checked with."""
    return "edger" if "deseq" in _said(engine) or "ttest" in _said(engine) or _said(engine) == "t-test" else "deseq2"


def cross_validates(asked: object, explicit: bool | None = None) -> bool:
    """Whether results are cross-checked: what is said outright, else yes unless it is switched off."""
    return explicit if explicit is not None else _said(asked) not in _OFF


def confirmatory_engine(asked: str | None) -> str:
    """The engine where pseudobulk is a must: tests of single cells give way to the automatic choice."""
    return "auto" if _said(asked) in _CELL_LEVEL else _said(asked)


def needs_pseudobulk(condition: str | None, planned: bool, n_replicates: int | None, n_samples: int | None) -> bool:
    return bool(condition) and (planned or (n_replicates if n_replicates is not None else n_samples or 0) >= 2)


def genes_of_groups(ranked: DataFrame, by: str = "cluster", n: int = 100) -> DataFrame:
    """(gene_id, at) for an enrichment from ranked markers ``(by, gene_id, rank)``: of each group, in
    the groups' order, the first max(10, n / groups) genes, until a group's end where ``n`` are there."""
    groups = ranked.agg(F.countDistinct(by).alias("__g"))
    each = F.greatest(F.lit(10), F.floor(F.lit(n) / F.greatest("__g", F.lit(1))))
    first = ranked.crossJoin(F.broadcast(groups)).where(F.col("rank") <= each)
    sizes = first.groupBy(by).agg(F.count("*").alias("__n"))
    before = sizes.select(by, (F.sum("__n").over(Window.orderBy(by)) - F.col("__n")).alias("__before"))  # a row a group
    rows = first.join(before, by).where(F.col("__before") < n)
    return rows.select("gene_id", (F.col("__before") + F.row_number().over(Window.partitionBy(by).orderBy("rank"))).alias("at"))


def top_variance(matrix: DataFrame, n_cells: int, most: int = 80) -> DataFrame:
    """(gene_id, variance): the genes of the largest variance over all cells, zeros included; ties by id."""
    s = matrix.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    v = (F.col("q") - F.col("s") * F.col("s") / n_cells) / n_cells
    return s.select("gene_id", v.alias("variance")).orderBy(F.desc(F.round("variance", 9)), "gene_id").limit(most)


def factorize(df: DataFrame, column: str, into: str = "code") -> DataFrame:
    """``df`` with the place of each row's value among the sorted distinct ones, which are few beside the rows."""
    codes = df.select(column).distinct().where(F.col(column).isNotNull())
    codes = codes.select(F.col(column).alias("__v"), (F.row_number().over(Window.orderBy(column)) - 1).alias(into))
    return df.join(codes, F.col(column) == F.col("__v"), "left").drop("__v")


def pathway_points(ora: DataFrame, most: int = 20) -> DataFrame:
    """(term, x, size, colour): what a plot of enriched terms shows, most significant first."""
    p = F.greatest("fdr", F.lit(1e-300))
    return ora.orderBy("pval", F.desc("overlap"), "term").limit(most).select("term", (F.col("overlap") / F.greatest("set_size", F.lit(1))).alias("x"), F.col("overlap").alias("size"), (-F.log10(p)).alias("colour"))
