"""Summaries: modes, compositions, histograms, trends and the nearest-rank percentile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def modes(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value per group, the smallest on a tie."""
    c = df.groupBy(by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), value)
    return c.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(by, F.col(value).alias("mode"), "n")


def _marked(obs: DataFrame, selection: DataFrame) -> DataFrame:
    return obs.join(selection.select("cell_id").distinct().withColumn("__in", F.lit(True)), "cell_id", "left").withColumn("__in", F.coalesce("__in", F.lit(False)))


def composition(obs: DataFrame, selection: DataFrame, column: str) -> DataFrame:
    """Counts of a column's values within and outside a selection of cells."""
    m = _marked(obs, selection)
    return m.groupBy(F.col(column).alias("value")).agg(F.sum(F.col("__in").cast("bigint")).alias("n_in"), F.sum((~F.col("__in")).cast("bigint")).alias("n_rest"))


def in_and_out(matrix: DataFrame, obs: DataFrame, selection: DataFrame) -> DataFrame:
    """Per gene the mean over the selected and over the other cells, zeros included."""
    m = _marked(obs.select("cell_id"), selection)
    n = m.agg(F.sum(F.col("__in").cast("bigint")).alias("a"), F.sum((~F.col("__in")).cast("bigint")).alias("b"))
    per = matrix.join(m, "cell_id").groupBy("gene_id").agg(F.sum(F.when(F.col("__in"), F.col("value")).otherwise(0.0)).alias("sa"), F.sum(F.when(~F.col("__in"), F.col("value")).otherwise(0.0)).alias("sb"))
    mean = lambda s, k: F.when(F.col(k) > 0, F.col(s) / F.col(k))
    return per.crossJoin(F.broadcast(n)).select("gene_id", mean("sa", "a").alias("mean_in"), mean("sb", "b").alias("mean_rest"))


def histogram(df: DataFrame, by: str, value: str, bins: int = 24) -> DataFrame:
    """(by, bin, lo, hi, n): bins of equal width, the last one closed; a single value gets width one."""
    rows = df.where(F.col(value).isNotNull())
    r = rows.groupBy(by).agg(F.min(value).alias("a"), F.max(value).alias("b")).withColumn("b", F.when(F.col("b") <= F.col("a"), F.col("a") + 1).otherwise(F.col("b")))
    w = (F.col("b") - F.col("a")) / bins
    x = rows.join(r, by).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("a")) / w)).cast("int"))
    c = x.groupBy(by, "bin", "a", "b").agg(F.count("*").alias("n"))
    return c.select(by, "bin", (F.col("a") + F.col("bin") * (F.col("b") - F.col("a")) / bins).alias("lo"), (F.col("a") + (F.col("bin") + 1) * (F.col("b") - F.col("a")) / bins).alias("hi"), "n")


def trend(df: DataFrame, by: str, x: str, y: str, edges: int = 12) -> DataFrame:
    """(by, bin, n, mean) of y over edges - 1 bins of x; the greatest x falls outside, as it lies on
    the last edge."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = rows.groupBy(by).agg(F.min(x).alias("a"), F.max(x).alias("b")).where("b > a")
    z = rows.join(r, by).where(F.col(x) < F.col("b")).withColumn("bin", F.floor((F.col(x) - F.col("a")) / ((F.col("b") - F.col("a")) / (edges - 1))).cast("int"))
    return z.groupBy(by, "bin").agg(F.count("*").alias("n"), F.avg(y).alias("mean"))


def nearest_rank(df: DataFrame, by: str, value: str, qs: list[float]) -> DataFrame:
    """Percentiles at the index q * (n - 1), rounded half to even. Equal values are counted first, so a
    group is never gathered: the index is looked up in a running count of its distinct values."""
    c = df.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = c.withColumn("to", F.sum("c").over(Window.partitionBy(by).orderBy("v"))).join(c.groupBy(by).agg(F.sum("c").alias("n")), by)
    at = lambda q: F.bround(F.lit(q) * (F.col("n") - 1)) + 1
    return upto.groupBy(by).agg(*(F.min(F.when(F.col("to") >= at(q), F.col("v"))).alias(f"p{round(q * 100)}") for q in qs))


# How many cells a viewer shows, and what it may colour them by.
SHOWN = 15_000
COLOURS = ("leiden", "cluster", "cell_type", "cell_type_l1", "annotation_status", "sample", "predicted_doublet", "doublet_call")


def subsample(df: DataFrame, most: int = SHOWN, id: str = "cell_id", seed: int = 0) -> DataFrame:
    """At most ``most`` rows, the same on every run: the first by a hash of the id. For drawing only."""
    return df.orderBy(F.xxhash64(id, F.lit(seed)), id).limit(most)


def viewer_points(obs: DataFrame, points: DataFrame, most: int = SHOWN, qc: tuple[str, ...] = ("n_genes_by_counts", "total_counts", "pct_counts_mt")) -> DataFrame:
    """(cell_id, x, y, …) of the cells a viewer shows: places, the columns to colour by as text, QC values
    with no number as null. ``points(cell_id, vec)``; cells without one stand at the origin."""
    shown = subsample(obs, most).join(points.select("cell_id", "vec"), "cell_id", "left")
    xy = [F.coalesce(F.get("vec", i).cast("double"), F.lit(0.0)).alias(n) for i, n in enumerate("xy")]
    return shown.select("cell_id", *xy, *(F.col(c).cast("string").alias(c) for c in COLOURS if c in obs.columns), *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in qc if c in obs.columns))


def dotted(config: dict, path: str, default: object = None) -> object:
    """A nested value by its dotted path."""
    now: object = config
    for part in path.split("."):
        if not isinstance(now, dict) or part not in now:
            return default
        now = now[part]
    return now


def overlaid(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``, dictionaries laid over each other to any depth."""
    return base | {k: overlaid(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def metric_lines(logs: DataFrame, text: str = "text") -> DataFrame:
    """(…, name, value) of every ``name=value`` in a log's lines, as text."""
    pairs = F.regexp_extract_all(text, F.lit(r"(?m)(?:^|\s)([A-Za-z_]\w*=[^\s=]+)(?=\s|$)"), F.lit(1))
    return logs.select(*[c for c in logs.columns if c != text], F.explode(pairs).alias("p")).select(*[c for c in logs.columns if c != text], F.substring_index("p", "=", 1).alias("name"), F.substring_index("p", "=", -1).alias("value"))
