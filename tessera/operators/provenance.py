"""Snapshots and branches, manifests, fingerprints, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOTS = "thread string, step int, phase string, matrix_path string, obs_path string, fingerprint string, parent int, taken_at timestamp"


def fingerprint(matrix: DataFrame) -> DataFrame:
    """One row: shape and an order-free digest of the whole matrix (combined map-side)."""
    return matrix.agg(F.countDistinct("cell_id").alias("n_cells"), F.countDistinct("gene_id").alias("n_genes"), F.count("*").alias("n_entries"), F.bit_xor(F.conv(F.substring(F.md5(F.concat_ws("|", "cell_id", "gene_id", "value")), 1, 15), 16, 10).cast("bigint")).alias("digest"))


def record(snapshots: DataFrame, thread: str, step: int, phase: str, matrix_path: str, obs_path: str, digest: str) -> DataFrame:
    """The table with one more snapshot. Where the parent's matrix is the same, its path is kept, so
    only the cell table is new."""
    spark = snapshots.sparkSession
    last = snapshots.where((F.col("thread") == thread) & (F.col("step") < step)).orderBy(F.desc("step")).limit(1)
    new = spark.range(1).select(F.lit(thread).alias("thread"), F.lit(step).alias("step"), F.lit(phase).alias("phase"), F.lit(matrix_path).alias("m"), F.lit(obs_path).alias("obs_path"), F.lit(digest).alias("fingerprint"))
    met = new.join(F.broadcast(last.select(F.col("thread").alias("t"), F.col("step").alias("parent"), F.col("matrix_path").alias("pm"), F.col("fingerprint").alias("pf"))), F.col("thread") == F.col("t"), "left")
    row = met.select("thread", "step", "phase", F.when(F.col("pf") == F.col("fingerprint"), F.col("pm")).otherwise(F.col("m")).alias("matrix_path"), "obs_path", "fingerprint", "parent", F.current_timestamp().alias("taken_at"))
    return snapshots.unionByName(row)


def fork(snapshots: DataFrame, thread: str, new: str, upto: int) -> DataFrame:
    """A branch: the thread's entries up to a step under a new name, sharing all data."""
    own = snapshots.where((F.col("thread") == thread) & (F.col("step") <= upto)).withColumn("thread", F.lit(new))
    return snapshots.unionByName(own)


def checkout(snapshots: DataFrame, thread: str, step: int | None = None) -> DataFrame:
    own = snapshots.where(F.col("thread") == thread)
    return (own.where(F.col("step") <= step) if step is not None else own).orderBy(F.desc("step")).limit(1)


def merge_manifest(rows: DataFrame, key: str = "step", order: list[str] | None = None) -> DataFrame:
    """The last row of each step."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order or ["ts"]))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def fresh(sources: DataFrame, index: DataFrame, by: str = "collection", changed: str = "changed_at", built: str = "built_at") -> DataFrame:
    """Per collection whether its index is at least as new as its newest source."""
    s = sources.groupBy(by).agg(F.max(changed).alias("newest"), F.count("*").alias("n_sources"))
    i = index.groupBy(by).agg(F.max(built).alias("built"))
    return s.join(i, by, "left").withColumn("fresh", F.coalesce(F.col("built") >= F.col("newest"), F.lit(False)))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("||", *parts), 256), 1, 24)


def files_fingerprint(files: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """One row: a digest of files' names and contents, whatever order they come in."""
    one = F.sha2(F.concat_ws("\x00", F.col(name), F.coalesce(text, F.lit(""))), 256)
    return files.agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(one))), 256).alias("digest"), F.count("*").alias("n_files"))


def environment(packages: dict[str, str]) -> dict[str, str]:
    """A digest of the packages' versions, and Python's version."""
    import hashlib
    import json
    import sys

    return {"hash": hashlib.sha256(json.dumps(packages, sort_keys=True).encode()).hexdigest(), "python": sys.version.split()[0]}


def described(matrix: DataFrame, obs: DataFrame, var: DataFrame, step: str) -> DataFrame:
    """One row about a step's data: shape and the sorted names of its columns."""
    names = lambda df: F.array(*map(F.lit, sorted(df.columns)))
    return obs.agg(F.lit(step).alias("step"), F.count("*").alias("n_obs"), names(obs).alias("obs_columns"), names(var).alias("var_columns")).crossJoin(var.agg(F.count("*").alias("n_vars"))).crossJoin(matrix.agg(F.count("*").alias("n_entries")))


def semver(c: Column) -> Column:
    """(major, minor, patch) of the first version number in a text; null without one."""
    part = lambda i: F.regexp_extract(c, r"(\d+)\.(\d+)(?:\.(\d+))?", i).try_cast("int")
    return F.when(c.rlike(r"\d+\.\d+"), F.struct(part(1).alias("major"), part(2).alias("minor"), F.coalesce(part(3), F.lit(0)).alias("patch")))
