"""Reading matrices, tables, notes and catalogs; writing results.

Paths are resolved on the driver; data is read by Spark. Formats that need a library or a language
that isn't there (HDF5 containers, R objects, PDF) are refused by name.
"""

from __future__ import annotations

import glob
import math
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Where a 10x run keeps its matrix, in the order that is tried.
MTX_DIRS = ["", "filtered_feature_bc_matrix", "raw_feature_bc_matrix", "outs/filtered_feature_bc_matrix", "outs/raw_feature_bc_matrix", "outs"]
CATALOG = "name string, cl_id string, source string, lineage array<string>, positive array<string>, negative array<string>"
# Other names of tissues in marker catalogs.
TISSUES = {"blood": "pbmc", "immune": "pbmc", "airway": "lung", "cancer": "tumor", "crc": "tumor", "tme": "tumor", "intestine": "gut", "colon": "gut", "fetal": "embryo"}


def data_spec(spec: str) -> list[str]:
    """Paths of a comma-separated list with wildcards: sorted within each, each once, in order."""
    out: dict[str, None] = {}
    for part in (p.strip() for p in spec.split(",")):
        if part:
            found = sorted(glob.glob(part, recursive=True)) if any(c in part for c in "*?[") else [part]
            out.update(dict.fromkeys(found))
    return list(out)


def has_mtx(path: str) -> bool:
    return any((Path(path) / f"matrix.mtx{x}").is_file() for x in ("", ".gz"))


def mtx_dir(path: str) -> str | None:
    return next((str(Path(path) / d) for d in MTX_DIRS if has_mtx(str(Path(path) / d))), None)


def sample_label(path: str) -> str:
    """A sample's name from where its matrix lies: the run's folder, not the fixed ones within it."""
    parts = [p for p in Path(path).parts if p not in {"outs", "filtered_feature_bc_matrix", "raw_feature_bc_matrix", "/"}]
    return re.sub(r"\.(parquet|mtx|h5ad|loom|h5|csv|tsv)(\.gz)?$", "", parts[-1]) if parts else "sample"


def discover_samples(path: str) -> list[tuple[str, str]]:
    """(label, path) of the sample at a path, or else of those in its folders."""
    if (own := mtx_dir(path)) is not None:
        return [(sample_label(path), own)]
    return [(sample_label(str(p)), d) for p in sorted(Path(path).iterdir()) if p.is_dir() and (d := mtx_dir(str(p))) is not None]


def platform(path: str) -> str:
    """What made a file, by the first rule that its name fits."""
    name = path.lower().rstrip("/")
    for kind, rx in (("parse", r"parse|split-?seq"), ("loom", r"\.loom$"), ("seurat", r"\.(rds|h5seurat)$"), ("10x", r"\.h5ad$|\.h5$|10x|matrix\.mtx|feature_bc_matrix|outs$"), ("multi", r"[,*]")):
        if re.search(rx, name):
            return kind
    return "10x" if os.path.isdir(path) and mtx_dir(path) else "unknown"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number from 1. A file of names is read as one row, so its order is kept."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), "\n+$", ""), "\n")).alias("i", "line")).select((F.col("i") + 1).alias("no"), "line")


def read_mtx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matrix, cells, genes) of a 10x directory; entries beyond the named genes or cells are dropped."""
    d = mtx_dir(path)
    if d is None:
        raise FileNotFoundError(f"no matrix.mtx under {path}")
    one = lambda *names: next(str(Path(d) / (n + x)) for n in names for x in ("", ".gz") if (Path(d) / (n + x)).is_file())
    cells = _numbered(spark, one("barcodes.tsv")).select("no", F.element_at(F.split("line", "\t"), 1).alias("cell_id"))
    f = F.split("line", "\t")
    genes = _numbered(spark, one("features.tsv", "genes.tsv")).select("no", F.coalesce(F.get(f, 1), F.get(f, 0)).alias("gene_id"))
    genes = unique_names(genes, "gene_id", "no")
    parts = F.split(F.trim("value"), r"\s+")
    body = spark.read.text(one("matrix.mtx")).where("value not like '\\%%' and trim(value) <> ''")
    rows = body.select(F.get(parts, 0).cast("long").alias("g"), F.get(parts, 1).cast("long").alias("c"), F.get(parts, 2).cast("double").alias("value"), F.size(parts).alias("n"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("o"))
    size = rows.orderBy("o").limit(1).select(F.col("o").alias("size_line"))
    rows = rows.join(F.broadcast(size), rows.o == size.size_line, "left_anti")  # the size line
    matrix = rows.join(genes.withColumnRenamed("no", "g"), "g").join(cells.withColumnRenamed("no", "c"), "c").where("value <> 0").select("cell_id", "gene_id", "value")
    return matrix, cells.select("cell_id"), genes.select("gene_id")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get -1, -2, … in order."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("__n", n).withColumn(name, F.when(F.col("__n") > 1, F.concat_ws("-", F.col(name), (F.col("__n") - 1).cast("string"))).otherwise(F.col(name))).drop("__n")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A long matrix from Parquet or a 10x directory."""
    low = path.lower().rstrip("/")
    if low.endswith((".h5ad", ".h5", ".loom", ".rds", ".h5seurat", ".pdf")):
        raise NotImplementedError(f"{Path(low).suffix} needs a library that isn't part of this engine; convert it to Parquet (cell_id, gene_id, value)")
    return spark.read.parquet(path) if low.endswith(".parquet") or not mtx_dir(path) else read_mtx(spark, path)[0]


def peek(matrix: DataFrame) -> DataFrame:
    """Shape and number of entries in one pass."""
    return matrix.agg(F.countDistinct("cell_id").alias("n_cells"), F.countDistinct("gene_id").alias("n_genes"), F.count("*").alias("n_entries"))


def count_rows(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank; gzip as well."""
    return spark.read.text(path).where("trim(value) <> ''").count()


def read_marker_catalog(spark: SparkSession, path: str, tissue: str | None = None) -> DataFrame:
    """(tissue, pos, name, cl_id, source, lineage, positive, negative) from JSON, CSV or TSV. A tissue
    that the catalog lacks gives no rows, never another tissue's."""
    if path.endswith(".json"):
        schema = f"tissues map<string, array<struct<{', '.join(x.replace(' ', ': ', 1) for x in CATALOG.split(', '))}>>>"
        raw = spark.read.schema(schema).option("multiLine", True).json(path)
        rows = raw.select(F.explode("tissues").alias("tissue", "types")).select("tissue", F.posexplode("types").alias("pos", "t")).select("tissue", "pos", "t.*")
    else:
        raw = spark.read.option("header", True).option("sep", "\t" if path.endswith((".tsv", ".txt")) else ",").csv(path)
        many = lambda c: F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\|", ";"), ";"), F.trim), lambda x: x != "") if c in raw.columns else F.array().cast("array<string>")
        plain = lambda c: (F.col(c) if c in raw.columns else F.lit(None).cast("string")).alias(c)
        rows = raw.select(plain("tissue"), F.monotonically_increasing_id().cast("int").alias("pos"), plain("name"), plain("cl_id"), plain("source"), many("lineage").alias("lineage"), many("positive").alias("positive"), many("negative").alias("negative"))
    if tissue:
        want = TISSUES.get(tissue.lower(), tissue.lower())
        rows = rows.where(F.lower("tissue") == want)
    return rows


def read_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The records of a knowledge file, whichever of its four roots it has, one row each: (kind, name,
    id, record as JSON)."""
    roots = {"records": "array<map<string,string>>", "states": "array<map<string,string>>", "sets": "array<map<string,string>>"}
    raw = spark.read.text(path, wholetext=True)
    out = None
    for root in (*roots, "tissues"):
        value = F.get_json_object("value", f"$.{root}")
        listed = F.from_json(value, "array<string>")
        mapped = F.from_json(value, "map<string, array<string>>")
        rows = raw.select(F.explode(F.coalesce(F.when(value.startswith("["), listed), F.when(value.startswith("{"), F.flatten(F.map_values(mapped))))).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out.select(F.lit(kind).alias("kind"), F.get_json_object("record", "$.name").alias("name"), F.coalesce(F.get_json_object("record", "$.id"), F.get_json_object("record", "$.cl_id")).alias("id"), "record")


def read_notes(spark: SparkSession, pattern: str, most: int | None = None) -> DataFrame:
    """(path, stem, title, front, text) of Markdown notes: the title is the first heading, ``front`` the
    fields between the opening dashes; ``most`` cuts the text, as a prompt's budget does."""
    raw = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    front = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    fields = F.map_from_entries(F.transform(F.filter(F.split(front, r"\r?\n"), lambda l: l.rlike(r"^\w[\w-]*\s*:")), lambda l: F.struct(F.regexp_extract(l, r"^(\w[\w-]*)", 1), F.trim(F.regexp_extract(l, r"^\w[\w-]*\s*:\s*\"?(.*?)\"?$", 1)))))
    return raw.select("path", F.regexp_extract("path", r"([^/]+?)\.[^./]+$", 1).alias("stem"), F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1).alias("title"), fields.alias("front"), (F.substring("text", 1, most) if most else F.col("text")).alias("text"))


def read_notebooks(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, text): Markdown cells as they are, code cells fenced."""
    cell = "cells array<struct<cell_type: string, source: array<string>>>"
    raw = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", cell).alias("n"))
    body = F.transform("n.cells", lambda c: F.when(c["cell_type"] == "markdown", F.array_join(c["source"], "")).when(c["cell_type"] == "code", F.concat(F.lit("```python\n"), F.array_join(c["source"], ""), F.lit("\n```"))))
    return raw.select("path", F.array_join(F.filter(body, lambda b: b.isNotNull()), "\n\n").alias("text"))


def without_shadowed(raw: DataFrame, parsed: DataFrame, stem: str = "stem") -> DataFrame:
    """Sources of which no parsed form is there."""
    return raw.join(parsed.select(stem).distinct(), stem, "left_anti")


def load_chunks(spark: SparkSession, path: str, collections: list[str] | None = None) -> DataFrame:
    """The chunk index, laid out by collection, so the filter prunes folders."""
    df = spark.read.parquet(path)
    return df.where(F.col("collection").isin(collections)) if collections else df


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Rewrites the collections that ``chunks`` holds; others stay."""
    chunks.repartition("collection").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("collection").parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Results as Parquet, JSON or CSV; CSV leaves nested columns out."""
    flat = df.select(*[f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]) if fmt == "csv" else df
    flat.write.mode("overwrite").options(header=True).format(fmt).save(path) if fmt == "csv" else flat.write.mode("overwrite").format(fmt).save(path)


def genes_from_table(df: DataFrame, n: int = 200) -> DataFrame:
    """(gene): the first ``n`` genes of a DE table by adjusted p, whatever its columns are called."""
    pick = lambda names: next((c for want in names for c in df.columns if c.lower() == want), None)
    gene, p = pick(["gene", "genes", "names", "symbol", "gene_id", "gene_name"]), pick(["fdr", "padj", "pvals_adj", "adj_p", "q_value", "pval", "pvals"])
    if gene is None:
        raise ValueError(f"no column of genes among {df.columns}")
    rows = df.select(F.col(gene).cast("string").alias("gene"), (F.col(p).cast("double") if p else F.lit(1.0)).alias("p")).where("gene is not null")
    return rows.orderBy(F.asc_nulls_last("p"), "gene").limit(n).select("gene")


def first_column(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that the table has: how sample and condition columns are found."""
    low = {c.lower(): c for c in df.columns}
    return next((low[c.lower()] for c in candidates if c.lower() in low), None)


def reserved_renamed(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("_index", "orig_index")


def text_column(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, query) of a selection file: ids under ``cell_ids``, ``barcodes`` or ``ids``, the first
    that has any."""
    raw = spark.read.text(path, wholetext=True)
    listed = lambda k: F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>")
    some = lambda k: F.when(F.size(listed(k)) > 0, listed(k))
    ids = F.coalesce(some("cell_ids"), some("barcodes"), some("ids"))
    return raw.select(F.explode(ids).alias("cell_id"), F.coalesce(F.get_json_object("value", "$.query"), F.lit("")).alias("query"))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """(state_no, name, aliases, markers, pathways, citations) of a catalog of cell states."""
    state = "name: string, aliases: array<string>, markers: array<string>, pathways: array<struct<id: string, name: string>>, citations: array<struct<pmid: string, doi: string, title: string, year: int, journal: string>>"
    raw = spark.read.schema(f"states array<struct<{state}>>").option("multiLine", True).json(path)
    return raw.select(F.posexplode("states").alias("state_no", "s")).select("state_no", "s.*")


def gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(term, gene) of a file of gene sets, genes in upper case; sets without a name or genes give none."""
    raw = spark.read.schema("sets array<struct<id: string, name: string, genes: array<string>>>").option("multiLine", True).json(path)
    s = raw.select(F.explode("sets").alias("s")).select(F.coalesce("s.id", "s.name").alias("term"), F.explode("s.genes").alias("gene"))
    return s.where("term <> '' and gene <> ''").select("term", F.upper("gene").alias("gene")).distinct()


def format_record(record: Column, source: Column) -> Column:
    """A record (JSON) as text: its name and id, its source, its lists and its plain fields, one a line."""
    get = lambda k: F.get_json_object(record, f"$.{k}")
    name = F.coalesce(get("name"), get("id"), get("term"), F.lit("record"))
    rid = F.coalesce(get("id"), get("cl_id"))
    line = lambda k, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}: "), v))
    many = lambda k: F.coalesce(F.array_join(F.from_json(get(k), "array<string>"), ", "), get(k))
    ids = lambda k, by: F.array_join(F.filter(F.transform(F.from_json(get(k), "array<map<string,string>>"), lambda x: F.coalesce(*(x[b] for b in by))), lambda x: x.isNotNull()), "; " if k == "citations" else ", ")
    return F.concat_ws(
        "\n", F.concat(F.lit("# "), name, F.coalesce(F.concat(F.lit(" ("), rid, F.lit(")")), F.lit(""))), line("source", source),
        *(line(k, many(k)) for k in ("synonyms", "aliases", "tissues", "expected_types", "lineage", "markers", "positive", "negative", "genes")),
        *(line(k, get(k)) for k in ("parent", "atlas", "qc_note", "collection", "tissue")), line("pathways", ids("pathways", ("id", "name"))), line("citations", ids("citations", ("pmid", "doi", "title"))),
    )


def demo_matrix(spark: SparkSession, n_cells: int = 100, n_genes: int = 60, rate: float = 1.5, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matrix, cells, genes) of Poisson counts, the same on every run, for trying things out."""
    genes = spark.range(n_genes).select(F.col("id").alias("gene_id"), F.coalesce(F.get(F.array(*map(F.lit, ("MT-ND1", "MT-CO1", "CD3D", "MS4A1"))), F.col("id").cast("int")), F.concat(F.lit("Gene"), F.col("id").cast("string"))).alias("gene_name"))
    cells = spark.range(n_cells).select(F.concat(F.lit("cell_"), F.col("id").cast("string")).alias("cell_id"), F.when(F.col("id") < n_cells // 2, "s1").otherwise("s2").alias("sample"))
    # Inversion: the count is the number of cumulative probabilities that a uniform number exceeds.
    terms, p, total = [], math.exp(-rate), 0.0
    for k in range(int(rate * 10) + 20):
        total += p
        terms.append(total)
        p *= rate / (k + 1)
    u = (F.pmod(F.xxhash64("cell_id", "gene_id", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)).alias("u")
    grid = cells.select("cell_id").crossJoin(F.broadcast(genes.select("gene_id"))).select("cell_id", "gene_id", u)  # the fixture's own size
    return grid.select("cell_id", "gene_id", F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: t < F.col("u"))).cast("double").alias("value")).where("value > 0"), cells, genes
