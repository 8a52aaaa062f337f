"""Label fusion, marker scoring, ontology ids, evidence claims and rule audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels that say nothing, and groups of names of one cell type.
EMPTY = ["", "unknown", "unassigned", "nan", "none", "low_conf", "mixed", "na"]
SKIP = ["", "unknown", "unassigned", "unvalidated", "mixed", "none", "nan"]
ALIASES = {
    "cd8": ["cd8 t", "cd8 t cell", "cd8 t cells", "cd8+ t", "cd8+ t cell", "cd8+ t cells", "cytotoxic t"],
    "cd4": ["cd4 t", "cd4 t cell", "cd4 t cells", "cd4+ t", "cd4+ t cell", "cd4+ t cells", "helper t"],
    "t": ["t cell", "t cells", "t-cell", "t lymphocyte", "t lymphocytes"],
    "b": ["b cell", "b cells", "b-cell", "b lymphocyte", "b lymphocytes"],
    "nk": ["nk", "nk cell", "nk cells", "natural killer", "natural killer cell", "natural killer cells"],
    "mono": ["monocyte", "monocytes", "cd14 monocyte", "cd14+ monocyte", "cd16 monocyte"],
    "macro": ["macrophage", "macrophages", "mφ"],
    "plate": ["platelet", "platelets", "megakaryocyte"],
    "dc": ["dendritic cell", "dendritic cells", "cdc", "pdc", "dc"],
}
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"


def norm_label(c: Column) -> Column:
    """The trimmed label; null where it says nothing."""
    t = F.trim(c)
    return F.when(t.isNull() | F.lower(t).isin(EMPTY), None).otherwise(t)


def canon_key(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    return F.regexp_replace(F.trim(F.replace(s, F.lit(" cells"), F.lit(" cell"))), "s$", "")


def agreement_key(c: Column) -> Column:
    """One key for labels that agree: the alias group, else the canonical form; null for no label.

    It is a plain expression over a fixed short list, so fusing labels needs no join.
    """
    low, canon = F.lower(norm_label(c)), canon_key(norm_label(c))
    key = F.concat(F.lit("k:"), canon)
    for group, names in reversed(list(ALIASES.items())):
        key = F.when(canon.isin(names) | low.isin(names), F.lit(f"g:{group}")).otherwise(key)
    return F.when(low.isNull(), None).otherwise(key)


def labels_agree(a: Column, b: Column) -> Column:
    return F.coalesce(agreement_key(a) == agreement_key(b), F.lit(False))


def fuse(df: DataFrame, sources: list[str], marker: str, min_agree: int = 2) -> DataFrame:
    """``df`` with cell_type, annotation_status, annotation_n_agree, annotation_n_sources.

    Votes that agree form a bucket; the largest wins, ties to the one seen first. A marker label is
    kept if the winning bucket holds it, gives ``mixed`` if the winner has enough votes without it,
    and stands alone otherwise; without one, enough votes give ``…|unvalidated``.
    """
    votes = F.filter(F.array(*(F.struct(norm_label(F.col(c)).alias("label"), agreement_key(F.col(c)).alias("key")) for c in sources)), lambda v: v["key"].isNotNull())
    x = df.withColumn("__v", votes)
    keys = F.transform("__v", lambda v: v["key"])
    sizes = F.transform(keys, lambda k: F.size(F.filter(keys, lambda o: o == k)))
    x = x.withColumn("__n", F.coalesce(F.array_max(sizes), F.lit(0)))
    best = F.element_at(F.filter(F.arrays_zip(keys.alias("k"), sizes.alias("n")), lambda z: z["n"] == F.col("__n")), 1)["k"]
    x = x.withColumn("__best", F.when(F.size("__v") > 0, best))
    inside = F.transform(F.filter("__v", lambda v: v["key"] == F.col("__best")), lambda v: v["label"])
    # The label the bucket shows most often, the first on a tie.
    counted = F.transform(inside, lambda s: F.size(F.filter(inside, lambda o: o == s)))
    x = x.withColumn("__winner", F.when(F.size(inside) > 0, F.element_at(inside, F.array_position(counted, F.array_max(counted)).cast("int"))))
    mk, has = norm_label(F.col(marker)), F.size("__v") > 0
    enough, in_best = F.col("__n") >= min_agree, F.coalesce(agreement_key(F.col(marker)) == F.col("__best"), F.lit(False))
    case = lambda fused, mixed, alone, auto, low, none: F.when(~has, none).when(mk.isNotNull() & enough & in_best, fused).when(mk.isNotNull() & enough, mixed).when(mk.isNotNull(), alone).when(enough, auto).otherwise(low)
    label = case(mk, F.lit("mixed"), mk, F.concat("__winner", F.lit("|unvalidated")), F.lit("low_conf"), F.lit("unknown"))
    status = case(*map(F.lit, ("fused", "conflict_mixed", "marker_only", "auto_consensus", "insufficient", "insufficient")))
    return x.withColumns({"cell_type": label, "annotation_status": status, "annotation_n_agree": F.col("__n"), "annotation_n_sources": F.size("__v")}).drop("__v", "__n", "__best", "__winner")


def ensemble(df: DataFrame, label: str, confidence: str, second: str | None = None, least: float = 0.8) -> DataFrame:
    """Sure labels stay; others take the second model's label if there is one. The method is told."""
    sure = F.coalesce(F.col(confidence) >= least, F.lit(False))
    if second is None:
        return df.withColumns({"cell_type": F.col(label), "method": F.when(sure, "celltypist").otherwise("celltypist_low_conf")})
    return df.withColumns({"cell_type": F.when(sure, F.col(label)).otherwise(F.coalesce(second, label)), "method": F.when(sure, "celltypist").when(F.col(second).isNotNull(), "second_model").otherwise("celltypist_low_conf")})


def ontology_ids(df: DataFrame, catalog: DataFrame, label: str = "cell_type") -> DataFrame:
    """``df`` with cell_ontology_id by name, else by canonical name; of equal names the last id."""
    base = F.lower(F.trim(F.element_at(F.split(F.col(label), r"\|"), 1)))
    ids = catalog.where("cl_id is not null").groupBy(F.lower("name").alias("name")).agg(F.max_by("cl_id", "pos").alias("cl_id"))
    x = df.withColumns({"__a": base, "__b": canon_key(base)})
    x = x.join(ids.select(F.col("name").alias("__a"), F.col("cl_id").alias("__ia")), "__a", "left").join(ids.select(F.col("name").alias("__b"), F.col("cl_id").alias("__ib")), "__b", "left")
    return x.withColumn("cell_ontology_id", F.coalesce("__ia", "__ib")).drop("__a", "__b", "__ia", "__ib")


def dual_validation(df: DataFrame, pos: str = "pos_means", neg: str = "neg_means", pos_min: float = 0.1, neg_max: float = 0.5, min_pos: int = 2, min_neg: int = 1) -> DataFrame:
    """Enough positive markers seen, and of the negative ones (if any are listed) enough not seen."""
    n_pos, n_neg = F.size(F.filter(pos, lambda x: x >= pos_min)), F.size(F.filter(neg, lambda x: x <= neg_max))
    return df.withColumns({"n_pos_pass": n_pos, "n_neg_pass": n_neg, "dual_ok": (n_pos >= min_pos) & ((F.size(neg) == 0) | (n_neg >= min_neg))})


def marker_scores(means: DataFrame, catalog: DataFrame) -> DataFrame:
    """Scores of every catalog entry in every cluster of its tissue that expresses one of its genes.

    ``means(cluster, tissue, gene, mean)``, ``catalog(tissue, type, pos_no, depth, positive,
    negative)``; an entry is its ``pos_no``, so one type may have several. Score = mean of positives
    less mean of negatives, 0.01 per lineage step, 1 if dually validated. Joined by tissue and gene, so
    an entry and a cluster that share none meet nowhere; absent genes count as zero.
    """
    genes = catalog.select("tissue", "pos_no", F.explode(F.concat(F.transform("positive", lambda g: F.struct(g.alias("gene"), F.lit(True).alias("up"))), F.transform(F.coalesce("negative", F.array()), lambda g: F.struct(g.alias("gene"), F.lit(False).alias("up"))))).alias("g")).select("tissue", "pos_no", "g.gene", "g.up").distinct()
    size = genes.groupBy("pos_no").agg(F.sum(F.col("up").cast("int")).alias("n_pos"), F.sum((~F.col("up")).cast("int")).alias("n_neg"))
    met = means.join(genes, ["tissue", "gene"]).groupBy("cluster", "pos_no").agg(
        F.sum(F.when(F.col("up"), F.col("mean")).otherwise(0.0)).alias("sp"), F.sum(F.when(~F.col("up"), F.col("mean")).otherwise(0.0)).alias("sn"),
        F.sum((F.col("up") & (F.col("mean") >= 0.1)).cast("int")).alias("hit"), F.sum((~F.col("up") & (F.col("mean") > 0.5)).cast("int")).alias("miss"),
    )
    x = met.join(size, "pos_no").join(catalog.select("type", "pos_no", "depth"), "pos_no")
    ok = (F.col("hit") >= 2) & ((F.col("n_neg") == 0) | (F.col("n_neg") - F.col("miss") >= 1))
    score = F.col("sp") / F.col("n_pos") - F.when(F.col("n_neg") > 0, F.col("sn") / F.col("n_neg")).otherwise(0.0) + 0.01 * F.col("depth") + ok.cast("double")
    return x.where("n_pos >= 2").select("cluster", "type", "pos_no", ok.alias("dual_ok"), score.alias("score"))


def best_type(scores: DataFrame) -> DataFrame:
    """The best type per cluster; ties to the catalog's first."""
    w = Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 9)), "pos_no")
    return scores.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def catalog_labels(top: DataFrame, catalog: DataFrame, least: float = 0.25) -> DataFrame:
    """(cluster, deg_label, share): the type whose positives the cluster's top genes cover best, if a
    quarter of them or more; entries of the cluster's own tissue stand, under two positives don't."""
    types = catalog.where(F.size("positive") >= 2).select("tissue", "type", "pos_no", F.size("positive").alias("n"), F.explode("positive").alias("gene")).withColumn("gene", F.upper("gene"))
    hits = top.select("cluster", "tissue", F.upper(F.col("gene")).alias("gene")).distinct().join(types, ["tissue", "gene"]).groupBy("cluster", "type", "pos_no", "n").agg(F.count("*").alias("k"))
    best = best_type(hits.withColumn("score", F.col("k") / F.col("n")))
    all_ = top.select("cluster").distinct().join(best, "cluster", "left")
    good = F.coalesce(F.col("score") >= least, F.lit(False))
    return all_.select("cluster", F.when(good, F.col("type")).otherwise("unknown").alias("deg_label"), F.round(F.coalesce("score", F.lit(0.0)), 6).alias("share"))


def lineage_levels(df: DataFrame, lineage: str, depth: int) -> DataFrame:
    return df.withColumns({f"cell_type_l{i + 1}": F.coalesce(F.get(lineage, i), F.lit("unknown")) for i in range(depth)})


def doi(c: Column) -> Column:
    """The DOI in a text without trailing punctuation; '' without one."""
    return F.regexp_replace(F.regexp_extract(c, DOI, 0), r"[).,;]+$", "")


def validate_claims(claims: DataFrame) -> DataFrame:
    """``claims(markers array<string>, pathway_id, pval, citations array<struct<doi, pmid>>)`` with
    n_markers, the three tests and ok. Two distinct markers, a pathway with a p-value, and a DOI or a
    PubMed number of digits are needed."""
    genes = F.array_distinct(F.filter(F.transform(F.coalesce("markers", F.array().cast("array<string>")), lambda g: F.upper(F.trim(g))), lambda g: g.isNotNull() & (g != "")))
    cited = F.exists("citations", lambda c: F.coalesce(c["doi"].rlike(DOI), F.lit(False)) | F.coalesce(c["pmid"].rlike("^[0-9]+$"), F.lit(False)))
    x = claims.withColumns({"n_markers": F.size(genes), "has_pathway": F.coalesce(F.trim("pathway_id") != "", F.lit(False)) & F.col("pval").isNotNull(), "has_literature": F.coalesce(cited, F.lit(False))})
    return x.withColumn("ok", (F.col("n_markers") >= 2) & F.col("has_pathway") & F.col("has_literature"))


def match_states(labels: DataFrame, states: DataFrame) -> DataFrame:
    """(label, state_no, how): by name or alias, else the first state whose name is in the label.

    ``labels(label)`` distinct; ``states(state_no, name, aliases)``. For the second stage a name is
    looked up by the one of its runs of three characters that the fewest labels hold (a shorter name by
    itself) and then compared, so every label that holds it is met, but no label meets all states.
    """
    l = labels.where(~F.lower(F.trim("label")).isin(SKIP)).select("label", F.lower(F.trim("label")).alias("key"))
    names = states.select("state_no", F.explode(F.array_distinct(F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: a.isNotNull()))).alias("a")).select("state_no", F.lower("a").alias("key")).groupBy("key").agg(F.min("state_no").alias("state_no"))
    exact = l.join(names, "key").select("label", "state_no", F.lit("exact").alias("how"))
    runs = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    own = states.where("name <> ''").groupBy(F.lower("name").alias("name")).agg(F.min("state_no").alias("state_no"))
    grams = l.join(exact.select("label"), "label", "left_anti").select("label", "key", F.explode(F.array_distinct(F.concat(runs(F.col("key"), 1), runs(F.col("key"), 2), runs(F.col("key"), 3)))).alias("run"))
    held = grams.groupBy("run").agg(F.count("*").alias("n"))
    parts = own.select("name", "state_no", F.explode(F.when(F.length("name") < 3, F.array("name")).otherwise(F.array_distinct(runs(F.col("name"), 3)))).alias("run"))
    rare = parts.join(held, "run", "left").groupBy("name", "state_no").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("run"))).alias("run"))
    inside = grams.join(rare, "run").where(F.contains("key", "name")).groupBy("label").agg(F.min("state_no").alias("state_no")).withColumn("how", F.lit("inside"))
    return exact.unionByName(inside)


def audit(texts: DataFrame, rules: dict[str, tuple[str, str]], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, rule, severity, found): the first match of every rule that a text breaks; rules are
    ``name: (severity, regular expression)``."""
    tries = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(sev).alias("severity"), F.regexp_extract(text, rx, 0).alias("found")) for k, (sev, rx) in rules.items()))
    return texts.select(id, F.explode(F.filter(tries, lambda r: r["found"] != "")).alias("r")).select(id, "r.rule", "r.severity", "r.found")


def audit_run(metrics: DataFrame) -> DataFrame:
    """The integration verdict and the limits a run's metrics break; of the integration rules the
    first that holds is taken."""
    verdict = F.when(F.col("ilisi") < 0.8, "poor_mixing_ilisi").when(F.col("kbet") < 0.5, "poor_mixing_kbet").when(F.col("ilisi").isNull() & F.col("kbet").isNull() & (F.col("r2") > 0.5), "batch_variance").when(F.col("mix") >= 0.95, "cluster_of_one_batch").otherwise("ok")
    return metrics.withColumns({"integration": verdict, "overfiltered": F.coalesce(F.col("pct_removed") > 30, F.lit(False)), "many_doublets": F.coalesce(F.col("doublet_rate") > 0.10, F.lit(False))})


def publication_score(items: DataFrame, weights: dict[str, int]) -> DataFrame:
    """(run, score, verdict) of ``items(run, item, status)``: pass gives the weight, missing half of it
    rounded down, fail nothing; any fail fails the run."""
    w = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v))))
    weight = F.coalesce(F.element_at(w, F.col("item")), F.lit(0))
    pts = F.when(F.col("status") == "pass", weight).when(F.col("status") == "missing", F.floor(weight / 2)).otherwise(0)
    return items.groupBy("run").agg(F.sum(pts).cast("bigint").alias("score"), F.when(F.max((F.col("status") == "fail").cast("int")) == 1, "FAIL").otherwise("PASS").alias("verdict"))
