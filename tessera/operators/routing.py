"""Requests to intents, methods, notes and figures by rules; options for a reviewer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of each intent, in the order in which intents are listed.
INTENTS: dict[str, list[str]] = {
    "qc": [r"质控", r"\bqc\b", r"doublet", r"mito", r"线粒体", r"scrublet"],
    "clustering": [r"聚类", r"\bleiden\b", r"\blouvain\b", r"cluster"],
    "annotation": [r"注释", r"cell\s*type", r"celltypist", r"annotat"],
    "deg": [r"差异表达", r"differential\s+express", r"\bpseudobulk\b", r"\bdeseq2?\b", r"\bedger\b", r"对照组", r"处理组", r"condition\s+vs", r"treated\s+vs", r"\bcase[- ]control\b", r"\bdeg\b", r"\bdge\b"],
    "trajectory": [r"轨迹", r"伪时间", r"命运", r"分化轴", r"\bpaga\b", r"pseudotime", r"\btrajectory\b", r"diffusion\s+map", r"\bdpt\b", r"monocle", r"palantir", r"scvelo", r"\bvelocity\b", r"rna\s+velocity"],
    "enrichment": [r"通路", r"富集", r"\bgsea\b", r"\bgsva\b", r"enrichment", r"hallmark"],
}
NOT_DEG = [r"degrad", r"degree", r"\bedge\s+detect"]
DEFAULT = ["qc", "clustering", "annotation"]
# Notes that belong to words of a request.
NOTES: dict[str, list[str]] = {
    "trajectory": ["轨迹", "拟时序", "pseudotime", "trajectory", "velocity", "paga"],
    "pseudobulk-de": ["差异", "deg", "deseq", "edger", "pseudobulk", "条件"],
    "pathway-enrichment": ["通路", "gsea", "enrich", "hallmark"],
    "integration": ["整合", "batch", "harmony", "scvi", "批次"],
}
ALWAYS = ["qc", "doublet-detection"]


def _any(c: Column, patterns: list[str]) -> Column:
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def intents(c: Column) -> Column:
    """The intents of a request as an array; enrichment joins clustering, annotation and DE."""
    q = F.coalesce(c, F.lit(""))
    hits = {k: _any(q, p) & (~_any(q, NOT_DEG) if k == "deg" else F.lit(True)) for k, p in INTENTS.items()}
    named = F.filter(F.array(*(F.when(h, F.lit(k)) for k, h in hits.items())), lambda x: x.isNotNull())
    named = F.when(F.size(named) == 0, F.array(*map(F.lit, DEFAULT))).otherwise(named)
    return F.when(F.arrays_overlap(named, F.array(*map(F.lit, ("clustering", "annotation", "deg")))), F.array_distinct(F.array_append(named, "enrichment"))).otherwise(named)


# How a request names an engine, a test of markers, and a cross-check.
METHOD_WORDS = {
    "deseq2": r"\bdeseq2?\b", "edger": r"\bedger\b", "mast": r"\bmast\b", "t-test": r"t\s*检验|t[-_ ]?test|\bttest\b", "wilcoxon": r"wilcox|秩和|mann[- ]?whitney", "groups": r"pseudobulk|组间|condition",
    "cross": r"交叉验证|cross[-\s]?valid|多种(检验|方法)|共识基因", "only": r"只用|仅用|only\s+(use\s+)?", "other than mast": r"wilcox|t[-_ ]?test|deseq|edger", "wilcox": "wilcox", "t": r"t[-_ ]?test|t检验",
}


def deg_preference(df: DataFrame, query: str = "query") -> DataFrame:
    """``df`` with engine, marker_method and cross_validate (null where the request doesn't say)."""
    said = {k: F.lower(F.coalesce(query, F.lit(""))).rlike(p) for k, p in METHOD_WORDS.items()}
    first = lambda *ways: reduce(lambda a, w: F.when(w[1], w[0]).otherwise(a), reversed(ways), F.lit(None).cast("string"))
    engine = first(("deseq2", said["deseq2"]), ("edger", said["edger"]), ("ttest", said["t-test"] & said["groups"]))
    marker = first(*((m, said[m]) for m in ("mast", "t-test", "wilcoxon")))
    cross = F.when(said["cross"], True).when(said["only"] & (engine.isNotNull() | marker.isNotNull()), False).when((marker == "mast") & said["other than mast"] | said["wilcox"] & said["t"], True)
    return df.withColumns({"engine": engine, "marker_method": marker, "cross_validate": cross})


def notes_for(c: Column) -> Column:
    """Names of the notes that go with a request, in order, each once."""
    q = F.lower(F.coalesce(c, F.lit("")))
    hit = lambda words: reduce(lambda a, b: a | b, (q.contains(w) for w in words))
    rest = F.filter(F.array(*(F.when(hit(w), F.lit(k)) for k, w in NOTES.items())), lambda x: x.isNotNull())
    return F.concat(F.array(*map(F.lit, ALWAYS)), rest)


# Notes that belong to a phase, and to words within a step's name, in this order.
PHASE_NOTES = {
    "qc": ["qc", "doublet-detection", "normalization", "feature-selection"], "interpret": ["pathway-enrichment", "pseudobulk-de", "marker-genes"], "enrichment": ["pathway-enrichment", "pseudobulk-de", "marker-genes"],
}
MUST_NOTES = ["clustering", "cell-annotation", "marker-genes"]
STEP_NOTES = [
    ("qc", ["qc", "doublet-detection", "normalization", "feature-selection"]), ("normalize", ["normalization", "feature-selection"]), ("hvg", ["feature-selection"]), ("pca", ["dimensionality-reduction"]),
    ("neighbors", ["dimensionality-reduction", "clustering"]), ("leiden", ["clustering"]), ("umap", ["dimensionality-reduction"]), ("harmony", ["integration"]), ("scvi", ["integration"]), ("integrate", ["integration"]),
    ("annotate", ["cell-annotation", "marker-genes"]), ("annotation", ["cell-annotation", "marker-genes"]), ("deg", ["pseudobulk-de", "marker-genes"]), ("gsea", ["pathway-enrichment"]), ("enrichment", ["pathway-enrichment"]),
    ("trajectory", ["trajectory"]), ("paga", ["trajectory"]), ("dpt", ["trajectory"]),
]


def notes_for_route(steps: Column, query: Column) -> Column:
    """Names of the notes for a route's steps (an array) and a request, in order, each once."""
    words = lambda names: F.array(*map(F.lit, names))
    low = F.transform(F.coalesce(steps, F.array().cast("array<string>")), F.lower)
    of = lambda s: F.flatten(F.array(*(F.when(s.contains(k), words(v)).otherwise(F.array().cast("array<string>")) for k, v in STEP_NOTES)))
    asked = notes_for(query)
    return F.array_distinct(F.concat(words(ALWAYS), F.flatten(F.transform(low, of)), F.slice(asked, len(ALWAYS) + 1, len(NOTES))))


def notes_for_phase(phase: Column, steps: Column, query: Column) -> Column:
    """Names of the notes for a phase; phases without a list of their own take the route's, and what
    every analysis needs."""
    out = F.array_distinct(F.concat(notes_for_route(steps, query), F.array(*map(F.lit, MUST_NOTES))))
    for name, notes in PHASE_NOTES.items():
        out = F.when(phase == name, F.array(*map(F.lit, notes))).otherwise(out)
    return out


# Old names of skills, the skills every analysis has, words that call for others, and
# words that tell a skill's kind.
OLD_SKILLS = {
    "dataset-loader": "seurat-workflow", "qc-preprocessing": "seurat-workflow", "integration-batch": "seurat-workflow", "clustering-embedding": "seurat-workflow", "visualization": "seurat-workflow", "report-generation": "seurat-workflow",
    "cell-annotation": "cell-annotation", "deg-pathway": "differential-expression", "cell-communication": "cell-communication",
}
CORE_SKILLS = ["seurat-workflow", "cell-annotation"]
SKILL_WORDS = [
    ("differential-expression", ["deg", "differen", "pseudobulk", "差异", "pathway", "gsea"], ["deg", "gsea", "enrichment", "pseudobulk"]),
    ("trajectory", ["traject", "pseudotime", "velocity", "monocle", "slingshot", "命运", "轨迹"], ["trajectory", "paga", "dpt"]),
    ("cell-communication", ["cellchat", "communication", "ligand", "nichenet", "通讯", "配体"], []),
    ("spatial-analysis", ["spatial", "visium", "xenium", "squidpy", "空间", "st ", " slide-seq"], []),
]
SKILL_KINDS = {
    "workflow": ["seurat-workflow", "qc", "cluster", "integrat", "load", "umap", "leiden"], "annotation": ["cell-annotation", "celltypist", "marker", "注释", "azimuth"],
    "deg": ["differential-expression", "pseudobulk", "deg", "差异", "pathway"], "trajectory": ["trajectory", "pseudotime", "velocity", "monocle", "轨迹"],
    "communication": ["cell-communication", "cellchat", "ligand", "通讯"], "spatial": ["spatial-analysis", "spatial", "visium", "squidpy", "空间"],
}
PHASE_SKILLS = {"qc": ["seurat-workflow"], "cluster": ["seurat-workflow"], "downstream": ["seurat-workflow", "cell-annotation", "differential-expression"], "annotate": ["cell-annotation", "differential-expression"]}


def _holds(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words), F.lit(False))


def skills_for(topic: Column, route: Column) -> Column:
    """The skills that a request's words and a route's steps call for, the core ones first."""
    steps = F.transform(F.coalesce(route, F.array().cast("array<string>")), F.lower)
    text = F.lower(F.concat_ws(" ", topic, F.array_join(steps, " ")))
    more = F.array(*(F.when(_holds(text, words) | (F.arrays_overlap(steps, F.array(*map(F.lit, exact))) if exact else F.lit(False)), F.lit(name)) for name, words, exact in SKILL_WORDS))
    return F.concat(F.array(*map(F.lit, CORE_SKILLS)), F.filter(more, lambda x: x.isNotNull()))


def skill_kind(name: Column, description: Column) -> Column:
    """The first kind of which a skill's name or description holds a word, else ``other``."""
    hay = F.lower(F.concat_ws(" ", name, description))
    return reduce(lambda a, kv: F.when(_holds(hay, kv[1]), kv[0]).otherwise(a), reversed(list(SKILL_KINDS.items())), F.lit("other"))


def skill_name(c: Column) -> Column:
    """A skill's present name."""
    key = F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-"))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in OLD_SKILLS.items() for x in kv)), key), key)


def within_budget(notes: DataFrame, order: str, text: str = "text", budget: int = 4000) -> DataFrame:
    """Notes, in order, as long as their lengths together stay within the budget. A request's notes
    are few, so their one window is small."""
    total = F.sum(F.length(text)).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return notes.withColumn("__t", total).where(F.col("__t") <= budget).drop("__t")


def fused(parts: list[DataFrame], k: int) -> DataFrame:
    """Hits of several sources in the order of the sources (``query_id, id, source, text, score``):
    repeated passages once, the first ``k`` per query."""
    rows = reduce(lambda a, b: a.unionByName(b), (p.select("query_id", "id", "source", "text", "score").withColumn("part", F.lit(i)) for i, p in enumerate(parts)))
    order = ["part", F.desc(F.round("score", 9)), "id"]
    one = rows.withColumn("__f", F.row_number().over(Window.partitionBy("query_id", "source", F.substring("text", 1, 96)).orderBy(*order))).where("__f = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).drop("__f")


def filter_options(qc: DataFrame, by: str, nmads: dict[str, float], value: str = "pct_counts_mt") -> DataFrame:
    """(by, option, nmads, est_remove_pct): what share of the cells each limit would take off the high
    side; a MAD of zero takes none."""
    med = qc.groupBy(by).agg(F.median(value).alias("m"))
    x = qc.join(med, by)
    x = x.join(x.groupBy(by).agg(F.median(F.abs(F.col(value) - F.col("m"))).alias("mad")), by)
    options = F.explode(F.array(*(F.struct(F.lit(k).alias("option"), F.lit(float(n)).alias("nmads")) for k, n in nmads.items())))
    shares = x.groupBy(by).agg(*(F.round(100 * F.avg(((F.col("mad") > 0) & (F.col(value) > F.col("m") + n * F.col("mad"))).cast("double")), 2).alias(k) for k, n in nmads.items()))
    picked = reduce(lambda a, k: F.when(F.col("o.option") == k, F.col(k)).otherwise(a), nmads, F.lit(None).cast("double"))
    return shares.withColumn("o", options).select(by, "o.option", "o.nmads", picked.alias("est_remove_pct"))


def match_figures(figures: DataFrame, wanted: DataFrame) -> DataFrame:
    """(slot, path, kind) of ``wanted(slot, kind)``: a figure captioned with the kind, else one whose
    file name holds it, longer kinds first; ties by path. Names are cut into runs of words, so the join
    is by equality."""
    f = figures.select("path", "kind")
    exact = wanted.join(f, "kind").select("slot", "path", "kind", F.lit(0).alias("p"))
    parts = F.split(F.regexp_replace(F.lower(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)), "[^a-z0-9]+", "_"), "_")
    n = F.size(parts)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.array_join(F.slice(parts, i, j - i + 1), "_"))))
    named = f.select("path", F.explode(F.array_distinct(runs)).alias("kind")).join(wanted, "kind").select("slot", "path", "kind", F.lit(1).alias("p"))
    w = Window.partitionBy("slot").orderBy("p", F.desc(F.length("kind")), "path")
    return exact.unionByName(named).withColumn("r", F.row_number().over(w)).where("r = 1").select("slot", "path", "kind")


def inspect(matrix: DataFrame, obs: DataFrame, var: DataFrame, sample: str, condition: str | None) -> DataFrame:
    """One row about a data set: shape, samples, replicates, confounding, need of batch correction."""
    from tessera.operators.cells import species_vote
    from tessera.operators.stats import confounding

    shape = obs.agg(F.count("*").alias("n_cells"), F.countDistinct(sample).alias("n_samples")).crossJoin(var.agg(F.count("*").alias("n_genes"))).crossJoin(matrix.agg(F.count("*").alias("n_entries")))
    if condition:
        per = obs.groupBy(condition).agg(F.countDistinct(sample).alias("n"))
        shape = shape.crossJoin(per.agg(F.min("n").alias("n_replicates"))).crossJoin(confounding(obs, sample, condition).select("confounded"))
    else:
        shape = shape.withColumns({"n_replicates": F.lit(None).cast("bigint"), "confounded": F.lit(False)})
    return shape.crossJoin(species_vote(var).select("species")).withColumn("need_batch_correction", (F.col("n_samples") > 1) & ~F.col("confounded"))


def has_batch_figure(paths: Column) -> Column:
    """Whether a figure that shows batches before and after integration is among the paths."""
    return F.exists(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.lower(p).contains("batch_pca") | F.lower(p).contains("batch_umap"))


def merged_in_order(a: Column, b: Column) -> Column:
    """The values of two arrays in order, each where it comes first."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def claim_text(claims: DataFrame, id: str = "id") -> DataFrame:
    """(id, text) of ``claims(id, assertion, ok, markers array<string>, pathway_id, pval, fdr, citations)``: what a
    report says of each, citations as they are given and none invented."""
    none = lambda c, other: F.when(F.coalesce(c, F.lit("")) == "", other).otherwise(c)
    cite = lambda c: F.concat_ws(" ", F.lit("- citation:"), c["title"], F.concat(F.lit("DOI `"), c["doi"], F.lit("`")), F.concat(F.lit("PMID "), c["pmid"]))
    cited = F.when(F.coalesce(F.size("citations"), F.lit(0)) > 0, F.array_join(F.transform("citations", cite), "\n")).otherwise("- citation: none; do not invent")
    p = F.when(F.col("pval").isNotNull(), F.concat(F.lit("p="), F.col("pval").cast("string"), F.coalesce(F.concat(F.lit(", FDR="), F.col("fdr").cast("string")), F.lit("")))).otherwise("n/a")
    lines = F.concat_ws("\n", F.concat(F.lit("### "), "assertion"), F.lit(""), F.concat(F.lit("- status: "), F.when(F.col("ok"), "supported").otherwise("unsupported — do not report as fact")),
        F.concat(F.lit("- markers: "), none(F.array_join("markers", ", "), "none")), F.concat(F.lit("- pathway: `"), none(F.col("pathway_id"), "n/a"), F.lit("` ("), p, F.lit(")")), cited)
    return claims.select(id, lines.alias("text"))


def assembled_claims(labels: DataFrame, states: DataFrame, terms: DataFrame) -> DataFrame:
    """(label, state_no, markers, pathway_id, pval, fdr, citations): each label's claim with the markers and
    citations of its state ``states(state_no, markers, pathways, citations)`` and, of the enriched
    ``terms(label, term, pval, fdr)``, the first that the state names, else the first; without any the
    state's own first pathway, which then has no p-value. ``labels(label, state_no)``, a null for none."""
    s = labels.join(states, "state_no", "left")
    wanted = F.transform(F.coalesce("pathways", F.array().cast("array<struct<id:string,name:string>>")), lambda p: F.upper(F.coalesce(p["id"], F.lit(""))))
    s = s.withColumn("wanted", wanted)
    t = terms.join(s.select("label", "wanted"), "label").withColumn("named", F.array_contains("wanted", F.upper("term")))
    best = t.groupBy("label").agg(F.min_by(F.struct("term", "pval", "fdr"), F.struct((~F.col("named")).alias("n"), "pval", "term")).alias("t"))
    return s.join(best, "label", "left").select("label", "state_no", "markers", F.coalesce("t.term", F.get("pathways", 0)["id"]).alias("pathway_id"), "t.pval", "t.fdr", "citations")
