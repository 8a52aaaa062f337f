"""Rules on scripts: what must not be called, and what an analysis must and must not contain.

Each rule is a predicate over a script's text, so a table of scripts is audited in one pass inside the
JVM. Null scripts are empty ones. The predicates are plain SQL over ``text``, ``low`` (its lower case)
and the columns of the data set's facts, so the rules can be read, and run, by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Calls that leave the sandbox.
BLOCKED = [
    r"\bos\.system\b", r"\bos\.popen\b", r"\bos\.execv", r"\bos\.execl", r"\bos\.spawn", r"\bos\.fork\b", r"\bsubprocess\b", r"\bshutil\.rmtree\b", r"\bctypes\b", r"\bpty\b",
    r"\bsocket\.socket\b", r"\beval\s*\(", r"\bexec\s*\(", r"\bcompile\s*\(", r"__import__\s*\(", r"\bpickle\.loads\b", r"\bmarshal\.loads\b", r"\bwebbrowser\b", r"\bpty\.spawn\b", r"\bimportlib\.import_module\b",
]
LOCKED = ("LOCKED_QC_START ===", "LOCKED_QC_END ===")


def _any(*words: str) -> str:
    return "(" + " or ".join(f"contains(low, '{w}')" for w in words) + ")"


_INTEGRATED = _any("harmony", "scvi", "scanorama", "cca", "bbknn")
_SKIPPED = "(contains(low, 'skip integration') or contains(text, '跳过整合'))"
_MAD = r"(contains(low, 'median_abs_deviation') or regexp_like(low, '\\bmad\\b'))"
_DUAL = "(contains(low, 'positive') and contains(low, 'negative') or contains(low, 'dual'))"
_NOTE = "(contains(low, 'pseudobulk') and (contains(low, 'fdr') or contains(low, 'padj') or contains(text, '多重')))"
_FUSED = _any("fuse_annotation", "annotation_n_agree", "annotation_fusion")
_RANKED = _any("rank_genes_groups", "rank_genes(")
_IMMUNE = _any("immune_all_low.pkl", "immune_all_high.pkl")

# Fixed values: (rule, phase, severity, when it is broken). The facts are tissue, has_model, n_samples,
# need_batch_correction, force_pseudobulk, confounded and wants_trajectory.
RULES: list[tuple[str, str, str, str]] = [
    ("qc.violin", "qc", "fail", f"not {_any('violin', 'vlnplot')}"),
    ("qc.scatter", "qc", "fail", f"not {_any('scatter')}"),
    ("qc.mad", "qc", "fail", f"not {_MAD}"),
    ("qc.locked", "qc", "fail", f"not (contains(text, '{LOCKED[0]}') and contains(text, '{LOCKED[1]}'))"),
    ("qc.mt_side", "qc", "fail", _MAD + """ and not (contains(text, 'side="high"') or contains(text, 'side=''high''') or contains(text, 'side = "high"'))"""),
    ("qc.log1p", "qc", "fail", f"not {_any('log1p=true', 'log1p = true')}"),
    ("qc.hard_mt", "qc", "fail", r"regexp_like(low, 'pct[_]?mt\\s*[<>=]+\\s*(5|10)\\b')"),
    ("qc.doublet", "qc", "fail", f"not {_any('predicted_doublet', 'doublet_call', 'detect_doublets', 'scrublet')}"),
    ("qc.r_skip_doublet", "qc", "fail", "contains(text, 'SystemExit(0)') and not contains(text, 'R_QC_OK') and contains(text, 'maybe_run_r_qc')"),
    ("qc.ambient_heuristic", "qc", "fail", "contains(low, 'remove_ambient') and contains(low, 'soupx_python') and not contains(low, 'allow_heuristic')"),
    ("qc.doublet_skip", "qc", "fail", "contains(low, 'scrublet skipped') and not contains(low, 'predicted_doublet')"),
    ("qc.doublet_cross", "qc", "fail", f"(n_samples > 1 or need_batch_correction or tissue in ('tumor', 'brain', 'heart', 'kidney', 'liver', 'embryo')) and not {_any('detect_doublets', 'scdblfinder')}"),
    ("down.integrate", "downstream", "fail", f"need_batch_correction and not {_INTEGRATED} and not ({_SKIPPED} or contains(low, 'user disabled batch'))"),
    ("down.umap_mix", "downstream", "fail", f"need_batch_correction and {_INTEGRATED} and regexp_like(low, 'umap.{{0,40}}(mix|mixed|混匀)') and not {_any('ilisi', 'kbet')}"),
    ("down.cluster_umap", "downstream", "fail", r"contains(low, 'umap') and regexp_like(low, 'leiden\\(.*umap|cluster.*umap')"),
    ("down.celltypist", "downstream", "fail", "has_model and not contains(low, 'celltypist')"),
    ("down.immune_all", "downstream", "fail", f"has_model and tissue not in ('pbmc', 'blood', 'immune') and {_IMMUNE}"),
    ("down.immune_all_default", "downstream", "fail", f"not has_model and {_IMMUNE}"),
    ("down.ref2", "downstream", "fail", f"not {_any('ref2_label', 'singler', 'popv', 'second_reference', 'ref_crossval', 'deg_label', 'cluster_deg')}"),
    ("down.fusion", "downstream", "fail", f"not {_FUSED}"),
    ("down.azimuth_only", "downstream", "fail", f"contains(low, 'azimuth') and not {_FUSED} and not contains(low, 'celltypist')"),
    ("down.dual", "downstream", "fail", f"not {_DUAL}"),
    ("down.dual_expression", "downstream", "fail", f"not {_any('dual_validate_expression', 'dual_ok')}"),
    ("down.r_skip_evidence", "downstream", "fail", "contains(text, 'SystemExit(0)') and not contains(text, 'R_REF_OK')"),
    ("down.lineage", "downstream", "fail", f"not {_any('cell_type_l1', 'lineage')}"),
    ("down.pseudobulk", "downstream", "fail", f"force_pseudobulk and (not {_any('pseudobulk_de(', 'get.aggregate')} or not ({_NOTE} or contains(low, 'fdr')))"),
    ("down.pb_confirmatory", "downstream", "fail", "force_pseudobulk and not (contains(text, 'confirmatory=True') or contains(text, 'confirmatory = True'))"),
    ("down.deg_note", "downstream", "fail", f"not force_pseudobulk and {_RANKED} and not {_NOTE}"),
    ("down.padj", "downstream", "fail", f"{_RANKED} and not {_any('pvals_adj', 'padj', 'fdr')}"),
    ("down.deg_scaled", "downstream", "fail", "contains(low, 'tl.rank_genes_groups') and contains(low, 'scale(') and not contains(low, 'use_raw')"),
    ("down.confound", "downstream", "fail", f"confounded and {_any('harmony', 'scvi', 'scanorama', 'bbknn')} and not ({_SKIPPED} or contains(low, 'collinear'))"),
    ("down.single_gene", "downstream", "fail", f"contains(low, 'cell_type') and not {_DUAL}"),
    ("down.trajectory", "downstream", "fail", f"wants_trajectory and not {_any('dpt', 'diffmap', 'paga', 'monocle', 'palantir', 'scvelo', 'run_trajectory_phase', 'velocity')}"),
    ("seed", "", "warn", "not contains(low, 'seed')"),
]
FACTS = {"tissue": "''", "has_model": "false", "n_samples": "1", "need_batch_correction": "false", "force_pseudobulk": "false", "confounded": "false", "wants_trajectory": "false"}


def violations(scripts: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """(id, no, found): the first match of every blocked call that a script makes, in the rules' order."""
    hits = F.array(*(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), p, 0) for p in BLOCKED))
    return scripts.select(id, F.posexplode(hits).alias("no", "found")).where("found <> ''")


def audit_code(scripts: DataFrame, phase: str, id: str = "id", text: str = "text") -> DataFrame:
    """(id, rule, severity) of the rules of a phase that a script breaks; facts that ``scripts`` has no
    column for are as for a single sample of an unknown tissue. One pass, no join."""
    x = scripts.withColumns({"text": F.coalesce(F.col(text), F.lit("")), "low": F.lower(F.coalesce(F.col(text), F.lit("")))})
    x = x.withColumns({k: F.expr(v) if k not in scripts.columns else F.coalesce(F.col(k), F.expr(v)) for k, v in FACTS.items()})
    broken = F.array(*(F.when(F.expr(when), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, own, severity, when in RULES if own in ("", phase)))
    return x.select(id, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("r")).select(id, "r.rule", "r.severity")
