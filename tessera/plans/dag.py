"""The steps of an analysis, what each needs, and their order."""

from __future__ import annotations

from collections import deque

# The steps and their prerequisites, and what a request for a kind of result aims at.
STEPS: dict[str, list[str]] = {
    "qc": [],
    "normalize": ["qc"],
    "hvg": ["normalize"],
    "pca": ["hvg"],
    "ambient_soupx": ["qc"],
    "ambient_decontx": ["qc"],
    "impute_magic": ["normalize"],
    "impute_alra": ["normalize"],
    "harmony": ["pca"],
    "scvi": ["pca"],
    "cca": ["pca"],
    "bbknn": ["pca"],
    "neighbors": ["pca"],
    "leiden": ["neighbors"],
    "umap": ["neighbors"],
    "annotate": ["leiden", "umap"],
    "cluster_deg": ["leiden", "umap"],
    "pseudobulk_deg": ["annotate"],
    "trajectory": ["umap", "leiden"],
    "gsea": ["leiden", "umap"],
}
GOALS = {"qc": ["qc"], "clustering": ["leiden", "umap"], "annotation": ["annotate"], "deg": ["cluster_deg", "pseudobulk_deg"], "trajectory": ["trajectory"], "enrichment": ["gsea"]}
INTEGRATORS = ["harmony", "scvi", "cca", "bbknn"]


def needs(step: str, integrator: str | None = None) -> list[str]:
    """A step's prerequisites; with an integrator, neighbours are found after it."""
    return [integrator] if step == "neighbors" and integrator in INTEGRATORS else STEPS.get(step, [])


def order(goals: list[str], integrator: str | None = None) -> list[str]:
    """The goals, the integrator and all they need, each after its prerequisites: steps that become
    free wait in line, those that become free together by name. Steps that go in a circle come out by
    name, as there is no order to give."""
    want, todo = set(), [*goals, *([integrator] if integrator else [])]
    while todo:
        s = todo.pop()
        if s not in want:
            want.add(s)
            todo += needs(s, integrator)
    waits = {s: {d for d in needs(s, integrator) if d in want} for s in want}
    line = deque(sorted(s for s, d in waits.items() if not d))
    out: list[str] = []
    while line:
        done = line.popleft()
        out.append(done)
        for s in sorted(s for s in want if done in waits[s]):
            waits[s].remove(done)
            if not waits[s]:
                line.append(s)
    return out if len(out) == len(want) else sorted(want)


def route(intents: list[str], integrator: str | None = None, imputation: str | None = None, ambient: str | None = None) -> list[str]:
    """The steps that a request's intents lead to."""
    goals = {g for i in intents for g in GOALS.get(i, ())} or {"qc", "leiden", "umap", "annotate"}
    for kind, asked in (("impute", imputation), ("ambient", ambient)):
        if asked and asked not in ("none", "off"):
            goals.add(f"{kind}_{asked}")
    return order(sorted(goals), integrator)


def edges(steps: list[str], integrator: str | None = None) -> list[tuple[str, str]]:
    return [(d, s) for s in steps for d in needs(s, integrator) if d in steps]


def check(steps: list[str], integrator: str | None = None) -> list[str]:
    """What is wrong with a sequence of steps: QC is a must, and prerequisites come first."""
    issues = [] if "qc" in steps else ["the QC step is missing"]
    for i, s in enumerate(steps):
        issues += [f"{s} comes before {d}" for d in needs(s, integrator) if d not in steps[:i]]
    return issues
