import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, provenance, retrieval, routing, stats, summaries
from tessera.sources import readers


def col(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first().x


def test_notes_and_skills(spark):
    route = col(spark, routing.notes_for_route(F.col("s"), F.col("q")), s=["pca", "Leiden"], q="batch")
    assert route == ["qc", "doublet-detection", "dimensionality-reduction", "clustering", "integration"]
    assert col(spark, routing.notes_for_phase(F.col("p"), F.col("s"), F.col("q")), p="qc", s=[], q="") == ["qc", "doublet-detection", "normalization", "feature-selection"]
    assert col(spark, routing.notes_for_phase(F.col("p"), F.col("s"), F.col("q")), p="x", s=[], q=None) == ["qc", "doublet-detection", "clustering", "cell-annotation", "marker-genes"]
    assert col(spark, routing.skills_for(F.col("t"), F.col("r")), t="RNA velocity", r=["gsea"]) == ["seurat-workflow", "cell-annotation", "differential-expression", "trajectory"]
    assert col(spark, routing.skill_kind(F.col("n"), F.col("d")), n="x", d="Visium") == "spatial" and col(spark, routing.skill_kind(F.col("n"), F.col("d")), n="x", d=None) == "other"
    assert col(spark, routing.skill_name(F.col("n")), n="DEG_Pathway") == "differential-expression"
    assert col(spark, routing.has_batch_figure(F.col("p")), p=["a/batch_UMAP.png"]) and not col(spark, routing.has_batch_figure(F.col("p")), p=[])
    assert col(spark, routing.merged_in_order(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z", "x"]) == ["x", "y", "z"]


def test_literature(spark):
    assert col(spark, retrieval.first_sentence(F.col("t")), t="One; two.  Three. Four") == "One; two."
    assert col(spark, retrieval.first_sentence(F.col("t")), t="x" * 300) == "x" * 220 + "…" and col(spark, retrieval.first_sentence(F.col("t")), t=None) == ""
    hits = spark.createDataFrame([(1, 2, "p", None, "A b. c", "s", "papers", 0.5), (1, 1, "q", "methods", " ", "s", None, 1.0)], "query_id int, rank int, stem string, section string, text string, source string, collection string, score double")
    assert [r.line for r in retrieval.recommendations(hits).collect()] == ["p [body]: A b."]
    assert retrieval.format_hits(hits).first().text == "[1] s (score=1.000)\n\n\n[2] s [papers] (score=0.500)\nA b. c"
    q = retrieval.phase_queries(spark.createDataFrame([("qc", "mine", "", None)], "phase string, user_query string, tissue string, platform string")).first().query
    assert q.startswith("mine single-cell quality control")


def test_papers_by_section(spark):
    md = "# Title\n\nlead\n\n## Methods\nwe did hyphen-\nated work\n\n## Results\n" + "A fact stands here. " * 60 + "\n\n## Methods\nlater\n\n## References\n[1]"
    df = spark.createDataFrame([(1, md), (2, None)], "id int, text string")
    parts = {r.section: r for r in retrieval.split_sections(df).collect()}
    assert {k: r.no for k, r in parts.items()} == {"title": None, "other": 0, "methods": 1, "results": 2} and parts["methods"].text == "later" and parts["title"].text == "Title"
    chunks = retrieval.chunk_sections(df, 300, 50).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in chunks] == list(range(len(chunks))) and chunks[0].section == "other" and all(len(r.text) <= 300 for r in chunks)
    assert retrieval.markdown(retrieval.split_sections(df)).first().markdown.startswith("# Title\n\n## Other\n\nlead\n")
    assert col(spark, retrieval.postprocess(F.col("t")), t="Open Access\nreal hyphen-\nated line\n12\n\n\nPage 3 of 9\n.a\nmore\x00text") == "real hyphenated line\n\nmoretext"


def test_claims_and_selection(spark, tmp_path):
    states = spark.createDataFrame([(1, ["A", "B"], [("GO:1", "n")], [("7", "10.1/x", "T")])], "state_no int, markers array<string>, pathways array<struct<id:string,name:string>>, citations array<struct<pmid:string,doi:string,title:string>>")
    labels = spark.createDataFrame([("x", 1), ("y", None), ("z", 1)], "label string, state_no int")
    terms = spark.createDataFrame([("x", "GO:9", 1e-9, 0.1), ("x", "go:1", 1e-3, 0.2), ("y", "GO:9", 0.5, 0.5)], "label string, term string, pval double, fdr double")
    got = {r.label: r for r in routing.assembled_claims(labels, states, terms).collect()}
    assert (got["x"].pathway_id, got["y"].pathway_id, got["z"].pathway_id, got["z"].pval) == ("go:1", "GO:9", "GO:1", None)
    text = routing.claim_text(routing.assembled_claims(labels, states, terms).withColumns({"assertion": F.col("label"), "ok": F.lit(True)}), "label").where("label = 'x'").first().text
    assert text == "### x\n\n- status: supported\n- markers: A, B\n- pathway: `go:1` (p=0.001, FDR=0.2)\n- citation: T DOI `10.1/x` PMID 7"
    (tmp_path / "s.json").write_text(json.dumps({"cell_ids": [], "barcodes": ["a", "b"], "query": "q"}))
    assert sorted(map(tuple, readers.read_selection(spark, str(tmp_path / "s.json")).collect())) == [("a", "q"), ("b", "q")]


def test_catalog_files(spark, tmp_path):
    (tmp_path / "st.json").write_text(json.dumps({"states": [{"name": "S", "aliases": ["t"], "markers": ["A"], "pathways": [{"id": "GO:1"}], "citations": [{"pmid": "1", "year": 2020}]}]}))
    (tmp_path / "gs.json").write_text(json.dumps({"sets": [{"id": "H", "genes": ["a", "B", ""]}, {"name": "N", "genes": []}]}))
    assert readers.read_states(spark, str(tmp_path / "st.json")).first().citations[0].year == 2020
    assert sorted(map(tuple, readers.gene_sets(spark, str(tmp_path / "gs.json")).collect())) == [("H", "A"), ("H", "B")]
    rec = json.dumps({"name": "N", "cl_id": "CL:1", "markers": ["a", "b"], "parent": "p", "pathways": [{"id": "GO:1"}, {"name": "x"}], "citations": [{"doi": "d"}]})
    assert col(spark, readers.format_record(F.col("r"), F.lit("f")), r=rec) == "# N (CL:1)\nsource: f\nmarkers: a, b\nparent: p\npathways: GO:1, x\ncitations: d"
    m, c, g = readers.demo_matrix(spark)
    assert c.count() == 100 and g.count() == 60 and abs(m.agg(F.sum("value")).first()[0] / 6000 - 1.5) < 0.06


def test_small_helpers(spark):
    assert summaries.dotted({"a": {"b": 1}}, "a.b") == 1 and summaries.dotted({}, "a.b", 2) == 2
    assert summaries.overlaid({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    logs = spark.createDataFrame([(1, "doublet_status=ok rate=0.1\nother line")], "id int, text string")
    assert {(r.name, r.value) for r in summaries.metric_lines(logs).collect()} == {("doublet_status", "ok"), ("rate", "0.1")}
    assert tuple(col(spark, provenance.semver(F.col("v")), v="scanpy 1.10")) == (1, 10, 0) and col(spark, provenance.semver(F.col("v")), v="none") is None
    files = spark.createDataFrame([("a", "x"), ("b", None)], "name string, text string")
    assert provenance.files_fingerprint(files).first() == provenance.files_fingerprint(files.orderBy(F.desc("name"))).first()
    obs = spark.createDataFrame([(i, "s", float("nan") if i else 1.0) for i in range(30)], "cell_id int, sample string, total_counts double")
    pts = spark.createDataFrame([(1, [1.0, 2.0])], "cell_id int, vec array<double>")
    v = summaries.viewer_points(obs, pts, 10)
    assert v.count() == 10 and v.columns == ["cell_id", "x", "y", "sample", "total_counts"]
    assert cells.second_method(["sim", "scdblfinder"]) == "scdblfinder" and cells.second_method([]) is None
    m = spark.createDataFrame([(1, 1, 3.0)], "cell_id int, gene_id int, value double")
    assert cells.counts_layer({"raw": m}, m) is m
    with pytest.raises(ValueError):
        cells.counts_layer({}, m)
    ora = spark.createDataFrame([("t", 2, 4, 0.01, 0.05)], "term string, overlap int, set_size int, pval double, fdr double")
    assert stats.pathway_points(ora).first().x == 0.5
