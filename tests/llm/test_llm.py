import base64
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import canonical, encode, lookalike, packing, scans, spans, splitting
from tessera.llm.bpe import PATTERN, VOCAB, ByteBPE

ODD = "ab  \n\té漢'sstll.1９　\x1c\x85🙂-"


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE()


def fuzz(seed, n, most):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, most))) for _ in range(n)]


# Problem 7


def test_ids_equal_the_public_library(bpe):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    want = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = fuzz(1, 3000, 16) + ["<|endoftext|> x", " lead", "trail ", "a" * 5000, "ab" * 4000, "!?" * 3000, "漢字" * 2000, " " * 999, "don't we'll  I'm", ""]
    assert all(bpe.ids(t) == want.encode_ordinary(t) for t in texts)


def test_encode_rows(spark):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "y"), (4, "naïve\x00 🙂 " * 2000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # a column of the result's name is there already
    got = encode.encode(df)
    assert got.columns == ["doc_id", "ids"] and got.count() == 5
    assert [r.ids for r in got.where("doc_id in (2, 3)").collect()] == [[], []]
    back = encode.decode(got).select("doc_id", "text").distinct().collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t or "") for i, t, _ in rows}
    assert encode.encode(df.limit(0)).count() == 0


# Problem 8


def test_containers(spark, bpe):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["cell", "tramuguba", "7", "ok"]) for _ in range(rnd.randint(0, 60))) for _ in range(400)] + [None, "", "word " * 900, "same", "same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, container int").repartition(5)
    got = packing.pack(df, capacity=128, windows=8).collect()
    size = {i: len(bpe.ids(t)) for i, t in enumerate(texts)}
    assert {r.doc_id for r in got} == set(size)
    by, held = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        held.setdefault(r.container, []).append(r)
    for i, rows in by.items():
        assert sum(r.n_tokens for r in rows) == size[i]
        rows.sort(key=lambda r: r.piece)
        assert [r.token_start for r in rows] == [128 * k for k in range(len(rows))]
        assert len(rows) == 1 or size[i] > 128
    for rows in held.values():
        rows = sorted((r for r in rows if r.n_tokens), key=lambda r: r.at)
        at = 0
        for r in rows:
            assert r.at == at
            at += r.n_tokens
        assert at <= 128
    used = sum(size.values()) / (128 * len(held))
    assert used > 0.9
    assert packing.fill(spark.createDataFrame(got), 128).first().n_tokens == sum(size.values())
    assert packing.pack(df.limit(0)).count() == 0


def test_only_empty_texts(spark):
    got = packing.pack(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string").coalesce(1)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 0), (2, 0)]


# Problem 3


def test_cuts_keep_limit_and_overlap():
    para = "One sentence stands here. Another follows it, longer than the first one was.\n\n"
    for t in (para * 90, "a" * 9000, " " * 4100, "ab " * 3000, "\n" * 5000, "a." * 2500, "é" * 6000, "x" * 2001, para * 20 + "z" * 5000):
        c = splitting.cuts(t)
        assert c[0][0] == 0 and c[-1][1] == len(t) and all(0 < e - s <= 2000 for s, e, _ in c)
        assert all(b[0] == a[1] - 150 for a, b in zip(c, c[1:]))
    assert {k for *_, k in splitting.cuts(para * 90)} == {"paragraph", "end"}
    assert splitting.cuts("x" * 2000) == [(0, 2000, "end")] and splitting.cuts("") == []


def test_cuts_are_the_cheapest():
    """Against every chain of cuts, on short texts."""
    rnd = random.Random(3)
    for _ in range(30):
        t = "".join(rnd.choice("ab. \n") for _ in range(rnd.randint(25, 60)))
        limit, over = 20, 4
        pos, kinds = splitting.boundaries(t, limit - over)
        pieces = -(-(len(t) - over) // (limit - over))
        goal = (len(t) - over) / pieces
        best = {over: 0.0}
        for p, k in zip(pos, kinds):
            ways = [c + ((p - q) / goal - 1) ** 2 for q, c in best.items() if q < p and p - q <= limit - over]
            if p > over and ways:
                best[p] = min(ways) + splitting._COST[k] + 0.05
        got, at = 0.0, over
        for _, e, k in splitting.cuts(t, limit, over):
            got += ((e - at) / goal - 1) ** 2 + splitting._COST[splitting.KINDS.index(k)] + 0.05
            at = e
        assert abs(got - best[len(t)]) < 1e-9


def test_split_rows(spark):
    df = spark.createDataFrame([(1, "a", "w " * 3000, 0), (2, "b", None, 0), (3, "c", "", 0), (4, "d", "x" * 2000, 0), (1, "a", "w " * 3000, 0)], "id int, field string, text string, piece int")
    got = splitting.split(df, ["id", "field"], "text").collect()
    assert {r.id for r in got} == {1} and len([r for r in got if r.piece_no == 0]) == 2
    assert all(r.piece == ("w " * 3000)[r.start : r.end] for r in got)
    assert {r.id for r in splitting.split(df, ["id"], "text", only_oversized=False).collect()} == {1, 4}
    assert splitting.split(df.limit(0), ["id"], "text").count() == 0


# Problem 6


def test_one_form():
    one = lookalike.transducer()
    same = [("Ａｂ１：（x）", "Ab1:(x)"), ("naïve", "naïve"), ("c​a⁠﻿t", "cat"), ("a b c d　e\tf", "a b c d e f"), ("Сеllѕ оf", "Cells of"), ("µm", "μm"), ("u​̈", "ü")]
    assert all(one(a) == b for a, b in same)
    apart = ["Abc", "abc", "naive", "naïve", "a-b", "a—b", "a\nb", "a b", "a  b", "a1", "al", "a,b", "a.b", "β", "ß", "Карта"]
    assert len({one(x) for x in apart}) == len(apart)
    for t in fuzz(4, 500, 20) + [a for a, _ in same]:
        assert one(one(t)) == one(t)


def test_longest_match_over_clusters():
    one = lookalike.transducer()
    # The twin alone has a rule, the twin with its marks another one; half-width kana likewise.
    same = [("а", "a"), ("ӓ", "ä"), ("ａ̣̂", "ậ"), ("ậ", "ậ"), ("ậ", "ậ"), ("ё", "ë"), ("Ά", "Á"), ("ｶ", "カ"), ("ｶﾞ", "ガ"), ("ﾊﾟ", "パ"), ("각", "각"), ("ﬁ", "fi"), ("ǆ", "dž"), ("\u212a", "K"), ("u\u200b\u200d̈", "ü")]
    assert [one(a) for a, _ in same] == [b for _, b in same]
    # Without the rules of sequences the shorter match would leave the mark outside.
    bare = lookalike.Transducer([("x", "y")])
    full = lookalike.Transducer([("x", "y"), ("x\u20d7", "z")])
    assert bare("éx\u20d7") == "éy\u20d7" and full("éx\u20d7") == "éz"


def test_all_twins_become_one():
    one = lookalike.transducer()
    for group in (lookalike.CYRILLIC, lookalike.GREEK, lookalike.ARMENIAN, lookalike.LISU, lookalike.CHEROKEE):
        for pair in group.split():
            assert one(pair[0]) == pair[1]
    assert one("𝐀𝒷𝗖𝟜") == "AbC4" and one("Ⅷ") == "VIII" and one("ꓡꓲꓢꓴ ᎳᎬ") == "LISU WE"
    assert all(one(one(a)) == one(a) for a, _ in lookalike.rules())


def test_conflicts_are_found():
    with pytest.raises(ValueError):
        lookalike.Transducer([("x", "a"), ("x", "b")])
    with pytest.raises(ValueError):
        lookalike.Transducer([("x", "y"), ("y", "x")])
    assert lookalike.Transducer([("ﬁ", "A"), ("ﬁﬁ", "B")])("ﬁﬁﬁ") == "BA"  # the longest match first


def test_same_look(spark):
    rows = [(1, "t", "Cell"), (2, "t", "С​ell"), (3, "t", "Cell"), (4, "s", "Ｃell"), (5, "t", None), (6, "t", " "), (7, "t", " "), (8, "t", "cell"), (2, "t", "С​ell")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id bigint, field string, text string, raw string")
    assert sorted(map(tuple, lookalike.same_look(df, "id", "field", "text").collect())) == [(1, 2, "t"), (2, 3, "t")]
    assert lookalike.same_look(df.limit(0), "id", "field", "text").count() == 0
    got = lookalike.unify(df).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.id in (1, 2, 4)} == {"Cell"}


# Problem 9


def pairs_by_force(texts, n=200):
    grams = {}
    for i, t in texts:
        for a in range(len(t) - n + 1 if t else 0):
            grams.setdefault(t[a : a + n], set()).add(i)
    return {(a, b) for g in grams.values() for a in g for b in g if a < b}


def made_texts(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh é漢") for _ in range(rnd.randint(1, 9)))
    text = lambda n: "".join(word() for _ in range(n))
    base = [text(rnd.randint(20, 200)) for _ in range(30)]
    out = list(base)
    for _ in range(60):
        s = rnd.choice(base)
        a, n = rnd.randint(0, max(0, len(s) - 150)), rnd.choice([150, 199, 200, 201, 260, 600])
        out.append(text(rnd.randint(0, 40)) + s[a : a + n] + text(rnd.randint(0, 40)))
    return out + [base[0], base[0], "ab" * 300, "ab" * 250 + "c", "x" * 200, "x" * 199, None, ""]


def test_shared_spans(spark):
    texts = list(enumerate(made_texts(5)))
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id bigint, text string, h int")
    want = pairs_by_force(texts)
    for hot in (256, 2):  # with every unit cold, and with nearly every one hot
        s = spans.shared(df, hot=hot)
        got = s.pairs().collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
        cover = {}
        for r in s.spans().collect():
            cover.setdefault(r.key, set()).update(range(r.start, r.end))
        for i, t in texts:
            mine = set()
            for j, u in texts:
                if i != j and t and u:
                    grams = {u[a : a + 200] for a in range(len(u) - 199)}
                    for a in range(len(t) - 199):
                        if t[a : a + 200] in grams:
                            mine.update(range(a, a + 200))
            assert cover.get(i, set()) == mine
    share = {r.doc_id: r for r in spans.share(df).collect()}
    assert len(share) == len(texts) and share[0].share == 1.0 and share[len(texts) - 1].share == 0.0
    assert spans.shared(df.limit(0)).pairs().count() == 0


def test_repeated_units(spark):
    para = "shared words " * 20
    df = spark.createDataFrame([(2, "x\n" + para), (1, para.replace(" ", "  ") + "\nend"), (3, None), (4, para + "\n" + para)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.start, r.kept_doc_id, r.kept_start) for r in spans.repeated_units(df).collect())
    assert got == [(2, 2, 1, 0), (4, 0, 1, 0), (4, len(para) + 1, 1, 0)]


# Problem 5


CANON = [(1, "gamma felofekil progenitor", "LKFH5"), (2, "memory felofekil progenitor", "FKLB1"), (3, "tissue-resident gabatrapli progenitor", "GTPA1"), (4, "VTRP15-positive nizofeba neuron", "NZFB1"), (5, "zateplufoscyte", "ZTPA2"), (6, "sezovefu cell", "SZVA3")]
MORE = [(10 + i, f"{q} {s} {k}", f"QX{i}A{i}") for i, (q, s, k) in enumerate((q, s, k) for q in ("gamma", "memory", "tissue-resident", "resting", "alpha") for s, k in (("drukolimap", "cell"), ("bofitrasen", "progenitor"), ("mugedrilot", "neuron"), ("kaprenufib", "fibroblast"), ("pilosutrem", "epithelial cell")))]


def test_canonical(spark):
    means = {
        "Gamma Felofekil Progenitors": 1, "felofekli prog. (γ)": 1, "MEMORY_FELOFEKIL_PROGENITOR": 2, "fklb-1": 2, "(FKLB1)": 2, "gabatrapli progenitor - check": 3, "Tissue Resident gaba trapli prog.": 3,
        "Vtrp15⁺ Nizofeba Neuron": 4, "nizofeba neuron ?": 4, "c12 zateplufscytes": 5, "Cluster 3: sezovefu c.": 6, "sezoefu cell / n=615": 6, "ｓezovefu cell": 6, "LKFH5 cells": 1,
        "doublet?": 0, "": 0, "n/a": 0, "unk. 16": 0, "gamma lesotovom cell": 0, "alpha felofekil progenitor": 0, "cluster 7": 0,
    }
    ref = spark.createDataFrame(CANON + MORE, "canon_id bigint, canon_name string, short_name string")
    got = canonical.match(spark.createDataFrame([(v,) for v in means], "value string"), ref)
    assert {r.value: r.canon_id for r in got.collect()} == means


def test_short_and_broken_stems(spark):
    ref = spark.createDataFrame([(1, "resting ova cell", "A1"), (2, "memory li cell", "A2"), (3, "gamma drukolimapsotre cell", "A3")] + MORE, "canon_id bigint, canon_name string, short_name string")
    means = {"ova cells": 1, "ovaa cell": 1, "li cell": 2, "lo cell": 0, "dru ko limap sotre cell": 3, "d r u k o l i m a p s o t r e": 3}
    got = canonical.match(spark.createDataFrame([(v,) for v in means], "value string"), ref)
    assert {r.value: r.canon_id for r in got.collect()} == means


def test_prefix_filter_loses_nothing(spark):
    rnd = random.Random(6)
    stems = sorted({"".join(rnd.choice("abcdefgklmnoprstu") for _ in range(rnd.randint(1, 12))) for _ in range(40)} | {"é漢", "aaaa"})
    forms = set(stems)
    for stem in stems:
        for _ in range(8):
            w = list(stem)
            for _ in range(rnd.randint(0, 5)):
                w[rnd.randrange(len(w))] = rnd.choice("abcdefgklmnoprstué")
            forms.add("".join(w))
    pairs = lambda w: {f"^{w}$"[i : i + 2] for i in range(len(w) + 1)}
    for t in (0.25, 0.6):
        want = {(f, s, round(len(pairs(f) & pairs(s)) / len(pairs(f) | pairs(s)), 9)) for f in forms for s in stems}
        got = canonical.candidates(spark.createDataFrame([(f,) for f in forms], "form string"), spark.createDataFrame([(x,) for x in stems], "stem string"), t).collect()
        assert {(r.form, r.stem, round(r.jaccard, 9)) for r in got} == {x for x in want if x[2] >= t} and len(got) == len({(r.form, r.stem) for r in got})


def test_match_rows(spark):
    values = spark.createDataFrame([(1, 0, "sezovefu cells", "k"), (1, 1, None, "k"), (2, 0, "sezovefu cells", "k"), (3, 0, "w" * 5000, "k"), (4, 0, "", "k")], "row_id bigint, pos int, value string, canon_name string")
    ref = spark.createDataFrame(CANON + MORE, "canon_id bigint, canon_name string, short_name string")
    got = sorted((r.row_id, r.pos, r.canon_id) for r in canonical.match(values, ref).collect())
    assert got == [(1, 0, 6), (2, 0, 6), (3, 0, 0), (4, 0, 0)]
    assert {r.canon_id for r in canonical.match(values, ref.limit(0)).collect()} == {0}
    assert canonical.match(values.limit(0), ref).count() == 0


# Problem 2


def paper(spark, sections, title="Mapping sparse progenitors by differential testing", source="papers/katovodopaba_2013.pdf"):
    filler = {"other": "\n".join(["heterogeneous fractions of the stomach were detected in tissue-resident cells before scoring.", "The progenitors of peripheral tissue-resident cells were heterogeneous fractions."] * 15)}
    rows = [(1, title, source, sections, "x"), (2, None, None, filler, "x"), (3, "t", "s", None, "x"), (4, "t", "s", {"abstract": None, "methods": "  "}, "x")]
    return spark.createDataFrame(rows, "paper_id bigint, title string, source_pdf string, sections map<string,string>, word string")


def found(df):
    return {(r.id, r.section, r.noise) for r in scans.noise(df).select("id", "section", "noise").collect()}


def test_noise_kinds(spark):
    df = paper(spark, {
        "abstract": "The hete-\nrogeneous fract‐\nMapping sparse progenitors by   12\nions were detected in tissue-\nresident cells.",
        "introduction": "The progenltors of the stom@ch\n- 13 -\nwere detected.",
        "methods": "Cells per donor:\n4160\n9520\n1303\nThe fractions were detected in tissue-\nresident cells before\nscoring.",
        "results": "Fractions were\n14\nKatovodopaba et al.\ndetected in the stomach.",
    })
    assert found(df) == {(1, "abstract", "hyphen"), (1, "abstract", "header"), (1, "introduction", "ocr"), (1, "introduction", "page"), (1, "results", "page"), (1, "results", "header")}
    fixed = {(r.paper_id, r.section): r.text for r in scans.repair(df).collect()}
    assert fixed[1, "abstract"] == "The heterogeneous fractions were detected in tissue-resident cells."
    assert fixed[1, "introduction"] == "The progenitors of the stomach were detected."
    assert fixed[1, "methods"].startswith("Cells per donor:\n4160\n9520\n1303\nThe fractions were detected in tissue-resident cells before scoring.")
    assert fixed[1, "results"] == "Fractions were detected in the stomach."
    assert fixed[4, "abstract"] == "" and fixed[4, "methods"] == ""


def test_look_alikes_are_no_misreadings(spark):
    assert found(paper(spark, {"abstract": "The prоgenitors of the ｓtomach were de​tected."})) == set()


def test_no_papers(spark):
    df = paper(spark, {}).limit(0)
    assert found(df) == set() and scans.repair(df).count() == 0


# The queries


def test_queries_run(spark, sf):
    import __spark_entry__ as entry

    for name in [n for n in entry.queries() if n[0] == "p" and n[1:2].isdigit()]:
        df = entry.queries()[name](spark, sf)
        assert df.select(F.count("*")).first()[0] >= 0, name
