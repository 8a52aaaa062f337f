"""Repairing text that comes from scanned pages.

Running headers are found by fuzzy repetition of short lines within a paper (and against its title
and file name), page numbers by their form and place. What is left is joined into paragraphs: a word
broken at a line's end is put together if the corpus writes it as one word, and kept apart with its
hyphen if the corpus writes it so. A word the corpus hardly knows, that one known confusion of
characters turns into a word it knows well, is a misreading.

Each text is parsed once, into its noise lines, broken words and words with their numbers; the rest
are joins and group-bys of words, none of which gathers the corpus. Which characters are confused is
learned from pairs of rare and frequent words, besides a short list for small corpora. Only words that
make up at least 1 / 50,000 of all words are broadcast, so at most 50,000 of them.

Defined results: null and blank sections and papers without sections have no noise; a null title or
file name only takes away that evidence; repeated rows count each by their id; rows with a null id
are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.lookalike import transducer
from tessera.session import materialize

# What scanners read for what is printed, as (read, printed). They only help where a
# corpus is too small to show its confusions by itself (see ``_learned``).
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("@", "a"), ("ri", "n"), ("n", "ri"), ("!", "i"), ("!", "l"), ("l", "i"), ("i", "l"), ("1", "l"), ("1", "i"),
    ("cl", "d"), ("d", "cl"), ("5", "s"), ("0", "o"), ("ii", "u"), ("u", "ii"), ("rn", "m"), ("m", "rn"), ("q", "g"), ("g", "q"), ("b", "h"), ("h", "b"),
    ("6", "b"), ("8", "b"), ("9", "g"), ("l", "t"), ("t", "l"), ("vv", "w"), ("w", "vv"), ("3", "e"), ("$", "s"), ("|", "l"), ("|", "i"), ("o", "c"), ("c", "o"),
    ("nn", "m"), ("fi", "h"), ("li", "h"), ("in", "m"),
]
MARKS = "-\u2010\u2011\u00ad\u00ac"
COMMON = 50_000
LETTER = r"[^\W\d_]"

_hidden = re.compile("[\u200b-\u200d\u2060\ufeff\x0c]")
_broken = re.compile(rf"({LETTER}+)([{MARKS}])\s*$")
_onward = re.compile(rf"({LETTER}+)")
_page = re.compile(r"\W*(?:p(?:(?:a?g)?e?|p)\.?\s*)?(s?\d{1,5}|[ivxlc]{1,7})(?:\s*(?:/|of)\s*\d{1,5})?\W*", re.I)
_number = re.compile(r"\s*\d[\d,.]*\s*")
_running = re.compile(rf"[\d%=<>()]|[{MARKS}]$").search
_wide = re.compile("[\u3040-\u9fff]{3}").search
_item = re.compile(r"\s*(?:[-*•–]|\d+[.)])\s").match
_edge_no = re.compile(r"^\W*\d{1,5}\W+|\W+\d{1,5}\W*$")
_word = re.compile(r"[^\s.,;:()\[\]{}\"“”•/]+(?:[.][^\s.,;:()\[\]{}\"“”•/]+)*").findall
_shape = re.compile(r"(?=.*[^\W\d_A-Z])(?:[^\W_]|[@!|$])+")


def _fold(line: str) -> str:
    """A line's core for comparison: one form, lower case, single blanks, page number off."""
    return " ".join(_edge_no.sub(" ", line).lower().replace("|", " ").split())


def _alike(a: str, b: str, least: float = 0.82) -> bool:
    if a == b:
        return True
    if abs(len(a) - len(b)) > 0.2 * max(len(a), len(b)):
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.quick_ratio() >= least and m.ratio() >= least


class Paper:
    """The lines of a paper's sections: ``kinds`` has None, ``page`` or ``header`` for each."""

    def __init__(self, title: str | None, source: str | None, sections: list[tuple[str, str | None]]) -> None:
        one = transducer(MARKS)
        self._flow: dict[int, list[str]] = {}
        self.lines: list[tuple[str, list[str]]] = []
        for name, text in sections:
            self.lines.append((name, [one(_hidden.sub("", line)) if not line.isascii() else line.replace("\x0c", "") for line in (text or "").split("\n")]))
        head = " ".join(one(title or "").lower().split())
        stem = re.split(r"[_.]", (source or "").rsplit("/", 1)[-1])[0].lower()
        self.kinds = [[None] * len(lines) for _, lines in self.lines]
        short: list[tuple[int, int, str]] = []
        longest = max(75, len(head) + 16)  # a header is a heading or the title, with a page number
        for s, (_, lines) in enumerate(self.lines):
            for i, line in enumerate(lines):
                bare = line.strip()
                if not bare:
                    continue
                if _page.fullmatch(bare) and not bare.endswith((".", ",", ";")) and (bare.count(")") == bare.count("(")) and not self._listed(lines, i):
                    self.kinds[s][i] = "page"
                elif len(bare) <= longest and not bare.endswith((":", ",", ";")) and len(lines) > 1:
                    core = _fold(bare)
                    if " " in core or _wide(core):
                        short.append((s, i, core))
        # Fuzzy repetition: lines are compared within blocks of equal first or last word. Running text
        # has its templates too, so only what looks like a heading is compared.
        blocks: dict[str, list[int]] = {}
        for n, (s, i, core) in enumerate(short):
            line, w = self.lines[s][1][i].strip(), core.split()
            if len(w) <= 7 and (line[0].isupper() or line[0].isdigit()) and not _running(core) and (line[-1] != "." or line.lower().endswith("al.")):
                for k in {"<" + w[0], ">" + w[-1]}:
                    blocks.setdefault(k, []).append(n)
        again: set[int] = set()
        for block in blocks.values():
            firsts: list[tuple[str, int]] = []
            for n in block:
                core = short[n][2]
                for other, m in firsts:
                    if _alike(core, other, 0.9):
                        again |= {n, m}
                        break
                else:
                    firsts.append((core, n))
        title_words = set(head.split())
        for n, (s, i, core) in enumerate(short):
            words = core.split()
            titled = len(core) <= len(head) + 3 and (_wide(core) or len(words) >= 3 and 2 * len(title_words.intersection(words)) >= len(words)) and _alike(core, head[: len(core)], 0.85)
            named = len(stem) > 5 and len(words) <= 6 and any(abs(len(w) - len(stem)) < 3 and (w[:3] == stem[:3] or w[-3:] == stem[-3:]) and _alike(w.strip(":,"), stem, 0.8) for w in words)
            if titled or named or n in again:
                self.kinds[s][i] = "header"

    @staticmethod
    def _listed(lines: list[str], i: int) -> bool:
        """Whether a number's line belongs to a list of numbers."""
        if not _number.fullmatch(lines[i]):
            return False
        if "," in lines[i] or "." in lines[i]:
            return True
        before = next((x for x in reversed(lines[:i]) if x.strip()), "")
        after = next((x for x in lines[i + 1 :] if x.strip()), "")
        if before.rstrip().endswith(":"):
            return True
        if i and _number.fullmatch(lines[i - 1]) or i + 1 < len(lines) and _number.fullmatch(lines[i + 1]):
            near = [int(x) for x in (before, lines[i], after) if x.strip().isdigit()]
            return not all(b - a == 1 for a, b in zip(near, near[1:]))
        return False

    def flow(self, s: int) -> list[str]:
        if s not in self._flow:
            self._flow[s] = self._flowing(s)
        return self._flow[s]

    def _flowing(self, s: int) -> list[str]:
        """A section's lines without its noise lines; a blank line that only parted noise goes too."""
        lines, kinds, out = self.lines[s][1], self.kinds[s], []
        for i, (line, kind) in enumerate(zip(lines, kinds)):
            if kind:
                continue
            if not line.strip() and ((i and kinds[i - 1]) or (i + 1 < len(kinds) and kinds[i + 1])):
                text = next((x for x in reversed(out) if x.strip()), "").rstrip()
                if text and text[-1] not in ".!?。：:":
                    continue
            out.append(line)
        return out

    def breaks(self, s: int) -> list[tuple[int, str, str, str]]:
        """(line, left, mark, right) of words that may be broken at the end of a line of the flow."""
        lines, out = self.flow(s), []
        for i, line in enumerate(lines[:-1]):
            end = line.rstrip()
            m = _broken.search(end.rsplit(None, 1)[-1]) if end and end[-1] in MARKS else None
            if m:
                r = _onward.match(lines[i + 1].lstrip())
                # After capitals ("TGF-", "RRHMB-") a hyphen is the name's own.
                if r and r[1][0].islower() and not (m[2] == "-" and len(m[1]) > 1 and m[1].isupper()):
                    out.append((i, m[1].lower(), m[2], r[1].lower()))
        return out

    def words(self, s: int) -> dict[str, int]:
        """Words that stand whole within a line, lower case: hyphenated ones whole and in parts."""
        lines = self.flow(s)
        count: Counter[str] = Counter()
        ends = {i for i, *_ in self.breaks(s)}
        for i, line in enumerate(lines):
            found = _word(line)
            if i in ends and found:
                found.pop()
            if i - 1 in ends and found:
                found.pop(0)
            count.update(found)
        out: dict[str, int] = {}
        for w, n in count.items():
            for form in _forms[w]:
                out[form] = out.get(form, 0) + n
        return out


class _Forms(dict):
    """What a written word counts as: itself in lower case, and the parts of a compound."""

    def __missing__(self, w: str) -> tuple[str, ...]:
        if len(self) > 200_000:
            self.clear()
        low = "" if _caps(w) else w.strip("'’-").lower()
        if len(low) < 3:
            forms: tuple[str, ...] = ()
        elif "-" in low:
            forms = (low, *(p for p in low.split("-") if len(p) > 2 and _shape.fullmatch(p)))
        else:
            forms = (low,) if _shape.fullmatch(low) else ()
        self[w] = forms
        return forms


_forms = _Forms()


def _caps(w: str) -> bool:
    """Names of genes and the like: two capitals or more at the start."""
    return w[:2].isupper() or w.isdigit()


def readings(word: str, confusions: list[tuple[str, str]] = CONFUSIONS) -> set[str]:
    """What a word may be if one kind of confusion is taken back, at one place or at all."""
    out = set()
    for read, printed in confusions:
        if read in word:
            at = word.find(read)
            while at >= 0:
                out.add(word[:at] + printed + word[at + len(read) :])
                at = word.find(read, at + 1)
            out.add(word.replace(read, printed))
    out.discard(word)
    return out


def _papers(df: DataFrame, id: str, title: str, source: str, sections: str) -> DataFrame:
    entries = F.map_entries(sections)
    return df.select(F.col(id).alias("id"), F.col(title).alias("title"), F.col(source).alias("source"), entries.alias("sections")).where("id is not null and sections is not null")


def _each(batch: pa.RecordBatch) -> Iterator[tuple[object, Paper]]:
    for i, t, src, sec in zip(*(c.to_pylist() for c in batch.columns[:4])):
        yield i, Paper(t, src, [(x["key"], x["value"]) for x in sec])


def _sections(papers: DataFrame) -> DataFrame:
    """What each section says, in one pass over the text: (id, section, kinds, breaks, words, ns): its
    kinds of noise lines, its words that may be broken, and its words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, p in _each(b):
                for s, (name, _) in enumerate(p.lines):
                    words = p.words(s)
                    breaks = [{"left": x[1], "mark": x[2], "right": x[3]} for x in p.breaks(s)]
                    rows.append((i, name, sorted({k for k in p.kinds[s] if k}), breaks, list(words), list(words.values())))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = (b.schema.field(0).type, pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([(k, pa.string()) for k in ("left", "mark", "right")])), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "section", "kinds", "breaks", "words", "ns"])

    return papers.mapInArrow(run, f"id {dict(papers.dtypes)['id']}, section string, kinds array<string>, breaks array<struct<left: string, mark: string, right: string>>, words array<string>, ns array<bigint>")


def _counts(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode(F.arrays_zip("words", "ns")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.ns").alias("n"))


def _learned(counts: DataFrame, least: int, times: int, support: int, most: int) -> list[tuple[str, str]]:
    """Confusions that the corpus itself shows: (read, printed) pieces of one or two characters by
    which a word differs from a much more frequent one, in ``support`` pairs of words or more and in a
    fiftieth of what the commonest confusion has. Words meet by what is left of them without the
    piece. The ``most`` strongest are taken."""
    def gaps(df: DataFrame, piece: str) -> DataFrame:
        n = F.length("word")
        at = lambda a: F.when(n >= a, F.transform(F.sequence(F.lit(1), n - a + 1), lambda i: F.struct(F.concat(F.substring("word", F.lit(1), i - 1), F.lit("\x00"), F.substring("word", i + a, n)).alias("rest"), F.substring("word", i, F.lit(a)).alias(piece)))).otherwise(F.array())
        return df.select("word", "n", F.explode(F.concat(at(1), at(2))).alias("g")).select(F.col("word").alias(f"w_{piece}"), F.col("n").alias(f"n_{piece}"), "g.rest", f"g.{piece}")

    plain = counts.where(~F.contains("word", F.lit("-")) & (F.length("word") > 3))
    often = gaps(plain.where((F.col("n") >= least) & (F.length("word") > 4) & F.col("word").rlike(r"^\p{L}+$")), "printed")
    met = gaps(plain, "read").join(often.hint("merge"), "rest").where(F.col("n_printed") >= times * F.col("n_read"))
    met = met.where((F.substring("read", 1, 1) != F.substring("printed", 1, 1)) & (F.substring("read", -1, 1) != F.substring("printed", -1, 1)))
    found = met.groupBy("read", "printed").agg(F.count("*").alias("n")).where(F.col("n") >= support).orderBy(F.desc("n"), "read", "printed").limit(most).collect()
    return [(r["read"], r["printed"]) for r in found if 50 * r["n"] >= found[0]["n"]]


def _misread(counts: DataFrame, least: int, times: int, confusions: list[tuple[str, str]]) -> DataFrame:
    """(word, right) of words that are misreadings of much more frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, right = [], []
            for i, w in enumerate(b.column(0).to_pylist()):
                if "-" not in w:
                    for r in readings(w, confusions):
                        if len(r) > 2 and r.isalpha():
                            who.append(i), right.append(r)
            take = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(right, pa.string())], names=["word", "n", "right"])

    tried = counts.mapInArrow(run, "word string, n bigint, right string")
    odd = F.col("word").rlike("[^\\p{L}]")
    known = tried.join(counts.select(F.col("word").alias("right"), F.col("n").alias("m")).hint("merge"), "right")
    known = known.where(F.when(odd, (F.col("m") >= 2) & (F.col("m") >= 2 * F.col("n"))).otherwise((F.col("m") >= least) & (F.col("m") >= times * F.col("n"))))
    return known.groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"))


def _broken_words(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(left, mark, right) of breaks that belong to one word."""
    q = asked.select("left", "mark", "right").distinct()
    keys = F.array(*(F.struct(F.lit(k).alias("role"), v.alias("word")) for k, v in (("join", F.concat("left", "right")), ("both", F.concat_ws("-", "left", "right")), ("left", F.col("left")), ("right", F.col("right")))))
    met = q.select("*", F.explode(keys).alias("k")).select("left", "mark", "right", "k.role", "k.word").join(counts, "word", "left")
    of = lambda role: F.sum(F.when(F.col("role") == role, F.coalesce("n", F.lit(0))).otherwise(0))
    n = met.groupBy("left", "mark", "right").agg(of("join").alias("j"), of("both").alias("b"), of("left").alias("l"), of("right").alias("r"))
    whole = F.when(F.col("j") + F.col("b") > 0, F.col("j") >= F.col("b")).when(F.col("mark") != "-", True).otherwise(~((F.col("l") >= 3) & (F.col("r") >= 3)))
    return n.where(whole).select("left", "mark", "right")


def noise(df: DataFrame, id: str = "paper_id", title: str = "title", source: str = "source_pdf", sections: str = "sections", least: int = 5, times: int = 10, known: list[tuple[str, str]] = CONFUSIONS, support: int = 3, most: int = 1000) -> DataFrame:
    """(id, section, noise, word, left, mark, right, fix) of all noise; a row per kind for noise
    lines, per distinct broken or misread word for the others. Confusions are those ``known`` and
    those that at least ``support`` pairs of the corpus' words show."""
    parsed = materialize(_sections(_papers(df, id, title, source, sections)), "parsed")
    counts = materialize(_counts(parsed), "words")
    confusions = list(dict.fromkeys([*known, *_learned(counts, least, times, support, most)]))
    misread = materialize(_misread(counts, least, times, confusions), "misread")
    text = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    lines = parsed.select("id", "section", F.explode("kinds").alias("noise"), *text("word", "left", "mark", "right", "fix"))
    asked = parsed.select("id", "section", F.explode(F.array_distinct("breaks")).alias("b")).select("id", "section", F.lit("hyphen").alias("noise"), *text("word"), "b.left", "b.mark", "b.right")
    joined = asked.join(_broken_words(asked, counts), ["left", "mark", "right"], "left_semi").withColumn("fix", F.concat("left", "right"))
    # Words that make up 1 / 50,000 of all words are right, unless they are misreadings; without them
    # few rows are left to join.
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") * COMMON >= total).join(misread, "word", "left_anti").select("word")
    words = parsed.select("id", "section", F.explode("words").alias("word")).join(F.broadcast(often), "word", "left_anti")  # at most COMMON words
    misreads = words.join(misread.withColumnRenamed("right", "fix").hint("merge"), "word").select("id", "section", F.lit("ocr").alias("noise"), "word", *text("left", "mark", "right"), "fix")
    cols = ["id", "section", "noise", "word", "left", "mark", "right", "fix"]
    return lines.select(cols).unionByName(joined.select(cols)).unionByName(misreads.select(cols))


def repair(df: DataFrame, id: str = "paper_id", title: str = "title", source: str = "source_pdf", sections: str = "sections") -> DataFrame:
    """(id, section, text, noise) with each section as continuous paragraphs and the kinds of noise
    taken out of it. The fixes of a paper travel with it as one array, no longer than its text."""
    found = noise(df, id, title, source, sections)
    per = found.groupBy("id").agg(F.collect_list(F.struct("section", "noise", "word", "left", "right", "fix")).alias("fixes"))
    papers = _papers(df, id, title, source, sections).join(per, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for (i, p), fixes in zip(_each(b), b.column(4).to_pylist()):
                for s, (name, _) in enumerate(p.lines):
                    own = [f for f in fixes or [] if f["section"] == name]
                    joins = {(f["left"], f["right"]) for f in own if f["noise"] == "hyphen"}
                    right = {f["word"]: f["fix"] for f in own if f["noise"] == "ocr"}
                    rows.append((i, name, _paragraphs(p, s, joins, right), sorted({f["noise"] for f in own})))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.string()))], names=[id, "section", "text", "noise"])

    return papers.mapInArrow(run, f"`{id}` {dict(papers.dtypes)['id']}, section string, text string, noise array<string>")


def _paragraphs(p: Paper, s: int, joins: set[tuple[str, str]], right: dict[str, str]) -> str:
    out: list[str] = []
    now = ""
    lines = p.flow(s)
    ends = {i: (left, mark, r) for i, left, mark, r in p.breaks(s)}
    for i, line in enumerate(lines):
        bare = line.strip()
        if not bare:
            if now:
                out.append(now)
            now = ""
            continue
        now += bare
        if i in ends:
            left, mark, r = ends[i]
            if (left, r) in joins:
                now = now.rstrip(MARKS + " ")
            elif mark != "-":
                now = now.rstrip(MARKS + " ") + "-"
        elif i + 1 < len(lines) and lines[i + 1].strip():
            now += "\n" if _number.fullmatch(bare) or bare.endswith(":") or "\t" in bare or _item(lines[i + 1]) else " "
    if now:
        out.append(now)
    text = "\n\n".join(out)

    def fix(m: re.Match) -> str:
        parts = m[0].split("-")
        new = [right.get(x.lower(), None) for x in parts]
        return "-".join(x if n is None else n[:1].upper() + n[1:] if x[:1].isupper() else n for x, n in zip(parts, new))

    return re.sub(r"[^\s.,;:()\[\]{}\"“”•/]+", fix, text) if right else text
