"""One form for texts that look the same.

A transducer is compiled from rules over grapheme clusters: a letter and its marks to the composed
letter, also where the letter is another script's twin; conjoining jamo to syllables; half-width kana
and their sound marks; widths, ligatures and letters of mathematics; blanks; invisible characters;
letters of other scripts that are drawn alike. Most rules are made from the character database, only
the twins of letters are listed. Compiling checks that no two rules give one sequence different
outputs and that no output holds anything a rule would change again, so one pass is enough and a
second pass changes nothing. At each place the longest sequence that has a rule is taken, so a
letter's twin with marks becomes the composed letter and not the bare twin with marks behind it.
Marks are met in canonical order. Runs of ordinary characters pass untouched: only runs of other
characters reach the transducer, and each distinct run is worked out once per worker.

Kept apart, as they can be told apart by eye: case, accents, digits, punctuation, line breaks, and
the number of blanks.

Defined results: null gives null, empty gives empty; repeated rows stay; unpaired combining marks
stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

# Letters drawn like a Latin letter, as pairs of the letter and its Latin twin.
CYRILLIC = "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ϳj"
ARMENIAN = "օo սu"
LISU = "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
CHEROKEE = "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB"
# Characters that are drawn like another one.
TWINS = {"\u00b5": "\u03bc", "\u2010": "-", "\u2011": "-"}
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad\u180e\u2061\u2062\u2063\u2064\u061c\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Ranges whose compatible forms look the same: full and half widths, Latin ligatures,
# Roman numerals, digraphs, letters of mathematics.
WIDTHS, KANA = range(0xFF01, 0xFFEF), range(0xFF66, 0xFF9E)
LIKE = [WIDTHS, range(0xFB00, 0xFB07), range(0x2160, 0x2180), range(0x132, 0x134), range(0x1C4, 0x1CD), range(0x1F1, 0x1F4), range(0x1D400, 0x1D800)]
SOUND = {"\uff9e": "\u3099", "\uff9f": "\u309a"}


def rules(keep: str = "") -> list[tuple[str, str]]:
    """The mapping as (sequence, output) pairs; characters in ``keep`` get no rule."""
    single: dict[str, str] = {pair[0]: pair[1] for group in (CYRILLIC, GREEK, ARMENIAN, LISU, CHEROKEE) for pair in group.split()}
    single |= TWINS | {c: "" for c in INVISIBLE} | {chr(c): "" for c in range(0xFE00, 0xFE10)} | {c: " " for c in BLANKS}
    for c in (chr(code) for part in LIKE for code in part):
        if (plain := unicodedata.normalize("NFKC", c)) != c and c not in single:
            single[c] = plain
    single = {a: b for a, b in single.items() if a not in keep}
    out = list(single.items())
    # Half-width kana with their sound marks are one letter.
    for c in map(chr, KANA):
        for mark, joined in SOUND.items():
            if len(both := unicodedata.normalize("NFC", unicodedata.normalize("NFKC", c) + joined)) == 1:
                out.append((c + mark, both))
    # A letter and its marks, the letter itself or any twin of it, and syllables from their parts.
    twins: dict[str, list[str]] = {}
    for a, b in single.items():
        if len(a) == len(b) == 1 and b != " ":
            twins.setdefault(b, []).append(a)
    for c in _composed():
        apart = unicodedata.normalize("NFD", c)
        one = unicodedata.normalize("NFC", single.get(apart[0], apart[0]) + apart[1:])
        out += [(a + apart[1:], one) for a in [apart[0], *twins.get(apart[0], ())] if len(apart) > 1]
    return out


def _composed() -> list[str]:
    """Every character that stands for a sequence of a letter and marks or of jamo."""
    return [c for c in map(chr, [*range(0xC0, 0xD800), *range(0xF900, 0x12000)]) if unicodedata.decomposition(c)[:1] not in ("<",) and unicodedata.normalize("NFD", c) != c and unicodedata.normalize("NFC", c) == c]


class Transducer:
    """Longest-match rewriting by a trie over runs in canonical order."""

    def __init__(self, pairs: Iterable[tuple[str, str]]) -> None:
        known: dict[str, str] = {}
        for a, b in pairs:
            if not a or known.setdefault(a, b) != b:
                raise ValueError(f"two outputs for {a!r}")
        self.hidden = re.compile("[" + re.escape("".join(a for a, b in known.items() if len(a) == 1 and not b)) + "]") if "" in known.values() else re.compile("(?!)")
        self.root: dict = {}
        for a, b in known.items():
            node = self.root
            for c in unicodedata.normalize("NFD", a):
                node = node.setdefault(c, {})
            node[""] = b
        # Outputs go through the rules until they are stable; a circle is a conflict.
        final = {}
        for a, b in known.items():
            seen = {a}
            while (c := self._run(b)) != b:
                if c in seen or b in seen:
                    raise ValueError(f"rules for {a!r} go in a circle")
                seen.add(b)
                b = c
            final[a] = b
        for a, b in final.items():
            node = self.root
            for c in unicodedata.normalize("NFD", a):
                node = node[c]
            node[""] = b
        for b in set(final.values()):
            if self._run(b) != b:
                raise ValueError(f"the output {b!r} would be changed again")
        self.runs: dict[str, str] = {}

    def _walk(self, run: str) -> str:
        out, i, n, root = [], 0, len(run), self.root
        while i < n:
            node, j, hit, end = root, i, None, i
            while j < n and (node := node.get(run[j])) is not None:
                j += 1
                if "" in node:
                    hit, end = node[""], j
            if hit is None:
                out.append(run[i])
                i += 1
            else:
                out.append(hit)
                i = end
        return "".join(out)

    def _run(self, run: str) -> str:
        """A run without what is invisible, its marks in order, rewritten. Marks that would compose
        past another mark have no rule; the last step joins them."""
        return unicodedata.normalize("NFC", self._walk(unicodedata.normalize("NFD", self.hidden.sub("", run))))

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.replace("\t", " ")
        out: list[str] = []
        last, runs = 0, self.runs
        for m in _other(text):
            a, run = m.start(), m[0]
            if run[0] in _after and a > last:  # it belongs to the letter before
                a -= 1
                run = text[a] + run
            done = runs.get(run)
            if done is None:
                done = self._run(run)
                if len(run) < 40:
                    if len(runs) > 200_000:
                        runs.clear()
                    runs[run] = done
            out.append(text[last:a])
            out.append(done)
            last = m.end()
        out.append(text[last:])
        return "".join(out)


# What belongs to the character before it: marks and what is invisible.
_after = frozenset(c for c in map(chr, [*range(0x80, 0x20000), *range(0xE0100, 0xE01F0)]) if c in INVISIBLE or 0xFE00 <= ord(c) < 0xFE10 or unicodedata.category(c) in ("Mn", "Me", "Mc"))
_other = re.compile("[\t\x80-\U0010ffff]+").finditer
_made: dict[str, Transducer] = {}


def transducer(keep: str = "") -> Transducer:
    """This worker's compiled transducer."""
    if keep not in _made:
        _made[keep] = Transducer([*rules(keep), ("\t", " ")])
    return _made[keep]


def unify(df: DataFrame, text: str = "text", into: str = "text") -> DataFrame:
    """``df`` with ``into`` holding the one form of ``text``. A map over Arrow batches, no shuffle."""
    held = [c for c in df.columns if c != into]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = transducer()
        for b in batches:
            texts = b.column(len(held)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(held)], pa.array([t and one(t) for t in texts], pa.string())], names=[*held, into])

    return df.select(*[F.col(f"`{c}`") for c in held], F.col(f"`{text}`").alias("__text")).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in held), f"`{into}` string"]))


def same_look(df: DataFrame, id: str, field: str, text: str) -> DataFrame:
    """(a, b, field), a < b: rows whose texts in a field look the same but differ as strings.

    Only digests of the raw and the unified text are shuffled, and written once as a table since
    several steps read them. Pairs are made between the distinct spellings of a class, then the rows of
    either spelling are joined, so rows spelled alike never meet. Null and blank texts don't count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = transducer()
        for b in batches:
            texts = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([one(t) for t in texts], pa.string())], names=["id", "field", "raw", "one"])

    kinds = dict(df.dtypes)
    rows = df.where(F.col(text).rlike(r"\S")).select(F.col(id).alias("id"), F.col(field).alias("field"), F.col(text).alias("raw"))
    seen = rows.mapInArrow(run, f"id {kinds[id]}, field {kinds[field]}, raw string, one string").where(r"one rlike '\\S'")
    digests = materialize(seen.select("id", "field", F.unhex(F.md5("raw")).alias("raw"), F.unhex(F.md5("one")).alias("one")), "digests")
    spellings = digests.select("field", "one", "raw").distinct()
    a, b = (spellings.select("field", "one", F.col("raw").alias(f"raw_{s}")) for s in "ab")
    pairs = a.join(b, ["field", "one"]).where("raw_a < raw_b").select("field", "raw_a", "raw_b")
    members = lambda s: digests.select("field", F.col("raw").alias(f"raw_{s}"), F.col("id").alias(f"id_{s}"))
    met = pairs.join(members("a"), ["field", "raw_a"]).join(members("b"), ["field", "raw_b"]).where("id_a <> id_b")
    return met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "field").distinct()
