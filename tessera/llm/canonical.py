"""Mapping freely typed values to the entries of a reference list.

A prefix-filter set-similarity join. The distinguishing word of each entry (its stem) and of each
value is a set of letter pairs. Pairs are ordered by their rarity over both sides, only the rare
prefixes of the sets are joined, candidates are thinned by length and position, the Jaccard
similarity is verified exactly, and of what is left the nearest by edits, then by Jaccard, is kept.

Which words distinguish is read off the reference list: a word in ``common`` entries or more
(qualifiers, kinds of things) doesn't, the rest of an entry is its stem; a common word that only
ever follows the stem says what kind of thing the entry is and doesn't tell entries of one stem apart.
No list of words is built in. A value may bring other words (remarks, numbers) or break its stem, so
every run of uncommon words no longer than a stem can be is tried.

Each distinct value is worked on once, whatever the number of its rows. Both sides of the join are
tables; a short reference list is broadcast by the planner, a long one is joined by shuffle. Only the
reference list's common words are sent to the tasks: those in at least one of 10,000 entries, so
there are at most 10,000 times as many as an entry has words.

Defined results: a null value gives no row; a value equal to an entry's name or short name means
that entry (the lowest id, if several have it); empty values and values of which no stem is near
enough mean none (0); where a stem has several entries, the value's qualifiers decide, a value
without any takes the entry without any or else the lowest id, and one with other qualifiers than
every entry means none. Repeated rows stay; an empty list gives 0 throughout.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.lookalike import transducer
from tessera.session import materialize

# How a marker's sign may be written out.
POSITIVE = {"positive", "pos"}
_signs = str.maketrans({"⁺": " positive ", "+": " positive ", "_": " ", "­": None, "’": "'"})
_greek = re.compile("[α-ω]").sub
_word = re.compile(r"[^\W_]+").findall


def words(value: str) -> list[str]:
    """A value's words in one form: lower case, Greek letters by name, a marker and its sign as one
    word that ends in a plus."""
    v = transducer()(value.translate(_signs)).lower()
    v = _greek(lambda m: " " + unicodedata.name(m[0]).rsplit(" ", 1)[-1].lower() + " ", v)
    out: list[str] = []
    for w in _word(v):
        if w not in POSITIVE:
            out.append(w)
        elif out:
            out[-1] += "+"
    return out


def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        two, one = one, now
    return one[-1]


@F.pandas_udf(T.IntegerType())
def _edits(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([edits(x, y, m) for x, y, m in zip(a, b, most)], dtype="int32")


def _parsed(df: DataFrame, column: str, common: set[str], longest: int | None) -> DataFrame:
    """``df`` with qualifiers (common words, sorted), runs (uncommon words that follow each other, put
    together, up to ``longest`` letters) and ``before`` (common words before the first uncommon one or
    after a comma)."""
    held = df.columns
    at = held.index(column)
    kinds = dict(df.dtypes)

    def parse(value: str) -> tuple[list[str], list[str], list[str]]:
        said, before, rest = set(), set(), []
        head, _, tail = value.partition(",")
        late = set(words(tail))
        for w in words(value):
            known = w if w in common else w[:-1] if w.endswith("s") and w[:-1] in common else None
            if known or w.endswith("+"):
                said.add(known or w)
                if not any(rest) or w in late:
                    before.add(known or w)
                rest.append(None)
            else:
                rest.append(w)
        runs: dict[str, None] = {}
        for a in range(len(rest)):
            run = ""
            for w in rest[a:]:
                if w is None or longest is not None and len(run) + len(w) > longest + 1:
                    break
                run += w
                runs[run] = None
        return sorted(said), list(runs), sorted(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(parse(v) for v in b.column(at).to_pylist()))) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.list_(pa.string())) for c in cols)], names=[*held, "said", "runs", "before"])

    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in held) + ", said array<string>, runs array<string>, before array<string>")


def pairs_of(c: Column) -> Column:
    """The letter pairs of a word as a set of numbers, its ends marked."""
    padded = F.concat(F.lit("^"), c, F.lit("$"))
    letter = lambda i: F.ascii(F.substring(padded, i, F.lit(1))).cast("bigint")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.shiftleft(letter(i), 21) + letter(i + 1)))


def candidates(forms: DataFrame, stems: DataFrame, threshold: float = 0.25, slips: int | None = None) -> DataFrame:
    """(form, stem, jaccard) of all words of ``forms(form)`` and ``stems(stem)``, both distinct and not
    empty, whose sets of letter pairs are at least as similar as ``threshold``; with ``slips`` only
    of those that so many edits may lead from one to the other, which is told before sets are compared."""
    both = forms.select(F.col("form").alias("word"), F.lit(False).alias("own")).unionByName(stems.select(F.col("stem").alias("word"), F.lit(True).alias("own")))
    tokens = both.select("word", "own", F.explode(pairs_of(F.col("word"))).alias("tok"))
    rarity = tokens.groupBy("tok").agg(F.count("*").alias("n"))
    sets = tokens.join(rarity, "tok").groupBy("word", "own").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "tok"))), lambda x: x["tok"]).alias("toks"))
    # A set of n pairs that is similar enough to another shares one of its n - ceil(t n) + 1 rarest.
    n = F.size("toks")
    prefix = (n - F.greatest(F.lit(1), F.ceil(F.lit(threshold) * n)) + 1).cast("int")
    parts = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # spread by word, however few bytes they are
    sets = materialize(sets.select("word", "own", "toks", n.alias("n"), F.slice("toks", 1, prefix).alias("prefix")).repartition(parts, "word"), "sets")
    side = lambda own, s: sets.where(F.col("own") if own else ~F.col("own")).select(F.col("word").alias(f"w{s}"), F.col("toks").alias(f"t{s}"), F.col("n").alias(f"n{s}"), F.col("prefix").alias(f"p{s}"), F.posexplode("prefix").alias(f"i{s}", "tok"))
    met = side(False, "a").join(side(True, "b"), "tok")
    na, nb, t = F.col("na"), F.col("nb"), threshold
    met = met.where((nb >= t * na) & (na >= t * nb))
    if slips is not None:
        met = met.where(F.abs(F.length("wa") - F.length("wb")) <= slips)
        near = F.levenshtein("wa", "wb", 2 * slips) >= 0  # a swap counts two there
    # Position: what lies before the shared pair and what lies after it can't hold more than this.
    need = t / (1 + t) * (na + nb) - 1e-9
    met = met.where(F.least("ia", "ib") + 1 + F.least(na - F.col("ia") - 1, nb - F.col("ib") - 1) >= need)
    if slips is not None:
        met = met.where(near)
    both_ = F.size(F.array_intersect("ta", "tb"))
    met = met.withColumn("jaccard", both_ / (na + nb - both_)).where(F.col("jaccard") >= t)
    met = met.where(F.get(F.array_intersect("pa", "pb"), 0) == F.col("tok"))  # each two words meet once
    return met.select(F.col("wa").alias("form"), F.col("wb").alias("stem"), "jaccard")


def match(values: DataFrame, reference: DataFrame, id: str = "canon_id", name: str = "canon_name", short: str = "short_name", threshold: float = 0.25, common: int = 5, slips: int = 3) -> DataFrame:
    """``values`` (any columns, with a string ``value``) with ``canon_id``, 0 for none. Up to ``slips``
    edits, fewer in short stems: one for every three letters, none under three."""
    rows = values.where("value is not null")
    names = reference.select(F.col(id).cast("bigint").alias("cid"), F.coalesce(F.col(name), F.lit("")).alias("name"), F.col(short).alias("short"))
    split = F.pandas_udf(lambda s: s.map(lambda v: sorted(set(words(v)))), "array<string>")
    least = F.greatest(F.lit(common), F.ceil(F.lit(1e-4) * names.count()))
    often = {r[0] for r in names.select(F.explode(split("name")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("w").collect()}
    entries = _parsed(names.select("cid", "name", "short"), "name", often, None)
    longest_run = F.array_max(F.transform("runs", lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    entries = materialize(entries.select("cid", "name", "short", "said", "before", longest_run.alias("stem")), "entries")
    # Common words that never stand before a stem, or apart from it, are kinds.
    tells = F.broadcast(entries.select(F.explode("before").alias("q")).distinct().agg(F.collect_set("q").alias("tells")))  # one row of common words
    stems = entries.where("stem is not null").crossJoin(tells).select("cid", "stem", F.filter("said", lambda q: F.array_contains("tells", q) | q.endswith("+")).alias("has"))
    longest = (entries.agg(F.max(F.length("stem"))).first()[0] or 0) + slips

    distinct = materialize(_parsed(rows.select("value").distinct(), "value", often, longest).select("value", "said", "runs"), "values")
    known = names.select("cid", F.explode(F.array("name", "short")).alias("value")).where("value is not null").groupBy("value").agg(F.min("cid").alias("exact"))
    # A run that is an entry's short name, whatever its case and marks; the first such run.
    code = F.lower(F.regexp_replace("short", r"[\W_]", ""))
    codes = names.select("cid", code.alias("run")).where("run <> ''").groupBy("run").agg(F.min("cid").alias("cid"))
    by_code = distinct.select("value", F.posexplode("runs").alias("no", "run")).join(codes, "run").groupBy("value").agg(F.min_by("cid", "no").alias("code"))

    singular = lambda r: F.when(r.endswith("s"), F.array(r, F.substring(r, F.lit(1), F.length(r) - 1))).otherwise(F.array(r))
    tried = distinct.select("value", F.explode(F.array_distinct(F.flatten(F.transform("runs", singular)))).alias("form")).where("form <> ''")
    near = candidates(tried.select("form").distinct(), stems.select("stem").distinct(), threshold, slips)
    letters = F.length("stem")
    near = near.withColumn("most", F.least(F.lit(slips), F.when(letters < 3, 0).otherwise(F.floor((letters + 1) / 3))).cast("int"))
    # A swap of neighbours is one edit here and two there, so twice as many are let through.
    near = near.withColumn("lev", F.levenshtein("form", "stem", 2 * slips)).where("lev >= 0 and lev <= 2 * most")
    near = near.withColumn("d", F.when(F.col("lev") <= 1, F.col("lev")).otherwise(_edits("form", "stem", "most"))).where("d <= most")
    best = near.groupBy("form").agg(F.min(F.struct("d", (-F.col("jaccard")).alias("j"), "stem")).alias("b"))
    best = tried.join(best, "form").groupBy("value").agg(F.min("b").alias("b")).select("value", F.col("b.stem").alias("stem"))

    met = best.join(distinct.select("value", "said"), "value").crossJoin(tells).select("value", "stem", F.filter("said", lambda q: F.array_contains("tells", q) | q.endswith("+")).alias("says"))
    met = met.join(stems, "stem")
    fit = F.when(F.col("says") == F.col("has"), 0).when((F.size("says") == 0) & (F.size("has") == 0), 1).when(F.size("says") == 0, 2).when(F.size(F.array_except("says", "has")) == 0, 3)
    by_stem = met.groupBy("value").agg(F.min(F.when(fit.isNotNull(), F.struct(fit.alias("fit"), "cid"))).alias("f")).select("value", F.col("f.cid").alias("near"))

    found = distinct.select("value").join(known, "value", "left").join(by_code, "value", "left").join(by_stem, "value", "left").select("value", F.coalesce("exact", "code", "near", F.lit(0).cast("bigint")).alias("__cid"))
    return rows.join(found, "value").select(*[F.col(f"`{c}`") for c in values.columns if c != "value"], "value", F.col("__cid").alias(id))
