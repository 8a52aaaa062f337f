"""Long exact spans shared between records.

Units of text are digested and the digests grouped globally. Two kinds of units:

* :func:`repeated_units`: lines or paragraphs, normalised; of each the earliest ranked occurrence is
  kept and the others come out for removal, with their original offsets.
* :func:`shared`: stretches of ``span // 2`` characters, cut where the content says so (the least
  hash of ``span // 2 + 1`` neighbouring stretches), since a shared span need not hold a whole line.
  Every span of ``span`` characters holds at least one such unit, wherever it begins, so no shared
  span can be missed. Occurrences of a unit are then compared exactly, character for character, up
  to ``span // 2`` to either side.

Texts that are equal as a whole are first reduced to their first record, so that a group of copies
costs as much as one record. The text is shuffled once, and only with those records that hold a unit
found elsewhere. A unit in more than ``hot`` records isn't paired by itself: its occurrences are
grouped by the digest of each stretch of ``span`` characters around it, so pairs are made of records
that share one, never of all that hold the unit.

Defined results: null and shorter texts share nothing; rows with a null key are left out; a record
shares nothing with itself; repeated rows with one key count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import discard, materialize

SPAN = 200  # characters of the shortest span that counts
_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BI = np.uint64(pow(int(_B), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _B), np.full(size, _BI)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(text: str, k: int) -> np.ndarray:
    """A 64-bit hash of each of the text's stretches of ``k`` characters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _pow(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(codes + np.uint64(1)) * up[:n], out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def selected(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the stretches that are the least of some ``window`` neighbouring ones (all of
    them, if there are fewer). Which are taken depends on nothing but the text around them."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    window = min(window, n)
    least, width = hashes, 1
    while width * 2 <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        least = np.minimum(least[: n - window + 1], least[window - width :])
    # Position i is taken if its hash is the least of a window that holds it: spread the windows' minima back.
    m = len(least)
    top = np.zeros(n, np.uint64)
    top[:m] = least
    most, width = top, 1
    pad = np.concatenate([np.zeros(window - 1, np.uint64), top])
    while width * 2 <= window:
        pad = np.maximum(pad[:-width], pad[width:])
        width *= 2
    if width < window:
        pad = np.maximum(pad[: n], pad[window - width :])
    most = pad[:n]
    return np.flatnonzero(most == hashes)


def _units(text: str, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of a text's units."""
    k = span // 2
    h = gram_hashes(text, k)
    at = selected(h, span - k + 1)
    return h[at], at


def _fingerprints(docs: DataFrame, span: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(_units(t, span)[0]) for t in b.column(1).to_pylist()]
            who = np.repeat(np.arange(len(found)), [len(x) for x in found])
            every = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), b.column(0).take(pa.array(who))], names=["h", "key"])

    return docs.mapInArrow(run, f"h bigint, key {dict(docs.dtypes)['key']}")


def _contexts(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """(h, key, ats, before, after) of each wanted unit with its surroundings; ``ats`` has all places
    where it stands so (in periodic text there are many), ``before`` is reversed."""
    k = span // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, hs, ats, before, after = [], [], [], [], []
            for i, (t, want) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                h, at = _units(t, span)
                keep = np.isin(h.view(np.int64), np.array(want, np.int64))
                seen: dict[tuple, list[int]] = {}
                for x, p in zip(h[keep].view(np.int64).tolist(), at[keep].tolist()):
                    seen.setdefault((x, t[max(0, p - k) : p][::-1], t[p + k : p + 2 * k]), []).append(p)
                for (x, b4, aft), places in seen.items():
                    who.append(i), hs.append(x), ats.append(places), before.append(b4), after.append(aft)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hs, pa.int64()), b.column(0).take(pa.array(who, pa.int64())), pa.array(ats, pa.list_(pa.int64())), pa.array(before, pa.string()), pa.array(after, pa.string())], names=["h", "key", "ats", "before", "after"]
            )

    return docs.join(wanted, "key").select("key", "text", "units").mapInArrow(run, f"h bigint, key {dict(docs.dtypes)['key']}, ats array<bigint>, before string, after string")


def _common(a: str, b: str) -> Column:
    """Length of the longest common prefix of two columns, by halving steps inside the JVM."""
    most = F.least(F.length(a), F.length(b))
    steps = F.array(*(F.lit(1 << i) for i in range(14, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when((n + s <= most) & (F.col(a).substr(F.lit(1), n + s) == F.col(b).substr(F.lit(1), n + s)), n + s).otherwise(n))


@dataclass
class Shared:
    """``members`` (key, rep, copies, n): each record, the first with its very text, how many have
    it, and its length; ``contexts``: the units found in several texts and what stands around them."""

    members: DataFrame
    contexts: DataFrame
    span: int
    hot: int

    def _split(self) -> tuple[DataFrame, DataFrame]:
        n = self.contexts.groupBy("h").agg(F.count("*").alias("n"))
        several = n.where("n > 1")
        cold = self.contexts.join(several.where(f"n <= {self.hot}").select("h"), "h", "left_semi")
        hot = self.contexts.join(several.where(f"n > {self.hot}").select("h"), "h", "left_semi")
        return cold, hot

    def _cold(self, cold: DataFrame) -> DataFrame:
        k = self.span // 2
        a, b = (cold.select("h", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "ats", "before", "after"))) for s in "ab")
        pairs = a.join(b, "h").where("key_a < key_b")
        met = pairs.select("key_a", "key_b", "ats_a", "ats_b", _common("before_a", "before_b").alias("l"), _common("after_a", "after_b").alias("r"))
        return met.where(F.col("l") + F.col("r") + k >= self.span)

    def _hot(self, hot: DataFrame) -> DataFrame:
        """(h, x, digest, key, ats): every stretch of ``span`` characters around a hot unit."""
        k = self.span // 2
        rest = self.span - k
        least, most = F.greatest(F.lit(0), F.lit(rest) - F.length("after")), F.least(F.lit(rest), F.length("before"))
        rows = hot.where(least <= most).select("*", F.explode(F.sequence(least, most)).alias("x"))
        digest = F.unhex(F.md5(F.concat(F.expr("substring(before, 1, x)"), F.lit("\x00"), F.expr(f"substring(after, 1, {rest} - x)"))))
        rows = rows.select("h", "x", digest.alias("digest"), "key", "ats")
        by = ["h", "x", "digest"]
        return rows.join(rows.groupBy(by).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select(by), by, "left_semi")

    def links(self) -> DataFrame:
        """(key_a, key_b), key_a < key_b: first records of different texts that share a span. With
        ``members`` it says all that :meth:`pairs` says, without a row for every pair of copies."""
        cold, hot = self._split()
        h = self._hot(hot)
        a, b = (h.select("h", "x", "digest", F.col("key").alias(f"key_{s}")) for s in "ab")
        return self._cold(cold).select("key_a", "key_b").unionByName(a.join(b, ["h", "x", "digest"]).where("key_a < key_b").select("key_a", "key_b")).distinct()

    def linked(self) -> DataFrame:
        """(key, rep, copies, n_linked): of each record the first with its text, how many have that
        text, and with how many different texts it shares a span."""
        links = self.links()
        ends = links.select(F.col("key_a").alias("rep")).unionByName(links.select(F.col("key_b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_linked"))
        return self.members.join(ends, "rep", "left").select("key", "rep", "copies", F.coalesce("n_linked", F.lit(0).cast("bigint")).alias("n_linked"))

    def pairs(self) -> DataFrame:
        """(a, b), a < b: records whose texts share a span, copies included. Its size is the result's."""
        reps = self.links()
        ma, mb = (self.members.select(F.col("rep").alias(f"key_{s}"), F.col("key").alias(s)) for s in "ab")
        across = reps.join(ma, "key_a").join(mb, "key_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        many = self.members.where("copies > 1")
        within = many.select("rep", F.col("key").alias("a")).join(many.select("rep", F.col("key").alias("b")), "rep").where("a < b").select("a", "b")
        return across.unionByName(within)

    def spans(self) -> DataFrame:
        """(key, start, end): the maximal stretches of a record that stand elsewhere too."""
        k = self.span // 2
        cold, hot = self._split()
        met = self._cold(cold)
        part = lambda c: met.select(F.col(f"key_{c}").alias("rep"), F.explode(f"ats_{c}").alias("at"), F.col("l").alias("before"), (k + F.col("r")).alias("after"))
        around = self._hot(hot).select(F.col("key").alias("rep"), F.explode("ats").alias("at"), F.col("x").alias("before"), (self.span - F.col("x")).alias("after"))
        found = part("a").unionByName(part("b")).unionByName(around).select("rep", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end")).distinct()
        single = found.join(self.members.where("copies = 1").select("key", "rep"), "rep").select("key", "start", "end")
        w = Window.partitionBy("key").orderBy("start", "end")
        cut = F.coalesce((F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
        runs = single.withColumn("cut", cut).withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        merged = runs.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
        return merged.unionByName(self.members.where("copies > 1").select("key", F.lit(0).cast("bigint").alias("start"), F.col("n").alias("end")))


def shared(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, hot: int = 256) -> Shared:
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where((F.length("text") >= span) & F.col("key").isNotNull())
    digests = docs.groupBy("key").agg(F.min(F.unhex(F.md5("text"))).alias("digest"), F.max(F.length("text").cast("bigint")).alias("n"))
    members = materialize(digests.join(digests.groupBy("digest").agg(F.min("key").alias("rep"), F.count("*").alias("copies")), "digest").select("key", "rep", "copies", "n"), "members")
    prints = materialize(_fingerprints(docs, span), "units")
    several = prints.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("h")
    wanted = prints.join(several, "h", "left_semi").join(members.where("key = rep").select("key"), "key", "left_semi")
    contexts = materialize(_contexts(docs, wanted.groupBy("key").agg(F.collect_set("h").alias("units")), span), "contexts")
    discard(prints)  # nothing reads them again
    return Shared(members, contexts, span, hot)


def share(df: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(key, n_spans, n_shared, share) of every record, those that share nothing included."""
    per = shared(df, key, text, span).spans().groupBy(F.col("key").alias(key)).agg(F.count("*").alias("n_spans"), F.sum(F.col("end") - F.col("start")).alias("n_shared"))
    rows = df.select(key, F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars")).join(per, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return rows.select(key, "n_chars", zero(F.col("n_spans")).alias("n_spans"), zero(F.col("n_shared")).alias("n_shared"), F.when(F.col("n_chars") > 0, F.round(zero(F.col("n_shared")) / F.col("n_chars"), 4)).otherwise(0.0).alias("share"))


def repeated_units(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = SPAN) -> DataFrame:
    """(key, start, end, kept_key, kept_start): paragraphs of at least ``least`` characters, blanks
    aside, that stand earlier too (by key, then position), with the occurrence that is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, start, end, unit = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                at = 0
                for line in t.split("\n"):
                    if len(line) >= least and len(u := " ".join(line.split())) >= least:
                        who.append(i), start.append(at), end.append(at + len(line)), unit.append(u)
                    at += len(line) + 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(unit, pa.string())], names=["key", "start", "end", "unit"])

    kind = dict(df.dtypes)[key]
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where((F.length("text") >= least) & F.col("key").isNotNull())
    units = docs.mapInArrow(run, f"key {kind}, start bigint, end bigint, unit string").select("key", "start", "end", F.unhex(F.md5("unit")).alias("digest"))
    first = units.groupBy("digest").agg(F.min(F.struct("key", "start")).alias("kept"), F.count("*").alias("n")).where("n > 1")
    met = units.join(first.select("digest", "kept"), "digest").where(F.struct("key", "start") != F.col("kept"))
    return met.select(F.col("key").alias(key), "start", "end", F.col("kept.key").alias(f"kept_{key}"), F.col("kept.start").alias("kept_start"))
