"""Cutting oversized texts at natural boundaries.

Dynamic programming over boundary positions: a cut after a paragraph costs nothing, after a
sentence a little, and pieces away from the balanced length cost the square of their deviation. Line
ends, word ends, characters and places amid a character and its marks are ever worse kinds, and a
worse kind may be cut only where the better ones leave a gap wider than a piece can be; there all of
its places are candidates, and its cost makes the fewest of such cuts cheapest. So every admissible
chain of cuts is weighed, no more positions than can matter are looked at, and there is always a
chain: every piece keeps the limit, and each next piece begins exactly ``overlap`` characters before
the last one's end.

In a gap without any blank of more than ``DENSE`` characters every few characters are a candidate
(never more than a sixteenth of a piece apart), as they differ in the balance alone.

Defined results: null, empty and short texts (up to the limit) give no pieces with
``only_oversized``, else one piece; the pieces, less their overlaps, give the text back exactly;
of chains of equal cost the one with the earlier last cut is taken.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("paragraph", "sentence", "line", "word", "character", "amid", "end")
_COST = (0.0, 0.15, 8.0, 400.0, 2e4, 1e6, 0.0)
_PAY = [c + 0.05 for c in _COST]
DENSE = 512
_natural = re.compile(r"\n[ \t\r]*\n\s*|[.!?。！？][\"')\]”’»]*(?:\s+|(?<=[。！？]))").finditer
_line = re.compile(r"\n").finditer
_blank = re.compile(r"\s+").finditer


def _joined(c: str) -> bool:
    """Whether a character belongs to the one before it: marks, joiners, variation selectors."""
    return unicodedata.combining(c) != 0 or unicodedata.category(c) in ("Mn", "Me", "Mc") or c == "\u200d"


def boundaries(text: str, reach: int, start: int = 0) -> tuple[list[int], list[int]]:
    """Positions after ``start`` and kinds of admissible cuts; the last is the text's end. No two
    neighbours are more than ``reach`` apart."""
    n = len(text)
    at = {m.end(): (0 if m[0].count("\n") > 1 else 1) for m in _natural(text) if start < m.end() < n}
    for kind in range(2, 6):
        known = [start, *sorted(at), n]
        wide = [(a, b) for a, b in zip(known, known[1:]) if b - a > reach]
        if not wide:
            break
        for a, b in wide:
            if kind < 4:
                found = (m.end() for m in (_line, _blank)[kind - 2](text, a, b))
            else:
                step = min(max(1, (b - a) // DENSE), max(1, reach // 16))
                found = range(a + step, b, step)
                if kind == 4:
                    found = (p for p in found if not _joined(text[p]))
            for p in found:
                if a < p < b:
                    at.setdefault(p, kind)
    where = sorted(at)
    return [*where, n], [*(at[p] for p in where), 6]


def cuts(text: str, limit: int = 2000, overlap: int = 150) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of each piece."""
    n = len(text)
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if n <= limit:
        return [(0, n, "end")] if n else []
    reach = limit - overlap
    pieces = -(-(n - overlap) // reach)
    goal = (n - overlap) / pieces
    pos, kinds = boundaries(text, reach, overlap)
    p = np.array([overlap, *pos], np.float64)  # a first, virtual cut: the first piece begins at 0
    part = p / goal  # positions in pieces of the balanced length
    best, back = np.zeros(len(p)), [0] * len(p)
    lows, ends = np.searchsorted(p, p - reach, "left").tolist(), (part - 1.0).tolist()
    for j, kind in enumerate(kinds, 1):
        lo = lows[j]
        cost = ends[j] - part[lo:j]
        cost *= cost
        cost += best[lo:j]
        k = int(cost.argmin())
        best[j], back[j] = cost[k] + _PAY[kind], lo + k
    out, j = [], len(p) - 1
    while j:
        i = back[j]
        out.append((int(p[i]) - overlap, int(p[j]), KINDS[kinds[j - 1]]))
        j = i
    return out[::-1]


def split(df: DataFrame, keys: list[str], text: str, limit: int = 2000, overlap: int = 150, only_oversized: bool = True, with_text: bool = True) -> DataFrame:
    """(keys, piece_no, start, end, cut[, piece]) of each row; texts within the limit are left out
    before they reach Python. No shuffle."""
    rows = df.select(*keys, F.col(text).alias("__text")).where(F.length("__text") > (limit if only_oversized else 0))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, no, start, end, cut, piece = [], [], [], [], [], []
            for i, t in enumerate(b.column(len(keys)).to_pylist()):
                found = cuts(t, limit, overlap)
                take += [i] * len(found)
                no += range(len(found))
                for s, e, k in found:
                    start.append(s), end.append(e), cut.append(k)
                if with_text:
                    piece += [t[s:e] for s, e, _ in found]
            who = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(who) for c in range(len(keys))), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(cut, pa.string()), *([pa.array(piece, pa.string())] if with_text else [])],
                names=[*keys, "piece_no", "start", "end", "cut", *(["piece"] if with_text else [])],
            )

    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece_no int, start bigint, end bigint, cut string" + ", piece string" * with_text)
