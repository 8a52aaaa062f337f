"""Byte-level BPE with the vocabulary of a public tokenizer.

The merge loop keeps one bucket of linked-list positions per merge rank and a two-level bitmap of
the buckets in use. Find-first-set gives the next rank, entries whose pair has changed meanwhile are
skipped when they come up. The work is linear in the length of a pre-token (times the bitmap's two
levels), so a pre-token of 30,000 letters costs as much a byte as one of ten.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from heapq import heappop, heappush

import regex
from pyspark import SparkFiles
from pyspark.sql import SparkSession

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of this tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD = 256  # bits of one word of the bitmap
KEEP = 300_000  # entries of each cache of a worker; beyond it the cache starts anew
LONGEST = 48  # characters of a piece that is worth keeping


class RankQueue:
    """Positions by rank; the lowest rank's leftmost position comes first."""

    def __init__(self) -> None:
        self.top = 0
        self.words: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, pos: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [pos]
            w, b = divmod(rank, WORD)
            self.words[w] = self.words.get(w, 0) | 1 << b
            self.top |= 1 << w
        else:
            heappush(bucket, pos)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        w = (self.top & -self.top).bit_length() - 1
        bits = self.words[w]
        rank = w * WORD + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        pos = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            bits &= bits - 1
            self.words[w] = bits
            if not bits:
                self.top &= self.top - 1
        return rank, pos


class ByteBPE:
    """Encoder of one vocabulary file (base64 token, blank, rank per line)."""

    def __init__(self, path: str = VOCAB, pattern: str = PATTERN) -> None:
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.pretokens: dict[str, bytes] = {}
        self.after_blank = _Cache(self, " ")
        self.at_start = _Cache(self, "")

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token's bytes."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        ranks, tokens, n = self.ranks, self.tokens, len(raw)
        ids = [ranks[raw[i : i + 1]] for i in range(n)]
        after, before, queue = list(range(1, n + 1)), list(range(-1, n - 1)), RankQueue()
        pair = [-1] * n  # rank of the pair that begins here, by which stale entries show
        for i in range(n - 1):
            r = ranks.get(raw[i : i + 2])
            if r is not None:
                pair[i] = r
                queue.push(r, i)
        while (entry := queue.pop()) is not None:
            rank, i = entry
            if pair[i] != rank:
                continue
            j = after[i]
            k = after[j]
            ids[i], after[i], pair[j] = rank, k, -1
            ids[j] = -1
            pair[i] = -1
            if k < n:
                before[k] = i
                r = ranks.get(tokens[rank] + tokens[ids[k]])
                if r is not None:
                    pair[i] = r
                    queue.push(r, i)
            h = before[i]
            if h >= 0:
                r = ranks.get(tokens[ids[h]] + tokens[rank])
                pair[h] = -1 if r is None else r
                if r is not None:
                    queue.push(r, h)
        return [t for t in ids if t >= 0]

    def pretokenized(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers, by its pre-tokens."""
        out, known = [], self.pretokens
        for p in self.find(text):
            b = known.get(p)
            if b is None:
                b = array("i", self.merge(p.encode("utf-8", "surrogatepass"))).tobytes()
                if len(p) <= LONGEST:
                    if len(known) >= KEEP:
                        known.clear()
                    known[p] = b
            out.append(b)
        return b"".join(out)

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text as 32-bit integers; nothing for null and empty text.

        No pre-token reaches over a single blank between two characters that aren't blank, except
        that the blank opens the next one. So a text falls into pieces there, and most pieces have
        been seen before.
        """
        if not text:
            return b""
        pieces = text.split(" ") if _uneven(text) is None else _even(text)
        return self.at_start[pieces[0]] + b"".join(map(self.after_blank.__getitem__, pieces[1:]))

    def ids(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


class _Cache(dict):
    def __init__(self, bpe: ByteBPE, lead: str) -> None:
        self.bpe, self.lead = bpe, lead

    def __missing__(self, piece: str) -> bytes:
        b = self.bpe.pretokenized(self.lead + piece)
        if len(piece) <= LONGEST:
            if len(self) >= KEEP:
                self.clear()
            self[piece] = b
        return b


_uneven = re.compile(r"^ |\s | \s| $").search
_even = re.compile(r"(?<=\S) (?=\S)").split

_made: dict[str, ByteBPE] = {}


def encoder(path: str = VOCAB) -> ByteBPE:
    """This worker's encoder of a vocabulary, made once; of the file that :func:`ship` sent along where
    the path isn't there."""
    if path not in _made:
        _made[path] = ByteBPE(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _made[path]


def ship(spark: SparkSession, path: str) -> None:
    """Send the vocabulary file to the executors, so that only the driver needs it."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)
