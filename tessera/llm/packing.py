"""Filling containers of fixed capacity with the texts of a corpus.

Bounded-space online packing: every partition keeps a fixed number of open containers, puts each
item into the one it fills best, and emits the fullest when none has room. What is still open at a
partition's end is merged in groups of partitions. Sizes are counted and items are placed in the
same pass over the text, so no text is shuffled; only (key, sizes) of the leftovers move.

Defined results: a text of more than the capacity is cut into pieces of exactly the capacity and a
rest, each full piece having a container of its own; no other text is cut. Null and empty texts have
no tokens; they go into a container with other items and take no space. Repeated rows are items of
their own. ``container`` is unique, ``at`` is where in it the piece begins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import VOCAB, ship
from tessera.llm.encode import count_tokens
from tessera.session import materialize

_COLS = ["piece", "token_start", "n_tokens", "container", "at"]
_KINDS = "piece int, token_start bigint, n_tokens int, container bigint, at int"


class Windows:
    """Open containers, sorted by the space they have left."""

    def __init__(self, capacity: int, most: int, first_no: int) -> None:
        self.capacity, self.most, self.no = capacity, most, first_no
        self.left: list[tuple[int, int]] = []  # (space left, container)
        self.items: dict[int, list] = {}

    def put(self, item: tuple, size: int) -> list:
        """Place one item; gives back the rows of a container emitted to make room."""
        out: list = []
        i = bisect_left(self.left, (size, -1))
        if i == len(self.left):
            if len(self.left) == self.most:
                out = self.items.pop(self.left.pop(0)[1])
            space, no = self.capacity, self.no
            self.no += 1
            self.items[no] = []
        else:
            space, no = self.left.pop(i)
        self.items[no].append((*item, size, no, self.capacity - space))
        if space == size and size:
            out = out + self.items.pop(no)
        else:
            insort(self.left, (space - size, no))
        return out


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, windows: int = 64, group: int = 32, vocab: str = VOCAB) -> DataFrame:
    """(key, piece, token_start, n_tokens, container, at), a row per item or piece of one."""
    kind = dict(df.dtypes)[key]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        open_ = Windows(capacity, windows, part << 36)
        empty: list = []  # items without tokens wait for the next container to be emitted

        def rows(done: list, last: bool = False) -> pa.RecordBatch:
            cols = list(zip(*done)) or [[]] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], key_type), *(pa.array(c, k) for c, k in zip(cols[1:], (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))), pa.array([part if last else None] * len(done), pa.int32())], names=[key, *_COLS, "open_in"]
            )

        key_type = None
        for b in batches:
            key_type, done = b.schema.field(0).type, []
            for k, n in zip(b.column(0).to_pylist(), count_tokens(b.column(1), vocab)):
                if not n:
                    empty.append(k)
                    continue
                piece, start = 0, 0
                while n - start > capacity:
                    done.append((k, piece, start, capacity, open_.no, 0))
                    open_.no += 1
                    piece, start = piece + 1, start + capacity
                done += open_.put((k, piece, start), n - start)
                if done and empty:
                    done += [(e, 0, 0, 0, done[-1][4], 0) for e in empty]
                    empty = []
            yield rows(done)
        if key_type is not None:
            done = [r for x in open_.items.values() for r in x]
            yield rows(done + [(e, 0, 0, 0, done[0][4] if done else open_.no, 0) for e in empty], True)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        # Largest first, best fit: few rows, as each partition has a bounded number of windows.
        pdf = pdf.sort_values(["n_tokens", "open_in", "container", "at", "piece"], ascending=[False, True, True, True, True], kind="stable")
        base = int(pdf["open_in"].min()) << 36 | 1 << 35
        open_, out = Windows(capacity, len(pdf) + 1, base), []
        for r in pdf[[key, "piece", "token_start", "n_tokens"]].itertuples(index=False, name=None):
            out += open_.put(r[:3], int(r[3]))
        out += [r for x in open_.items.values() for r in x]
        return pd.DataFrame(out, columns=[key, *_COLS])

    ship(df.sparkSession, vocab)
    placed = materialize(df.select(key, text).mapInArrow(place, f"`{key}` {kind}, {_KINDS}, open_in int"), "pack")
    left = placed.where("open_in is not null").groupBy(F.floor(F.col("open_in") / group)).applyInPandas(merge, f"`{key}` {kind}, {_KINDS}")
    return placed.where("open_in is null").select(key, *_COLS).unionByName(left)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, and the share of the capacity that is used."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.round(F.sum("n") / (F.count("*") * capacity), 4).alias("used"), F.max("n").alias("fullest"))
