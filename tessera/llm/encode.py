"""Token ids and token counts of a corpus.

Defined results: null and empty text give an empty list and the count 0; strings that look like
special tokens are ordinary text; every row is kept, repeated rows too; columns beside key and text
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import VOCAB, encoder, ship


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = VOCAB) -> DataFrame:
    """(key, ids) of each row. One pass without a shuffle; each task streams Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(vocab).packed
        for b in batches:
            parts = [packed(t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) >> 2 for p in parts], out=ends[1:])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    ship(df.sparkSession, vocab)
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, ids: str = "ids", vocab: str = VOCAB) -> DataFrame:
    """Adds ``text``, the exact inverse of :func:`encode` (null and empty text both give '')."""

    @F.pandas_udf("string")
    def back(s):
        tokens = encoder(vocab).tokens
        return s.map(lambda x: b"".join(tokens[i] for i in x).decode("utf-8", "surrogatepass"))

    ship(df.sparkSession, vocab)
    return df.withColumn("text", back(ids))


def count_tokens(batch: pa.Array, vocab: str = VOCAB) -> list[int]:
    packed = encoder(vocab).packed
    return [len(packed(t)) >> 2 for t in batch.to_pylist()]
