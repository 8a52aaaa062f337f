"""Identifiers written in several forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def term_number(col: Column | str) -> Column:
    """The number in an ontology id, whatever is written around it; null where it holds none.

    ``CL:0012``, ``cl_12``, `` 12`` are all 12. A number beyond 64 bits gives null.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(c, r"([0-9]+)", 1).try_cast("bigint")
