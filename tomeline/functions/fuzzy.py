"""Similarity of names: twice the longest common subsequence over the sum of lengths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-vectors (Allison and Dix 1986; Hyyro 2004)."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def lcs_with(query: str):
    """A pandas UDF: the common length of each name and ``query``."""

    @F.pandas_udf(T.IntegerType())
    def lcs(names: pd.Series) -> pd.Series:
        return names.map(lambda n: lcs_length(query, n))

    return lcs


def lcs_sql(column: str, query: str) -> Column:
    """The same as an SQL expression (one row of the table for each character); slower, for tests."""
    q = query.replace("\\", "\\\\").replace("'", "\\'")
    chars = f"split({column}, '')"
    return F.expr(
        f"element_at(aggregate(filter({chars}, c -> c <> ''), array_repeat(0, {len(query) + 1}), (p, c) -> aggregate(sequence(1, {len(query)}), array(0), "
        f"(r, j) -> array_append(r, CASE WHEN substring('{q}', j, 1) = c THEN element_at(p, j) + 1 ELSE greatest(element_at(p, j + 1), element_at(r, j)) END))), -1)"
    )


def possible(column: Column | str, query: str, cutoff: int) -> Column:
    """Whether lengths alone leave ``cutoff`` percent possible."""
    n = F.length(column)
    return 2 * 100 * F.least(n, F.lit(len(query))) >= cutoff * (n + len(query))
