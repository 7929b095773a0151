"""Filters of a catalogue: by name, key, type, pattern and place in the namespace."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ascii_lower, like, sort_key
from ..schema import FETCH_CAP


def of_type(symbols: DataFrame, symbol_type: str | None) -> DataFrame:
    return symbols if symbol_type is None else symbols.filter(F.col("symbol_type") == symbol_type)


def exact_name(symbols: DataFrame, name: str, limit: int, symbol_type: str | None = None) -> DataFrame:
    """Symbols of exactly this name, the first ``limit`` by id."""
    return of_type(symbols.filter(F.col("name") == name), symbol_type).orderBy("id").limit(limit)


def by_key(symbols: DataFrame, qualified_name: str) -> DataFrame:
    """The symbol of this qualified name; where the parents' names are stored, with its parent's, by which a sorted copy is pruned."""
    found = symbols.filter(F.col("qualified_name") == qualified_name)
    if "parent_key" not in symbols.columns or "." not in qualified_name:
        return found
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in qualified_name.rsplit(".", 1)[0])
    return found.filter(F.col("parent_key") == folded)


def any_case(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of this name whatever the case of its ASCII letters."""
    return symbols.filter(ascii_lower("name") == ascii_lower(F.lit(name)))


#: What a pattern is looked for in.
_SEARCHED = ("name", "qualified_name", "signature")
_GRAM = 3


def grams(symbols: DataFrame, *kept: str) -> DataFrame:
    """(gram, id, the columns ``kept``) of every run of three characters in name, qualified name and signature, A-Z lower-cased, once for each symbol; the index of :func:`containing`.

    Symbols are dealt evenly first, without their texts: a snapshot's parts are even in bytes, and short
    symbols, which have most grams for their bytes, lie together in few of them.
    """

    def cut(column: str) -> Column:
        return F.regexp_extract_all(ascii_lower(F.coalesce(column, F.lit(""))), F.lit(f"(?s)(?=(.{{{_GRAM}}}))."), F.lit(1))

    dealt = symbols.select("id", *kept, *[c for c in _SEARCHED if c not in kept]).repartition("id")
    return dealt.select(F.explode(F.array_distinct(F.concat(*map(cut, _SEARCHED)))).alias("gram"), "id", *kept)


def needed_grams(query: str) -> list[str]:
    """What every symbol that holds all parts of a query has among its grams; wildcards end a run."""
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in query)
    runs = [run for term in folded.split() for run in re.split("[%_]", term)]
    return sorted({run[i : i + _GRAM] for run in runs for i in range(len(run) - _GRAM + 1)})


def containing(symbols: DataFrame, query: str, symbol_type: str | None = None, cap: int = FETCH_CAP, index: DataFrame | Callable[[], DataFrame] | None = None) -> DataFrame:
    """Symbols with every part of the query in name, qualified name or signature; the first ``cap`` by name.

    With an ``index`` of grams, sorted by gram, only symbols that have all grams of the query are looked
    at; a query without a run of three fixed characters is looked for in all.
    """
    rows, wanted = symbols, needed_grams(query)
    if index is not None and wanted:
        index = index if isinstance(index, DataFrame) else index()
        met = index.filter(F.col("gram").isin(wanted)).groupBy("id").agg(F.count("*").alias("n"))
        rows = rows.join(met.filter(F.col("n") == len(wanted)).select("id"), "id", "left_semi").select(symbols.columns)
    for term in query.split():
        rows = rows.filter(reduce(or_, (like(c, f"%{term}%") for c in _SEARCHED)))
    return of_type(rows, symbol_type).orderBy("name", "id").limit(cap)


def children(symbols: DataFrame, qualified_name: str) -> DataFrame:
    """Symbols one level below a name.

    Where the parents' names are stored (parent_key), they are compared: by equality or, as an underscore
    in the name stands for any character, by pattern behind the part before it. Sorted copies prune both.
    """
    if "parent_key" in symbols.columns and "%" not in qualified_name:
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in qualified_name)
        fixed = folded.split("_", 1)[0]
        hit = F.col("parent_key") == folded if fixed == folded else F.col("parent_key").startswith(fixed) & like("parent_key", qualified_name)
        return symbols.filter(hit)
    return symbols.filter(like("qualified_name", f"{qualified_name}.%") & ~like("qualified_name", f"{qualified_name}.%.%"))


def unseen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose qualified name an earlier stage has not returned."""
    return rows.join(seen.select("qualified_name"), "qualified_name", "left_anti").select(rows.columns)


def members(symbols: DataFrame, qualified_name: str) -> DataFrame:
    """Direct children in the order of results."""
    return children(symbols, qualified_name).orderBy(*sort_key(), "id")


def browse(symbols: DataFrame, qualified_name: str, limit: int, cap: int = FETCH_CAP) -> DataFrame:
    """The first ``cap`` children by name, then the first ``limit`` of them in the order of results."""
    return children(symbols, qualified_name).orderBy("name", "id").limit(cap).orderBy(*sort_key(), "id").limit(limit)
