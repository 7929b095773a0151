"""The search: stages from exact to approximate, each leaving out what an earlier one has found."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import sort_key
from ..operators import fts, fuzzy, lookup, navigate
from ..operators.rank import numbered

_KEPT = ("id", "name", "qualified_name", "symbol_type", "signature", "docstring")


def _staged(rows: DataFrame, stage: str, tier: str, turn: int, *order) -> DataFrame:
    return numbered(rows, *order, name="within").select(*_KEPT, F.lit(stage).alias("stage"), F.lit(tier).alias("tier"), F.lit(turn).alias("turn"), "within")


def _result(parts: list[DataFrame], limit: int) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts).orderBy("turn", "within").limit(limit)
    return numbered(rows, "turn", "within").select(*_KEPT, "stage", "tier", "rank")


def _empty(symbols: DataFrame) -> DataFrame:
    return symbols.limit(0).select(*_KEPT, F.lit("").alias("stage"), F.lit("").alias("tier"), F.lit(0).cast("long").alias("rank"))


def dotted(symbols: DataFrame, query: str, limit: int, tree: DataFrame | None = None) -> DataFrame | None:
    """A dotted query's shortcuts: members by inheritance, the name itself, what lies under it. Types don't matter here."""
    found = navigate.inherited(symbols, query, limit)
    if found is not None and not found.isEmpty():
        return _result([_staged(found, "inheritance", "fts", 0, "turn", "within", "id")], limit)
    name = navigate.resolve_one(symbols, query)
    if name is not None:
        return _result([_staged(lookup.by_key(symbols, name), "resolved", "fts", 0, "id")], limit)
    below = lookup.browse(symbols if tree is None else tree, query, limit)
    return None if below.isEmpty() else _result([_staged(below, "namespace", "fts", 0, *sort_key(), "id")], limit)


def search(
    symbols: DataFrame,
    index: fts.Index | Callable[[], fts.Index],
    query: str,
    limit: int = 50,
    symbol_type: str | None = None,
    tree: DataFrame | None = None,
    grams: DataFrame | Callable[[], DataFrame] | None = None,
) -> DataFrame:
    """Results with stage, tier (fts or fuzzy) and rank. Later stages run only if earlier ones leave room. ``tree`` is a copy of the symbols sorted by parent and ``grams`` an index of their letters, where there are any.

    ``index`` and ``grams`` may be functions that give them; one is called when a stage looks into what it gives, and only then.
    """
    if not query.strip():
        return _empty(symbols)
    if "." in query and (found := dotted(symbols, query, limit, tree)) is not None:
        return found
    order = [*sort_key(), "id"]
    exact = lookup.exact_name(symbols, query, limit, symbol_type).cache()
    n = exact.count()  # at most ``limit`` rows
    parts = [_staged(exact, "exact", "fts", 0, *order)]
    seen, left = exact.select("qualified_name"), limit - n
    if left > 0:
        named = fts.search(symbols, index, query, ("name", "qualified_name"), symbol_type)
        stage, found = "full text", None if named is None else lookup.unseen(named, seen).cache()
        if n == 0 and (found is None or found.isEmpty()):
            stage, found = "pattern", lookup.containing(symbols, query, symbol_type, index=grams).cache()
        if found is not None:
            seen = seen.unionByName(found.select("qualified_name"))
            parts.append(_staged(found.orderBy(*order).limit(left), stage, "fts", 1, *order))
            left -= min(left, found.count())  # the stage fetches a bounded number of rows
    if left > 0:
        near: list[DataFrame] = []
        text = fts.search(symbols, index, query, ("docstring",), symbol_type)
        if text is not None:
            text = lookup.unseen(text, seen).cache()
            seen = seen.unionByName(text.select("qualified_name"))
            near.append(text.select(*_KEPT, F.lit("docstring").alias("stage")))
        alike = fuzzy.search(symbols, query, left, symbol_type, seen=seen)
        near.append(alike.select(*_KEPT, F.lit("fuzzy").alias("stage")))
        rows = reduce(DataFrame.unionByName, near).orderBy(*order).limit(left)
        parts.append(numbered(rows, *order, name="within").select(*_KEPT, "stage", F.lit("fuzzy").alias("tier"), F.lit(2).alias("turn"), "within"))
    return _result(parts, limit)
