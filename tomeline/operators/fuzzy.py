"""Typo-tolerant search by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import lcs_with, possible
from ..schema import FUZZY_CUTOFF
from .lookup import of_type


def candidates(symbols: DataFrame, symbol_type: str | None = None) -> DataFrame:
    """Distinct names with the order in which ties are taken: by name, or by first id if a type is asked for."""
    rows = of_type(symbols, symbol_type)
    return rows.groupBy("name").agg(F.min("id").alias("first_id"))


def scored(names: DataFrame, query: str, cutoff: int = FUZZY_CUTOFF) -> DataFrame:
    """Names at least ``cutoff`` percent like the query, with lcs and ratio. Lengths rule most out before any is compared."""
    near = names.filter(possible("name", query, cutoff)).withColumn("lcs", lcs_with(query)("name"))
    total = F.length("name") + len(query)
    return near.filter(200 * F.col("lcs") >= cutoff * total).withColumn("ratio", F.lit(200.0) * F.col("lcs") / total)


def search(symbols: DataFrame, query: str, limit: int, symbol_type: str | None = None, cutoff: int = FUZZY_CUTOFF, seen: DataFrame | None = None) -> DataFrame:
    """Symbols (with ratio) of the ``limit`` most similar names, name by name, ``limit`` rows at most, without those seen.

    As many rows of a name are looked at as are still wanted when its turn comes, those seen among them
    included; so rows seen can leave a name short, and names after it come in. At most ``limit`` rows of
    ``limit`` names meet in one row, in which the turns are taken.
    """
    tie = F.col("first_id") if symbol_type else F.col("name")
    best = scored(candidates(symbols, symbol_type), query, cutoff).orderBy(F.col("ratio").desc(), tie).limit(limit)
    # ``limit`` names at most.
    ranked = best.withColumn("name_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("ratio").desc(), tie)))
    rows = of_type(symbols, symbol_type).join(F.broadcast(ranked.select("name", "ratio", "name_rank")), "name")
    if seen is None:
        return rows.orderBy("name_rank", "id").limit(limit)
    known = seen.select(F.col("qualified_name").alias("seen_name")).distinct()
    first = rows.select("name_rank", "id", "qualified_name").withColumn("place", F.row_number().over(Window.partitionBy("name_rank").orderBy("id"))).filter(F.col("place") <= limit)
    first = first.join(known, F.col("qualified_name") == F.col("seen_name"), "left").select("name_rank", F.struct("place", "id", F.col("seen_name").isNotNull().alias("seen")).alias("row"))
    turns = first.groupBy("name_rank").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    turns = turns.agg(F.sort_array(F.collect_list(F.struct("name_rank", "rows"))).alias("turns"))
    fresh = lambda ids, turn: F.filter(F.slice(turn["rows"], F.lit(1), F.greatest(F.lit(limit) - F.size(ids), F.lit(0))), lambda r: ~r["seen"])
    taken = F.aggregate("turns", F.array().cast("array<bigint>"), lambda ids, turn: F.concat(ids, F.transform(fresh(ids, turn), lambda r: r["id"].cast("bigint"))))
    taken = turns.select(F.explode(taken).alias("id"))
    return rows.join(F.broadcast(taken), "id").orderBy("name_rank", "id").limit(limit)
