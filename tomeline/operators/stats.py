"""Counts over a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(symbols: DataFrame) -> DataFrame:
    return symbols.agg(F.count("*").alias("n_symbols"), F.count_distinct("name").alias("n_names"))


def by_type(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("symbol_type").agg(F.count("*").alias("n_symbols"))


def stats(symbols: DataFrame | None, packages: DataFrame | None) -> dict:
    """Totals and counts by type; an error entry if nothing has been indexed."""
    if symbols is None or packages is None:
        return {"error": "No index found. Build one first."}
    counts = {r.symbol_type: r.n_symbols for r in by_type(symbols).orderBy("symbol_type").collect()}  # one row for each type
    return {"symbols": sum(counts.values()), "packages": packages.count(), "by_type": counts}
