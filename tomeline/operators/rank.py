"""Order of results, and choices that depend on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import parent, sort_key


def numbered(rows: DataFrame, *order, name: str = "rank") -> DataFrame:
    """With the place of each row in an order, from 1; for results of bounded size."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def refetched(rows: DataFrame, fetched_by: list, cap: int, limit: int) -> DataFrame:
    """The first ``cap`` rows of one order, then the first ``limit`` of these in the order of results: two top-k, no full sort."""
    return rows.orderBy(*fetched_by).limit(cap).orderBy(*sort_key(), "id").limit(limit)


def unique_exact(results: DataFrame) -> DataFrame:
    """The one result that has no other result among its dotted ancestors; nothing unless there is exactly one.

    Ancestors are exploded and met by equality, so the join is no comparison of all pairs.
    """
    places = F.expr("filter(transform(split(qualified_name, ''), (c, i) -> CASE WHEN c = '.' THEN i END), i -> i IS NOT NULL)")
    above = results.select("qualified_name", F.explode(F.transform(places, lambda i: F.substring("qualified_name", F.lit(1), i))).alias("ancestor"))
    below = above.join(results.select(F.col("qualified_name").alias("ancestor")), "ancestor", "left_semi").select("qualified_name").distinct()
    roots = results.join(below, "qualified_name", "left_anti").select(results.columns)
    one = roots.agg(F.count("*").alias("n"), F.first(F.struct(*results.columns)).alias("row")).filter("n = 1")
    return one.select("row.*")


def depth_parent(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("parent_qname", parent("qualified_name"))
