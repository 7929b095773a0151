"""Keeping a catalogue fresh: upserts, deletes, and snapshots of sources compared by modification time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PROJECT_PREFIX


def last_writer(rows: DataFrame, key: str = "qualified_name", order: str = "seq") -> DataFrame:
    """One row for each key, the last by ``order``; a maximum, so most of it happens before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(order, *rest), order).alias("row"))
    return best.select(*[F.col(key) if c == key else F.col(f"row.`{c}`").alias(c) for c in rows.columns])


def last_sorted(rows: DataFrame, *by: Column, order: str = "id") -> DataFrame:
    """:func:`last_writer` for rows that are to be stored in the order of their keys ``by``: range-partitioned and sorted by them.

    Whole rows, with their texts, are shuffled and sorted once, where an aggregate of them sorts before and
    after its shuffle and the range partitioning shuffles again. Rows of one key meet in one task.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    spread = rows.withColumns(dict(zip(keys, by))).repartitionByRange(*keys)
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return spread.withColumn("_turn", turn).filter("_turn = 1").select(rows.columns)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` put over it by qualified name; the new rows come last."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    return last_writer(both.withColumn("_order", F.struct("_turn", "seq")), "qualified_name", "_order").drop("_turn", "_order")


def delete_source(symbols: DataFrame, source_key: str) -> DataFrame:
    """Without the rows of one source; other sources whose name begins alike stay."""
    return symbols.filter(F.col("source_key") != source_key)


def changes(listing: DataFrame, packages: DataFrame, force: bool = False) -> DataFrame:
    """(name, action) of every source: new, changed, removed or unchanged.

    ``listing`` holds what is on disk now (name, source_path, mtime), ``packages`` what was indexed.
    Times are compared exactly.
    """
    disk = listing.select("name", F.col("mtime").alias("disk_mtime"))
    known = packages.select("name", F.col("mtime").alias("known_mtime"))
    both = disk.join(known, "name", "full_outer")
    action = (
        F.when(F.col("disk_mtime").isNull(), "removed")
        .when(F.col("known_mtime").isNull(), "new")
        .when(F.lit(force) | (F.col("disk_mtime") != F.col("known_mtime")), "changed")
        .otherwise("unchanged")
    )
    return both.select("name", action.alias("action"))


def is_stale(listing: DataFrame, packages: DataFrame) -> DataFrame:
    """One row, stale: whether any source is new, changed or removed."""
    return changes(listing, packages).agg(F.coalesce(F.max((F.col("action") != "unchanged").cast("int")), F.lit(0)).alias("stale"))


def dead(packages: DataFrame, listing: DataFrame) -> DataFrame:
    """Indexed sources whose path is gone."""
    return packages.join(listing.select("source_path"), "source_path", "left_anti").select("name")


def package_counts(rows: DataFrame, key: str = "source_key") -> DataFrame:
    """Symbols that each source yields, before names are made unique."""
    return rows.groupBy(key).agg(F.count("*").alias("symbol_count"))


def project_name(path: str) -> str:
    """The name of a project directory among the packages: its whole path, so equal folder names stay apart."""
    return f"{PROJECT_PREFIX}{path}"


def without_projects(packages: DataFrame) -> DataFrame:
    return packages.filter(~F.col("name").startswith(PROJECT_PREFIX))
