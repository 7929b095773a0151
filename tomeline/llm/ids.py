"""Ids of any ordered type as numbers of the same order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def numbered_ids(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id") -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with a long id, and a function that puts the original ids back in the named columns of a result.

    Whole numbers stay what they are. Other ids are numbered in their own order by a range sort of the
    distinct ones; numbers grow with the ids but are not consecutive, so no task sees all of them.
    """
    kind = dict(docs.dtypes)[id_col]
    if kind in _WHOLE:
        return docs.withColumn(id_col, F.col(id_col).cast("long")), lambda out, *columns: out.select(*[F.col(c).cast(kind).alias(c) if c in columns else c for c in out.columns])
    ids = docs.select(F.col(id_col).alias("own_id")).filter("own_id is not null").distinct().orderBy("own_id")
    ids = scratch.table("ids", ids.withColumn("nr", F.monotonically_increasing_id()))

    def back(out: DataFrame, *columns: str) -> DataFrame:
        shown = out.columns
        for c in columns:
            out = out.join(ids.select(F.col("own_id").alias(f"{c}_"), F.col("nr").alias(c)), c, "left").drop(c).withColumnRenamed(f"{c}_", c)
        return out.select(*shown)

    named = docs.join(ids, docs[id_col] == ids["own_id"], "left").drop("own_id", id_col).withColumnRenamed("nr", id_col)
    return named, back
