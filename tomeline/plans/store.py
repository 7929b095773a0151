"""Stored snapshots: tables that are written once, sorted for the filters that searches use, and read by every later query.

A snapshot holds one row for each qualified name, sorted by name, so Parquet's row-group statistics prune
equality and prefix filters on it, and columns that a query does not ask for, texts above all, are not
read. The full-text index lies beside it: postings sorted by term, document lengths and corpus totals.
"""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fts


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder, which only a local master can use."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tomeline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Store:
    """Tables under one folder, each written when it is first asked for and complete once Spark has marked it so."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        """Whether the table was written to its end; a job that failed leaves no mark, and its table is written anew."""
        return bool(self._fs().exists(self._path(f"{name}/_SUCCESS")))

    def table(self, name: str, make: Callable[[], DataFrame], *order: str) -> DataFrame:
        """The table; unless it is there, what ``make`` gives is written, range-partitioned and sorted by ``order``."""
        path = f"{self.folder}/{name}"
        if not self.has(name):
            rows = make()
            if order:
                rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
            rows.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def drop(self) -> None:
        """Deletes the folder, if it is there."""
        with contextlib.suppress(Exception):  # the session may be gone
            self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder), True)

    def temporary(self) -> Store:
        """The same store, deleted when the interpreter ends."""
        atexit.register(lambda: self.spark.sparkContext._jsc is not None and self.drop())
        return self

    def index(self, symbols: DataFrame, stemmed: bool) -> fts.Index:
        """The full-text index of a snapshot; texts are split into words once, for the table by symbol, of which the others are made."""
        kind = "stemmed" if stemmed else "plain"
        words = self.table(f"{kind}/forward", lambda: fts.forward(symbols, stemmed))
        stems = self.table(f"{kind}/stems", lambda: fts.stems_of(words)) if stemmed else None
        postings = self.table(f"{kind}/postings", lambda: fts.by_term(words, stems))
        lengths = self.table(f"{kind}/lengths", lambda: words.select("id", "dl"), "id")
        totals = self.table(f"{kind}/totals", lambda: fts.totals_of(lengths))
        return fts.Index(postings, lengths, totals, stemmed)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of names, sizes and times of the files under ``paths``, so that changed inputs get a snapshot of their own."""
    seen = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        entries = fs.listStatus(p)
        seen += [f"{e.getPath().getName()}:{e.getLen()}:{e.getModificationTime()}" for e in entries]
    return hashlib.md5("\n".join([*paths, *seen]).encode()).hexdigest()[:16]


def snapshot(store: Store, rows: Callable[[], DataFrame]) -> DataFrame:
    """One row for each qualified name, sorted by name; ``rows`` makes them, so sorted, if they are not stored."""
    return store.table("symbols", rows)


def scratch(spark: SparkSession, what: str) -> Store:
    """A store of its own, gone when the interpreter ends."""
    return Store(spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}").temporary()


def placed(rows: DataFrame, by: list[str], order: list, name: str = "place") -> DataFrame:
    """``rows`` with the place of each in an order among those that share the columns ``by``, from 1.

    A range sort of all rows; a row's place is its place in its partition, plus the rows of the partitions
    before, less the place before the first row that shares its columns. So a group of any size is spread
    over tasks; the driver sees one number for each partition.
    """
    at, first = f"{name}_at", f"{name}_first"
    keys = [*map(F.col, by), *(F.col(o) if isinstance(o, str) else o for o in order)]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    ordered = scratch(rows.sparkSession, "placed").table("ordered", lambda: ordered)
    part, within = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    before, total = F.lit(0).cast("long"), 0
    for r in sorted(ordered.groupBy(part.alias("part")).count().collect()):
        before, total = F.when(part == r.part, total).otherwise(before), total + r["count"]
    found = ordered.withColumn(name, before + within + 1).drop(at)
    if not by:
        return found
    starts = found.groupBy(*by).agg((F.min(name) - 1).alias(first))
    met = found.join(starts.select(*[F.col(c).alias(f"{first}_{c}") for c in by], first), [F.col(c).eqNullSafe(F.col(f"{first}_{c}")) for c in by])
    return met.withColumn(name, F.col(name) - F.col(first)).select(*rows.columns, name)
