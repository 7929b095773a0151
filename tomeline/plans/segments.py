"""A catalogue kept in segments: what changes is written anew, the rest stays where it is.

Each refresh is a run. It writes the symbols of new and changed sources, a second copy of them sorted by
their parent, and their part of the full-text index to partitions ``run=<number>`` of its own, and last the
table ``state``: a row for each source with the run that holds it. Nothing that an earlier run has written
is touched, so readers hold to the state they found, and a refresh that dies half-way has changed nothing:
the next one takes the same number and writes over what was left.

A source that is superseded or gone is one whose run ``state`` does not name; its rows stay on disk, and the
join with ``state`` leaves them out, until a merge or :meth:`Segments.drop_unused`. Names that several
sources define belong to the row with the largest id; the others' ids are in ``shadowed``, of which only
the names that a run touches are decided again.
"""

from __future__ import annotations

import contextlib
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import by_name, parent_key
from ..operators import fts, lookup
from ..operators.maintain import last_sorted
from .store import Store

#: Runs that may hold live sources before small ones are merged.
MOST_RUNS = 8
#: What the library itself keeps of a source.
_OWN = ("at", "symbol_count", "n_symbols")
#: Tables whose rows belong to a source.
_BY_SOURCE = ("rows", "tree", "postings", "grams", "lengths")
_BLOOM = "parquet.bloom.filter.enabled#qualified_name"


class Segments:
    """The tables of one folder: rows, tree, postings, grams, lengths, totals, shadowed and state, each by run."""

    def __init__(self, spark: SparkSession, folder: str, stemmed: bool = True):
        self.spark, self.folder, self.stemmed = spark, folder.rstrip("/"), stemmed
        self._known: dict[int, tuple[list[int], bool, bool]] = {}

    # -- reading -------------------------------------------------------------------------------------

    def _table(self, name: str, run: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}" + ("" if run is None else f"/run={run}"))

    def run(self) -> int:
        """The last complete run; 0 if there is none."""
        try:
            return max((int(x[1]) for f in self._table("state").inputFiles() if (x := re.search(r"/run=(\d+)/", f))), default=0)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return 0
            raise

    def state(self, run: int | None = None) -> DataFrame:
        """(source_key, the columns that were stored with it, at, symbol_count, n_symbols) of each live source."""
        run = run or self.run()
        if not run:
            raise RuntimeError(f"nothing is stored in {self.folder}")
        return self._table("state", run)

    def _live(self, name: str, state: DataFrame) -> DataFrame:
        """Rows of a table whose source the state puts into their run."""
        where = state.select(F.col("source_key"), F.col("at").alias("run"))
        rows = self._table(name)
        return rows.join(where, ["source_key", "run"], "left_semi").select(*[c for c in rows.columns if c != "run"])

    def _facts(self, run: int) -> tuple[list[int], bool, bool]:
        """Of a complete run, which never changes: the runs that hold live sources, whether all their rows are live, and whether any is shadowed."""
        if run not in self._known:
            totals = self._table("totals", run).first()
            self._known[run] = (list(totals.runs), totals.whole, totals.any_shadowed)
        return self._known[run]

    def _seen(self, name: str, run: int | None) -> DataFrame:
        run = run or self.run()
        state = self.state(run)
        runs, whole, any_shadowed = self._facts(run)
        rows = self._table(name).filter(F.col("run").isin(runs)).drop("run") if whole else self._live(name, state)
        return rows.join(self._table("shadowed", run).select("id"), "id", "left_anti").select(*rows.columns) if any_shadowed else rows

    def symbols(self, run: int | None = None) -> DataFrame:
        """One row for each qualified name, each run's sorted by name."""
        return self._seen("rows", run)

    def tree(self, run: int | None = None) -> DataFrame:
        """The same rows, each run's sorted by parent and qualified name, with Bloom filters on the latter."""
        return self._seen("tree", run)

    def grams(self, run: int | None = None) -> DataFrame:
        """(gram, id): the index of the symbols' letters, each run's sorted by gram."""
        return self._seen("grams", run).drop("source_key")

    def index(self, run: int | None = None) -> fts.Index:
        run = run or self.run()
        return fts.Index(self._seen("postings", run).drop("source_key"), self._seen("lengths", run).drop("source_key"), self._table("totals", run).select("n", "avgdl"), self.stemmed)

    # -- writing -------------------------------------------------------------------------------------

    def _write(self, name: str, run: int, rows: DataFrame, *order: str) -> None:
        if order:
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        rows.write.mode("overwrite").option(_BLOOM, str(name == "tree").lower()).parquet(f"{self.folder}/{name}/run={run}")

    def refresh(self, rows: DataFrame, sources: DataFrame, gone: DataFrame | None = None) -> int:
        """Puts sources in the place of what was stored of them and forgets those ``gone``; the number of the run.

        ``rows`` has the symbols of the sources given, in any order: source_key, id, name, qualified_name,
        symbol_type, signature, docstring and any further columns, the same in every run. Of rows that share
        source and qualified name the one with the largest id stays. ``sources`` has one row for each
        of them: source_key and any columns that are to be kept with it; sources without rows are kept too.
        ``gone`` has a source_key each.
        """
        before = self.run()
        run = before + 1
        changed = sources.select("source_key")
        changed = changed if gone is None else changed.unionByName(gone.select("source_key")).distinct()
        own = last_sorted(rows, *by_name(), F.col("source_key"))
        self._write("rows", run, own.withColumn("parent_key", parent_key("qualified_name")))
        own = self._table("rows", run)
        self._write("tree", run, own, "parent_key", "qualified_name")
        self._write("grams", run, lookup.grams(own, "source_key"), "gram", "id")
        passing = Store(self.spark, f"{self.folder}/_passing")
        passing.drop()  # of a refresh that died
        words = passing.table("forward", lambda: fts.forward(own, self.stemmed, "source_key"))
        stems = passing.table("stems", lambda: fts.stems_of(words)) if self.stemmed else None
        self._write("postings", run, fts.by_term(words, stems, "source_key"))
        self._write("lengths", run, words.select("id", "dl", "source_key"), "id")
        passing.drop()
        counts = rows.groupBy("source_key").agg(F.count("*").alias("symbol_count"))
        counts = counts.join(own.groupBy("source_key").agg(F.count("*").alias("n_symbols")), "source_key")
        zero = F.lit(0).cast("long")
        fresh = sources.withColumn("at", F.lit(run)).join(counts, "source_key", "left").withColumns({c: F.coalesce(F.col(c), zero) for c in _OWN[1:]})
        if not before:
            self._finish(run, fresh, own.select("qualified_name", "id"), own.select("qualified_name").distinct(), None)
            return run
        old = self.state(before)
        standing = self._live("rows", old).select("source_key", "qualified_name", "id")
        touched = own.select("qualified_name").unionByName(standing.join(changed, "source_key", "left_semi").select("qualified_name")).distinct()
        kept = standing.join(changed, "source_key", "left_anti").select("qualified_name", "id").join(touched, "qualified_name", "left_semi")
        state = old.join(changed, "source_key", "left_anti").unionByName(fresh)
        self._finish(run, state, kept.unionByName(own.select("qualified_name", "id")), touched, self._table("shadowed", before))
        return run

    def _finish(self, run: int, state: DataFrame, rows: DataFrame, touched: DataFrame, shadowed: DataFrame | None) -> None:
        """Decides who owns the names touched, of which ``rows`` has all live ones, and makes the run the current one."""
        best = rows.groupBy("qualified_name").agg(F.max("id").alias("best"), F.count("*").alias("n")).filter("n > 1")
        lost = rows.join(best, "qualified_name").filter("id < best").select("id", "qualified_name")
        if shadowed is not None:
            lost = shadowed.join(touched, "qualified_name", "left_anti").select("id", "qualified_name").unionByName(lost)
        self._write("shadowed", run, lost)
        shadowed = self._table("shadowed", run).select("id")
        self._total(run, state, fts.totals_of(self._live("lengths", state).join(shadowed, "id", "left_anti")), not shadowed.isEmpty())
        self._publish(run, state.select("source_key", *[c for c in state.columns if c not in ("source_key", *_OWN)], *_OWN))

    def _total(self, run: int, state: DataFrame, totals: DataFrame, any_shadowed: bool) -> None:
        """One row: the index's totals, the runs with live sources, whether nothing in them is superseded, and whether anything is shadowed."""
        live = state.filter("n_symbols > 0").agg(F.coalesce(F.collect_set(F.col("at").cast("int")), F.array().cast("array<int>")).alias("runs"), F.coalesce(F.sum("n_symbols"), F.lit(0)).alias("n")).first()
        held = self._table("lengths").filter(F.col("run").isin(live.runs)).count()
        self._write("totals", run, totals.select("n", "avgdl", F.array(*map(F.lit, live.runs)).cast("array<int>").alias("runs"), F.lit(held == live.n).alias("whole"), F.lit(any_shadowed).alias("any_shadowed")))

    def _publish(self, run: int, state: DataFrame) -> None:
        """The last write of a run; one file of a short row for each source, so it appears at once."""
        self._write("state", run, state.coalesce(1))

    def merge(self, most: int = MOST_RUNS) -> int:
        """Brings the sources of small runs together in a new one, if more than ``most`` runs hold live sources; the current run.

        From the smallest up, runs are taken as long as one is at most twice as large as those before it
        together, so a row is moved about as often as the catalogue doubles. Ids stay, and nothing is read
        from its text again.
        """
        before = self.run()
        old = self.state(before)
        sizes = sorted((r.n, r.at) for r in old.groupBy("at").agg(F.sum("n_symbols").alias("n")).collect())  # ``most`` runs and a few
        if len(sizes) <= most:
            return before
        taken, pool = [], 0
        for n, at in sizes:
            if len(taken) > 1 and n > 2 * pool:
                break
            taken.append(at)
            pool += n
        run = before + 1
        moved = F.col("at").isin(taken)
        part = old.filter(moved)
        for name, *order in (("rows", "name", "id"), ("tree", "parent_key", "qualified_name"), ("postings", "term", "id"), ("grams", "gram", "id"), ("lengths", "id")):
            self._write(name, run, self._live(name, part), *order)
        self._write("shadowed", run, self._table("shadowed", before))
        state = old.withColumn("at", F.when(moved, F.lit(run)).otherwise(F.col("at")))
        self._total(run, state, self._table("totals", before), self._facts(before)[2])
        self._publish(run, state)
        return run

    def drop_unused(self) -> list[int]:
        """Deletes the runs that hold no live source and are not the current one; their numbers. Not while others read an older state."""
        current = self.run()
        live = {r["at"] for r in self.state(current).select("at").distinct().collect()}
        jvm, dropped = self.spark._jvm, set()
        for name in (*_BY_SOURCE, "shadowed", "totals", "state"):
            top = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for entry in fs.listStatus(top):
                found = re.fullmatch(r"run=(\d+)", entry.getPath().getName())
                keep = {current} | (live if name in _BY_SOURCE else set())
                if found and int(found[1]) < current and int(found[1]) not in keep:
                    with contextlib.suppress(FileNotFoundError):
                        fs.delete(entry.getPath(), True)
                    dropped.add(int(found[1]))
        return sorted(dropped)
