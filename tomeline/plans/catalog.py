"""A catalogue on disk: built, refreshed and asked."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fts, lookup, maintain, navigate, stats
from ..operators.format import details, hint
from ..operators.rank import unique_exact
from ..schema import PACKAGES, PROJECT_PREFIX
from ..sources import discover
from ..sources.python_tree import read_sources, read_symbols
from . import cascade
from .segments import Segments


#: An id is made of the run that indexed a symbol, the place of its source in that run and its own place in the source.
_RUN_BITS, _TURN_BITS = 44, 24


class Catalog:
    """Symbols by source and what was indexed of each source, in one folder, as :class:`Segments`.

    As in an index that replaces rows, what is indexed later has larger ids, and of equal qualified names
    in several sources the one indexed last counts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.segments = Segments(spark, self.folder)

    def exists(self) -> bool:
        return self.segments.run() > 0

    def packages(self) -> DataFrame:
        if not self.exists():
            raise RuntimeError(f"nothing is indexed in {self.folder}; build it first")
        return self.segments.state().select(F.col("source_key").alias("name"), "source_path", "mtime", "symbol_count")

    def symbols(self) -> DataFrame:
        """One row for each qualified name."""
        self.packages()
        return self.segments.symbols()

    def build(self, venv: Path | None = None, projects: list[Path] = (), force: bool = False) -> int:
        """Indexes what is new or changed and drops what is gone; the number of symbols, or -1 if there was nothing to do.

        Only changed sources are read and written; until all of it is, others see the catalogue as it was.
        """
        venv = venv or discover.find_venv()
        site = discover.find_site_packages(venv) if venv else None
        if site is None:
            raise RuntimeError("no environment with site-packages was found")
        known = self.packages() if self.exists() else self.spark.createDataFrame([], PACKAGES)
        projects = [str(Path(p).resolve()) for p in projects]
        indexed = [r.name.removeprefix(PROJECT_PREFIX) for r in known.filter(F.col("name").startswith(PROJECT_PREFIX)).select("name").collect()]
        projects += [p for p in indexed if p not in projects and Path(p).is_dir()]
        disk = read_sources(self.spark, str(site), projects)
        plan = {r.name: r.action for r in maintain.changes(disk, known, force).filter("action <> 'unchanged'").collect()}
        todo = sorted(n for n, action in plan.items() if action != "removed")
        if not plan:
            return 0 if force else -1
        run = self._refresh(todo, disk.filter(F.col("name").isin(todo)), read_symbols(self.spark, str(site), projects, todo), [n for n in plan if n not in todo])
        count = self.segments.state(run).filter(F.col("at") == run).agg(F.sum("symbol_count")).first()[0] or 0
        self.segments.merge()
        return -1 if not todo and not force else count

    def _refresh(self, todo: list[str], listing: DataFrame, rows: DataFrame, gone: list[str]) -> int:
        run = self.segments.run() + 1
        turns = self.spark.createDataFrame(list(zip(todo, range(len(todo)), strict=True)), "source_key string, turn long")
        number = F.lit(run).cast("long") * (1 << _RUN_BITS) + F.col("turn") * (1 << _TURN_BITS) + F.col("seq")
        rows = rows.join(turns, "source_key").withColumn("id", number).drop("turn", "seq")
        sources = listing.select(F.col("name").alias("source_key"), "source_path", "mtime")
        return self.segments.refresh(rows, sources, self.spark.createDataFrame([(n,) for n in gone], "source_key string"))

    def is_stale(self, venv: Path | None = None, projects: list[Path] = ()) -> bool:
        """Whether anything on disk differs from what was indexed; without an index yes, without an environment no."""
        if not self.exists():
            return True
        site = discover.find_site_packages(venv) if venv else None
        if site is None:
            return False
        known = [r.name.removeprefix(PROJECT_PREFIX) for r in self.packages().filter(F.col("name").startswith(PROJECT_PREFIX)).collect()]
        alive = [p for p in known if Path(p).is_dir()]
        return bool(maintain.is_stale(read_sources(self.spark, str(site), alive), self.packages()).first().stale)

    def ensure(self, here: Path | None = None) -> Catalog:
        """Builds or refreshes for the project of a folder; without an environment nothing happens."""
        here = Path(here or Path.cwd()).resolve()
        venv = discover.find_venv_cached(here)
        if venv is not None:
            own = [here] if (here / "pyproject.toml").exists() or (here / "setup.py").exists() else []
            if self.is_stale(venv):
                self.build(venv, own)
        return self

    def clean(self) -> list[str]:
        """Drops sources whose path is gone, and files that no source needs any more; their names."""
        gone = [r.name for r in self.packages().collect() if not Path(r.source_path.removeprefix(PROJECT_PREFIX)).exists()]
        if gone:
            self._refresh([], self.spark.createDataFrame([], PACKAGES), read_symbols(self.spark).limit(0), gone)
            self.segments.drop_unused()
        return gone

    def index(self) -> fts.Index:
        return self.segments.index()

    def find(self, query: str, limit: int = 50, symbol_type: str | None = None) -> DataFrame:
        return cascade.search(self.symbols(), self.index(), query, limit, symbol_type, self.segments.tree(), self.segments.grams())

    def find_hint(self, results: DataFrame, in_project: bool = True) -> str | None:
        tiers = {r.tier: r["count"] for r in results.groupBy("tier").count().collect()}
        return hint(tiers.get("fts", 0), tiers.get("fuzzy", 0), in_project)

    def single(self, results: DataFrame) -> str | None:
        """The qualified name of a search's single exact result, if it has one."""
        row = unique_exact(results.filter("tier = 'fts'")).first()
        return row.qualified_name if row else None

    def get(self, name: str) -> DataFrame:
        """The symbol that a name resolves to, no row if none."""
        symbols = self.symbols()
        found = navigate.resolve_one(symbols, name)
        return symbols.limit(0) if found is None else lookup.by_key(self.segments.tree(), found)

    def show(self, name: str) -> str | list[str]:
        """The detail of a symbol, or names that a search for it suggests."""
        row = details(self.symbols(), self.get(name)).first()
        return row.detail if row else [r.qualified_name for r in self.find(name, limit=5).orderBy("rank").collect()]

    def members(self, name: str) -> DataFrame:
        symbols = self.symbols()
        found = navigate.resolve_one(symbols, name)
        return symbols.limit(0) if found is None else lookup.members(self.segments.tree(), found)

    def stats(self) -> dict:
        return stats.stats(self.symbols(), self.packages()) if self.exists() else stats.stats(None, None)
