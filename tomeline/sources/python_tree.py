"""Packages and project folders as relations over a listing of their files.

Spark's file sources leave out files whose name begins with an underscore, so ``__init__.py`` would be
lost; the source ``python_listing`` lists folders itself. What is a package, which of several counts and
when it changed last are relations over its rows (``listing``). Files are opened on executors, each by
itself; parsing and re-exports are relations over the files of all packages.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import PROJECT_PREFIX
from . import discover, extract, listing, reexports

#: Partitions of a listing, at most.
PARTS = 64
#: Folders below which a package shows nothing that tells whether it is one.
_DEPTH = 2


class _Entries(InputPartition):
    def __init__(self, entries: list[tuple[str, str, int, str, bool]]):
        self.entries = entries  # (root, via, turn, name, project)


def _pth_folders(file: str) -> list[str]:
    """The folders that a ``.pth`` file adds: its lines but comments and imports, relative to where it lies."""
    with open(file, encoding="utf-8", errors="replace") as lines:
        named = [w for w in (line.strip() for line in lines) if w and not w.startswith(("#", "import "))]
    places = [os.path.realpath(os.path.join(os.path.dirname(file), w)) for w in named]
    return [p for p in places if os.path.isdir(p)]


def _below(folder: str, pruned, depth: int | None = None) -> Iterator[str]:
    """Modules and stubs below a folder, relative to what holds it, without folders that ``pruned`` names."""
    outside = os.path.dirname(folder)
    for at, folders, files in os.walk(folder):
        level = 1 + at[len(folder) :].count(os.sep)
        folders[:] = [] if depth is not None and level >= depth else [d for d in folders if not pruned(d)]
        yield from (os.path.relpath(os.path.join(at, f), outside).replace(os.sep, "/") for f in files if f.endswith((".py", ".pyi")) and os.path.isfile(os.path.join(at, f)))


def _closed(name: str) -> bool:
    return name.startswith((".", "_"))


class _ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.site = options.get("site")
        self.projects = [p for p in options.get("projects", "").split("\n") if p]

    def partitions(self) -> list[InputPartition]:
        entries = [(os.path.dirname(p), "", 0, os.path.basename(p), True) for p in self.projects]
        for name in os.listdir(self.site) if self.site else ():
            entries.append((self.site, name, 0, name, False))
            pth = os.path.join(self.site, name)
            if name.endswith(".pth") and os.path.isfile(pth):
                entries += [(folder, name, turn, n, False) for turn, folder in enumerate(_pth_folders(pth)) for n in os.listdir(folder)]
        return [_Entries(entries[i::PARTS]) for i in range(min(PARTS, len(entries)))] or [_Entries([])]

    def read(self, partition: _Entries) -> Iterator[tuple]:
        for root, via, turn, name, project in partition.entries:
            whole = os.path.join(root, name)
            if os.path.isdir(whole):
                paths = [f"{name}/", *(_below(whole, _closed) if project else _below(whole, lambda _: False, _DEPTH))]
            else:
                paths = [name] if os.path.isfile(whole) else []
            for path in paths:
                yield root, via, turn, path, os.stat(os.path.join(root, path)).st_mtime, project


class PythonListing(DataSource):
    """``spark.read.format("python_listing").option("site", folder)``: files of a folder of packages, of those that its ``.pth`` files add, and of project folders (option ``projects``, one a line)."""

    @classmethod
    def name(cls) -> str:
        return "python_listing"

    def schema(self) -> str:
        return "root string, via string, turn int, path string, mtime double, project boolean"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options)


def read_listing(spark: SparkSession, site: str | None = None, projects: list[str] | None = None) -> DataFrame:
    """Of packages the files that tell what is one, of projects all modules."""
    spark.dataSource.register(PythonListing)
    reader = spark.read.format(PythonListing.name()).option("projects", "\n".join(projects or []))
    return (reader.option("site", site) if site else reader).load()


def _texts(files: DataFrame, project: bool) -> DataFrame:
    """The text of each file (source_key, base, path); files are dealt to tasks one by one, whatever their packages' sizes."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, base, path in zip(pdf["source_key"], pdf["base"], pdf["path"], strict=True):
                text = Path(base, path).read_text(encoding="utf-8", errors="replace")
                yield pd.DataFrame([(k, base, path, text, project)], columns=["source_key", "base", "path", "text", "project"])

    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("source_key", "base", "path").repartition(parts, "base", "path").mapInPandas(each, "source_key string, base string, path string, text string, project boolean")


def _package_files(packages: DataFrame) -> DataFrame:
    """(source_key, base, path) of all modules and stubs of packages (name, root, entry)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, root, entry in zip(pdf["name"], pdf["root"], pdf["entry"], strict=True):
                whole = os.path.join(root, entry)
                paths = list(_below(whole, lambda _: False)) if os.path.isdir(whole) else [entry]
                yield pd.DataFrame({"source_key": [name] * len(paths), "base": [f"{root}/"] * len(paths), "path": paths}, dtype=object)

    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packages.select("name", "root", "entry").repartition(parts, "name").mapInPandas(each, "source_key string, base string, path string")


def _folder() -> Column:
    return F.concat("root", F.when(F.col("root").endswith("/"), "").otherwise("/"), "entry")


def _beside(site: str | None) -> reexports.Outside:
    """Finds modules beside a package, in the folder that holds it."""

    def look(missing: DataFrame) -> DataFrame:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found = ((k, m, discover.module_file(m, Path(site))) for k, m in zip(pdf["source_key"], pdf["module"], strict=True) if site and m)
                for k, m, f in found:
                    if f:
                        yield pd.DataFrame([(k, m, str(f), str(f), f.read_text(encoding="utf-8", errors="replace"))], columns=["source_key", "module", "path", "file_path", "text"])

        return missing.select("source_key", "module").mapInPandas(each, "source_key string, module string, path string, file_path string, text string")

    return look


def read_symbols(spark: SparkSession, site: str | None = None, projects: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """Symbols of the packages of a folder and of project folders, before names are made unique."""
    rows = read_listing(spark, site, projects)
    packages = listing.package_sources(rows.filter("not project"))
    found = reexports.symbols(_texts(_package_files(packages.filter(F.col("name").isin(only)) if only else packages), False), _beside(site))
    if not projects:
        return found
    walked = listing.modules(rows.filter("project")).withColumn("entry", F.split_part("path", F.lit("/"), F.lit(1)))
    files = walked.select(F.concat(F.lit(PROJECT_PREFIX), _folder()).alias("source_key"), F.concat(_folder(), F.lit("/")).alias("base"), F.expr("substr(path, length(entry) + 2)").alias("path"))
    return found.unionByName(reexports.symbols(_texts(files.filter(F.col("source_key").isin(only)) if only else files, True), projects=True))


def read_sources(spark: SparkSession, site: str | None = None, projects: list[str] | None = None) -> DataFrame:
    """name, source_path and mtime of every package and project."""
    rows = read_listing(spark, site, projects)
    packages = listing.package_sources(rows.filter("not project")).select("name", _folder().alias("source_path"), "mtime")
    if not projects:
        return packages
    own = F.concat(F.lit(PROJECT_PREFIX), _folder())
    return packages.unionByName(listing.project_sources(rows.filter("project")).select(own.alias("name"), own.alias("source_path"), "mtime"))


def symbols_of_files(files: DataFrame) -> DataFrame:
    """Symbols of packages whose files are rows (source_key, path, text), path being relative to the folder of packages."""
    return reexports.symbols(files)


def symbols_of_folders(files: DataFrame) -> DataFrame:
    """Symbols of project folders whose files are rows (source_key, path, text), path being relative to the folder."""
    return reexports.symbols(files, projects=True)


def reexports_of_files(files: DataFrame) -> DataFrame:
    """Re-exports of ``__init__`` files that are rows (module, text), numbered within each."""
    rows_of = lambda module, text: ((module, i, *r) for i, r in enumerate(extract.reexports_of(text, module)))
    return reexports.of_each(files.select("module", "text"), rows_of, "init_module string, ord int, local_name string, source_module string, source_name string, is_module boolean")
