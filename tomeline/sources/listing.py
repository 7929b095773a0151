"""Packages, modules and times of change from a listing of files that is a table.

A listing has a row for each file with its ``path`` relative to the folder of packages, parts joined by
a slash; a folder's own row, if there is one, ends with a slash. Rows may repeat. A listing of several
folders has a ``root`` as well, and where their packages compete the place (``via``, ``turn``) of each root
in that order. Listings of any size are filtered and aggregated where they are; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entries of a folder of packages that are no packages.
SKIPPED = (".dist-info", ".egg-info", ".so", ".pyd", ".pth")


def _parts() -> Column:
    return F.split("path", "/")


def _top() -> Column:
    return F.split_part(F.col("path"), F.lit("/"), F.lit(1))


def _folders() -> Column:
    """The folders between the first part of a path and its file."""
    return F.slice(_parts(), F.lit(2), F.greatest(F.size(_parts()) - 2, F.lit(0)))


def _module() -> Column:
    return F.regexp_replace(F.translate(F.regexp_replace("path", "[.]pyi?$", ""), "/", "."), "[.]__init__$", "")


def _package_name() -> Column:
    """The name of the package that a row makes its first part, null if it makes it none."""
    top, parts = _top(), _parts()
    skipped = top.startswith("_") | top.startswith(".")
    for suffix in SKIPPED:
        skipped = skipped | top.endswith(suffix)
    last, depth = F.element_at(parts, -1), F.size(parts)
    module = last.endswith(".py")
    fits = ((depth == 1) & module) | ((depth == 2) & (module | last.endswith(".pyi"))) | ((depth == 3) & (last == "__init__.py"))
    return F.when(~skipped & fits, F.when(depth == 1, F.regexp_replace(top, "[.]py$", "")).otherwise(top))


def packages(listing: DataFrame) -> DataFrame:
    """(name, entry) of each package: a folder with an ``__init__`` or with modules directly below, or a module file.

    Of entries that share a name the first one counts. Modules and stubs make a folder a package, and so
    do folders below it that have an ``__init__``.
    """
    named = listing.select(_package_name().alias("name"), _top().alias("entry")).filter("name is not null")
    return named.groupBy("name").agg(F.min("entry").alias("entry"))


def package_sources(listing: DataFrame) -> DataFrame:
    """(name, root, entry, mtime) of the packages of all roots; of those that share a name the first by (via, turn, entry) counts.

    A module file's time of change is its own, a folder's the later of its own and its ``__init__``'s.
    """
    own = (F.col("path") == _top()) | (F.col("path") == F.concat(_top(), F.lit("/"))) | (F.col("path") == F.concat(_top(), F.lit("/__init__.py")))
    entries = listing.groupBy("via", "turn", _top().alias("entry"), "root").agg(F.max(_package_name()).alias("name"), F.max(F.when(own, F.col("mtime"))).alias("mtime"))
    first = F.min(F.struct("via", "turn", "entry", "root", "mtime")).alias("at")
    return entries.filter("name is not null").groupBy("name").agg(first).select("name", "at.root", "at.entry", "at.mtime")


def project_sources(listing: DataFrame) -> DataFrame:
    """(root, entry, mtime) of the folders of a listing as projects: the latest of a folder and all modules that ``modules`` keeps."""
    own = F.col("path") == F.concat(_top(), F.lit("/"))
    rows = listing.filter(own | _walked())
    files = rows.groupBy("root", _top().alias("entry"), _stem().alias("stem")).agg(F.min_by("mtime", "path").alias("mtime"))
    return files.groupBy("root", "entry").agg(F.max("mtime").alias("mtime"))


def _stem() -> Column:
    return F.regexp_replace("path", "[.]pyi?$", "")


def _walked() -> Column:
    """Whether a row is a module or stub outside of private and hidden folders below the first."""
    return F.col("path").rlike("[.]pyi?$") & ~F.exists(_folders(), lambda d: d.startswith(".") | d.startswith("_"))


def modules(listing: DataFrame) -> DataFrame:
    """(path, module), after the root if there are several, of modules, and of stubs without a module beside them; nothing in private or hidden folders below the first."""
    root = [c for c in listing.columns if c == "root"]
    rows = listing.filter(_walked()).select(*root, "path").distinct()
    best = rows.groupBy(*root, _stem().alias("stem")).agg(F.min("path").alias("path"))  # .py sorts before .pyi
    return best.select(*root, "path", _module().alias("module"))


def inits(listing: DataFrame) -> DataFrame:
    """(module, path) of each ``__init__.py`` in a folder, private folders included, hidden ones and caches not."""
    hidden = F.exists(_folders(), lambda d: d.startswith(".") | (d == "__pycache__"))
    return listing.filter(F.col("path").endswith("/__init__.py") & ~hidden).select(_module().alias("module"), "path").distinct()


def changed(listing: DataFrame) -> DataFrame:
    """(source, package_mtime, project_mtime) of each folder: as a package, its own time or its ``__init__``'s; as a project, that of any module too."""
    top = _top()
    own = F.col("path") == F.concat(top, F.lit("/"))
    rows = listing.filter(F.contains("path", F.lit("/"))).join(modules(listing).select("path", F.lit(True).alias("walked")), "path", "left")
    package = F.when(own | (F.col("path") == F.concat(top, F.lit("/__init__.py"))), F.col("mtime"))
    return rows.groupBy(top.alias("source")).agg(F.max(package).alias("package_mtime"), F.max(F.when(own | F.col("walked"), F.col("mtime"))).alias("project_mtime"))
