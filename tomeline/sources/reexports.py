"""Symbols of whole packages as relations: files, definitions, imports.

Each file is parsed by itself, wherever it lies. What a package re-exports follows from joins over all
packages at once: which ``__init__`` modules a package's public names reach is a breadth-first fixpoint over
an edge table, one join for each level of nesting; an arrival is told by the path of import numbers that led
to it, so that of several ways to a module or a name the first one counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import parent
from ..plans.store import Store, placed, scratch
from . import extract

_SYMBOL = "name string, qualified_name string, symbol_type string, signature string, docstring string, file_path string, line_no int, bases array<string>, return_annotation string"
COLUMNS = [c.split()[0] for c in _SYMBOL.split(", ")]
_IMPORT = "source_key string, init_module string, ord int, local_name string, source_module string, source_name string, is_module boolean"

#: Files whose texts a task takes out of an Arrow batch at once, and rows of a batch that it gives on.
_FILES, _ROWS = 16, 1000
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}

Outside = Callable[[DataFrame], DataFrame]


def module_of(path: str) -> Column:
    """Dotted name of a module file by its relative path; an ``__init__`` names its folder."""
    return F.regexp_replace(F.translate(F.regexp_replace(path, "[.]pyi?$", ""), "/", "."), "(^|[.])__init__$", "")


def _folders(first: int) -> Column:
    """The folders of a path from the ``first`` on, counted from 1."""
    parts = F.split("path", "/")
    return F.slice(parts, F.lit(first), F.greatest(F.size(parts) - first, F.lit(0)))


def walked(files: DataFrame) -> DataFrame:
    """(source_key, path) of the modules of each source, and of stubs without a module beside them; nothing in private or hidden folders below the first."""
    open_ = files.filter(F.col("path").rlike("[.]pyi?$") & ~F.exists(_folders(2), lambda d: d.startswith(".") | d.startswith("_")))
    return open_.groupBy("source_key", F.regexp_replace("path", "[.]pyi?$", "").alias("stem")).agg(F.min("path").alias("path")).drop("stem")


def _inits(files: DataFrame) -> DataFrame:
    """(source_key, module, path) of ``__init__.py`` files, those in private folders included, hidden ones and caches not."""
    hidden = F.exists(_folders(1), lambda d: d.startswith(".") | (d == "__pycache__"))
    return files.filter(F.col("path").endswith("/__init__.py") & ~hidden).select("source_key", module_of("path").alias("module"), "path")


def of_each(files: DataFrame, rows_of: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that ``rows_of`` makes of each row's values.

    They are given on by the thousand, so that beside a batch of texts, which Spark bounds by bytes, a task
    holds the rows of one file and of two such batches, however many files it has.
    """
    types = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = (batch.slice(at, _FILES) for batch in batches for at in range(0, batch.num_rows, _FILES))
        made = (row for part in few for values in zip(*(c.to_pylist() for c in part.columns), strict=True) for row in rows_of(*values))
        while piece := list(islice(made, _ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*piece, strict=True), types.types, strict=True)], schema=types)

    return files.mapInArrow(each, schema)


def _parsed(files: DataFrame) -> DataFrame:
    """The symbols of each file (source_key, path, module, file_path, text), numbered in it by ``at``."""
    rows_of = lambda key, path, module, file_path, text: ((*s, key, path, at) for at, s in enumerate(extract.symbols_of(text, module, file_path)))
    return of_each(files.select("source_key", "path", "module", "file_path", "text"), rows_of, f"{_SYMBOL}, source_key string, path string, at int")


def _imports(inits: DataFrame) -> DataFrame:
    """The re-exports of each ``__init__`` (source_key, module, text), numbered in it by ``ord``."""
    rows_of = lambda key, module, text: ((key, module, i, *r) for i, r in enumerate(extract.reexports_of(text, module)))
    return of_each(inits.select("source_key", "module", "text"), rows_of, _IMPORT)


def _reached(store: Store, inits: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_key, module, prefix, level, way): the ``__init__`` modules that public names lead to, each under the first that does.

    ``way`` holds the numbers of the imports on the way; ways of one level compare like the places of their
    ends in a queue. Every round goes one import further and keeps what it meets for the first time.
    """
    at = inits.filter("module = source_key").select("source_key", "module", F.col("module").alias("prefix"), F.lit(0).alias("level"), F.array().cast("array<int>").alias("way"))
    seen, level = at, 0
    while not at.isEmpty():
        level += 1
        step = at.withColumnRenamed("module", "init_module").join(edges, ["source_key", "init_module"])
        step = step.select("source_key", F.col("target").alias("module"), F.concat_ws(".", "prefix", "local_name").alias("prefix"), F.concat("way", F.array("ord")).alias("way"))
        first = step.join(seen, ["source_key", "module"], "left_anti").groupBy("source_key", "module").agg(F.min(F.struct("way", "prefix")).alias("first"))
        first = first.select("source_key", "module", "first.prefix", F.lit(level).alias("level"), "first.way")
        at = store.table(f"level-{level}", lambda first=first: first)
        seen = seen.unionByName(at)
    return seen


def _suppressed(store: Store, clashes: DataFrame) -> DataFrame:
    """(source_key, name) of names that an earlier class brings as its member; a class that is suppressed itself brings none.

    ``clashes`` has (source_key, name, owner). A name waits until it is decided for its owner, one level of
    nesting a round.
    """
    key = ["source_key", "name"]
    waiting, gone, turn = clashes, clashes.limit(0).select(*key), 0
    while not waiting.isEmpty():
        turn += 1
        undecided = waiting.select("source_key", F.col("name").alias("owner"))
        ready = store.table(f"ready-{turn}", lambda w=waiting, u=undecided: w.join(u, ["source_key", "owner"], "left_anti"))
        gone = gone.unionByName(ready.join(gone.withColumnRenamed("name", "owner"), ["source_key", "owner"], "left_anti").select(*key))
        waiting = waiting.join(ready, key, "left_anti")
    return gone


def _public(store: Store, files: DataFrame, parsed: DataFrame, outside: Outside | None) -> DataFrame:
    """Symbols under the names that ``__init__`` files give them, with level, way, ord and sub, by which they come."""
    inits = _inits(files)
    imports = store.table("imports", lambda: _imports(inits.join(files.select("source_key", "path", "text"), ["source_key", "path"])))
    inner = F.concat_ws(".", "source_module", "source_name")
    known = inits.select("source_key", F.col("module").alias("target"), F.lit(True).alias("is_init"))
    imports = imports.withColumn("target", F.when(F.col("is_module"), F.col("source_module")).otherwise(inner)).join(known, ["source_key", "target"], "left")
    reached = _reached(store, inits, imports.filter("is_init"))
    asked = reached.withColumnRenamed("module", "init_module").join(imports.filter("not is_module and is_init is null"), ["source_key", "init_module"])
    asked = store.table("asked", lambda: asked.select("source_key", F.concat_ws(".", "prefix", "local_name").alias("public"), "local_name", F.col("source_module").alias("module"), "source_name", "level", "way", "ord"))

    # The file that defines a module: its __init__, a module or a stub.
    plain = files.filter(F.col("path").rlike("[.]pyi?$") & ~F.col("path").rlike("(^|/)__init__[.]pyi?$"))
    served = inits.withColumn("turn", F.lit(0)).unionByName(plain.select("source_key", module_of("path").alias("module"), "path", F.when(F.col("path").endswith(".py"), 1).otherwise(2).alias("turn")))
    served = served.groupBy("source_key", "module").agg(F.min_by("path", F.struct("turn", "path")).alias("path"))
    if outside is not None:
        missing = asked.select("source_key", "module").join(served, ["source_key", "module"], "left_anti").distinct()
        found = store.table("outside", lambda: outside(missing))
        served = served.unionByName(found.select("source_key", "module", "path"))
        parsed = parsed.unionByName(store.table("parsed-outside", lambda: _parsed(found)))
    top = parsed.filter(~F.col("symbol_type").endswith("method"))
    top = top.groupBy("source_key", "path", F.col("name").alias("source_name")).agg(F.min_by(F.struct(*COLUMNS), "at").alias("symbol"))
    hits = asked.join(served, ["source_key", "module"]).join(top, ["source_key", "path", "source_name"])
    turn = F.struct("level", "way", "ord", F.lit(0).alias("sub"))
    first = hits.groupBy("source_key", F.col("public").alias("name")).agg(F.min_by(F.struct(turn.alias("turn"), "path", "local_name", "symbol"), turn).alias("hit"))
    leaves = store.table("leaves", lambda: first.select("source_key", "name", "hit.*"))

    # Direct members of the classes among them.
    classes = leaves.filter("symbol.symbol_type = 'class'").select("source_key", "path", F.col("symbol.qualified_name").alias("class_name"), F.col("name").alias("owner"), "turn")
    inside = parsed.withColumn("class_name", parent("qualified_name")).withColumn("local", F.struct(*COLUMNS))
    inside = inside.groupBy("source_key", "path", "class_name", "name").agg(F.min_by("local", "at").alias("symbol"), F.min("at").alias("at"))
    members = classes.join(inside, ["source_key", "path", "class_name"]).select(
        "source_key", F.concat_ws(".", "owner", "name").alias("name"), "owner", F.col("name").alias("local_name"), "symbol", F.struct("turn.level", "turn.way", "turn.ord", (F.col("at") + 1).alias("sub")).alias("turn")
    )
    members = store.table("members", lambda: members)
    clashes = members.select("source_key", "name", "owner", F.col("turn").alias("before")).join(leaves.select("source_key", "name", "turn"), ["source_key", "name"]).filter("before < turn")
    gone = _suppressed(store, store.table("clashes", lambda: clashes.select("source_key", "name", "owner")))
    leaves = leaves.join(gone, ["source_key", "name"], "left_anti")
    members = members.join(gone.withColumnRenamed("name", "owner"), ["source_key", "owner"], "left_anti").join(leaves, ["source_key", "name"], "left_anti")
    shown = ["source_key", "name", "local_name", "symbol", "turn"]
    every = leaves.select(*shown).unionByName(members.select(*shown))
    own = {"name": F.col("local_name").alias("name"), "qualified_name": F.col("name").alias("qualified_name")}
    return every.select("source_key", *[own.get(c, F.col(f"symbol.{c}")) for c in COLUMNS], "turn.*")


def symbols(files: DataFrame, outside: Outside | None = None, projects: bool = False) -> DataFrame:
    """Symbols of every source whose files are rows (source_key, path, text and, if known, base): those of its modules, then, of packages, those under re-exported names that its modules don't have; numbered by seq in each source.

    A package's paths are relative to the folder that holds it, a project's to its own folder; a project's
    own ``__init__`` is left out and nothing is re-exported. ``outside`` finds the modules that a package
    imports from beside itself: of (source_key, module) it gives those there are, with path, file_path and
    text. Files that do not parse have no symbols.
    """
    store = scratch(files.sparkSession, "python")
    base = F.coalesce("base", F.lit("")) if "base" in files.columns else F.lit("")
    files = files.select("source_key", "path", F.concat(base, "path").alias("file_path"), F.coalesce("text", F.lit("")).alias("text"), module_of("path").alias("module"))
    if projects:
        kept = walked(files.withColumn("path", F.concat(F.lit("./"), "path"))).withColumn("path", F.substring("path", 3, 1 << 30))
        files = files.filter("module <> ''")
    else:
        kept = walked(files)
    files = store.table("files", lambda: files)
    parsed = store.table("parsed", lambda: _parsed(files.filter(F.col("path").rlike("[.]pyi?$"))))
    own = parsed.join(kept, ["source_key", "path"], "left_semi")
    order = {"phase": F.lit(0), "level": F.lit(0), "way": F.array().cast("array<int>"), "ord": F.lit(0), "sub": F.col("at")}
    rows = own.select("source_key", *COLUMNS, "path", *[c.alias(n) for n, c in order.items()])
    if not projects:
        again = _public(store, files, parsed, outside).join(own.select("source_key", "qualified_name"), ["source_key", "qualified_name"], "left_anti")
        rows = rows.unionByName(again.withColumns({"phase": F.lit(1), "path": F.lit("")}))
    found = placed(rows, ["source_key"], ["phase", "path", "level", "way", "ord", "sub", "qualified_name"], "seq")
    return found.select(*COLUMNS, "source_key", (F.col("seq") - 1).alias("seq"))
