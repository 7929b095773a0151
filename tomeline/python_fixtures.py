"""Python source trees derived from the driver's documents, and SQL for what they hold.

A language is a package, a source (by thousands of ids, so that no folder grows without end) a package in it,
and each document a module, whose text follows from its id. Some modules lie in a private folder, some are stubs, some do not parse. ``__init__`` files re-export
classes, under other names, and functions, those of private modules too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Parameters of the functions that ``signatures`` looks at, by doc_id % 6, as written and as shown.
HEADS = [
    ("()", "()"),
    ("(a, b=1)", "(a, b = 1)"),
    ("(a, /, b: int=2, *c, d, e=3, **f) -> None", "(a, /, b: int = 2, *c, d, e = 3, **f) -> None"),
    ("(*, k: str='x')", "(*, k: str = 'x')"),
    ("(self, x: list[int] | None=None)", "(self, x: list[int] | None = None)"),
    ("(p, q=5, /)", "(p, q, /)"),
]

_MODULE = """class C%1$s(Base, mod.Other[K, V]):
    'About %1$s.'
    def run(self, a: int, /, b: str = "x", *, c=%2$s, **kw) -> bool: ...
    async def stop(self, *args: int): ...
    def _hidden(self): ...
    class Part:
        def turn(self): ...
def f%1$s(a, b=%2$s):
    def inner(): ...
class _P%1$s:
    def lost(self): ...
"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.concat_ws("_", "source", F.floor(F.col("doc_id") / 1000).cast("string")).alias("source"))
    sub = F.when(F.col("doc_id") % 7 == 3, "_hid").otherwise(F.col("source"))
    return docs.withColumns({"package": F.concat(F.lit("p_"), "lang"), "sub": sub, "module": F.concat(F.lit("m"), F.col("doc_id").cast("string")), "parses": F.col("doc_id") % 13 != 12})


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_key, path, text, doc_id) of each document's module."""
    docs = _documents(spark, sf_dir)
    body = F.format_string(_MODULE, F.col("doc_id").cast("string"), (F.col("doc_id") % 5).cast("string"))
    text = F.when(~F.col("parses"), F.lit("def (:\n")).otherwise(F.concat(F.when(F.col("doc_id") % 4 == 0, F.lit("'''Text.'''\n")).otherwise(F.lit("")), body))
    path = F.concat_ws("/", "package", "sub", F.concat("module", F.when(F.col("doc_id") % 10 == 9, ".pyi").otherwise(".py")))
    return docs.select(F.col("package").alias("source_key"), path.alias("path"), text.alias("text"), "doc_id")


def inits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_key, path, text) of the ``__init__`` files, their lines in order."""
    docs = _documents(spark, sf_dir)
    line = F.format_string("from .%s%s import C%s as K%s, f%s\n", F.when(F.col("sub") == "_hid", "._hid.").otherwise(""), "module", *[F.col("doc_id").cast("string")] * 3)
    lines = docs.withColumn("line", F.when(F.col("doc_id") % 3 == 0, line))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "").alias("text")
    inner = lines.groupBy("package", "source").agg(joined("line")).select(F.col("package").alias("source_key"), F.concat_ws("/", "package", "source", F.lit("__init__.py")).alias("path"), "text")
    outer = docs.groupBy("package").agg(joined(F.concat(F.lit("from . import "), "source", F.lit("\n"))))
    return inner.unionByName(outer.select(F.col("package").alias("source_key"), F.concat_ws("/", "package", F.lit("__init__.py")).alias("path"), "text"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules(spark, sf_dir).drop("doc_id").unionByName(inits(spark, sf_dir))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as project folders: a project for each language, paths relative to it."""
    return files(spark, sf_dir).select(F.concat(F.lit("project:/"), "source_key").alias("source_key"), F.substring_index("path", "/", -2).alias("path"), "text").filter("path not like 'p!_%' escape '!'")


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_key, path, text): a function for each document, one file a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    head = F.element_at(F.array(*[F.lit(h) for h, _ in HEADS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return docs.select(F.lit("m").alias("source_key"), F.concat(F.lit("m/f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("def f"), F.col("doc_id").cast("string"), head, F.lit(": ...\n")).alias("text"))


# What each module defines: name below it, type, signature, line after its class line, return annotation.
_DEFINED = """(values ('', 'module', null, 0, null), ('.C%', 'class', '(Base, mod.Other[K, V])', 0, null), ('.C%.run', 'method', '(self, a: int, /, b: str = ''x'', *, c = #, **kw) -> bool', 2, 'bool'),
  ('.C%.stop', 'async_method', '(self, *args: int)', 3, null), ('.C%.Part', 'class', null, 5, null), ('.C%.Part.turn', 'method', '(self)', 6, null), ('.f%', 'function', '(a, b = #)', 7, null)) t(below, symbol_type, signature, shift, return_annotation)"""

#: SQL of the derived trees: ``docs``, ``own`` (symbols of modules) and ``again`` (re-exported ones).
CTE = f"""
with docs as (select doc_id, cast(doc_id as varchar) as d, concat('p_', lang) as package, concat(source, '_', cast(doc_id // 1000 as varchar)) as source, case when doc_id % 7 = 3 then '_hid' else concat(source, '_', cast(doc_id // 1000 as varchar)) end as sub, case when doc_id % 4 = 0 then 1 else 0 end as titled, doc_id % 13 <> 12 as parses from documents),
defined as (select docs.*, t.below, t.symbol_type, replace(t.signature, '#', cast(doc_id % 5 as varchar)) as signature, case when t.below = '' then 1 else 1 + titled + t.shift end as line_no, t.return_annotation from docs cross join {_DEFINED} where parses and (t.below <> '' or titled = 1)),
own as (select package, sub, concat(package, '.', sub, '.m', d, replace(below, '%', d)) as qualified_name, symbol_type, signature, line_no, return_annotation from defined),
again as (select concat(package, '.', source, case when starts_with(below, '.C') then concat('.K', d, substr(below, 4)) else concat('.f', d) end) as qualified_name, symbol_type, signature, line_no, return_annotation
  from defined where doc_id % 3 = 0 and below not in ('', '.C%.Part.turn'))
"""

#: SQL of the import statements: each line imports a class and a function.
IMPORTS = """
, lines as (select package, source, d, concat('from .', case when sub = '_hid' then '._hid.' else '' end, 'm', d, ' import C', d, ' as K', d, ', f', d, chr(10)) as line,
    concat(package, '.', sub, '.m', d) as module from docs where doc_id % 3 = 0),
placed as (select *, row_number() over (partition by package, source order by line) - 1 as nr from lines)
select concat(package, '.', source) as init_module, cast(2 * nr + k as int) as ord, concat(case k when 0 then 'K' else 'f' end, d) as local_name, module as source_module, concat(case k when 0 then 'C' else 'f' end, d) as source_name, false as is_module
from placed cross join (values (0), (1)) v(k)
union all
select package, cast(row_number() over (partition by package order by source) - 1 as int), source, package, source, false from (select distinct package, concat(source, chr(10)) as line, source from docs) s
"""
