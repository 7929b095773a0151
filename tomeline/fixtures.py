"""The catalogue projected from the driver's tables, and its SQL for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .functions.columns import by_name, parent_key
from .operators import lookup
from .operators.fts import Index
from .operators.maintain import last_sorted
from .plans.store import Store, fingerprint, shared_dir, snapshot

TABLES = ("region", "nation", "customer", "supplier", "part", "documents")

# Rows come from one table each (src) under its key (k); id is made of both, so no row needs the others
# to be numbered. Later rows replace earlier ones of the same qualified name.
RAW = """
nat as (
  select n.n_nationkey, n.n_name, replace(r.r_name, ' ', '_') as rn
  from nation n join region r on n.n_regionkey = r.r_regionkey),
rows_by_table as (
  select 0 as src, cast(r_regionkey as bigint) as k, replace(r_name, ' ', '_') as name, concat('geo.', replace(r_name, ' ', '_')) as qualified_name,
         'module' as symbol_type, cast(null as varchar(4000)) as signature, cast(null as varchar(4000)) as docstring, cast(null as varchar(4000)) as base
  from region
  union all
  select 1, cast(n_nationkey as bigint), n_name, concat('geo.', rn, '.', n_name), 'class',
         case when n_nationkey > 0 then concat('(NATION_', cast(cast(floor(n_nationkey / 2) as int) as varchar(20)), ')') end, null,
         case when n_nationkey > 0 then concat('NATION_', cast(cast(floor(n_nationkey / 2) as int) as varchar(20))) end
  from nat
  union all
  select 2, c_custkey, replace(c_name, '#', '_'), concat('geo.', rn, '.', n_name, '.', replace(c_name, '#', '_')), 'method', concat('(self, segment: ', c_mktsegment, ')'), null, null
  from customer join nat on c_nationkey = n_nationkey
  union all
  select 3, s_suppkey, replace(s_name, '#', '_'), concat('geo.', rn, '.', n_name, '.', replace(s_name, '#', '_')), 'async_method', '(self)', null, null
  from supplier join nat on s_nationkey = n_nationkey
  union all
  select 4, min(p_partkey), replace(p_brand, '#', '_'), concat('catalog.', replace(p_brand, '#', '_')), 'class', null, null, null
  from part group by p_brand
  union all
  select 5, p_partkey, replace(p_name, ' ', '_'), concat('catalog.', replace(p_brand, '#', '_'), '.', replace(p_name, ' ', '_')), 'method',
         concat('(self, size: int = ', cast(p_size as varchar(20)), ') -> ', p_type), null, null
  from part
  union all
  select 6, doc_id, doc_name, concat('docs.', lang, '.', source, '.', doc_name), 'function', concat('(n: int = ', cast(n_chars as varchar(20)), ')'), text, null
  from (select *, case doc_id % 10 when 5 then concat('__doc_', cast(doc_id as varchar(20)), '__') when 7 then concat('_doc_', cast(doc_id as varchar(20))) else concat('doc_', cast(doc_id as varchar(20))) end as doc_name from documents) d),
raw as (select src * 1000000000000 + k as id, src, name, qualified_name, symbol_type, signature, docstring, base from rows_by_table)
"""

#: The catalogue as a CTE of DuckDB queries.
CTE = (
    "with"
    + RAW
    + """,
ranked as (select *, row_number() over (partition by qualified_name order by id desc) as rk from raw),
symbols as (select id, src, name, qualified_name, symbol_type, signature, docstring, base from ranked where rk = 1)
"""
)


def raw_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, before later ones replace earlier ones."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    sql = "with" + RAW + "select * from raw"
    for t in TABLES:
        for word in ("from", "join"):
            sql = sql.replace(f"{word} {t} ", f"{word} {{{t}}} ").replace(f"{word} {t}\n", f"{word} {{{t}}}\n").replace(f"{word} {t})", f"{word} {{{t}}})")
    return spark.sql(sql, **tables)


_stores: dict[tuple[str, str], Store] = {}


def store(spark: SparkSession, sf_dir: str) -> Store:
    """Where this application keeps the catalogue of these tables; tables that change get another."""
    key = (spark.sparkContext.applicationId, fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in TABLES]))
    if key not in _stores:
        _stores[key] = Store(spark, f"{shared_dir(spark)}/catalog-{'-'.join(key)}").temporary()
    return _stores[key]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each qualified name: id, src, name, qualified_name, symbol_type, signature, docstring, base; from the stored snapshot, which the first query writes."""
    return snapshot(store(spark, sf_dir), lambda: last_sorted(raw_symbols(spark, sf_dir), *by_name()))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue sorted by parent and qualified name, with the parent's folded name; written by the first query that asks for it."""
    rows = lambda: catalog(spark, sf_dir).withColumn("parent_key", parent_key("qualified_name"))
    return store(spark, sf_dir).table("tree", rows, "parent_key", "qualified_name")


def grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index of the letters of names and signatures, sorted by gram."""
    return store(spark, sf_dir).table("grams", lambda: lookup.grams(catalog(spark, sf_dir)), "gram", "id")


def index(spark: SparkSession, sf_dir: str, stemmed: bool) -> Index:
    """The stored full-text index of the snapshot."""
    return store(spark, sf_dir).index(catalog(spark, sf_dir), stemmed)
