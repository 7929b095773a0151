"""Every operator of the catalogue as a query over the driver's tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import python_fixtures
from .fixtures import CTE, catalog, grams, index, raw_symbols, tree
from .functions.columns import absolute_module, depth, like, parent, sanitized, sort_key, type_rank, valid_query, visibility
from .operators import format as fmt
from .operators import fts, fuzzy, lookup, maintain, navigate, rank, stats
from .plans import cascade
from .plans.store import placed
from .sources import listing, python_tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SHOWN = ["id", "name", "qualified_name", "symbol_type"]
_TYPE_RANK = "case symbol_type when 'module' then 0 when 'class' then 1 when 'function' then 2 when 'async_function' then 2 when 'method' then 3 when 'async_method' then 3 else 4 end"
_VISIBLE = "case when starts_with(name, '__') then 1 when starts_with(name, '_') then 2 else 0 end"
_ORDER = f"{_TYPE_RANK}, {_VISIBLE}, name, id"
_CHOICE = "case symbol_type when 'class' then 0 when 'module' then 1 else 2 end, id"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PARENT = "regexp_replace(qualified_name, '[.][^.]*$', '')"
_DEPTH = "(length(qualified_name) - length(replace(qualified_name, '.', '')))"


def _query(oracle: str | None = None, cte: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = (CTE + oracle) if cte else oracle
        return f

    return add


def _like(column: str, pattern: str) -> str:
    return f"{_FOLD.format(column)} like '{pattern.lower()}'"


# -- filters and projections -------------------------------------------------------------------------


@_query("select id, name, qualified_name, symbol_type from symbols where name = 'NATION_7' order by id limit 50")
def exact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.exact_name(catalog(spark, sf_dir), "NATION_7", 50).select(_SHOWN)


@_query("select id, name, qualified_name, symbol_type from symbols where qualified_name = 'geo.ASIA'")
def get_symbol_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.by_key(tree(spark, sf_dir), "geo.ASIA").select(_SHOWN)


@_query(f"select id, name, qualified_name, symbol_type from symbols where {_FOLD.format('name')} = 'nation_7'")
def nocase_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.any_case(catalog(spark, sf_dir), "nation_7").select(_SHOWN)


@_query("select id, name, qualified_name, symbol_type from symbols where symbol_type = 'class'")
def type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.of_type(catalog(spark, sf_dir), "class").select(_SHOWN)


_TERMS = " and ".join(f"({_like('name', p)} or {_like('qualified_name', p)} or {_like('signature', p)})" for p in ("%segm_nt%", "%NATION_1%"))


@_query(f"select id, name, qualified_name, symbol_type from symbols where {_TERMS} order by name, id limit 200")
def like_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.containing(catalog(spark, sf_dir), "segm_nt NATION_1", index=grams(spark, sf_dir)).select(_SHOWN)


_BELOW_ASIA = f"{_like('qualified_name', 'geo.asia.%')} and not {_like('qualified_name', 'geo.asia.%.%')}"


@_query(f"select *, row_number() over (order by {_ORDER}) as rank from (select id, name, qualified_name, symbol_type from symbols where {_BELOW_ASIA} order by name, id limit 200) order by rank limit 50")
def namespace_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.numbered(lookup.browse(tree(spark, sf_dir), "geo.ASIA", 50).select(_SHOWN), *sort_key(), "id")


@_query(f"select id, name, qualified_name, symbol_type, row_number() over (order by {_ORDER}) as rank from symbols where {_like('qualified_name', 'catalog.brand_11.%')} and not {_like('qualified_name', 'catalog.brand_11.%.%')}")
def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(lookup.children(tree(spark, sf_dir), "catalog.Brand_11").select(_SHOWN), [], [*sort_key(), "id"], "rank")


@_query(f"select id, name, qualified_name, symbol_type from (select * from symbols where {_like('name', '%nation_1%')} order by name, id limit 200) where name <> 'NATION_1'")
def stage_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = catalog(spark, sf_dir)
    found = symbols.filter(F.expr("translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%nation_1%'")).orderBy("name", "id").limit(200)
    return lookup.unseen(found, lookup.exact_name(symbols, "NATION_1", 50)).select(_SHOWN)


@_query(f"select id, {_DEPTH} as depth, {_PARENT} as parent_qname from symbols")
def depth_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("id", depth("qualified_name").cast("long").alias("depth"), parent("qualified_name").alias("parent_qname"))


_SPACED = """translate(raw_query, '+-@^"(){}:!|&~<>_.', repeat(' ', 18))"""


@_query(
    f"select id, raw_query, array_to_string(list_transform(list_filter(regexp_split_to_array({_SPACED}, '\\s+'), lambda x: x <> ''), lambda x: concat(x, '*')), ' ') as fts_query "
    "from (select id, concat(name, coalesce(signature, '')) as raw_query from symbols)"
)
def sanitize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = catalog(spark, sf_dir).select("id", F.concat("name", F.coalesce("signature", F.lit(""))).alias("raw_query"))
    return raw.select("id", "raw_query", sanitized("raw_query").alias("fts_query"))


# -- order and counts --------------------------------------------------------------------------------


@_query(f"select id, {_TYPE_RANK} as type_rank, {_VISIBLE} as visibility, row_number() over (partition by src order by {_ORDER}) as place from symbols")
def symbol_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).select("id", "src", "name", type_rank("symbol_type").alias("type_rank"), visibility("name").alias("visibility"))
    return placed(rows, ["src"], ["type_rank", "visibility", "name", "id"]).select("id", "type_rank", "visibility", "place")


@_query(f"select * , row_number() over (order by {_ORDER}) as rank from (select id, name, qualified_name, symbol_type from symbols where {_like('qualified_name', '%nation_1%')} order by name, id limit 200) order by rank limit 20")
def overfetch_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).filter(like("qualified_name", "%nation_1%"))
    return rank.numbered(rank.refetched(rows, ["name", "id"], 200, 20).select(_SHOWN), *sort_key(), "id")


@_query(f"select qualified_name from symbols where name = 'NATION_7' order by {_CHOICE} limit 1")
def resolve_short_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.resolve(catalog(spark, sf_dir), ["NATION_7"]).select("qualified_name")


@_query("select count(*) as n_symbols, count(distinct name) as n_names from symbols")
def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(catalog(spark, sf_dir))


@_query("select symbol_type, count(*) as n_symbols from symbols group by symbol_type")
def stats_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_type(catalog(spark, sf_dir))


@_query("select cast(src as varchar) as source_key, count(*) as symbol_count from raw group by src")
def package_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.package_counts(raw_symbols(spark, sf_dir).withColumn("source_key", F.col("src").cast("string")))


@_query("select name, min(id) as first_id from symbols where symbol_type = 'method' group by name")
def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.candidates(catalog(spark, sf_dir), "method")


# -- upkeep ------------------------------------------------------------------------------------------


@_query("select id, name, qualified_name, symbol_type, signature from symbols")
def upsert_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.last_writer(raw_symbols(spark, sf_dir), "qualified_name", "id").select(*_SHOWN, "signature")


@_query("select id, name, qualified_name, symbol_type from symbols where src <> 5")
def delete_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog(spark, sf_dir).withColumn("source_key", F.col("src").cast("string"))
    return maintain.delete_source(rows, "5").select(_SHOWN)


# Two snapshots of suppliers as sources: the indexed one lacks every seventh, the one on disk every fifth, and every third has changed.
_INDEXED = "select s_name as name, concat('/p/', s_name) as source_path, s_acctbal as mtime from supplier where s_suppkey % 7 <> 0"
_DISK = "select s_name as name, concat('/p/', s_name) as source_path, case when s_suppkey % 3 = 0 then s_acctbal + 1 else s_acctbal end as mtime from supplier where s_suppkey % 5 <> 0"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return tuple(spark.sql(q.replace("from supplier", "from {supplier}"), supplier=suppliers) for q in (_DISK, _INDEXED))


_CHANGES = (
    f"select coalesce(d.name, k.name) as name, case when d.name is null then 'removed' when k.name is null then 'new' when d.mtime <> k.mtime then 'changed' else 'unchanged' end as action "
    f"from ({_DISK}) d full outer join ({_INDEXED}) k on d.name = k.name"
)


@_query(_CHANGES, cte=False)
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.changes(*_snapshots(spark, sf_dir))


@_query(f"select max(case when action <> 'unchanged' then 1 else 0 end) as stale from ({_CHANGES})", cte=False)
def is_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.is_stale(*_snapshots(spark, sf_dir))


@_query(f"select name from ({_INDEXED}) where source_path not in (select source_path from ({_DISK}))", cte=False)
def clean_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk, known = _snapshots(spark, sf_dir)
    return maintain.dead(known, disk)


# -- navigation --------------------------------------------------------------------------------------

# A name for each turn of the resolution, and some that fail.
_NAMES = ["geo.ASIA", "NATION_7", "nation_3", "geo.NATION_7", "geo.asia", "docs.doc_1", "catalog.Brand_11", "NATION_24.Customer", "region.NATION_1", "missing", "ASIA.NATION_8", "ASIA.nothing"]
_ASKED = ", ".join(f"('{n}')" for n in _NAMES)


def _glob(wanted: str, gap: int) -> str:
    """Oracle of the unambiguous prefix search over (query, prefix, name)."""
    level = "(length(prefix) - length(replace(prefix, '.', '')) + 1)"
    return (
        f"(with met as (select w.query, s.id, s.qualified_name, {_DEPTH} as level, {_PARENT} as parent from symbols s join ({wanted}) w on s.name = w.name "
        f"where {_FOLD.format('s.qualified_name')} like concat({_FOLD.format('w.prefix')}, '.%') and (s.symbol_type in ('class', 'module') or {_DEPTH} - {level} <= {gap})), "
        "tops as (select query, count(distinct parent) as parents, min(level) as top from met group by query), "
        "shallow as (select m.query, count(distinct m.parent) as parents from met m join tops t on m.query = t.query and m.level = t.top group by m.query), "
        "fit as (select m.*, row_number() over (partition by m.query order by length(m.qualified_name), m.id) as rn from met m join tops t on m.query = t.query join shallow s on s.query = m.query "
        "where t.parents = 1 or (s.parents = 1 and m.level = t.top)) select query, qualified_name from fit where rn = 1)"
    )


_DIRECT = (
    "(select query, qualified_name from (select q.query, s.qualified_name, row_number() over (partition by q.query order by case when s.qualified_name = q.query then 1 when s.name = q.query then 2 else 3 end, "
    f"case when s.qualified_name = q.query then 0 else case s.symbol_type when 'class' then 0 when 'module' then 1 else 2 end end, s.id) as rn from symbols s join every q "
    f"on s.qualified_name = q.query or s.name = q.query or {_FOLD.format('s.name')} = {_FOLD.format('q.query')}) where rn = 1)"
)
_WANTED = "select query, regexp_replace(query, '[.][^.]*$', '') as prefix, regexp_extract(query, '([^.]*)$', 1) as name from every where contains(query, '.')"
_RESOLVED = f"""
, asked(query) as (values {_ASKED}),
every as (select query from asked union select regexp_replace(query, '[.][^.]*$', '') from asked),
direct as (select * from {_DIRECT}),
globbed as (select * from {_glob(_WANTED, 1)} g where query not in (select query from direct)),
done as (select * from direct union all select * from globbed),
chained as (select w.query, w.name, d.qualified_name as prefix from ({_WANTED}) w join done d on d.query = w.prefix where w.query not in (select query from done)),
resolved as (select * from done union all select * from {_glob('select * from chained', 0)} c)
select a.query, r.qualified_name from asked a join resolved r on r.query = a.query
"""


@_query(_RESOLVED)
def resolve_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.resolve(catalog(spark, sf_dir), _NAMES).select("query", "qualified_name")


@_query(_RESOLVED.replace("select a.query, r.qualified_name from asked a join resolved r on r.query = a.query", "select r.query, s.id, s.qualified_name, s.symbol_type, s.signature from asked a join resolved r on r.query = a.query join symbols s on s.qualified_name = r.qualified_name"))
def get_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = catalog(spark, sf_dir)
    return navigate.resolve(symbols, _NAMES).select("query", "qualified_name").join(symbols, "qualified_name").select("query", "id", "qualified_name", "symbol_type", "signature")


_PREFIXED = "select concat('docs.', name) as query, 'docs' as prefix, name from symbols where src = 6 union all select concat('catalog.', name), 'catalog', name from (select distinct name from symbols where src = 5) union all select concat('geo.', name), 'geo', name from symbols where src in (1, 2)"


@_query(f", every as (select 1 as unused) select query, qualified_name from {_glob(_PREFIXED, 1)} g")
def prefix_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = catalog(spark, sf_dir)
    wanted = spark.sql(_PREFIXED.replace("from symbols", "from {symbols}"), symbols=symbols.select("src", "name"))
    return navigate.unambiguous(symbols, wanted, 1)


# The names of the other sources too: regions, suppliers and brands.
_PREFIXED_ALL = _PREFIXED + " union all select concat('geo.', name), 'geo', name from symbols where src in (0, 3) union all select concat('catalog.', name), 'catalog', name from symbols where src = 4"


@_query(f", every as (select 1 as unused) select query, qualified_name from {_glob(_PREFIXED_ALL, 1)} g")
def prefix_glob_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prefix_glob for the names of every source."""
    symbols = catalog(spark, sf_dir)
    wanted = spark.sql(_PREFIXED_ALL.replace("from symbols", "from {symbols}"), symbols=symbols.select("src", "name"))
    return navigate.unambiguous(symbols, wanted, 1)


def _with_bases(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("bases", F.when(F.col("base").isNull(), F.array().cast("array<string>")).otherwise(F.array("base")))


_UP = """, recursive_start as (select 1), up as (
  with recursive r(class_name, level) as (
    select base, 1 from symbols where name = 'NATION_24' and symbol_type = 'class' and base is not null
    union select s.base, r.level + 1 from r join symbols s on s.name = r.class_name and s.symbol_type = 'class' and s.base is not null where r.level <= (select count(*) from symbols where symbol_type = 'class'))
  select class_name, min(level) as level from r group by class_name)
"""


@_query(_UP + "select class_name, level from up")
def mro_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = catalog(spark, sf_dir).filter("symbol_type = 'class' and base is not null").select(F.col("name").alias("class_name"), F.col("base").alias("base_name"))
    return navigate.closure(edges, "NATION_24")


_INHERITED = (
    f"select id, qualified_name, turn from (select id, qualified_name, 0 as turn, qualified_name as within from symbols where {_like('name', '%customer%')} and {_like('qualified_name', '%nation_24.customer%')} "
    f"union all select s.id, s.qualified_name, u.level, '' from symbols s join up u on {_FOLD.format('s.qualified_name')} like concat('%.', {_FOLD.format('u.class_name')}, '.customer%') where {_like('s.name', '%customer%')}) order by turn, within, id limit 50"
)


@_query(_UP + _INHERITED)
def inheritance_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return navigate.inherited(_with_bases(catalog(spark, sf_dir)), "NATION_24.Customer", 50).select("id", "qualified_name", "turn")


@_query(
    f"select a.id, a.qualified_name from (select *, count(*) over () as n from (select * from symbols s where {_like('s.qualified_name', 'geo.%.nation_7%')} and not exists "
    f"(select 1 from symbols o where {_like('o.qualified_name', 'geo.%.nation_7%')} and starts_with(s.qualified_name, concat(o.qualified_name, '.'))))) a where n = 1"
)
def unique_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.unique_exact(catalog(spark, sf_dir).filter(like("qualified_name", "geo.%.nation_7%"))).select("id", "qualified_name")


# -- full text ---------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_POSTINGS = ", postings as (select id, col, term, count(*) as tf from (" + " union all ".join(f"select id, '{c}' as col, unnest({_TOKENS.format(c)}) as term from symbols" for c in fts.COLUMNS) + ") group by id, col, term)"


@_query(f"select id, len({_TOKENS.format('docstring')}) as n_tokens, len(list_distinct({_TOKENS.format('docstring')})) as n_terms from symbols")
def fts_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fts.tokens(F.coalesce("docstring", F.lit("")), fold=False)
    return catalog(spark, sf_dir).select("id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


@_query(_POSTINGS + " select id, col, term, tf from postings")
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, stemmed=False).postings


def _bm25(first: str, second: str, columns: str) -> str:
    return (
        _POSTINGS + ", dl as (select s.id, coalesce(sum(p.tf), 0) as dl from symbols s left join postings p on p.id = s.id group by s.id), tot as (select count(*) as n, avg(dl) as avgdl from dl), "
        f"hits as (select id, 0 as t, cast(sum(tf) as double) as f from postings where starts_with(term, '{first}') and col in ({columns}) group by id union all "
        f"select id, 1, cast(sum(tf) as double) from postings where starts_with(term, '{second}') group by id), ni as (select t, cast(count(*) as double) as ni from hits group by t), "
        "parts as (select h.id, case when ln((n - ni + cast(0.5 as double)) / (ni + cast(0.5 as double))) <= 0 then cast(0.000001 as double) else ln((n - ni + cast(0.5 as double)) / (ni + cast(0.5 as double))) end "
        "* (f * cast(2.2 as double) / (f + cast(1.2 as double) * (cast(1.0 as double) - cast(0.75 as double) + cast(0.75 as double) * dl.dl / avgdl))) as part from hits h join ni on ni.t = h.t join dl on dl.id = h.id cross join tot), "
        "scored as (select id, -sum(part) as score from parts group by id having count(*) = 2) "
        "select s.id, s.qualified_name, round(score, 6) as score, row_number() over (order by round(score, 12), s.id) as rank from scored c join symbols s on s.id = c.id order by rank limit 200"
    )


def _searched(spark: SparkSession, sf_dir: str, query: str, columns: tuple[str, ...]) -> DataFrame:
    found = fts.search(catalog(spark, sf_dir), index(spark, sf_dir, stemmed=False), query, columns)
    found = rank.numbered(found, F.round("score", 12), "id")
    return found.select("id", "qualified_name", F.round("score", 6).alias("score"), "rank")


@_query(_bm25("customer", "nation", "'name', 'qualified_name'"))
def fts_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "customer nation", ("name", "qualified_name"))


@_query(_bm25("licen", "und", "'docstring'"))
def fts_docstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "Licen und", ("docstring",))


@_query(_bm25("doc", "th", "'name', 'qualified_name'"))
def fts_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, sf_dir, "doc_th", ("name", "qualified_name"))


@_query(
    f"select id, len(terms) > 0 and len(list_filter(terms, lambda x: not regexp_full_match(x, '[A-Za-z0-9_\\x{{80}}-\\x{{10ffff}}]+') or x in ('AND', 'OR', 'NOT'))) = 0 as valid "
    f"from (select id, list_filter(regexp_split_to_array({_SPACED}, '\\s+'), lambda x: x <> '') as terms from "
    "(select id, case id % 4 when 0 then concat(name, ' ', coalesce(signature, '')) when 1 then concat(name, case when id % 8 = 1 then ' NOT' else ' not' end) when 2 then concat(qualified_name, case when id % 3 = 0 then '/x' else ' + (é)' end) else case when id % 3 = 0 then ' ( ) ' else name end end as raw_query from symbols) q) t"
)
def fts_invalid_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether user input parses as a full-text query, for inputs made of every symbol."""
    asked = "case id % 4 when 0 then concat(name, ' ', coalesce(signature, '')) when 1 then concat(name, case when id % 8 = 1 then ' NOT' else ' not' end) when 2 then concat(qualified_name, case when id % 3 = 0 then '/x' else ' + (é)' end) else case when id % 3 = 0 then ' ( ) ' else name end end"
    return catalog(spark, sf_dir).select("id", F.expr(asked).alias("raw_query")).select("id", valid_query("raw_query").alias("valid"))


# Whatever begins with these stems has a stem that does, and the other way round, so plain prefixes find the same.
@_query(_bm25("releas", "licens", "'docstring'"))
def fts_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fts.search(catalog(spark, sf_dir), index(spark, sf_dir, stemmed=True), "released licensing", ("docstring",))
    return rank.numbered(found, F.round("score", 12), "id").select("id", "qualified_name", F.round("score", 6).alias("score"), "rank")


# -- fuzzy -------------------------------------------------------------------------------------------

_TYPO = "NATON_7"


def _lcs_table(query: str) -> str:
    """(name, lcs) by a recursion over the characters of the names; a row holds one line of the table."""
    line = f"list_reduce(range(1, {len(query)} + 1), lambda r, j: list_append(r, case when substr('{query}', j, 1) = substr(name, i + 1, 1) then line[j] + 1 else greatest(line[j + 1], r[j]) end), [0::bigint])"
    return (
        f", walk as (with recursive w(name, i, line) as (select name, 0, [0::bigint for x in range({len(query)} + 1)] from (select distinct name from symbols) "
        f"union all select name, i + 1, {line} from w where i < length(name)) select name, line[{len(query)} + 1] as lcs from w where i = length(name))"
    )


@_query(_lcs_table(_TYPO) + f" select name, lcs, 200.0::double * lcs / (length(name) + {len(_TYPO)}) as ratio from walk where 200 * lcs >= 60 * (length(name) + {len(_TYPO)})")
def fuzzy_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.scored(fuzzy.candidates(catalog(spark, sf_dir)), _TYPO).select("name", F.col("lcs").cast("long").alias("lcs"), "ratio")


@_query(
    _lcs_table("Suplier_000000001")
    + ", best as (select name, 200.0::double * lcs / (length(name) + 17) as ratio, row_number() over (order by 200.0::double * lcs / (length(name) + 17) desc, name) as nr from walk where 200 * lcs >= 60 * (length(name) + 17)) "
    "select s.id, s.name, s.qualified_name, b.ratio from symbols s join best b on b.name = s.name where b.nr <= 10 order by b.nr, s.id limit 10"
)
def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.search(catalog(spark, sf_dir), "Suplier_000000001", 10).select("id", "name", "qualified_name", "ratio")


# -- search ------------------------------------------------------------------------------------------


#: Words of texts begin with it, and names of parts are like it, but no name holds it.
_NEAR = "blend"


def _cascade(spark: SparkSession, sf_dir: str, query: str, limit: int = 20, stemmed: bool = False) -> DataFrame:
    symbols = _with_bases(catalog(spark, sf_dir))
    # What no stage looks into is not built.
    return cascade.search(symbols, lambda: index(spark, sf_dir, stemmed), query, limit, grams=lambda: grams(spark, sf_dir)).select("id", "qualified_name", "symbol_type", "stage", "tier", "rank")


@_query(
    "select id, qualified_name, symbol_type, 'pattern' as stage, 'fts' as tier, row_number() over (order by " + _ORDER + ") as rank from "
    f"(select * from symbols where {_like('name', '%=%')} or {_like('qualified_name', '%=%')} or {_like('signature', '%=%')} order by name, id limit 200) order by rank limit 20"
)
def search_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir, "=")


@_query(f"select id, qualified_name, symbol_type, 'namespace' as stage, 'fts' as tier, row_number() over (order by {_ORDER}) as rank from (select * from symbols where {_like('qualified_name', 'geo.as_a.%')} and not {_like('qualified_name', 'geo.as_a.%.%')} order by name, id limit 200) order by rank limit 20")
def search_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir, "geo.AS_A")


@_query("select id, qualified_name, symbol_type, 'resolved' as stage, 'fts' as tier, 1::bigint as rank from symbols where name = 'NATION_7' and symbol_type = 'class'")
def search_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir, "geo.NATION_7")


def _best(tag: str, terms: list[str], columns: str) -> str:
    """best_<tag>: the ids of the 200 best symbols for prefixes, the first of them in some columns."""
    hits = " union all ".join(
        f"select id, {i} as t, cast(sum(tf) as double) as f from postings where starts_with(term, '{p}')" + ("" if i else f" and col in ({columns})") + " group by id" for i, p in enumerate(terms)
    )
    weight = "ln((n - ni + cast(0.5 as double)) / (ni + cast(0.5 as double)))"
    return (
        f", hits_{tag} as ({hits}), ni_{tag} as (select t, cast(count(*) as double) as ni from hits_{tag} group by t), "
        f"best_{tag} as (select h.id from hits_{tag} h join ni_{tag} w on w.t = h.t join dl on dl.id = h.id cross join tot group by h.id having count(*) = {len(terms)} "
        f"order by round(-sum(case when {weight} <= 0 then cast(0.000001 as double) else {weight} end "
        "* (f * cast(2.2 as double) / (f + cast(1.2 as double) * (cast(0.25 as double) + cast(0.75 as double) * dl.dl / avgdl)))), 12), h.id limit 200)"
    )


def _search_sql(query: str, limit: int = 20) -> str:
    """The stages of a search without a dot, its terms unstemmed."""
    terms = query.lower().replace("_", " ").split()
    pattern = " and ".join("(" + " or ".join(_like(c, f"%{w}%") for c in ("name", "qualified_name", "signature")) + ")" for w in query.split())
    total = f"(length(name) + {len(query)})"
    left = f"({limit} - (select count(*) from exact) - (select count(*) from second))"
    fields = "id, qualified_name, symbol_type, name"
    return (
        _POSTINGS + ", dl as (select s.id, coalesce(sum(p.tf), 0) as dl from symbols s left join postings p on p.id = s.id group by s.id), tot as (select count(*) as n, avg(dl) as avgdl from dl)"
        + _best("name", terms, "'name', 'qualified_name'")
        + _best("text", terms, "'docstring'")
        + _lcs_table(query)
        + f", exact as (select {fields} from symbols where name = '{query}' order by id limit {limit})"
        + f", named as (select {fields}, 'full text' as stage from symbols where id in (select id from best_name) and id not in (select id from exact))"
        + f", pattern as (select {fields}, 'pattern' as stage from symbols where {pattern} and not exists (select 1 from exact) and not exists (select 1 from named) order by name, id limit 200)"
        + ", found as (select * from named union all select * from pattern)"
        + f", second as (select * from (select *, row_number() over (order by {_ORDER}) as within from found) f where within <= {limit} - (select count(*) from exact))"
        + f", texts as (select {fields}, 'docstring' as stage from symbols where id in (select id from best_text) and id not in (select id from exact) and id not in (select id from found))"
        + f", close_names as (select name, row_number() over (order by 200.0::double * lcs / {total} desc, name) as nr from walk where 200 * lcs >= 60 * {total})"
        + ", known as (select id from exact union all select id from found union all select id from texts)"
        + f", named_alike as (select s.id, s.qualified_name, s.symbol_type, s.name, 'fuzzy' as stage, c.nr, row_number() over (partition by c.nr order by s.id) as place, s.id in (select id from known) as seen "
        f"from symbols s join close_names c on c.name = s.name and c.nr <= {left})"
        # How many rows each name finds taken when its turn comes.
        + f", turns as (with recursive t(nr, taken) as (select 1::bigint, 0::bigint union all select t.nr + 1, t.taken + coalesce((select count(*) from named_alike n where n.nr = t.nr and n.place <= {left} - t.taken and not n.seen), 0) "
        f"from t where t.nr < {left}) select * from t)"
        + f", alike as (select n.*, row_number() over (order by n.nr, n.id) as within_nr from named_alike n join turns t on t.nr = n.nr where n.place <= {left} - t.taken and not n.seen)"
        + f", last as (select *, row_number() over (order by {_ORDER}) as within from (select * from texts union all select {fields}, stage from alike) l)"
        + f", parts as (select {fields}, 'exact' as stage, 'fts' as tier, 0 as turn, row_number() over (order by {_ORDER}) as within from exact "
        f"union all select {fields}, stage, 'fts', 1, within from second union all select {fields}, stage, 'fuzzy', 2, within from last where within <= {left})"
        + f" select id, qualified_name, symbol_type, stage, tier, row_number() over (order by turn, within) as rank from parts order by rank limit {limit}"
    )


# No stem of the catalogue begins otherwise than its word where these queries look, so unstemmed SQL finds the same.
@_query(_search_sql("nation 7"))
def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir, "nation 7", stemmed=True)


@_query(_search_sql("NATON_7"))
def search_typo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir, "NATON_7", stemmed=True)


@_query(_search_sql("NATION_7"))
def search_exact_then_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name itself, then names by full text, cut to what is left."""
    return _cascade(spark, sf_dir, "NATION_7")


@_query(_search_sql(_NEAR, 200))
def search_text_and_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No name fits; docstrings and similar names are merged."""
    return _cascade(spark, sf_dir, _NEAR, 200)


@_query(_search_sql("NATON_7"))
def search_fuzzy_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir, "NATON_7")


@_query("select 0::bigint as results", cte=False)
def search_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir, "  ").agg(F.count("*").alias("results"))


@_query("select s.id, s.qualified_name from symbols s where s.qualified_name = 'geo.ASIA'")
def show_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = catalog(spark, sf_dir)
    return lookup.by_key(symbols, navigate.resolve_one(symbols, "asia") or "").select("id", "qualified_name")


# -- texts -------------------------------------------------------------------------------------------

_SHORT = "case when length(coalesce(signature, '')) > 50 then concat(substr(signature, 1, 47), '...') else coalesce(signature, '') end"
_LINE = f"format('{{:<8s}} {{}}{{}}', symbol_type, name, {_SHORT})"


@_query(f"select id, {_LINE} as line from symbols")
def format_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).select("id", fmt.line().alias("line"))


@_query(
    f", kids as (select {_PARENT} as owner, string_agg(concat('  ', {_LINE}), chr(10) order by {_ORDER}) as listing from symbols group by 1) "
    "select s.qualified_name, concat(s.symbol_type, ': ', s.qualified_name, case when s.signature <> '' then concat(chr(10), 'signature: ', s.signature) else '' end, "
    "case when s.docstring <> '' then concat(chr(10), 'docstring: ', case when length(s.docstring) <= 1500 then s.docstring else concat(substr(s.docstring, 1, 1500), '...') end) else '' end, "
    "chr(10), 'location: /src/', s.src, ':', s.id % 1000000000000, case when s.symbol_type in ('class', 'module') and k.listing is not null then concat(chr(10), 'members:', chr(10), k.listing) else '' end) as detail "
    "from symbols s left join kids k on k.owner = s.qualified_name where s.src in (0, 1, 6)"
)
def format_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = catalog(spark, sf_dir).withColumns({"file_path": F.concat(F.lit("/src/"), F.col("src").cast("string")), "line_no": F.col("id") % 1000000000000})
    return fmt.details(symbols, symbols.filter("src in (0, 1, 6)"))


@_query(ORACLES["format_detail"].replace(" where s.src in (0, 1, 6)", ""), cte=False)
def format_detail_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format_detail for every symbol of the catalogue."""
    symbols = catalog(spark, sf_dir).withColumns({"file_path": F.concat(F.lit("/src/"), F.col("src").cast("string")), "line_no": F.col("id") % 1000000000000})
    return fmt.details(symbols, symbols)


_HINTED = "select lang, source, count(case when doc_id % 97 = 0 then 1 end) as exact, count(case when doc_id % 53 = 0 then 1 end) as fuzzy, max(doc_id) % 2 = 0 as inside from documents group by lang, source"


@_query(
    "select lang, source, case when exact > 0 then null when fuzzy > 0 and inside then 'Showing approximate matches (no exact results). Package may not be installed — try: uv add <package>' "
    "when fuzzy > 0 then 'Showing approximate matches (no exact results). Not in a Python project — no sources to reindex.' when inside then 'No results. Package may not be installed — try: uv add <package>' "
    f"else 'Not in a Python project (no .venv found).' end as hint from ({_HINTED}) h",
    cte=False,
)
def search_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hint for numbers of exact and approximate results, for each language and source."""
    rows = spark.sql(_HINTED.replace("from documents", "from {documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("lang", "source", fmt.hint_column("exact", "fuzzy", "inside").alias("hint"))


_DIM, _CYAN, _RESET = "\x1b[2m", "\x1b[36m", "\x1b[0m"
_PARAMS = f"regexp_replace(regexp_replace(split_part(signature, ' -> ', 1), '(:\\s*)([^,)=]+)', '{_DIM}\\1\\2{_RESET}', 'g'), '(=\\s*)([^,)]+)', '{_DIM}\\1\\2{_RESET}', 'g')"
_STYLED = f"concat(replace(replace({_PARAMS}, '(', '{_CYAN}({_RESET}'), ')', '{_CYAN}){_RESET}'), case when contains(signature, ' -> ') then concat(' {_CYAN}->{_RESET} {_DIM}', substr(signature, instr(signature, ' -> ') + 4), '{_RESET}') else '' end)"


@_query(f"select id, {_STYLED} as styled from symbols where signature is not null")
def style_sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog(spark, sf_dir).filter("signature is not null").select("id", fmt.styled().alias("styled"))


# -- Python sources ----------------------------------------------------------------------------------

_OF_SYMBOL = "qualified_name, symbol_type, signature, line_no, return_annotation"
_OWN = f"select {_OF_SYMBOL} from own where sub <> '_hid'"
_SHOWN_SYMBOL = _OF_SYMBOL.split(", ")


@_query(python_fixtures.CTE + f"{_OWN} union all select {_OF_SYMBOL} from again", cte=False)
def index_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All packages at once: the symbols of their modules and those that they re-export."""
    return python_tree.symbols_of_files(python_fixtures.files(spark, sf_dir)).select(_SHOWN_SYMBOL)


@_query(python_fixtures.CTE + f"select {_OF_SYMBOL} from again", cte=False)
def resolve_reexports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = python_tree.symbols_of_files(python_fixtures.files(spark, sf_dir))
    return found.filter(~F.col("qualified_name").rlike("^[^.]+[.][^.]+[.]m[0-9]")).select(_SHOWN_SYMBOL)


@_query(python_fixtures.CTE + python_fixtures.IMPORTS, cte=False)
def extract_reexports(spark: SparkSession, sf_dir: str) -> DataFrame:
    inits = python_fixtures.inits(spark, sf_dir)
    return python_tree.reexports_of_files(inits.withColumn("module", F.replace(F.regexp_replace("path", "/__init__.py$", ""), F.lit("/"), F.lit("."))))


@_query(python_fixtures.CTE + _OWN, cte=False)
def parse_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules by themselves."""
    return python_tree.symbols_of_files(python_fixtures.modules(spark, sf_dir).drop("doc_id")).select(_SHOWN_SYMBOL)


@_query("select doc_id, case doc_id % 6 " + " ".join("when {} then '{}'".format(i, shown.replace("'", "''")) for i, (_, shown) in enumerate(python_fixtures.HEADS)) + " end as signature from documents", cte=False)
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = python_tree.symbols_of_files(python_fixtures.heads(spark, sf_dir))
    return found.select(F.substring("name", 2, 20).cast("long").alias("doc_id"), "signature")


@_query(python_fixtures.CTE + f"select substr(qualified_name, length(package) + 2) as qualified_name, {_OF_SYMBOL.split(', ', 1)[1]}, concat('project:/', package) as source_key from own where sub <> '_hid'", cte=False)
def index_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_tree.symbols_of_folders(python_fixtures.folders(spark, sf_dir)).select(*_SHOWN_SYMBOL, "source_key")


_IMPORTED = "select doc_id, cast(1 + doc_id % 4 as int) as level, case when doc_id % 5 <> 0 then concat('m', cast(doc_id % 11 as varchar(9)), case when doc_id % 2 = 0 then '.x' else '' end) end as module, concat(lang, '.', source, case when doc_id % 3 = 0 then '.deep' else '' end) as package from documents"


@_query(
    f"select doc_id, case when level <= len(parts) then array_to_string(list_concat(parts[1:len(parts) - level + 1], case when module is null then []::varchar[] else [module] end), '.') end as resolved "
    f"from (select *, string_split(package, '.') as parts from ({_IMPORTED}) i) p",
    cte=False,
)
def resolve_relative_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_IMPORTED.replace("from documents", "from {documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", absolute_module("level", "module", "package").alias("resolved"))


# -- listings of files ---------------------------------------------------------------------------------

#: A listing of files made of the documents, the same in both engines.
_LISTING = """
entries as (
  select doc_id, case doc_id % 9 when 0 then concat('_', lang) when 1 then concat(lang, '.dist-info') when 2 then concat('.', lang) else concat(lang, '_', cast(doc_id % 5 as varchar(9))) end as top,
         case doc_id % 7 when 0 then '' when 1 then 'core/' when 2 then '_private/' when 3 then '.hidden/' when 4 then '__pycache__/' when 5 then 'a/b/' else '' end as below,
         case doc_id % 11 when 0 then '__init__.py' when 1 then '__init__.py' when 2 then '__init__.pyi' when 3 then 'data.txt' when 4 then '_own.py'
              else concat('m', cast(doc_id % 6 as varchar(9)), case when doc_id % 11 < 8 then '.pyi' else '.py' end) end as file
  from documents),
listing as (
  select path, max(mtime) as mtime from (
    select concat(top, '/', below, file) as path, cast(doc_id as double) as mtime from entries
    union all select concat(top, '/'), 100.5 from entries
    union all select concat(top, case when doc_id % 2 = 0 then '.py' else '.so' end), 1.0 from entries where doc_id % 9 > 2) p
  group by path)
"""
_TOP = "split_part(path, '/', 1)"
_WALKED = ", walked as (select path from listing l where regexp_matches(path, '[.]pyi?$') and not regexp_matches(path, '^[^/]+/(.*/)?[._][^/]*/') and not (path like '%.pyi' and exists (select 1 from listing o where concat(o.path, 'i') = l.path)))"
_DOTTED = "regexp_replace(replace(regexp_replace(path, '[.]pyi?$', ''), '/', '.'), '[.]__init__$', '')"


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("with" + _LISTING.replace("from documents", "from {documents}") + "select * from listing", documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


@_query(
    "with" + _LISTING + f"select case when contains(path, '/') then {_TOP} else regexp_replace(path, '[.]py$', '') end as name, min({_TOP}) as entry from listing "
    f"where not regexp_matches({_TOP}, '^[._]|[.](dist-info|egg-info|so|pyd|pth)$') and regexp_matches(path, '^([^/]+[.]py|[^/]+/[^/]+[.]pyi?|[^/]+/[^/]+/__init__[.]py)$') group by 1",
    cte=False,
)
def src_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.packages(_listing(spark, sf_dir))


@_query("with" + _LISTING + _WALKED + f" select path, {_DOTTED} as module from walked", cte=False)
def src_py_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.modules(_listing(spark, sf_dir))


@_query("with" + _LISTING + f"select {_DOTTED} as module, path from listing where path like '%/__init__.py' and not regexp_matches(path, '^[^/]+/(.*/)?([.][^/]*|__pycache__)/')", cte=False)
def src_init_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.inits(_listing(spark, sf_dir))


@_query(
    "with" + _LISTING + _WALKED + f" select {_TOP} as source, max(mtime) filter (regexp_matches(path, '^[^/]+/(__init__[.]py)?$')) as package_mtime, "
    f"max(mtime) filter (path like '%/' or path in (select path from walked)) as project_mtime from listing where contains(path, '/') group by 1",
    cte=False,
)
def source_mtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.changed(_listing(spark, sf_dir))
