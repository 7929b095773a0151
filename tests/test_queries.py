"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from jobs import queries as jobs
from tomeline import queries as own
from tomeline.fixtures import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(frame):
    """Rows as sorted tuples, columns by name, missing values as None and numbers rounded."""

    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(x, 9) if isinstance(x, float) else x

    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted((tuple(map(value, r)) for r in frame.itertuples(index=False)), key=repr)


ORACLES = own.ORACLES | jobs.ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    assert len(want), "an oracle without rows proves nothing"
    assert plain(got) == plain(want)


def test_every_query_is_registered():
    assert set(own.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SF)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["search_words", "search_typo", "fts_stemmed"])
def test_searches_without_sql(spark, name):
    rows = own.QUERIES[name](spark, SF).collect()
    assert sorted(r.rank for r in rows) == list(range(1, len(rows) + 1)) and rows
    if name == "search_typo":
        assert {r.tier for r in rows} == {"fuzzy"} and any(r.qualified_name.endswith(".NATION_7") for r in rows)


def test_every_symbol_has_a_detail(spark):
    symbols = {r.qualified_name: r for r in catalog(spark, SF).collect()}
    got = {r.qualified_name: r.detail for r in own.QUERIES["format_detail_all"](spark, SF).collect()}
    assert set(got) == set(symbols) and {r.src for r in symbols.values()} == set(range(7))
    for name, r in symbols.items():
        assert got[name].startswith(f"{r.symbol_type}: {name}\n") and (not r.signature or f"\nsignature: {r.signature}\n" in got[name])
        if r.src == 4:
            listed = got[name].split("\nmembers:\n")[1].split("\n")
            assert len(listed) == sum(n.rsplit(".", 1)[0] == name for n in symbols)


def test_prefix_glob_asks_for_every_source(spark):
    symbols = catalog(spark, SF).collect()
    got = {r["query"]: r.qualified_name for r in own.QUERIES["prefix_glob_all"](spark, SF).collect()}
    few = {r["query"] for r in own.QUERIES["prefix_glob"](spark, SF).collect()}
    assert few < set(got) and all(got[r.qualified_name] == r.qualified_name for r in symbols if r.src in (0, 4))
