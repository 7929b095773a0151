"""Registered queries against their SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tomeline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    wanted = [tuple(r[names.index(c)] for c in columns) for r in want.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(wanted, key=repr)


def test_all_operators_are_registered():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 13)]
