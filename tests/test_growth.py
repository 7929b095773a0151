"""Steps whose cost must follow their input: what they build, shuffle and hold in a task."""

import collections
import re

import pytest

from tomeline import fixtures, queries
from tomeline.functions.columns import by_name
from tomeline.operators import fts, lookup, maintain
from tomeline.sources import reexports

SF = "/root/testdata/sf0.001"
SYMBOL = "id long, name string, qualified_name string, signature string, docstring string"


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def symbols(spark):
    rows = [(1, "Ab", "x.Ab", None, "b a b, B"), (2, "c", "x.c", "(\n𝒳𝒴z𝒳)", None), (3, "d", "x.d", "", ""), (4, "runs", "x.runs", "xx", "runs running, run é")]
    return spark.createDataFrame(rows, SYMBOL)


@pytest.mark.parametrize("query", ["search_blank", "search_cascade", "search_exact_then_words"])
def test_searches_build_what_they_look_into(spark, tmp_path, monkeypatch, query):
    monkeypatch.setattr(fixtures, "_stores", {})
    monkeypatch.setattr(fixtures, "shared_dir", lambda spark: str(tmp_path))
    queries.QUERIES[query](spark, SF).collect()
    store = fixtures.store(spark, SF)
    assert store.has("symbols") and not store.has("grams")
    assert store.has("plain/postings") == (query == "search_exact_then_words")


def test_words_are_counted_in_their_row(symbols):
    built = fts.build(symbols, stemmed=False)
    assert "Exchange" not in plan(built.postings) and "Exchange" not in plan(built.lengths)
    rows = symbols.collect()
    words = {(r.id, c): re.findall(r"[^\W_]+", (r[c] or "").lower()) for r in rows for c in fts.COLUMNS}
    assert sorted(map(tuple, built.postings.select("id", "col", "term", "tf").collect())) == sorted((i, c, t, n) for (i, c), w in words.items() for t, n in collections.Counter(w).items())
    assert dict(map(tuple, built.lengths.collect())) == {r.id: sum(len(words[r.id, c]) for c in fts.COLUMNS) for r in rows}


@pytest.mark.parametrize("stemmed", [False, True])
def test_parts_of_the_index_follow_its_rows(symbols, monkeypatch, stemmed):
    monkeypatch.setattr(fts, "PART_ROWS", 3)
    words = fts.forward(symbols, stemmed)
    rows = fts.by_term(words, fts.stems_of(words) if stemmed else None)
    assert rows.rdd.getNumPartitions() > 3
    got = [(r.id, r.col, r.term, r.tf) for r in rows.collect()]
    assert [(t, i) for i, _, t, _ in got] == sorted((t, i) for i, _, t, _ in got)
    assert sorted(got) == sorted((r.id, r.col, r.term, r.tf) for r in fts.build(symbols, stemmed).postings.collect())
    assert ((4, "docstring", "run", 3) in got) == stemmed


def test_grams_of_dealt_symbols(symbols):
    rows = lookup.grams(symbols)
    assert "REPARTITION_BY_COL" in plan(rows)
    want = {(t[i : i + 3], r.id) for r in symbols.collect() for c in ("name", "qualified_name", "signature") for t in ["".join(x.lower() if x.isascii() else x for x in r[c] or "")] for i in range(len(t) - 2)}
    got = [(r.gram, r.id) for r in rows.collect()]
    assert set(got) == want and len(got) == len(want)


def test_snapshots_shuffle_rows_once(spark):
    rows = spark.createDataFrame([(i, f"n{i % 7}", f"p{i % 2}.n{i % 7}", None, f"text {i}") for i in range(60)], SYMBOL)
    last = maintain.last_sorted(rows, *by_name())
    assert plan(last).count("Exchange") == 1
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, maintain.last_writer(rows, "qualified_name", "id").select(rows.columns).collect()))
    names = [r.name for r in last.collect()]
    assert names == sorted(names)


def test_symbols_are_given_on_as_they_are_found(spark, monkeypatch):
    """A task has no more rows in hand than those of one file and two output batches, whatever its Arrow batch holds."""
    held = []
    batches = lambda files: lambda each: held.append(each) or files
    files = spark.createDataFrame([("k", f"k/m{i}.py", f"k.m{i}", "", "def f(): ...\n" * 7) for i in range(600)], "source_key string, path string, module string, file_path string, text string")
    assert reexports._parsed(files).count() == 4200
    monkeypatch.setattr(type(files), "mapInArrow", lambda self, each, schema: batches(self)(each), raising=False)
    reexports._parsed(files)
    (each,) = held
    read = []
    rows = files.toArrow().select(["source_key", "path", "module", "file_path", "text"]).combine_chunks().to_batches()
    parse = reexports.extract.symbols_of
    monkeypatch.setattr(reexports.extract, "symbols_of", lambda *a: read.append(1) or parse(*a))
    sizes = []
    for out in each(iter(rows)):
        sizes.append(out.num_rows)
        assert 7 * len(read) - sum(sizes) <= 7
    assert sum(sizes) == 4200 and max(sizes) <= 1000
