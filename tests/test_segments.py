"""A catalogue in segments against one that is made anew."""

import random

import pytest
from pyspark.sql import functions as F

from tomeline.operators import fts, lookup
from tomeline.plans.segments import Segments

ROW = "source_key string, id long, name string, qualified_name string, symbol_type string, signature string, docstring string"


def row(source, i, name, doc=None, kind="function"):
    return (source, i, name.rsplit(".", 1)[-1], name, kind, "(x)", doc)


def rows_of(spark, rows):
    return spark.createDataFrame(rows, ROW)


def sources_of(spark, keys, mark=1):
    return spark.createDataFrame([(k, mark) for k in keys], "source_key string, mark int")


def shown(df):
    return sorted((r.qualified_name, r.id, r.docstring or "") for r in df.collect())


def check(spark, segments, expected, searched=False):
    """Symbols, index and search equal those of a catalogue that holds nothing but the expected rows."""
    want = rows_of(spark, expected).cache()
    assert shown(segments.symbols()) == shown(want) == shown(segments.tree())
    if not searched:
        return
    fresh, stored = fts.build(want), segments.index()
    for part in ("postings", "lengths", "totals"):
        got, wanted = getattr(stored, part), getattr(fresh, part)
        assert sorted(map(tuple, got.select(wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    assert sorted(map(tuple, segments.grams().select("gram", "id").collect())) == sorted(map(tuple, lookup.grams(want).collect()))
    for query, columns in (("thing", ("name", "qualified_name")), ("runner", ("docstring",))):
        got, wanted = (fts.search(s, i, query, columns).select("id", F.round("score", 9)).collect() for s, i in ((segments.symbols(), stored), (want, fresh)))
        assert sorted(got) == sorted(wanted) and got
    want.unpersist()


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """These tables have a handful of rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture
def segments(spark, tmp_path):
    return Segments(spark, str(tmp_path / "catalog"))


A = [row("a", 1, "a.Thing", "A round thing", "class"), row("a", 2, "a.Thing.run", "Running runners"), row("a", 3, "shared.one", "from a"), row("a", 4, "shared.two", "common words")]
B = [row("b", 10, "b.other", "common thing"), row("b", 11, "shared.one", "from b, which counts")]


def test_refreshes_equal_a_rebuild(spark, segments):
    assert segments.run() == 0
    with pytest.raises(RuntimeError, match="nothing is stored"):
        segments.symbols()
    assert segments.refresh(rows_of(spark, [*A, *B, row("a", 5, "a.Thing", "Said again")]), sources_of(spark, "abe")) == 1
    both = [row("a", 5, "a.Thing", "Said again"), A[1], A[3], *B]
    check(spark, segments, both)
    assert {(r.source_key, r.mark, r["at"], r.symbol_count, r.n_symbols) for r in segments.state().collect()} == {("a", 1, 1, 5, 4), ("b", 1, 1, 2, 2), ("e", 1, 1, 0, 0)}

    # One source of many changes: only its rows are written, and the name that it gives up goes back to the other.
    new_b = [row("b", 20, "b.round", "a runner"), row("b", 21, "shared.two", "taken over")]
    assert segments.refresh(rows_of(spark, new_b), sources_of(spark, "b", 2)) == 2
    check(spark, segments, [row("a", 5, "a.Thing", "Said again"), A[1], A[2], *new_b], searched=True)
    assert {r.source_key for r in spark.read.parquet(f"{segments.folder}/rows/run=2").collect()} == {"b"}
    assert {r.source_key for r in spark.read.parquet(f"{segments.folder}/postings/run=2").collect()} == {"b"}

    # A source goes, and with it its claim to a name.
    assert segments.refresh(rows_of(spark, []), sources_of(spark, []), spark.createDataFrame([("b",)], "source_key string")) == 3
    check(spark, segments, [row("a", 5, "a.Thing", "Said again"), *A[1:]])
    assert shown(segments.symbols(run=1)) == shown(rows_of(spark, both)), "earlier states stay readable"


def test_a_run_that_dies_changes_nothing(spark, segments, monkeypatch):
    segments.refresh(rows_of(spark, [*A, *B]), sources_of(spark, "ab"))
    before = segments.symbols()
    for stop in ("state",):
        write = Segments._write

        def dies(self, name, *rest, stop=stop, write=write):
            if name == stop:
                raise KeyboardInterrupt
            write(self, name, *rest)

        monkeypatch.setattr(Segments, "_write", dies)
        with pytest.raises(KeyboardInterrupt):
            segments.refresh(rows_of(spark, [row("c", 30, "c.lost", "never seen"), row("a", 31, "a.lost", "never seen")]), sources_of(spark, "ac"))
        monkeypatch.setattr(Segments, "_write", write)
        assert segments.run() == 1 and shown(segments.symbols()) == shown(before)
    check(spark, segments, [*A[:2], A[3], *B], searched=True)
    # What was left of it is written over, even where the new run has no rows for a source that it had.
    segments.refresh(rows_of(spark, []), sources_of(spark, "c"))
    check(spark, segments, [*A[:2], A[3], *B])


def test_small_runs_are_merged(spark, segments):
    big = [row("big", i, f"big.n{i}", "common thing") for i in range(40)]
    segments.refresh(rows_of(spark, big), sources_of(spark, ["big"]))
    for i in range(3):
        segments.refresh(rows_of(spark, [row(f"s{i}", 100 + i, f"s{i}.thing", "a runner"), row(f"s{i}", 200 + i, "all.same", f"{i}")]), sources_of(spark, [f"s{i}"]))
    expected = [*big, *(row(f"s{i}", 100 + i, f"s{i}.thing", "a runner") for i in range(3)), row("s2", 202, "all.same", "2")]
    assert segments.merge(most=8) == 4
    assert segments.merge(most=3) == 5
    assert {r.source_key: r["at"] for r in segments.state().collect()} == {"big": 1, **{f"s{i}": 5 for i in range(3)}}
    assert segments.drop_unused() == [1, 2, 3, 4]
    check(spark, segments, expected, searched=True)


def scanned(df):
    """Rows that the scans of an executed query gave out."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if "executedPlan" in dir(leaf):
            inner = leaf.executedPlan().collectLeaves()
            found += [inner.apply(j) for j in range(inner.size())]
        else:
            found.append(leaf)
    return sum(x.metrics().apply("numOutputRows").value() for x in found if x.metrics().contains("numOutputRows"))


def test_the_tree_is_pruned(spark, tmp_path):
    """Lookups by parent and key are pushed to the scan and skip row groups."""
    segments = Segments(spark, str(tmp_path / "tree"))
    rows = [(f"s{i % 7}", i, f"m{i}", f"top.p{i // 50:03}.m{i}", "function", "(x)", "word " * 20) for i in range(20_000)]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "65536")
    hadoop.set("parquet.page.size", "4096")
    try:
        segments.refresh(rows_of(spark, rows), sources_of(spark, [f"s{i}" for i in range(7)]))
    finally:
        hadoop.unset("parquet.block.size")
        hadoop.unset("parquet.page.size")
    tree = segments._table("tree", 1)
    for found, n in ((lookup.children(tree, "top.p123"), 50), (lookup.by_key(tree, "top.p007.m399"), 1), (lookup.children(tree, "TOP.p1_3"), 500)):
        assert found.count() == n
        plan = found._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("DataFilters: [")[1].split("PushedFilters: ")[0]
        assert "(parent_key" in pushed.replace("#", "(") and "isnotnull(parent_key" in pushed
        assert n <= scanned(found) <= 8000
    assert lookup.children(tree, "top.p123").count() == lookup.children(tree.drop("parent_key"), "top.p123").count() == 50
    for name in ("top", "top.p12_", "top%", "TOP.P003", "t_p", "nothing"):
        assert sorted(r.id for r in lookup.children(tree, name).collect()) == sorted(r.id for r in lookup.children(tree.drop("parent_key"), name).collect())


def test_patterns_by_grams(spark, tmp_path):
    """Equal to looking through all symbols, reading only those that have a pattern's grams."""
    rng = random.Random(6)
    say = lambda: "".join(rng.choice("abAB_%éx.") for _ in range(rng.randint(0, 12)))
    rows = [("s", i, say(), f"{say()}.n{i}", "function", say() if i % 3 else None, None) for i in range(600)] + [("s", 600, "one_of_A_kind", "top.one_of_A_kind", "class", "(Ünique)", None)]
    symbols = rows_of(spark, rows).cache()
    lookup.grams(symbols).repartitionByRange(2, "gram").sortWithinPartitions("gram").write.parquet(str(tmp_path / "grams"))
    index = spark.read.parquet(str(tmp_path / "grams"))
    for query in ("aba", "AB abx", "a_b", "bab%xa", "ab", "%", "xéx.", "of_a Üni", "kind", "zzz", "n59"):
        found = lookup.containing(symbols, query, cap=10_000, index=index)
        assert [r.id for r in found.collect()] == [r.id for r in lookup.containing(symbols, query, cap=10_000).collect()], query
    assert lookup.needed_grams("of_a Kind ab") == ["ind", "kin"]
    filters = lookup.containing(symbols, "kind", index=index)._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1]
    assert "In(gram" in filters.split("ReadSchema")[0]
