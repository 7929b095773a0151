"""Column functions against the standard library."""

import random
import re
import sqlite3

from pyspark.sql import functions as F

from tomeline.functions.columns import like, query_terms, sanitized, valid_terms
from tomeline.functions.fuzzy import lcs_length, lcs_sql, lcs_with
from tomeline.functions.porter import stem
from tomeline.operators import fts, fuzzy
from tomeline.operators.format import line


def test_like_is_that_of_sqlite(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aAbB_%\\éÉ.'") for _ in range(rng.randint(0, 5))) for _ in range(120)]
    table = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    con = sqlite3.connect(":memory:")
    for pattern in ["a%", "A_", "%\\%", "é%", "É", "", "%'%", "_.%", "%b%a%"]:
        got = {r.t for r in table.filter(like("t", pattern)).collect()}
        assert got == {t for t in texts if con.execute("select ? like ?", (t, pattern)).fetchone()[0]}, pattern


def test_queries_become_prefixes(spark):
    pairs = {"polars.col": "polars* col*", "read_csv": "read* csv*", "a.b_c d": "a* b* c* d*", "plain": "plain*", "x+y (z)": "x* y* z*", " ": "", '"quoted"': "quoted*"}
    table = spark.createDataFrame([(q,) for q in pairs], "q string")
    assert {r.q: r.s for r in table.select("q", sanitized("q").alias("s")).collect()} == pairs
    assert all(" ".join(f"{t}*" for t in query_terms(q)) == s for q, s in pairs.items())
    assert valid_terms(["a", "é", "not"]) and not any(valid_terms(t) for t in ([], ["NOT"], ["a/b"], ["50%"], ["x", "AND"]))


def test_stems_are_those_of_fts5():
    import pydoc_data.topics

    rng = random.Random(1)
    words = set(re.findall("[a-z]+", str(pydoc_data.topics.topics).lower()))
    endings = "ational tional izer ization ator alism iveness fulness ousness aliti iviti biliti icate ative alize iciti ical ness ement ion ing ed ies sses y logi bli".split()
    words = sorted(words | {w[: rng.randint(1, 6)] + e for w in sorted(words) for e in rng.sample(endings, 2)} - {"eed"})
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter ascii')")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    con.executemany("insert into t(rowid, x) values (?, ?)", list(enumerate(words)))
    assert [(words[d], s) for s, d in con.execute("select term, doc from v") if stem(words[d]) != s] == []


def test_longest_common_subsequence(spark):
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(2)
    say = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 90)))
    pairs = [(say(), say()) for _ in range(300)]
    assert all(lcs_length(a, b) == plain(a, b) for a, b in pairs)
    table = spark.createDataFrame([(a[:20],) for a, _ in pairs[:40]], "a string")
    for r in table.select("a", lcs_with("badcab")("a").alias("x"), lcs_sql("a", "badcab").alias("y")).collect():
        assert r.x == r.y == plain(r.a, "badcab")


def test_ranked_search_is_that_of_fts5(spark):
    rng = random.Random(7)
    vocabulary = "model models modeling runner running run base based café cafe parse parser parsing token tokens query queries Field field_name x1 x2".split()
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, f"{rng.choice(vocabulary)}_{i % 7}", f"pkg.{rng.choice(vocabulary)}.n{i}", say(rng.randint(0, 12)) if i % 9 else None) for i in range(1, 90)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(name, qualified_name, docstring, tokenize='porter unicode61')")
    con.executemany("insert into t(rowid, name, qualified_name, docstring) values (?, ?, ?, ?)", rows)
    table = spark.createDataFrame([(*r, "class") for r in rows], "id long, name string, qualified_name string, docstring string, symbol_type string").cache()
    index = fts.build(table).cached()
    for query in ("model", "running base", "cafe", "query tok", "pars x1"):
        for label, columns in (("{name qualified_name}", ("name", "qualified_name")), ("{docstring}", ("docstring",))):
            match = f"{label}: {' '.join(t + '*' for t in query_terms(query))}"
            want = con.execute("select rowid, bm25(t) from t where t match ? order by round(bm25(t), 12), rowid limit 200", (match,)).fetchall()
            got = [(r.id, r.score) for r in fts.search(table, index, query, columns).orderBy(F.round("score", 12), "id").collect()]
            assert [i for i, _ in got] == [i for i, _ in want], (query, label)
            assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(got, want, strict=True))


def test_a_folder_of_stubs_is_a_package(spark, tmp_path):
    from tomeline.sources.python_tree import read_sources

    for name, file in [("stubs", "a.pyi"), ("plain", "a.py"), ("data", "a.txt")]:
        (tmp_path / name).mkdir()
        (tmp_path / name / file).write_text("")
    assert {r.name for r in read_sources(spark, str(tmp_path)).collect()} == {"stubs", "plain"}


def test_colours_are_put_on_after_shortening(spark):
    rows = spark.createDataFrame([("f", "function", "(a: int = 5, b={1: 2}, " + "c" * 40 + ": str) -> int"), ("g", "function", None)], "name string, symbol_type string, signature string")
    for r in rows.select(line(True).alias("shown"), line().alias("bare")).collect():
        assert re.sub("\x1b\\[[0-9]+m", "", r.shown) == r.bare and r.shown.count("\x1b") % 2 == 0
        assert "\x1b" not in r.bare and len(r.bare) <= 60


def test_rows_seen_count_for_the_limit_of_their_name(spark):
    """Against taking the names one by one."""
    rows = [(i, n, f"{o}.{n}") for i, (o, n) in enumerate((o, n) for o in "abcde" for n in ("field", "fields", "fielt", "yield", "shield", "other"))]
    symbols = spark.createDataFrame(rows, "id long, name string, qualified_name string")
    ratio = lambda n: fuzzy.scored(symbols.filter(f"name = '{n}'").select("name").distinct(), "field").first()
    order = sorted((n for n in {r[1] for r in rows} if ratio(n)), key=lambda n: (-ratio(n).ratio, n))
    for limit, known in ((3, {"a.field", "b.field", "a.fields"}), (7, {f"{o}.field" for o in "abc"} | {"e.fielt"}), (40, {"a.yield"}), (5, set())):
        wanted = []
        for n in order[:limit]:
            if len(wanted) < limit:
                wanted += [i for i, _, q in [r for r in rows if r[1] == n][: limit - len(wanted)] if q not in known]
        seen = spark.createDataFrame([(q,) for q in sorted(known)], "qualified_name string")
        assert [r.id for r in fuzzy.search(symbols, "field", limit, seen=seen).collect()] == wanted
