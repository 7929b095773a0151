"""Python trees: what is found, extracted, indexed, refreshed and shown."""

import os
import random
from pathlib import Path

import pytest

from tomeline import cli
from tomeline.operators import navigate
from tomeline.operators.format import hint
from tomeline.plans.catalog import Catalog
from tomeline.sources import discover, listing, reexports
from tomeline.sources.extract import absolute_module, reexports_of, symbols_of
from tomeline.sources.python_tree import _below, read_listing, read_sources, read_symbols
from tomeline.streaming.refresh import follow


def write(base, files):
    for path, text in files.items():
        (base / path).parent.mkdir(parents=True, exist_ok=True)
        (base / path).write_text(text)


@pytest.fixture
def site(tmp_path):
    packages = tmp_path / ".venv/lib/python3.13/site-packages"
    write(
        packages,
        {
            "shapes/__init__.py": '"""Shapes."""\nfrom ._impl import Circle\nfrom .flat import Square as Box\n',
            "shapes/_impl.py": 'class Circle(Shape):\n    """A round thing."""\n    def area(self) -> float:\n        """Computes the area."""\n    def _secret(self): ...\n',
            "shapes/flat.py": "class Shape:\n    def scale(self, by: int = 2): ...\nclass Square(Shape):\n    def area(self): ...\n",
            "shapes/_hidden/deep.py": "def lost(): ...\n",
            "single.py": "async def fetch(url): ...\n",
            "_private/__init__.py": "",
            "shapes-1.0.dist-info/METADATA": "",
            "spaced/inner/__init__.py": "def far(): ...\n",
            "data/readme.txt": "",
            "more.pth": "# comment\nimport x\n\n../linked\n../missing\n",
        },
    )
    write(packages.parent / "linked", {"pointed/__init__.py": "def here(): ...\n"})
    return packages


def test_discovery(spark, site, tmp_path):
    assert {r.name for r in read_sources(spark, str(site)).collect()} == {"shapes", "single", "spaced", "pointed"}
    assert discover.find_site_packages(tmp_path / ".venv") == site
    inner = tmp_path / "a/b"
    inner.mkdir(parents=True)
    assert discover.find_venv(inner) == tmp_path / ".venv"
    write(tmp_path / "t", {"m.py": "", "m.pyi": "", "s.pyi": "", "_f.py": "", "_d/x.py": "", ".h/x.py": "", "__pycache__/x.py": "", "p/__init__.py": "", "_d/__init__.py": ""})
    walked = listing.modules(read_listing(spark, None, [str(tmp_path / "t")])).collect()
    assert {r.path.removeprefix("t/") for r in walked} == {"m.py", "s.pyi", "_f.py", "p/__init__.py"}
    whole = spark.createDataFrame([(p,) for p in _below(str(tmp_path / "t"), lambda _: False)], "path string")
    assert {r.module for r in listing.inits(whole).collect()} == {"t.p", "t._d"}


def test_packages_of_equal_names_and_times_of_change(spark, tmp_path):
    """Of a name the first entry counts, those of a ``.pth`` file at its place and in the order of its lines; depth does not hide a package."""
    site = tmp_path / "site"
    write(site, {"b.pth": "../one\n../two\nimport os\n", "a/__init__.py": "", "c/m.py": "", "c.py": "", "d/s.pyi": "", "e/x/y/__init__.py": "", "f.so/__init__.py": "", ".h/__init__.py": "", "z/__init__.py": ""})
    write(tmp_path, {"one/a/__init__.py": "", "one/k/__init__.py": "", "two/k/__init__.py": "", "two/z.py": "", "two/_p/__init__.py": "", "two/x.pth": "../three", "three/w.py": "", "proj/m.py": "", "proj/.git/m.py": "", "proj/_b/m.py": ""})
    at = {"site/a": 5, "site/a/__init__.py": 9, "one/k": 7, "one/k/__init__.py": 3, "two/z.py": 4, "site/c": 2, "site/c/m.py": 99, "proj": 1, "proj/m.py": 6, "proj/.git/m.py": 50, "proj/_b/m.py": 60}
    for path, when in at.items():
        os.utime(tmp_path / path, (when, when))
    got = {r.name: (str(Path(r.source_path.removeprefix("project:")).relative_to(tmp_path)), r.mtime) for r in read_sources(spark, str(site), [str(tmp_path / "proj")]).collect()}
    project = next(k for k in got if k.endswith("proj"))
    assert got.pop(project) == ("proj", 6.0)
    assert {n: p for n, (p, _) in got.items()} == {"a": "site/a", "k": "one/k", "z": "two/z.py", "c": "site/c", "d": "site/d"}
    assert {n: got[n][1] for n in "akzc"} == {"a": 9.0, "k": 7.0, "z": 4.0, "c": 2.0}
    symbols = {(r.source_key, r.qualified_name) for r in read_symbols(spark, str(site), None, ["z", "d"]).collect()}
    assert symbols == set()
    (tmp_path / "two/z.py").write_text("def late(): ...\n")
    (tmp_path / "proj/m.py").write_text("def own(): ...\n")
    assert [r.qualified_name for r in read_symbols(spark, str(site), [str(tmp_path / "proj")], ["z", project]).select("qualified_name").sort("qualified_name").collect()] == ["m.own", "z.late"]


def test_extraction():
    assert symbols_of("def (", "m", "f") == [] and symbols_of("", "m", "f") == [] and symbols_of("x\0y", "m", "f") == []
    found = symbols_of("if 1:\n class A(b.C[D, E], metaclass=M):\n  def __init__(self, a, *, b=1): 'doc'\n  def _p(self): ...\n  def f(self):\n   def g(): ...\nclass _B:\n class C: ...\n", "m", "f.py")
    assert [(s.qualified_name, s.signature, s.docstring) for s in found] == [("m.A", "(b.C[D, E])", None), ("m.A.__init__", "(self, a, *, b = 1)", "doc"), ("m.A.f", "(self)", None)]
    assert found[0].bases == ["b.C[D, E]"]


def test_relative_imports():
    assert [absolute_module(*a) for a in [(1, "m", "a.b"), (2, "m", "a.b"), (2, None, "a.b")]] == ["a.b.m", "a.m", "a"]
    with pytest.raises(ValueError, match="beyond"):
        absolute_module(3, "m", "a.b")
    text = "from .x import *\nfrom ..... import y\ndef f():\n from z import q\nif A:\n from m import n as o\nelse:\n import r as s\nwith w:\n import t\n"
    assert [tuple(r) for r in reexports_of(text, "p")] == [("o", "m", "n", False), ("s", "r", "r", True)]


PACKAGES = {
    # Two packages that import each other; each module goes by the first name that reaches it.
    "circle": (
        {"__init__.py": "from . import a\n", "a/__init__.py": "from .. import b\nimport circle.b as bb\nfrom ._m import T\n", "b/__init__.py": "import circle.a\nfrom ._n import U\n", "a/_m.py": "class T:\n def f(self): ...\n", "b/_n.py": "def U(): ...\n"},
        ["a._m.T", "a._m.T.f", "b._n.U", "a.T", "a.T.f", "a.b.U"],
    ),
    "first": ({"__init__.py": "from ._a import X\nfrom ._b import X\n", "_a.py": "def X(a): ...\n", "_b.py": "def X(b): ...\n"}, ["_a.X", "_b.X", "X"]),
    # A module's docstring makes it the first symbol of its name.
    "shadowed": ({"__init__.py": "from ._d.Thing import Thing\n", "_d/Thing.py": '"""Doc."""\nclass Thing: ...\n'}, ["Thing"]),
    "beside": ({"__init__.py": "from six_like import X\nfrom missing import Y\n"}, ["X"]),
    # A class's member takes a name before a later import does, and then brings none of its own; an earlier import keeps it.
    "members": (
        {"__init__.py": "from ._k import K\nfrom . import sub as K\nfrom ._k import F\n", "_k.py": "class K:\n def go(self): ...\n class In:\n  def deep(self): ...\ndef F(): ...\n", "sub/__init__.py": "from ._s import In, go, other\n", "sub/_s.py": "class In:\n def lost(self): ...\nclass go: ...\ndef other(): ...\n"},
        ["_k.K", "_k.K.go", "_k.K.In", "_k.K.In.deep", "_k.F", "sub._s.In", "sub._s.In.lost", "sub._s.go", "sub._s.other", "K", "K.go", "K.In", "F", "K.other"],
    ),
    # Names that modules have already stay theirs; methods are no targets; stubs stand in for modules.
    "taken": ({"__init__.py": "from ._t import f, m, S\ndef f(): ...\n", "_t.pyi": "def f(x): ...\nclass C:\n def m(self): ...\nclass S:\n def a(self): ...\n def a(self, again): ...\n"}, ["f", "_t.f", "_t.C", "_t.C.m", "_t.S", "_t.S.a", "_t.S.a", "S", "S.a"]),
    "noinit": ({"mod.py": "def f(): ...\n", "deep/__init__.py": "from ..mod import f\n"}, ["mod.f"]),
    "broken": ({"__init__.py": "from ._a import (\n", "_a.py": "def X(): ...\n"}, ["_a.X"]),
}


def test_reexports(spark):
    """Many packages in one plan, each as by itself."""
    rows = [(k, f"{k}/{p}", t) for k, (files, _) in PACKAGES.items() for p, t in files.items()] + [("empty", "empty/data.txt", None)]
    files = spark.createDataFrame(rows, "source_key string, path string, text string").repartition(3)
    beside = lambda missing: missing.filter("module = 'six_like'").selectExpr("source_key", "module", "'six_like.py' as path", "'/at/six_like.py' as file_path", "'def X(): ...' as text")
    got = reexports.symbols(files, beside).collect()
    for k, (_, names) in PACKAGES.items():
        mine = sorted((r for r in got if r.source_key == k), key=lambda r: r.seq)
        assert [r.seq for r in mine] == list(range(len(names)))
        assert [r.qualified_name for r in mine] == [f"{k}.{n}" for n in names]
    found = {r.qualified_name: r for r in got}
    assert found["beside.X"].file_path == "/at/six_like.py" and found["shadowed.Thing"].symbol_type == "module" and found["first.X"].signature == "(a)"
    assert found["members.K.go"].symbol_type == "method" and {r.source_key for r in got} == set(PACKAGES)


def test_catalogue(spark, site, tmp_path):
    venv = tmp_path / ".venv"
    project = tmp_path / "proj"
    write(project, {"pyproject.toml": "", "main.py": '"""Main."""\ndef start(): ...\n', "lib/__init__.py": "class Tool: ...\n", ".hidden/x.py": "def no(): ...\n", "__init__.py": "def root(): ...\n"})
    catalog = Catalog(spark, str(tmp_path / "catalog"))
    assert catalog.stats() == {"error": "No index found. Build one first."} and catalog.is_stale(venv)
    with pytest.raises(RuntimeError, match="build"):
        catalog.symbols()
    assert catalog.build(venv, [project]) == 17
    assert catalog.build(venv, [project]) == -1 and not catalog.is_stale(venv)
    names = {r.qualified_name for r in catalog.symbols().collect()}
    assert {"shapes.Circle.area", "shapes.Box", "single.fetch", "pointed.here", "main", "main.start", "lib.Tool", "spaced.inner.far"} <= names and not any("hidden" in n or "secret" in n or "root" in n for n in names)

    found = catalog.find("Circle").orderBy("rank").collect()
    assert found[0].qualified_name in ("shapes.Circle", "shapes._impl.Circle") and found[0].tier == "fts"
    assert [r.qualified_name for r in catalog.find("Circl").collect()] and catalog.find("  ").count() == 0
    assert catalog.find("round thing").first().stage == "docstring"
    assert {r.tier for r in catalog.find("Sqare").collect()} == {"fuzzy"}
    assert {r.qualified_name for r in catalog.find("shapes.flat").collect()} == {"shapes.flat.Shape", "shapes.flat.Square"}
    assert "shapes.flat.Shape.scale" in {r.qualified_name for r in catalog.find("Square.scale").collect()}
    for hostile in ("(", "NOT", '"', "a.b.c.d", "\\"):
        catalog.find(hostile).collect()
    detail = catalog.show("shapes.Circle")
    assert detail.startswith("class: shapes.Circle\nsignature: (Shape)\ndocstring: A round thing.\nlocation: ") and "members:\n  method   area(self) -> float" in detail
    assert isinstance(catalog.show("Circel"), list) and [r.name for r in catalog.members("Box").collect()] == ["area"]
    assert catalog.stats()["by_type"]["async_function"] == 1
    assert hint(0, 3, True).startswith("Showing") and hint(1, 0, True) is None and hint(0, 0, False).startswith("Not in")

    write(site, {"single.py": "def other(): ...\n"})
    os.utime(site / "single.py", (2e9, 2e9))
    (project / "main.py").unlink()
    os.utime(project, (2e9, 2e9))
    assert catalog.is_stale(venv) and catalog.build(venv) == 2
    names = {r.qualified_name for r in catalog.symbols().collect()}
    assert "single.other" in names and "single.fetch" not in names and "main.start" not in names and "lib.Tool" in names
    import shutil

    shutil.rmtree(site / "spaced")
    assert catalog.clean() == ["spaced"] and "spaced.inner.far" not in {r.qualified_name for r in catalog.symbols().collect()}


def test_command_line(spark, site, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    run = lambda *a: cli.main(["--catalog", str(tmp_path / "c"), *a], spark)
    assert run("index") == 0 and "Indexed" in capsys.readouterr().out
    assert run("find", "Square", "-t", "class") == 0 and "class    Square(Shape)" in capsys.readouterr().out
    assert cli.main(["fetch", "--catalog", str(tmp_path / "c")], spark) == 0 and "async_function fetch(url)" in capsys.readouterr().out
    assert run("show", "nothing_like_it_at_all") == 1 and run("members", "shapes.Box") == 0 and run("stats") == 0 and run("clean") == 0


def test_changes_arrive_by_stream(spark, tmp_path):
    schema = "qualified_name string, seq long, docstring string"
    source, state = str(tmp_path / "in"), {"now": None}
    spark.createDataFrame([("a", 1, "old"), ("b", 2, "x"), ("a", 3, "new")], schema).write.parquet(f"{source}/1")
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source)
    keep = lambda df: state.update(now=spark.createDataFrame(df.collect(), schema))
    follow(stream(), lambda: state["now"], keep, str(tmp_path / "cp")).awaitTermination()
    assert {(r.qualified_name, r.docstring) for r in state["now"].collect()} == {("a", "new"), ("b", "x")}
    spark.createDataFrame([("b", 1, "y"), ("c", 2, "z")], schema).write.parquet(f"{source}/2")
    follow(stream(), lambda: state["now"], keep, str(tmp_path / "cp")).awaitTermination()
    assert {(r.qualified_name, r.docstring) for r in state["now"].collect()} == {("a", "new"), ("b", "y"), ("c", "z")}


def test_source_reads_package_by_package(spark, site):
    rows = read_symbols(spark, str(site))
    assert {r.source_key for r in rows.select("source_key").distinct().collect()} == {"shapes", "single", "spaced", "pointed"}
    assert read_symbols(spark, str(site), only=["single"]).count() == 1


def test_hierarchies_have_no_end_but_their_own(spark):
    """70 bases of one class, and a chain of 40 that closes in a circle."""
    rows = [(0, "A", "p.A", "class", [f"q.B{i}" for i in range(70)])]
    rows += [(100 + i, f"B{i}", f"p.B{i}", "class", ["B0", "Root"]) for i in range(70)] + [(300, "Root", "p.Root", "class", [])]
    rows += [(400 + i, "run", f"p.{c}.run", "method", []) for i, c in enumerate(("A", "B3", "B69", "Root"))]
    symbols = spark.createDataFrame(rows, "id long, name string, qualified_name string, symbol_type string, bases array<string>")
    assert navigate.ancestry(symbols, "A") == [*[f"q.B{i}" for i in range(70)], "B0", "Root"] and navigate.ancestry(symbols, "A", 3) == ["q.B0", "q.B1", "q.B2"]
    got = [(r.id, r.turn) for r in navigate.inherited(symbols, "A.run", 10).collect()]
    assert got == [(400, 0), (401, 4), (402, 70), (403, 72)]
    edges = spark.createDataFrame([(f"C{i}", f"C{(i + 1) % 40}") for i in range(40)], "class_name string, base_name string")
    levels = {r.class_name: r.level for r in navigate.closure(edges, "C0").collect()}
    assert levels == {f"C{i % 40}": i for i in range(1, 41)}


def test_ancestors_by_doubling(spark):
    """A chain of 1,000 levels, a class with many ways to one base, and a random graph against a plain search."""
    rng = random.Random(4)
    chain = spark.createDataFrame([(f"L{i}", f"L{i + 1}") for i in range(1000)], "class_name string, base_name string")
    assert {r.class_name: r.level for r in navigate.closure(chain, "L0").collect()} == {f"L{i}": i for i in range(1, 1001)}
    edges = [("D", f"M{i}") for i in range(5)] + [(f"M{i}", "Top") for i in range(5)] + [("M0", "N"), ("N", "Top")]
    edges += [(f"R{rng.randrange(60)}", f"R{rng.randrange(60)}") for _ in range(90)]
    table = spark.createDataFrame(edges, "class_name string, base_name string")
    for start in ("D", "R1", "none"):
        wanted, front, level = {}, {start}, 0
        while front:
            level += 1
            front = {b for a, b in edges if a in front} - set(wanted)
            wanted |= dict.fromkeys(front, level)
        got = {r.class_name: r.level for r in navigate.closure(table, start).collect()}
        assert got == wanted
    assert {r.class_name: r.level for r in navigate.closure(table, "D", 1).collect()} == {f"M{i}": 1 for i in range(5)}
