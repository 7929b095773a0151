"""The jobs over input that grows and changes between runs."""

import os
import re
import shutil

import pytest
from pyspark.sql import functions as F

from jobs import document_index, run, symbol_catalogue
from tomeline.fixtures import TABLES, catalog
from tomeline.operators import fts
from tomeline.plans.segments import Segments

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def files(folder):
    """Data files and when they were written."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_catalogue_follows_its_tables(spark, tmp_path):
    tables, out = str(tmp_path / "tables"), str(tmp_path / "catalogue")
    os.makedirs(tables)
    for t in TABLES:
        shutil.copy(f"{SF}/{t}.parquet", tables)
    names = lambda: sorted((r.id, r.qualified_name, r.source_key) for r in symbol_catalogue.output(spark, out).collect())
    wanted = lambda: sorted((r.id, r.qualified_name, r.qualified_name.rpartition(".")[0]) for r in catalog(spark, tables).collect())

    first = symbol_catalogue.refresh(spark, tables, out)
    assert first["run"] == 1 and first["changed"] == first["removed"] == 0 and first["written"] == len(wanted()) and first["read"] > first["written"]
    assert names() == wanted()
    written = files(out)
    again = symbol_catalogue.refresh(spark, tables, out)
    assert again["run"] == 1 and again["written"] == 0 and again["unchanged"] == first["new"] and files(out) == written

    # One language's documents grow by one, another source goes: only these are written.
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    gone = docs.select("lang", "source").orderBy("lang", "source").first()
    left = docs.filter((F.col("lang") != gone.lang) | (F.col("source") != gone.source))
    home = left.orderBy(F.col("lang").desc(), F.col("source").desc()).first()
    more = left.unionByName(spark.createDataFrame([(9_000_001, "Zebras graze", home.lang, home.source, 12)], docs.schema))
    more.toPandas().to_parquet(f"{tables}/documents.parquet")
    second = symbol_catalogue.refresh(spark, tables, out)
    assert (second["run"], second["new"], second["changed"], second["removed"]) == (2, 0, 1, 1)
    assert {r.source_key for r in spark.read.parquet(f"{out}/rows/run=2").collect()} == {f"docs.{home.lang}.{home.source}"}
    assert written.items() <= files(out).items(), "what was written stays as it is"
    assert names() == wanted()
    segments = Segments(spark, out, stemmed=False)
    found = fts.search(segments.symbols(), segments.index(), "zebra", ("docstring",)).collect()
    assert [r.id for r in found] == [6_000_009_000_001]


def test_index_takes_only_what_is_new(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "index", "checkpoint"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.filter("doc_id < 60").coalesce(2).write.parquet(folder)
    texts = {r.doc_id: (r.lang or "none", r.text) for r in docs.filter("doc_id < 60").collect()}

    def expected():
        counts = {}
        for i, (lang, text) in texts.items():
            for w in words(text):
                counts[i, lang, w] = counts.get((i, lang, w), 0) + 1
        return counts

    def got():
        found, known = document_index.current(spark, out)
        assert {(r.doc_id, r.lang) for r in known.collect()} == {(i, lang) for i, (lang, _) in texts.items()}
        return {(r.doc_id, r.lang, r.term): r.tf for r in found.collect()}

    first = document_index.update(spark, folder, out, checkpoint)
    assert first["read"] == first["documents"] == 60 and first["batches"] == 1 and got() == expected()
    written = files(out)
    assert document_index.update(spark, folder, out, checkpoint) == {"batches": 0, "documents": 0, "postings": 0, "read": 0} and files(out) == written

    # New documents, one that comes again with another text and language, one without text, one twice in a file, one without id.
    rows = [(5, "Neues von der alten Nummer", "de", "web", 1), (700, None, None, None, None), (701, "a", "en", "web", 1), (701, "b b", "en", "web", 1), (None, "lost", "en", "web", 4)]
    spark.createDataFrame(rows, docs.schema).unionByName(docs.filter("doc_id between 60 and 80")).coalesce(1).write.mode("append").parquet(folder)
    texts |= {r.doc_id: (r.lang or "none", r.text) for r in docs.filter("doc_id between 60 and 80").collect()} | {5: ("de", rows[0][1]), 700: ("none", None), 701: ("en", "b b")}
    second = document_index.update(spark, folder, out, checkpoint)
    assert second["read"] == 26 and second["documents"] == 24 and got() == expected()
    assert written.items() <= files(out).items()
    assert {(r.term, r.n_docs, r.n_hits) for r in document_index.terms(spark, out).filter("term = 'neues'").collect()} == {("neues", 1, 1)}

    # A batch whose end was not noted is run again and writes over itself.
    os.remove(f"{checkpoint}/commits/1")
    os.remove(f"{checkpoint}/commits/.1.crc")
    shutil.rmtree(f"{out}/documents/batch=1")
    third = document_index.update(spark, folder, out, checkpoint)
    assert third["read"] == 26 and got() == expected()


def test_no_input_yet(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert document_index.update(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))["read"] == 0
    assert all(t.isEmpty() for t in document_index.current(spark, str(tmp_path / "out")))


def test_command_line(tmp_path, monkeypatch):
    """Settings come from the file, and from the command line before it."""
    config = tmp_path / "c.toml"
    config.write_text('input = "/a"\noutput = "/b"\nfiles = 3\n[spark]\n"spark.x" = "1"\n')
    seen, stopped = {}, []

    class Session:
        class builder:  # noqa: N801
            appName = config = staticmethod(lambda *a, **k: Session.builder)
            getOrCreate = staticmethod(lambda: Session)

        stop = staticmethod(lambda: stopped.append(1))

    monkeypatch.setattr(run, "SparkSession", Session)
    assert run.main(lambda spark, **settings: seen.update(settings), str(config), ["--output", "/c", "--files", "5"]) == 0
    assert seen == {"input": "/a", "output": "/c", "files": 5} and stopped
    for module, name in ((symbol_catalogue, "symbol_catalogue"), (document_index, "document_index")):
        assert os.path.exists(os.path.join(os.path.dirname(module.__file__), f"{name}.toml"))
