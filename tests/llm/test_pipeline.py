"""The corpus pipeline's stages, one by one and together."""

import re

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        assert set(kept[name]) <= set(before)
        if name != "mixing":
            assert docs.columns == COLUMNS and docs.count() == len(kept[name])
        if name in ("toxicity", "near_dups", "decontamination"):
            assert all(before[i] == t for i, t in kept[name].items()) and 0.7 * len(before) < len(kept[name])
        if name == "secrets":
            assert set(before) == set(kept[name]) and not any(re.search(r"[0-9a-f]{16}", t) for t in kept[name].values())
            assert any(pipeline.MASK in t for t in kept[name].values())
            assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0
    copies = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("m")).collect()
    assert copies and all(r.n == r.m <= 3 for r in copies)


def test_edge_rows_pass_every_stage(spark):
    rows = [(None, None, None, None, None, 1.0, "r", True), (1, "", "en", "s", 0, 1.0, "r", True), (2, "a b c d e f g", None, None, 13, None, None, None), (2, "a b c d e f g", None, None, 13, None, None, None), (3, "a b c d e f g", "en", "s", 13, 1.0, "r", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, row string, masked boolean")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        ids = sorted((r.doc_id for r in out.select("doc_id").collect()), key=repr)
        # Of the three rows with one text the smallest id of its own stays; ids that repeat come after it.
        assert ids == ([1, 3, None] if name == "near_dups" else [1, 2, 2, 3, None])
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() <= 12


def test_rows_without_id_are_judged_by_their_text(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 20)
    say = lambda a: " ".join(f"{a}{i}" for i in range(40))
    rows = [(None, say("x"), "en", "s"), (None, say("x"), "en", "s"), (None, say("x"), "de", "t"), (1, say("y"), "en", "s"), (None, say("y"), "en", "s"), (None, say("z"), "en", "s"), (None, f"so {item} so", "en", "s"), (2, f"or {item}", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stages = dict(pipeline.STAGES)
    got = [(r.doc_id, r.text) for r in stages["near_dups"](spark, docs.limit(6), SF).collect()]
    assert sorted(got, key=repr) == sorted([(None, say("x")), (1, say("y")), (None, say("z"))], key=repr)
    short = spark.createDataFrame([(None, "", "en", "s"), (None, "", "en", "s"), (None, "a \x0b b", "en", "s"), (None, "a \x0b b", "en", "s"), (None, None, "en", "s"), (None, None, "en", "s")], docs.schema)
    assert sorted(r.text or "" for r in stages["near_dups"](spark, short, SF).collect()) == ["", "", "", "", "a \x0b b"]
    got = [(r.doc_id, r.text) for r in stages["decontamination"](spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted([r[:2] for r in rows[:6]], key=repr)


def test_no_row_goes_because_its_id_repeats(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 20)
    say = lambda a: " ".join(f"{a}{i}" for i in range(40))
    rows = [(7, say("x"), "en", "s"), (7, say("y"), "en", "s"), (7, say("y"), "en", "s"), (7, "", "en", "s"), (7, "", "en", "s"), (9, say("x"), "en", "s"), (8, f"so {item}", "en", "s"), (8, say("z"), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stages = dict(pipeline.STAGES)
    got = sorted((r.doc_id, r.text) for r in stages["near_dups"](spark, docs, SF).collect())
    assert got == sorted([(9, say("x")), (7, say("y")), (7, ""), (7, ""), (8, f"so {item}"), (8, say("z"))])
    got = sorted((r.doc_id, r.text) for r in stages["decontamination"](spark, docs, SF).collect())
    assert got == sorted((i, t) for i, t, *_ in rows if i != 8 or not t.startswith("so "))


def test_very_long_texts_pass_every_stage(spark):
    long = " ".join(f"w{i % 5000}" for i in range(250_000))
    docs = spark.createDataFrame([(1, long, "en", "s", len(long), 1), (2, long + " the end", "en", "s", 0, 1), (3, "a " * 200_000, None, None, 0, 1), (4, "short one", "en", "t", 9, 1)], "doc_id long, text string, lang string, source string, n_chars long, copy int")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF).collect()
        assert {r.doc_id for r in out} == ({1, 3, 4} if name == "near_dups" else {1, 2, 3, 4}) or name == "mixing"
        assert all(r.text == {1: long, 2: long + " the end", 3: "a " * 200_000, 4: "short one"}[r.doc_id] for r in out)


def test_ids_and_columns_of_any_kind(spark):
    """Text ids, which order as text, and columns that bear the names of a stage's own."""
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) >= 20)
    say = lambda a: " ".join(f"{a}{i}" for i in range(40))
    rows = [("b", say("x"), "s", 5, "c"), ("a10", say("x"), "s", 6, "c"), ("a9", say("x") + " more", "s", 7, None), (None, say("x"), "s", 8, "d"), ("z", f"so {item}", "t", 9, "d"), ("y", None, "t", 9, "d")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, size int, copy string")
    expected = {"toxicity": {"a10", "a9", "b", None, "y", "z"}, "near_dups": {"a10", "y", "z"}, "decontamination": {"a10", "a9", "b", None, "y"}, "secrets": {"a10", "a9", "b", None, "y", "z"}}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == expected[name]
    mixed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.columns == ["doc_id", "source", "size_", "copy_", "text", "size", "copy"]
    assert {(r.doc_id, r["size"], r["copy"]) for r in mixed.collect()} <= {(r[0], r[3], r[4]) for r in rows}
