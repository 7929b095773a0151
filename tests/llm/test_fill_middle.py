"""Fill-in-the-middle against its definition, spelt out per document."""

import hashlib
import random

import pytest
import regex

from tomeline.llm.fill_middle import fill_in_middle, restored

SCHEMA = "doc_id long, text string, n long, form string, output string, cut string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    lines = text.split("\n")
    units = [x + "\n" for x in lines[:-1]] + [x for x in lines[-1:] if x]
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < spm_rate:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [None, "", "\n", "\n\n", "a", "a\n", "\na", "a\r\nb\x0bc d\n", "x<P>y\n", "<S", "<\n<\n<\n<", "<S\n>P>\n", "M>\n<M\n>", "é\n😀\nß", "<M>", "a\nb\nc\nd"]
    texts += ["".join(rng.choice("ab<>PSM\né😀") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts += ["\n".join(["word " * rng.randint(0, 30)] * 2000), "no end " * 300_000]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc"), (None, None), (4, "same\nid\n"), (4, "same\nid\n"), (-5, "x\ny\nz\n")]


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (40, 100)])
def test_equals_definition(spark, rows, rate, spm_rate):
    docs = spark.createDataFrame([(i, t, 1, "f", "o", "c") for i, t in rows], SCHEMA).repartition(3)
    out = fill_in_middle(docs, rate=rate, spm_rate=spm_rate, keep=["n", "cut"])
    got = out.collect()
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256", "kept"]
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((expected(i, t, rate, spm_rate) for i, t in rows), key=repr)
    assert {r.form for r in got} == ({"plain", "spm", "psm"} if spm_rate < 100 else {"plain", "spm"})
    assert all(r.output_sha256 == sha(r.output) and r.kept == (1, "c") for r in got)
    assert sorted(r.restored_sha256 for r in got) == sorted(sha(t or "") for _, t in rows)
    assert all(restored(r.output, r.form) == restored(r.output, r.form) for r in got)


def test_other_units_and_ids(spark):
    docs = spark.createDataFrame([("a", "one two  three"), ("b", "x")], "name string, body string")
    r = {r.doc_id: r for r in fill_in_middle(docs, unit=r"\S+\s*", id_col="name", text_col="body").collect()}
    assert r["a"].n == 3 and r["b"].n == 1 and sha("one two  three") == r["a"].restored_sha256
    assert regex.search("one |two  |three|^", r["a"].output)


def test_empty_table(spark):
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
