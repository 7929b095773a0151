"""License scans by MinHash bands over overlapping text windows, in DataFrame operations only.

Templates fall into classes of similar length. For a class whose longest template has c words, windows
of c + c / 4 words begin every c / 4 words, so each occurrence of a template lies whole in some window.
As no template of a class is much shorter than its longest, a window that holds one (or the 80 % of its
five-word shingles that a match needs) resembles it: :func:`least_similarity` has the least Jaccard
similarity of the class. A band is one MinHash sample, which the two share with that probability;
:func:`bands` takes so many that a match is missed with a chance under ``MISS``. Windows meet the
templates with which they share a band, and exact shingle containment decides.

A template of fewer than five words makes one shingle, and its windows are of its own length: they are
equal or not, and one band always tells.

Before that, windows are dropped that lack every word of a screen. The screen is derived from the
templates so that no match can lack it: for each template, the shingles without a screen word are too
few to be a match. Texts are cut into overlapping blocks first, so that no row holds more than a block.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

SHINGLE = 5
PERCENT = 80
#: Highest chance that a window of a match shares no band with its template.
MISS = 1e-6
#: A class holds templates down to this share of its longest one's words.
SPREAD = 0.8
#: Words at which the windows of one row begin.
BLOCK = 512


def _words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def _needed(n: int) -> int:
    """How many of n shingles make a match."""
    return -(-PERCENT * n // 100)


def _count(words: list[str]) -> int:
    """Distinct shingles of a template."""
    return len({tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}) or 1


def _classes(templates: tuple[tuple[str, str], ...]) -> dict[int, list[int]]:
    """Template numbers by class; a class c holds templates of c words down to SPREAD * c, or of c words alone if these make no shingle."""
    sizes = sorted(((len(_words(t)), i) for i, (_, t) in enumerate(templates)), reverse=True)
    out: dict[int, list[int]] = {}
    for n, i in sizes:
        c = next((c for c in out if n == c or (n >= SPREAD * c and n >= SHINGLE)), n)
        out.setdefault(c, []).append(i)
    return out


def _shape(c: int) -> tuple[int, int]:
    """Length and step of a class's windows."""
    return (c + max(1, c // 4), max(1, c // 4)) if c >= SHINGLE else (c, 1)


def least_similarity(templates: tuple[tuple[str, str], ...], c: int, ids: list[int]) -> float:
    """The least Jaccard similarity of a template of class c and a window that holds a match of it."""
    if c < SHINGLE:
        return 1.0
    window = _shape(c)[0] - SHINGLE + 1
    counts = [_count(_words(templates[i][1])) for i in ids]
    return min(_needed(n) / (n + window - _needed(n)) for n in counts)


def bands(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> int:
    """So many bands that the least similar match of any class is missed with a chance under MISS."""
    least = min(least_similarity(templates, c, ids) for c, ids in _classes(templates).items())
    return 1 if least == 1 else math.ceil(math.log(MISS) / math.log(1 - least))


def screen(templates: tuple[tuple[str, str], ...]) -> list[str]:
    """Words of which every text that matches a template has one."""
    chosen: list[str] = []
    for _, text in templates:
        w = _words(text)
        shingles = [w[i : i + SHINGLE] for i in range(len(w) - SHINGLE + 1)] or [w]
        need = _needed(_count(w))
        while len({tuple(s) for s in shingles if not set(s) & set(chosen)}) >= need:
            chosen.append(max((x for s in shingles if not set(s) & set(chosen) for x in s), key=lambda x: (len(x), x)))
    return chosen


def _shingled(words: str, n: int) -> str:
    """SQL: hashes of the n-word shingles of an array column, by place."""
    hashes = ", ".join(f"get({words}, i + {j})" for j in range(n))
    return f"CASE WHEN size({words}) >= {n} THEN transform(sequence(0, size({words}) - {n}), i -> xxhash64({hashes})) ELSE array() END"


def _template_rows(spark: SparkSession, templates: tuple[tuple[str, str], ...], n: int) -> DataFrame:
    """(class, license, tpl, band, key): one row for each template of the fixed list and band."""
    rows = [(c, templates[i][0], _words(templates[i][1])) for c, ids in _classes(templates).items() for i in ids]
    found = spark.createDataFrame(rows, "class int, license string, tw array<string>")
    by_size = F.lit(None).cast("array<bigint>")
    for size in sorted({min(c, SHINGLE) for c, _, _ in rows}):
        by_size = F.when(F.least("class", F.lit(SHINGLE)) == size, F.expr(_shingled("tw", size))).otherwise(by_size)
    found = found.select("class", "license", F.array_distinct(by_size).alias("tpl"))
    keys = F.array(*[F.array_min(F.expr(f"transform(tpl, x -> xxhash64(x, {b}))")) for b in range(n)])
    return found.select("class", "license", "tpl", F.posexplode(keys).alias("band", "key")).filter((F.col("class") >= SHINGLE) | (F.col("band") == 0))


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, n_windows, first_word) for each license whose notice a document has.

    Words are lower-cased runs of a-z and 0-9. containment is the best share of a template's shingles
    in one window, n_windows counts the windows that match and first_word is the first of them, as a
    word index. A text that holds another license's text as a part has a row for each. Null and empty
    texts and those without a notice have no row. Rows that repeat a doc_id count together, rows
    without one as one document. Other columns are ignored.
    """
    spark, classes, n = docs.sparkSession, _classes(templates), bands(templates)
    words = screen(templates)
    lower = F.lower(F.col(text_col))
    any_word = F.lit(False)
    for w in words:
        any_word = any_word | F.contains(lower, F.lit(w))
    rows = docs.filter(any_word).select(F.col(id_col).alias("doc_id"), F.filter(F.split(lower, "[^a-z0-9]+"), lambda x: x != "").alias("w"))
    # Places of screen words; the blocks in which windows over them begin.
    longest = max(_shape(c)[0] for c in classes)
    near = F.array(*[F.lit(w) for w in words])
    rows = rows.withColumn("near", near).withColumn("at", F.expr("filter(transform(w, (x, i) -> CASE WHEN array_contains(near, x) THEN i END), i -> i IS NOT NULL)")).drop("near")
    blocks = F.expr(f"array_distinct(flatten(transform(at, i -> sequence(cast(greatest(0, i - {longest - 1}) div {BLOCK} AS int), cast(i div {BLOCK} AS int)))))")
    cut = f"struct(k * {BLOCK} AS base, slice(w, k * {BLOCK} + 1, {BLOCK + longest}) AS w, filter(at, i -> i >= k * {BLOCK} AND i < (k + 1) * {BLOCK} + {longest}) AS at)"
    rows = rows.filter(F.size("at") > 0).withColumn("blocks", blocks).select("doc_id", F.explode(F.expr(f"transform(blocks, k -> {cut})")).alias("b"))
    rows = rows.select("doc_id", "b.base", "b.w", F.expr("transform(b.at, i -> i - b.base)").alias("at"))
    # Shingle hashes by place, for each shingle size, and under the hash function of each band.
    sizes = sorted({min(c, SHINGLE) for c in classes})
    rows = rows.select("doc_id", "base", "at", F.size("w").alias("n"), *[F.expr(_shingled("w", s)).alias(f"h{s}") for s in sizes])
    for s in sizes:
        samples = [F.expr(f"transform(h{s}, x -> xxhash64(x, {b}))") for b in range(n if s == SHINGLE else 1)]
        rows = rows.withColumn(f"m{s}", F.array(*samples))
    # Windows (class, start, shingles, keys) over some screen word; the last one may be cut short by the text's end.
    made = []
    for c in classes:
        s, (size, step) = min(c, SHINGLE), _shape(c)
        starts = f"array_distinct(flatten(transform(at, i -> transform(sequence(cast(greatest(0, ceil((i - {size - 1}) / {step})) AS int), cast(i div {step} AS int)), k -> k * {step}))))"
        fits = f"filter({starts}, k -> k < {BLOCK} AND k + {s} <= n)"
        took = size - s + 1
        made.append(f"transform({fits}, k -> struct({c} AS class, k AS start, slice(h{s}, k + 1, {took}) AS shingles, transform(m{s}, m -> array_min(slice(m, k + 1, {took}))) AS keys))")
    rows = rows.select("doc_id", "base", F.explode(F.expr(f"concat({', '.join(made)})")).alias("x"))
    rows = rows.select("doc_id", (F.col("base") + F.col("x.start")).alias("start"), "x.class", "x.shingles", F.posexplode("x.keys").alias("band", "key"))
    # The template table is the fixed list above, so its size has a bound.
    met = rows.join(F.broadcast(_template_rows(spark, templates, n)), ["class", "band", "key"])
    share = F.size(F.array_intersect("shingles", "tpl")) / F.size("tpl")
    met = met.withColumn("containment", F.round(share, 6)).filter(share * 100 >= PERCENT)
    return met.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.count_distinct("start", "class").alias("n_windows"), F.min("start").cast("long").alias("first_word"))

