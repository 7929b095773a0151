"""Quality rules as a short-circuit cascade, in DataFrame operations only.

The counts that every row reports are computed for all rows. Further rules run as one CASE
expression, so a row that one rule rejects never reaches the next. Their order comes from a sample:
each rule's cost is the time its expression takes over many copies of the sample's rows, less that of
a rule that does nothing, and the next rule is always the one that rejects most per cost of the rows
that those before it have left. The order changes how fast rows are judged, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Rows that the sample for costs and selectivities holds, about.
SAMPLE_ROWS = 2000
#: Times that each of its rows is judged in one run that measures a cost.
COPIES = 2

_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A reason to reject a row; ``fails`` is an SQL condition over the base counts and the text."""

    name: str
    fails: str


RULES = (
    # More than a symbol for every ten words: markup, tables, garbage.
    Rule("symbols", "n_symbols * 10 > n_words"),
    # Mean word length that no prose has.
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    # Most lines repeat earlier ones.
    Rule("repeated_lines", "n_dup_lines * 2 > size(split(text, '\\n'))"),
    # Under half of the characters in words are letters of any script.
    Rule("letters", "length(regexp_replace(text, '[^\\\\p{L}\\\\p{M}]+', '')) * 2 < word_chars"),
    # Over 40 % of the characters in words are capitals.
    Rule("capitals", "length(regexp_replace(text, '[^\\\\p{Lu}]+', '')) * 5 > word_chars * 2"),
    # More than one word in ten ends in an ellipsis or is a bullet.
    Rule("ellipses", "regexp_count(text, '\\\\.\\\\.\\\\.|\\u2026|(^|\\n)[ \\t]*[-\\u2022\\u25cf]') * 10 > n_words"),
    # Filler that stands where text is missing.
    Rule("filler", "lower(text) LIKE '%lorem ipsum%'"),
)


def _once(column: Column) -> Column:
    """The column as one that Catalyst computes once, where it stands.

    Filters are pushed through projections by putting the expression in the place of its name. Inside
    a lambda that would compute a whole array again for each element. A nondeterministic part, though
    always true, keeps them above.
    """
    return F.when(F.spark_partition_id() >= 0, column)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null becomes empty), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, _SPACE, "") != "")
    spaced = F.translate("text", _SPACE, " " * len(_SPACE))
    rows = rows.select("doc_id", "text", _once(F.array_remove(F.split(spaced, " "), "")).alias("w"), _once(lines).alias("lines"))
    windows = F.expr("transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)))")
    rows = rows.withColumn("h", _once(F.when(F.size("w") >= 3, windows)))
    # Most texts repeat no window. For the others, windows as (hash, place), sorted, so that equal ones are neighbours.
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("win", _once(F.when(repeats, F.expr("sort_array(transform(h, (x, i) -> struct(x AS h, i AS p)))"))))
    # Places of those whose neighbour on either side is equal.
    twice = F.expr("sort_array(transform(filter(transform(win, (x, j) -> struct(x.p AS p, x.h = get(win, j - 1).h OR x.h = get(win, j + 1).h AS d)), x -> x.d), x -> x.p))")
    rows = rows.withColumn("twice", _once(twice))
    # Each covers its three words; those before `e` are counted already.
    covered = F.expr("aggregate(twice, struct(0 AS e, 0L AS c), (a, p) -> struct(p + 3 AS e, a.c + least(3, p + 3 - a.e) AS c), a -> a.c)")
    return rows.select(
        "doc_id",
        "text",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ordered(scratch: Scratch, docs: DataFrame, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules in the order in which they run, with their cost (seconds a row) and the share they reject of the sampled rows that reach them."""
    total = docs.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    sample = docs.sample(fraction=min(1.0, rows / total), seed=7)
    sample = scratch.table("sample", base_counts(sample).filter(~base_failed()))
    n = max(sample.count(), 1)
    # How many rows each set of rules rejects: a count for each set that occurs.
    verdicts = [F.coalesce(F.expr(r.fails), F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules)]
    sets = [(set(i for i in range(len(rules)) if x[i]), x["n"]) for x in sample.select(*verdicts).groupBy(*[f"r{i}" for i in range(len(rules))]).agg(F.count("*").alias("n")).collect()]

    copies = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).repartition(1).cache()
    copies.count()

    def seconds(condition: Column) -> float:
        # The copy's number keeps the condition above the copying.
        judged, times = copies.filter(F.when(F.col("copy") > 0, condition)), []
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            judged.count()
            times.append(time.perf_counter() - began)
        return min(times)

    idle = seconds(F.length("text") >= 0)
    cost = [max(seconds(F.expr(r.fails)) - idle, 1e-4) / (n * COPIES) for r in rules]
    copies.unpersist()
    scratch.drop("sample")
    found, left = [], list(range(len(rules)))
    while left:
        rejects = {i: sum(k for s, k in sets if i in s) for i in left}
        best = max(left, key=lambda i: (rejects[i] / cost[i], -cost[i]))
        found.append((rules[best], cost[best], rejects[best] / max(sum(k for _, k in sets), 1)))
        sets = [(s, k) for s, k in sets if best not in s]
        left.remove(best)
    return found


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    Base: too few words (under 50) or more than half of the words in three-word windows that occur
    twice; then the cascade of ``rules``. Words are runs outside ASCII white space. A null or empty
    text has zero counts and fails the base. doc_id may be null and may repeat; rows are judged one
    by one. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cascade = F.when(F.col("base_failed"), False)
    for rule, _, _ in ordered(scratch, named, rules):
        cascade = cascade.when(F.expr(rule.fails), False)
    out = base_counts(named).withColumn("base_failed", base_failed())
    return out.withColumn("kept", cascade.otherwise(True)).drop("text")
