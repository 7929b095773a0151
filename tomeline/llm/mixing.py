"""Mixing sources to target weights.

Token counts are summed by source; the targets follow from weights and a cap on repetition; each
document comes out floor(rate) times, and once more with the probability of the rate's fraction. All
of it is DataFrame operations, and no text is shuffled.

The draw of a document is a hash of its own id and a seed, so documents draw independently. One such
draw leaves a source of a few hundred documents ten percent or more off its target. So ``SEEDS`` seeds
are tried in one aggregate over (source, size, id), which adds up before its shuffle, and each source
uses the one that brings it nearest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WEIGHTS = (5, 2, 1)
#: Seeds tried for each source.
SEEDS = 32
WORDS = r"[^\x20\x09-\x0D]+"


def _ranked(scratch: Scratch, sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Sources with their weight by rank, code points ascending and null last.

    A range sort; each row's rank is the number of rows in the partitions before its own plus its place
    in its own, so no task sees all sources.
    """
    ordered = scratch.table("ordered", sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r.part: r["count"] for r in ordered.groupBy(part.alias("part")).count().collect()}  # a number for each partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    offset = F.lit(0)
    if before:
        offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((offset + place) % len(weights) + 1).cast("int"))
    return scratch.table("ranked", ordered.select("source", "source_size", "n_docs", weight.cast("long").alias("weight")))


def targets(scratch: Scratch, sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, n_docs, target): shares by weight of the sum of all sizes, none above ``most`` times its source's size.

    What a cap cuts off is shared out by weight among the others until none is above; each round is a
    sum over the sources.
    """
    ranked = _ranked(scratch, sources, weights)
    all_sizes = ranked.agg(F.sum("source_size")).first()[0] or 0
    left, share, capped = all_sizes, None, -1
    full = F.lit(False)
    while True:
        r = ranked.agg(F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.count(F.when(full, 1))).first()
        left, share = all_sizes - r[0], r[1]
        if r[2] == capped or not share:
            break
        capped = r[2]
        full = F.lit(left).cast("double") * F.col("weight") / F.lit(share) > most * F.col("source_size")
    fair = F.lit(left).cast("double") * F.col("weight") / F.lit(share or 1)
    return ranked.select("source", "source_size", "n_docs", F.least(fair, (most * F.col("source_size")).cast("double")).alias("target"))


def draws(key: Column, seed: str, share: str, n: int = SEEDS) -> list[Column]:
    """Whether a document takes one more copy under each of ``n`` seeds: whether a 52-bit number, the first bits of an MD5 digest, lies under a share of 2 ** 52, as hexadecimal digits."""
    return [F.concat(F.lit("0"), F.substring(F.md5(F.concat(F.lit(f"{seed}:{i}:"), key)), 1, 13)) < F.col(share) for i in range(n)]


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size (words of the text), source_size, target (of its source), copies and taken (copies * size), and, as a struct, kept: the columns of ``keep``.

    Sizes count runs outside ASCII white space; a null or empty text has 0. A null source is a source
    of its own, ranked last. Rows that repeat a doc_id and a source get the same number of copies, as
    only these two decide it; rows without doc_id go by a digest of their text instead. A source
    without words has the target 0 and none of its documents is taken. Of seeds that bring a source
    equally near, the first counts. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    # Rows without an id are told apart by their text.
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")
    columns = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")]
    sized = scratch.table("sized", docs.select(*columns))
    goal = targets(scratch, sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most)
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    share = F.ceil((F.col("rate") - F.floor("rate")) * float(1 << 52))
    goal = goal.withColumn("share", F.lower(F.lpad(F.hex(share), 14, "0"))).withColumnRenamed("source", "source_of").drop("n_docs")
    goal = scratch.table("goal", goal)
    same = F.col("source").eqNullSafe(F.col("source_of"))
    sums = [F.sum(F.when(d, F.col("size")).otherwise(0)).alias(f"s{i}") for i, d in enumerate(draws(F.col("key"), seed, "share"))]
    tried = sized.join(goal.select("source_of", "share"), same).groupBy("source_of").agg(*sums)
    met = goal.join(tried.withColumnRenamed("source_of", "of"), F.col("source_of").eqNullSafe(F.col("of")))
    base = F.floor("rate") * F.col("source_size")
    off = F.array(*[F.struct(F.abs((base + F.col(f"s{i}")).cast("double") - F.col("target")).alias("off"), F.lit(i).alias("at")) for i in range(SEEDS)])
    goal = scratch.table("chosen", met.select("source_of", "source_size", "target", "rate", "share", F.array_min(off)["at"].alias("at")))
    scratch.drop("goal")

    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    # With other columns to keep, sizes are counted once more where the rows are, so that these need not be written.
    rows = docs.select(*columns, *kept) if keep else sized
    out = rows.join(goal, same)
    draw = F.concat(F.lit("0"), F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("at").cast("string"), F.lit(":"), F.col("key"))), 1, 13)) < F.col("share")
    copies = (F.floor("rate") + draw.cast("long")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), *(["kept"] if keep else []))
