"""Full-text index and ranked prefix search.

The index is a table of postings (id, col, term, tf) with document lengths and corpus totals. A term
of the query finds all postings that begin with it; scores are BM25 over what those terms hit.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import query_terms, valid_terms
from ..functions.porter import porter_stem, stem
from ..schema import FETCH_CAP

COLUMNS = ("name", "qualified_name", "docstring")
K1, B = 1.2, 0.75


def _fold_map() -> tuple[str, str]:
    """Latin letters with diacritics and the plain letter that each decomposes to."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_MARKED, _PLAIN = _fold_map()


def tokens(column: Column | str, fold: bool = True) -> Column:
    """Lower-cased runs of letters and digits, without diacritics if ``fold``."""
    low = F.lower(column)
    return F.filter(F.split(F.translate(low, _MARKED, _PLAIN) if fold else low, r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # id, col, term, tf
    lengths: DataFrame  # id, dl
    totals: DataFrame  # one row: n, avgdl
    stemmed: bool

    def cached(self) -> Index:
        """The same index, held by the executors for several searches."""
        lengths = self.lengths.cache()
        return Index(self.postings.cache(), lengths, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).cache(), self.stemmed)


def build(symbols: DataFrame, stemmed: bool = True) -> Index:
    """The index of a catalogue, over rows that are unique by name, so replaced rows leave nothing behind."""
    words = forward(symbols, stemmed)
    postings = postings_of(words, stems_of(words) if stemmed else None)
    if stemmed:
        postings = postings.groupBy("id", "col", "term").agg(F.sum("tf").alias("tf"))
    lengths = words.select("id", "dl")
    return Index(postings, lengths, totals_of(lengths), stemmed)


def counted(rows: DataFrame, words: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each name, an array of (term, tf), the distinct words of an array and how often it has them, and ``<name>_n``, the number of all.

    A row is counted by itself: its words are sorted, and equal ones lie side by side. So nothing is
    shuffled, and a task holds no more than a row.
    """
    rows = rows.withColumns({f"{n}_sorted": F.sort_array(w) for n, w in words.items()})
    # Where runs of equal words begin, and the end.
    begins = lambda n: F.filter(F.sequence(F.lit(0), F.size(f"{n}_sorted")), lambda i: (i == 0) | ~F.get(f"{n}_sorted", i).eqNullSafe(F.get(f"{n}_sorted", i - 1)))
    rows = rows.withColumns({f"{n}_at": begins(n) for n in words})
    run = lambda n: lambda at, j: F.struct(F.get(f"{n}_sorted", at).alias("term"), (F.get(f"{n}_at", j + 1) - at).cast("long").alias("tf"))
    rows = rows.withColumns({n: F.transform(F.slice(f"{n}_at", F.lit(1), F.size(f"{n}_at") - 1), run(n)) for n in words})
    rows = rows.withColumns({f"{n}_n": F.size(f"{n}_sorted").cast("long") for n in words})
    return rows.drop(*[f"{n}_{c}" for n in words for c in ("sorted", "at")])


def forward(symbols: DataFrame, fold: bool, *kept: str) -> DataFrame:
    """The index by symbol: id, the columns ``kept``, an array of (term, tf) for each column that is searched, ``in_<column>``, and dl, the number of all words."""
    found = counted(symbols, {f"in_{c}": tokens(F.coalesce(F.col(c), F.lit("")), fold) for c in COLUMNS})
    return found.select("id", *kept, *[f"in_{c}" for c in COLUMNS], reduce(add, [F.col(f"in_{c}_n") for c in COLUMNS]).alias("dl"))


def stems_of(words: DataFrame) -> DataFrame:
    """(term, stem) of the words of a :func:`forward` index that their stems differ from; each distinct word crosses to Python once."""
    distinct = postings_of(words, None).select("term").distinct()
    return distinct.withColumn("stem", porter_stem("term")).filter("stem <> term")


def postings_of(words: DataFrame, stems: DataFrame | None, *kept: str) -> DataFrame:
    """(id, the columns ``kept``, col, term, tf) of a :func:`forward` index; with ``stems``, a symbol has a row for each word of a stem."""
    parts = [words.select("id", *kept, F.lit(c).alias("col"), F.explode(f"in_{c}").alias("w")).select("id", *kept, "col", "w.term", "w.tf") for c in COLUMNS]
    rows = reduce(DataFrame.unionByName, parts)
    return rows if stems is None else rows.join(stems, "term", "left").withColumn("term", F.coalesce("stem", "term")).select(rows.columns)


#: Postings that a task sorts.
PART_ROWS = 500_000


def by_term(words: DataFrame, stems: DataFrame | None, *kept: str) -> DataFrame:
    """:func:`postings_of`, range-partitioned and sorted by term and id; rows of one stem are added up where they meet, without a shuffle of their own.

    The number of parts follows the number of postings, so the memory of a task doesn't.
    """
    n = words.agg(F.sum(reduce(add, [F.size(f"in_{c}").cast("long") for c in COLUMNS]))).first()[0] or 0
    rows = postings_of(words, stems, *kept).repartitionByRange(1 + n // PART_ROWS, "term", "id")
    if stems is not None:
        rows = rows.groupBy("id", *kept, "col", "term").agg(F.sum("tf").alias("tf"))
    return rows.sortWithinPartitions("term", "id")


def totals_of(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def match(index: Index | Callable[[], Index], query: str, columns: tuple[str, ...]) -> DataFrame | None:
    """(id, score) of what holds all terms, the best having the lowest score; None if the query doesn't parse.

    The first term must be in ``columns``; the others may be in any column.
    """
    terms = query_terms(query)
    if not valid_terms(terms):
        return None
    index = index if isinstance(index, Index) else index()
    prefixes = [stem(t.lower()) if index.stemmed else t.lower() for t in terms]
    wanted = F.array(
        *[
            F.when(F.col("term").startswith(p) & (F.col("col").isin(*columns) if i == 0 else F.lit(True)), i)
            for i, p in enumerate(prefixes)
        ]
    )
    any_prefix = F.lit(False)
    for p in prefixes:
        any_prefix = any_prefix | F.col("term").startswith(p)
    hits = index.postings.filter(any_prefix).select("id", "tf", F.explode(F.filter(wanted, lambda x: x.isNotNull())).alias("t"))
    hits = hits.groupBy("id", "t").agg(F.sum("tf").cast("double").alias("f"))
    # One row for each term of the query.
    counts = F.broadcast(hits.groupBy("t").agg(F.count("*").cast("double").alias("ni")))
    totals = F.broadcast(index.totals)
    one = F.lit(1.0)
    idf = F.log((F.col("n") - F.col("ni") + 0.5e0) / (F.col("ni") + 0.5e0))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    norm = F.col("f") + F.lit(K1) * (one - F.lit(B) + F.lit(B) * F.col("dl") / F.col("avgdl"))
    scored = hits.join(counts, "t").join(index.lengths, "id").crossJoin(totals).withColumn("part", idf * (F.col("f") * F.lit(K1 + 1) / norm))
    return scored.groupBy("id").agg(F.count("*").alias("met"), F.negative(F.sum("part")).alias("score")).filter(F.col("met") == len(prefixes)).select("id", "score")


def search(symbols: DataFrame, index: Index | Callable[[], Index], query: str, columns: tuple[str, ...], symbol_type: str | None = None, cap: int = FETCH_CAP) -> DataFrame | None:
    """The ``cap`` best symbols (with score), ties by id; None if the query doesn't parse."""
    found = match(index, query, columns)
    if found is None:
        return None
    if symbol_type is not None:
        found = found.join(symbols.filter(F.col("symbol_type") == symbol_type).select("id"), "id", "left_semi")
    # Ranked as (id, score): whole rows, with their texts, are fetched for ``cap`` ids at most, which are few enough to broadcast.
    # Floating sums depend on the order of addition; twelve places are enough to tell scores apart.
    best = found.orderBy(F.round("score", 12), "id").limit(cap)
    return symbols.join(F.broadcast(best), "id")


def idf(n: int, having: int) -> float:
    """The weight of a term that ``having`` of ``n`` documents hold."""
    w = math.log((n - having + 0.5) / (having + 0.5))
    return w if w > 0 else 1e-6
