"""Benchmark decontamination by greedy string tiling (Wise 1993).

1. *Seeds.* Texts become sequences of lower-cased letter-and-digit tokens, and hashes of ``min_match``
   tokens in a row are the seeds (an item with fewer tokens is one seed of its own length). Only the
   distinct seeds of a document that a fixed-size bitmap of the benchmark's seeds lets pass leave the
   text scan.
2. *Pairs.* A document that covers enough of an item has a seed at so many of the item's places at
   least; so it has one among the item's rarest seeds, all places but that number less one. Documents
   and items meet in those only: a phrase that many items and documents share makes no pair. The places
   met are then counted for each pair, before any text moves.
3. *Tiles.* The texts of the pairs that are left meet, the items of a document dealt out in rows that
   hold about as much text as it does, so a dump of a benchmark is moved about once. The windows of a
   document are sorted once, and each item looks up its own in them. The longest match among free tokens is found by running Karp-Rabin hashes, held
   against the tokens themselves and marked in both texts, until none of ``min_match`` tokens is left.
   As tiles may come in any order, a passage whose sentences were rearranged is covered like the
   original. Matches are never listed as pairs of places, so repetitive texts take no more memory than
   others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch

#: Bits of the bitmaps of seeds and of texts: 1 MB on the driver and in each task, whatever the tables' sizes.
BITMAP_BITS = 1 << 23
_BUCKET = 32768  # bits that Spark's bitmap functions keep in one row
#: Bytes of items in a row of pairs, about, if the document has fewer.
ITEM_BYTES = 1 << 16


def _tokens(text: pa.Array) -> Iterator[tuple[int, int, K.Words, np.ndarray]]:
    text = pc.utf8_lower(text.cast(pa.large_string()))
    for i, j, data, bounds in K.chunks(text):
        yield i, j, K.Words(data, bounds, alphabet=K.ALNUM), data


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = (h & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _item_seeds(k: int):
    """(item key, n_tokens, width, seed, places) of each distinct seed of an item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, words, _ in _tokens(batch.column(1)):
                row, size, width, seed, places = [], [], [], [], []
                for d in range(j - i):
                    a, b = words.first[d], words.first[d + 1]
                    if b == a:
                        continue
                    w = min(k, int(b - a))
                    one = K.Words.__new__(K.Words)
                    one.hash, one.first = words.hash[a:b], np.array([0, b - a])
                    h, n = np.unique(one.windows(w)[0], return_counts=True)
                    row += [i + d] * len(h)
                    size += [int(b - a)] * len(h)
                    width += [w] * len(h)
                    seed.append(h)
                    places.append(n)
                seed = np.concatenate(seed) if seed else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(size, pa.int32()), pa.array(width, pa.int32()), pa.array(seed.view(np.int64)), pa.array(np.concatenate(places) if places else np.zeros(0, np.int64), pa.int64())],
                    names=["item", "n_tokens", "width", "seed", "places"],
                )

    return scan


def _doc_seeds(widths: list[int], bitmap: np.ndarray):
    """(document key, seed) of each distinct seed of a document that the bitmap lets pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, 1):
            for i, _, words, _ in _tokens(batch.column(1)):
                docs, seeds = [], []
                for w in widths:
                    h, inside = words.windows(w)
                    at = np.flatnonzero(inside & _in(bitmap, h)) if len(h) else np.zeros(0, np.int64)
                    docs.append(np.searchsorted(words.first, at, side="right") - 1)
                    seeds.append(h[at] if len(h) else np.zeros(0, np.uint64))
                doc, seed = np.concatenate(docs), np.concatenate(seeds)
                order = np.lexsort((seed, doc))
                doc, seed = doc[order], seed[order]
                once = np.ones(len(doc), dtype=bool)
                once[1:] = (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + doc[once])), pa.array(seed[once].view(np.int64))], names=["doc", "seed"])

    return scan


def _bitmap(seeds: DataFrame, column: str) -> np.ndarray:
    """Which values there are, as BITMAP_BITS bits; at most one 4 KB row for each 32768 bits comes to the driver."""
    bit = F.col(column).bitwiseAND(BITMAP_BITS - 1) + 1  # Spark's buckets of positive numbers begin at 1
    rows = seeds.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for r in rows:
        at = (r.bucket - 1) * (_BUCKET // 8)
        out[at : at + _BUCKET // 8] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return out


class _Rolling:
    """Hashes of all windows of any length over a sequence of token hashes, and which of them are free."""

    def __init__(self, tokens: np.ndarray, free: np.ndarray):
        self.n, self.free = len(tokens), free
        power, self.inverse = K._power_table(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(power[: self.n] * K.mix(tokens), out=self.sums[1:])

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places at which ``size`` free tokens begin, ascending, and their hashes."""
        if size > self.n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.zeros(self.n + 1, dtype=np.int64)
        np.cumsum(~self.free, out=taken[1:])
        at = np.flatnonzero(taken[size:] == taken[: self.n - size + 1])
        return at, (self.sums[at + size] - self.sums[at]) * self.inverse[at]


class Places:
    """Where windows begin in a sequence of token hashes; those of one length are hashed and sorted once."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self._rolling, self._sorted = tokens, _Rolling(tokens, np.ones(len(tokens), bool)), {}

    def of(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Places, ascending, of the windows of ``size`` tokens that have one of the (distinct) hashes."""
        if size not in self._sorted:
            at, h = self._rolling.windows(size)
            order = np.argsort(h, kind="stable")
            self._sorted[size] = at[order], h[order]
        at, h = self._sorted[size]
        first, counts = np.searchsorted(h, hashes, side="left"), np.searchsorted(h, hashes, side="right")
        counts -= first
        each = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else first, counts)
        return np.sort(at[each + np.arange(len(each))])

    def hashes(self, places: np.ndarray, size: int) -> np.ndarray:
        return (self._rolling.sums[places + size] - self._rolling.sums[places]) * self._rolling.inverse[places]


def tile(a: np.ndarray | Places, b: np.ndarray, k: int, same=None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of token hashes: (place in a, place in b, length) of each tile of ``k`` tokens or more.

    The longest match of free tokens is next, of equals the first in b, then the first in a. Its
    length is found by bisection, as a match holds shorter ones. ``same(p, q, n)`` says whether the
    tokens behind the hashes are equal. A sequence that meets many others comes as ``Places``; its
    length then costs nothing, only what it shares with ``b``.
    """
    a = a if isinstance(a, Places) else Places(a)
    if min(len(a.tokens), len(b)) < k:
        return []
    # Only what lies in a window of k tokens that both have can be in a tile.
    y = _Rolling(b, np.ones(len(b), bool))
    at, h = y.windows(k)
    places = a.of(np.unique(h), k)
    inside = np.unique(places[:, None] + np.arange(k))
    hit = at[np.isin(h, a.hashes(places, k))]
    y.free = np.isin(np.arange(y.n), hit[:, None] + np.arange(k))
    # What is left of a, each run of it followed by a token that is never free.
    back = np.union1d(inside, inside + 1)
    back = back[back < len(a.tokens)]
    x = _Rolling(a.tokens[back], np.isin(back, inside))
    tiles, most = [], min(x.n, y.n)
    wrong: set[tuple[int, int, int]] = set()

    def common(size: int) -> bool:
        return bool(np.isin(x.windows(size)[1], y.windows(size)[1]).any())

    while most >= k and common(k):
        low, high = k, most  # common(low) holds
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        at, h = x.windows(low)
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        moved = False
        for q, g in zip(*y.windows(low), strict=True):
            if not y.free[q : q + low].all():
                continue
            s, e = np.searchsorted(h, g, side="left"), np.searchsorted(h, g, side="right")
            for p in at[s:e]:
                if x.free[p : p + low].all() and (p, q, low) not in wrong:
                    if same is not None and not same(int(back[p]), int(q), low):
                        wrong.add((p, q, low))
                        continue
                    x.free[p : p + low] = y.free[q : q + low] = False
                    tiles.append((int(back[p]), int(q), low))
                    moved = True
                    break
        # Without a tile, all matches of this length were chance hits of the hash.
        most = low if moved else low - 1
    return tiles


def _tiler(k: int):
    """doc, text, items as an array of (item, text)."""

    def words_of(text: str) -> tuple[np.ndarray, list[bytes]]:
        _, _, words, data = next(_tokens(pa.array([text], pa.large_string())))
        raw = data.tobytes()
        return words.hash, [raw[s:e] for s, e in zip(words.start, words.end, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, items, sizes, covered, counts = [], [], [], [], []
            for d in range(batch.num_rows):
                a, left = words_of(batch.column(1)[d].as_py())
                a = Places(a)
                for item in batch.column(2)[d].values:
                    b, right = words_of(item["text"].as_py())
                    tiles = tile(a, b, min(k, len(b)), lambda p, q, n, left=left, right=right: left[p : p + n] == right[q : q + n])
                    docs.append(d)
                    items.append(item["item"].as_py())
                    sizes.append(len(b))
                    covered.append(sum(t[2] for t in tiles))
                    counts.append(len(tiles))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs, pa.int64())), pa.array(items, batch.schema.field(2).type.value_type.field("item").type), pa.array(sizes, pa.int32()), pa.array(covered, pa.int32()), pa.array(counts, pa.int32())],
                names=["doc_id", "item_id", "n_tokens", "n_tiled", "n_tiles"],
            )

    return run


def _chosen(bitmap: np.ndarray):
    """Rows whose print (the second column) the bitmap lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_in(bitmap, batch.column(1).to_numpy().view(np.uint64))))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, percent: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_tokens: int = 1) -> DataFrame:
    """Pairs (doc_id, item_id) of which the document covers ``percent`` of the item's tokens or more, with n_tokens of the item, n_tiled, n_tiles and coverage.

    Items of fewer than ``min_match`` tokens match as a whole, a lone name or number too, unless
    ``least_tokens`` asks for more. Null and empty texts, on either side, and rows without an id take part in no pair. Ids may be of any type. Several texts under one
    doc_id (or item_id) are judged each for itself, and a pair reports its best coverage; equal rows
    count once. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("print"), F.octet_length(text).alias("size"), text.alias("text")).filter("doc_id is not null and text <> ''")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).filter("item_id is not null and text <> ''").distinct()
    items = items.select(F.struct("item_id", F.xxhash64("text").alias("print"), F.octet_length("text").alias("size")).alias("item"), "text")
    key, item = dict(texts.select(F.struct("doc_id", "print", "size").alias("k")).dtypes)["k"], dict(items.dtypes)["item"]
    seeds = items.mapInArrow(_item_seeds(min_match), f"item {item}, n_tokens int, width int, seed long, places long").filter(F.col("n_tokens") >= least_tokens)
    seeds = scratch.table("items", seeds)
    bitmap = _bitmap(seeds, "seed")
    widths = sorted(r.width for r in seeds.select("width").distinct().collect())  # min_match of them at most
    hits = texts.select(F.struct("doc_id", "print", "size").alias("doc"), "text").mapInArrow(_doc_seeds(widths or [min_match], bitmap), f"doc {key}, seed long")
    # What the bitmap let pass in error goes here; a seed's count is that of its documents.
    hits = scratch.table("hits", hits)
    often = scratch.table("often", hits.groupBy("seed").agg(F.count("*").alias("docs")).join(seeds.select("seed").distinct(), "seed", "left_semi"))

    # A tile of n tokens lies over n - width + 1 >= n / width of an item's places; so many must be met.
    need = F.ceil(F.col("n_tokens") * percent / (100 * F.col("width")))
    ranked = seeds.join(often, "seed", "left").withColumns({"docs": F.coalesce("docs", F.lit(0)), "need": F.greatest(need, F.lit(1))})
    order = Window.partitionBy("item").orderBy("docs", "seed")  # an item's own seeds
    ranked = ranked.withColumn("before", F.coalesce(F.sum("places").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rarest = ranked.filter((F.col("docs") > 0) & (F.col("before") <= F.col("n_tokens") - F.col("width") + 1 - F.col("need")))
    pairs = scratch.table("pairs", hits.join(rarest.select("seed", "item", "need"), "seed").select("doc", "item", "need").distinct())
    # A pair asks for the item's seeds, not for the document's: there may be as many pairs as items, and each document may have the seeds of all.
    asked = pairs.join(seeds.join(often, "seed", "left_semi").select("item", "seed", "places"), "item")
    met = asked.join(hits, ["doc", "seed"]).groupBy("doc", "item").agg(F.sum("places").alias("met"), F.first("need").alias("need"))
    able = scratch.table("able", met.filter("met >= need").select("doc.doc_id", "doc.print", "doc.size", "item"))
    scratch.drop("items", "hits", "often", "pairs")

    # Only texts of such pairs are moved; the bitmap of their prints lets few others pass.
    some = texts.mapInArrow(_chosen(_bitmap(able, "print")), texts.schema).drop("size").distinct()
    rows = able.groupBy("doc_id", "print").agg(F.ceil(F.sum("item.size") / F.greatest(F.max("size"), F.lit(ITEM_BYTES))).alias("rows"))
    dealt = able.join(rows, ["doc_id", "print"]).withColumn("row", F.pmod(F.xxhash64("item"), "rows"))
    dealt = dealt.join(items, "item").groupBy("doc_id", "print", "row").agg(F.collect_list(F.struct(F.col("item.item_id").alias("item"), "text")).alias("items"))
    tiled = dealt.join(some, ["doc_id", "print"]).select("doc_id", "text", "items")
    kinds = dict(able.select("doc_id", "item.item_id").dtypes)
    tiled = tiled.mapInArrow(_tiler(min_match), f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_tokens int, n_tiled int, n_tiles int")
    leaks = tiled.filter(F.col("n_tiled") * 100 >= F.col("n_tokens") * percent).withColumn("coverage", F.round(F.col("n_tiled") / F.col("n_tokens"), 6))
    best = leaks.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "n_tokens", "n_tiled", F.negative("n_tiles").alias("fewer"))).alias("best"))
    return best.select("doc_id", "item_id", "best.n_tokens", "best.n_tiled", F.negative("best.fewer").alias("n_tiles"), "best.coverage")
