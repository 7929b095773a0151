"""MinHash near-duplicate detection with odd sketches.

1. One Arrow pass over the texts takes MinHash samples of each document's set of word shingles,
   band keys over those samples, and an odd sketch (Mitzenmacher, Pagh, Pham 2014): a bitmap in
   which every sample flips one bit, so that the population count of the XOR of two bitmaps
   estimates how many samples differ. A second bitmap is the odd sketch of the whole set; its count
   never exceeds the number of shingles in which two sets differ, so it rules pairs out for certain.
2. Documents with equal sets share a class, named by its smallest doc_id; only classes go on.
3. Classes that share a band key are first linked as a star, each to the key's smallest class. Links
   that the sketches leave possible are confirmed and joined into components; a group of near copies
   mostly is one component then, for as many pairs as it has members. For keys with many classes
   outside their largest component that is done again around another class.
4. What is still apart is decided exactly: in every key with more than one component, the classes
   outside its largest one meet all others of other components, in blocks of bounded size. A pair is
   looked at in the first band it shares only.
5. Every candidate is confirmed on the full sets, natively.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .ids import numbered_ids
from .scratch import Scratch

SKETCH_BITS = 512
#: Bits of the second bitmap, in which every shingle of the set flips one.
PARITY_BITS = 1024
WORDS = SKETCH_BITS // 64
#: Classes of a shared band key that one block holds from each side, about: a hash deals them out.
BLOCK = 256
#: Highest chance that two documents exactly at the threshold share no band.
MISS = 1e-5


class Plan:
    """Bands, samples and screens that follow from shingle size and threshold (percent)."""

    def __init__(self, k: int, percent: int):
        t = percent / 100
        self.k, self.percent = k, percent
        self.rows = 6 if percent >= 84 else 5
        self.bands = math.ceil(math.log(MISS) / math.log(1 - t**self.rows))
        self.samples = self.rows * self.bands
        differ = self.samples * (1 - t) + 4.75 * math.sqrt(self.samples * t * (1 - t))
        mean = SKETCH_BITS / 2 * (1 - math.exp(-4 * differ / SKETCH_BITS))
        #: Bits in which the sketches of a pair at the threshold may differ.
        self.most_bits = math.ceil(min(2 * differ, mean + 3 * math.sqrt(mean)))


def shingle_sets(words: K.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, sorted within each, and the number of each document."""
    h, inside = words.windows(k)
    short, _ = K.sequence_hash(words)
    first, parts, sizes = words.first, [], np.zeros(len(words.first) - 1, dtype=np.int64)
    for d in range(len(sizes)):
        a, b = first[d], first[d + 1]
        if b - a >= k:
            s = np.sort(h[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = short[d : d + 1]
        else:
            continue
        parts.append(s)
        sizes[d] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


def _samples(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n MinHash samples (uint32) of each run of values that begins at starts."""
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    out = np.empty((n, len(starts)), dtype=np.uint32)
    buffer = np.empty_like(low)
    for i in range(n):
        np.bitwise_xor(low, np.uint32(K._odd(2 * i) & 0xFFFFFFFF), out=buffer)
        np.multiply(buffer, np.uint32(K._odd(2 * i + 1) & 0xFFFFFFFF | 1), out=buffer)
        np.bitwise_xor(buffer, buffer >> np.uint32(15), out=buffer)
        np.multiply(buffer, np.uint32(K._odd(3 * i + 7) & 0xFFFFFFFF | 1), out=buffer)
        out[i] = np.minimum.reduceat(buffer, starts)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (documents x bytes) of samples (n x documents)."""
    n, docs = samples.shape
    bits = np.zeros((docs, SKETCH_BITS), dtype=np.uint8)
    rows = np.arange(docs)
    for i in range(n):
        at = (K.mix(samples[i].astype(np.uint64) + np.uint64(i << 32)) % np.uint64(SKETCH_BITS)).astype(np.int64)
        bits[rows, at] ^= 1
    return np.packbits(bits, axis=1)


def parity(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Odd sketches (documents x bytes) of whole sets: two of them never differ in more bits than the sets do in members."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    bit = (K.mix(values) >> np.uint64(32)).astype(np.int64) & (PARITY_BITS - 1)
    bits = np.bincount(doc * PARITY_BITS + bit, minlength=len(sizes) * PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8).reshape(len(sizes), PARITY_BITS), axis=1)


def _signer(plan: Plan):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in K.chunks(batch.column(1)):
                values, sizes = shingle_sets(K.Words(data, bounds, lower=True), plan.k)
                full = np.flatnonzero(sizes)
                ends = np.cumsum(sizes)
                keys = np.zeros((len(full), plan.bands), dtype=np.int32)
                sketch, sums = np.zeros((len(full), (SKETCH_BITS + PARITY_BITS) // 8), np.uint8), np.zeros((2, j - i), np.uint64)
                if len(full):
                    starts = (ends - sizes)[full]
                    samples = _samples(values, starts, plan.samples)
                    sketch = np.concatenate([odd_sketch(samples), parity(values, sizes[full])], axis=1)
                    for b in range(plan.bands):
                        key = np.full(len(full), b, dtype=np.uint64)
                        for r in range(plan.rows):
                            key = K.mix(key * np.uint64(31) + samples[b * plan.rows + r])
                        keys[:, b] = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    for s in (0, 1):
                        sums[s, full] = np.add.reduceat(K.mix(values + np.uint64(s)), starts)
                counts = np.zeros(j - i, dtype=np.int64)
                counts[full] = plan.bands
                picture = np.full(j - i, None, dtype=object)
                picture[full] = [x.tobytes() for x in sketch]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), K.lists(keys.ravel(), counts, pa.int32()), pa.array(picture, type=pa.binary())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    return sign


def _setter(plan: Plan):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in K.chunks(batch.column(1)):
                values, sizes = shingle_sets(K.Words(data, bounds, lower=True), plan.k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), K.lists(values.view(np.int64), sizes, pa.int64())], names=["node", "shingles"])

    return sets


def _near(plan: Plan, size_u: np.ndarray, size_v: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs the sketches (rows of 64-bit words) leave possible: the samples estimate the similarity, the whole sets' bitmaps bound the difference from below."""
    ok = np.minimum(size_u, size_v) * 100 >= plan.percent * np.maximum(size_u, size_v)
    at = np.flatnonzero(ok)
    bits = np.bitwise_count(u[at, :WORDS] ^ v[at, :WORDS]).sum(axis=1, dtype=np.int64)
    at = at[bits <= plan.most_bits]
    bits = np.bitwise_count(u[at, WORDS:] ^ v[at, WORDS:]).sum(axis=1, dtype=np.int64)
    at = at[bits * (100 + plan.percent) <= (100 - plan.percent) * (size_u[at] + size_v[at])]
    out = np.zeros(len(ok), dtype=bool)
    out[at] = True
    return out


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), (SKETCH_BITS + PARITY_BITS) // 64)


def _screen(plan: Plan):
    """Pairs that the sketches leave possible; columns: a, b, size_a, size_b, sketch_a, sketch_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = _near(plan, batch.column(2).to_numpy(), batch.column(3).to_numpy(), _sketches(batch.column(4)), _sketches(batch.column(5)))
            yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def _pair_maker(plan: Plan):
    """Candidate pairs (a < b) of blocks whose rows come sorted by block."""

    def pairs_of(node, comp, size, side, keys, sketch, band, within) -> tuple[np.ndarray, np.ndarray]:
        left, right = (np.arange(len(node)),) * 2 if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        ok = node[left, None] > node[None, right] if within else node[left, None] != node[None, right]
        ok &= comp[left, None] != comp[None, right]
        x, y = np.nonzero(ok)
        x, y = left[x], right[y]
        kept = []
        for s in range(0, len(x), 65536):
            u, v = x[s : s + 65536], y[s : s + 65536]
            near = _near(plan, size[u], size[v], sketch[u], sketch[v])
            u, v = u[near], v[near]
            if band:  # else they have met before
                near = ~(keys[u, :band] == keys[v, :band]).any(axis=1)
                u, v = u[near], v[near]
            kept.append((u, v))
        if not kept:
            return x, x
        x, y = (np.concatenate([k[n] for k in kept]) for n in (0, 1))
        return np.minimum(node[x], node[y]), np.maximum(node[x], node[y])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, list[pa.RecordBatch]]:
            cols = [table.column(c).to_numpy() for c in ("band", "key", "bi", "bj")]
            cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            if not last:
                if not len(cut):
                    return None, table.to_batches()
                rest, table = table.slice(cut[-1]), table.slice(0, cut[-1])
                cut, cols = cut[:-1], [c[: len(table)] for c in cols]
            else:
                rest = None
            edges = np.concatenate(([0], cut, [len(table)])).astype(np.int64)
            node, comp, size, side = (table.column(c).to_numpy() for c in ("node", "comp", "n_shingles", "side"))
            keys = np.stack(table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(table), plan.bands)) if len(table) else np.zeros((0, plan.bands))
            sketch = _sketches(table.column("sketch"))
            found = [pairs_of(node[a:b], comp[a:b], size[a:b], side[a:b], keys[a:b], sketch[a:b], int(cols[0][a]), cols[2][a] == cols[3][a]) for a, b in zip(edges[:-1], edges[1:], strict=True) if b - a > 1]
            x = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
            y = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()), pa.array(y, type=pa.int64())], names=["a", "b"]), rest.to_batches() if rest is not None else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                out, held = finish(pa.Table.from_batches(held), False)
                if out is not None and out.num_rows:
                    yield out
        if held:
            out, _ = finish(pa.Table.from_batches(held), True)
            if out is not None:
                yield out

    return make


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_of_a"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_of_b"))
    joined = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("set_of_a", "set_of_b")))
    return joined.filter(100 * F.col("common") >= percent * (F.size("set_of_a") + F.size("set_of_b") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept.

    Words are runs outside ASCII white space, A-Z lower-cased; a document's set holds its distinct
    ``k``-word shingles, or its whole word sequence if it is shorter. Two documents are linked if
    ``100 * |intersection| >= percent * |union|``.

    A null or empty text, or one without words, has an empty set, is linked with nothing and kept.
    Rows that repeat a doc_id count as one node of the graph and all carry its component. A row
    without doc_id gets the component of the documents with its own set, else null, and is kept only
    in the latter case. Ids may be of any type that has an order. Other columns are ignored.
    """
    spark, plan = docs.sparkSession, Plan(k, percent)
    scratch = Scratch(spark, "near-dups")
    texts, back = numbered_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), scratch)
    texts = texts.select("doc_id", "text")
    signed = scratch.table("signed", texts.mapInArrow(_signer(plan), "doc_id long, n_shingles long, set_a long, set_b long, bands array<int>, sketch binary"))
    classes = scratch.table("classes", signed.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node")))
    # The class of each set, with its signature: one row for each set and smallest doc_id. The id among the keys spreads the copies of one set.
    named = classes.withColumn("doc_id", F.col("node"))
    heads = signed.filter("n_shingles > 0").join(named, ["set_a", "set_b", "doc_id"]).dropDuplicates(["node", "set_a", "set_b"])
    heads = scratch.table("heads", heads.select("node", "n_shingles", "bands", "sketch"))

    keys = heads.select("node", F.posexplode("bands").alias("band", "key"))
    shared = scratch.table("shared", keys.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    met = scratch.table("met", keys.join(shared, ["band", "key"]))
    nodes = scratch.table("nodes", met.select("node").distinct())
    sets = texts.withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi").mapInArrow(_setter(plan), "node long, shingles array<long>")
    sets = scratch.table("sets", sets)
    sketched = heads.select("node", "n_shingles", "sketch")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (hub, node), as a < b, that are links."""
        pairs = scratch.table(f"{name}-pairs", pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
        one, other = (sketched.select(F.col("node").alias(c), F.col("n_shingles").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
        both = pairs.join(one, "a").join(other, "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")
        out = scratch.table(name, _confirmed(both.mapInArrow(_screen(plan), "a long, b long"), sets, percent))
        scratch.drop(f"{name}-pairs")
        return out

    links = linked(met.filter("node <> hub").select("hub", "node"), "links-0")
    turn, before = 0, None
    while True:
        joined = scratch.table(f"joined-{turn}", connected_components(links, scratch, f"cc-{turn}"))
        comp = F.coalesce("component", "node").alias("comp")
        rows = scratch.table(f"rows-{turn}", met.select("band", "key", "node").join(joined, "node", "left").select("band", "key", "node", comp))
        sizes = rows.groupBy("band", "key", "comp").agg(F.count("*").alias("n"))
        # Keys with more than one component: the largest, and how many classes lie in it and beside it.
        apart = sizes.groupBy("band", "key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("comps")).filter("comps > 1")
        apart = scratch.table(f"apart-{turn}", apart.select("band", "key", F.col("top.comp").alias("largest"), F.col("top.n").alias("inside"), (F.col("n") - F.col("top.n")).alias("beside")))
        wide = apart.filter(F.col("beside") > BLOCK)
        left = wide.agg(F.coalesce(F.sum("beside"), F.lit(0))).first()[0]
        # Another star helps as long as it takes in half of what is beside; what it leaves is decided below all the same.
        if not left or (before is not None and 2 * left > before):
            break
        before, turn = left, turn + 1
        # Written, so that the join stands alone and a key with very many classes can be split.
        beside = scratch.table(f"beside-{turn}", rows.join(wide.select("band", "key", "largest"), ["band", "key"]))
        hubs = beside.filter("comp <> largest").groupBy("band", "key").agg(F.min_by(F.struct("node", "comp"), F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("hub"))
        hubs = scratch.table(f"hubs-{turn}", hubs.select("band", "key", F.col("hub.node").alias("hub"), F.col("hub.comp").alias("hub_comp")))
        more = linked(beside.join(hubs, ["band", "key"]).filter("comp <> hub_comp").select("hub", "node"), f"links-{turn}")
        links = scratch.table(f"all-{turn}", links.unionByName(more))

    # Blocks (i, j) of a key: its rows beside the largest component in chunks 0 .. r - 1, the others in chunks r .. r + g - 1; i is one of the former.
    r, g = F.ceil(F.col("beside") / BLOCK), F.ceil(F.col("inside") / BLOCK)
    out = F.col("comp") != F.col("largest")
    blocked = rows.join(apart, ["band", "key"]).withColumns({"r": r, "g": g, "out": out})
    chunk = F.when(F.col("out"), F.pmod(F.xxhash64("node"), "r")).otherwise(F.col("r") + F.pmod(F.xxhash64("node"), "g"))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("out"), F.col("r") + F.col("g") - 1).otherwise(F.col("r") - 1))
    blocked = blocked.withColumn("chunk", chunk).withColumn("other", F.explode(others))
    blocked = blocked.select("band", "key", "node", "comp", F.least("chunk", "other").alias("bi"), F.greatest("chunk", "other").alias("bj"), F.when(F.col("chunk") <= F.col("other"), 0).otherwise(1).alias("side"))
    blocked = blocked.join(heads, "node").repartition("band", "key", "bi", "bj").sortWithinPartitions("band", "key", "bi", "bj", "node")
    blocked = blocked.select("band", "key", "bi", "bj", "side", "node", "comp", "n_shingles", "bands", "sketch")
    rest = scratch.table("links-rest", _confirmed(blocked.mapInArrow(_pair_maker(plan), "a long, b long").distinct(), sets, percent))

    name = joined.select("node", "component")
    rest = rest.join(name.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(name.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    rest = scratch.table("links-last", rest.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    last = connected_components(rest, scratch, "cc-last").select(F.col("node").alias("component"), F.col("component").alias("top"))
    last = scratch.table("last", last)
    # Classes that the stars joined, then those that only the last links name.
    named = name.join(last, "component", "left").select("node", F.coalesce("top", "component").alias("component_id"))
    alone = last.join(name.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component_id"))
    final = classes.join(named.unionByName(alone), "node", "left").select("set_a", "set_b", F.coalesce("component_id", "node").alias("component_id"))
    final = scratch.table("components", final)
    scratch.drop("heads", "shared", "met", "nodes", "sets", "links-rest", "links-last", "last", "classes", *(f"{x}-{t}" for t in range(turn + 1) for x in ("links", "all", "hubs", "beside", "joined", "rows", "apart")))

    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(final, ["set_a", "set_b"], "left")
    root = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return back(out.select("doc_id", "n_shingles", root.alias("component_id"), F.col("doc_id").eqNullSafe(root).alias("kept")), "doc_id", "component_id")
