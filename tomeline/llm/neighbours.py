"""Approximate nearest neighbours by cross-polytope hashing.

A vector of length 1 is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) and falls to the signed axis that it is nearest to. A bucket is a tuple of such axes; the
last of the tuple may be chosen among fewer axes. Each table has rotations of its own. A query looks into
its own bucket of each table and into those that come next by the sum of its coordinates on their axes.

Tables and buckets are as many for any number of vectors. So every vector is a fixed number of entries and
every query at most a fixed number of probes, and what is shuffled grows as the input; it is buckets that
become longer. A bucket is read as a stream past the queries that look into it, which are held, a bounded
number at a time, and each query gives on no more than the nearest it met. So that these do not become more
as buckets do, a query is compared with one vector of ``FIRST`` first: farther than what it finds there, nothing
is given on. Entries carry a sketch, 64
coordinates at most of four bits. One product of matrices tells which of a batch are nearly as close to
which query as neighbours are; only of these are exact distances taken, on the original vectors. How many
pairs are so told apart still grows with queries times vectors.

How close that is is fitted: as the least close true neighbour of a bounded sample of queries, which is
compared with all vectors. A query that so meets too few is looked up again without a screen. How many
buckets a table are probed is fitted, too: the least number at which the sample finds ``TARGET`` of its true
neighbours. Every vector is indexed, and every query that meets too few candidates is compared with all.

Equal vectors are one class with its smallest ids, so a vector that a third of all rows share costs one
entry. A bucket of more than twice its share of vectors is dealt to several groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ids import numbered_ids
from .scratch import Scratch

#: Tables, and bits of a bucket at most: neither grows with the vectors, so that entries and probes grow as the input.
TABLES, MOST_BITS = 1, 7
#: Buckets of a table for each distinct vector, at least, while they are fewer than that.
FINENESS = 2
#: Queries that the number of probes is fitted on, and the share of their true neighbours to be found.
SAMPLE = 64
TARGET = 0.95
#: Probes a table beyond which coarser buckets are taken instead.
MOST_PROBES = 8192
#: Bytes of the queries that a task holds at most.
HELD_BYTES = 128 << 20
#: One of so many vectors is compared with every query first, in so many groups, for a bound of what is near.
FIRST, FIRST_SLABS = 8, 4
#: Bytes of vectors that a group compares before it is dealt, and groups of a block at most, where queries are compared with all.
SLAB_BYTES, MOST_SLABS = 8 << 20, 128
#: Coordinates of a sketch, bits of each, and where they are cut, in standard deviations.
COORDINATES, LEVEL_BITS, CUT = 64, 4, 2.7
_TOP = (1 << LEVEL_BITS) - 1
_ANY = -(1 << 40)
_PAIR_VALUES = 1 << 20
_WAITING = 1 << 18
_ROTATE_VALUES = 1 << 18
SEED = 12


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform over the first axis, of a length that is a power of two, unscaled."""
    shape, h = x.shape, 1
    while h < shape[0]:
        x = x.reshape(shape[0] // (2 * h), 2, -1)
        y = np.empty_like(x)
        np.add(x[:, 0], x[:, 1], out=y[:, 0])
        np.subtract(x[:, 0], x[:, 1], out=y[:, 1])
        x, h = y, 2 * h
    return x.reshape(shape)


class Tables:
    """The hash tables for vectors of one length: 2 ** bits buckets each.

    A part of a bucket that chooses among all axes has a rotation of its own; those that choose among
    fewer axes take different coordinates of rotations that tables share.
    """

    def __init__(self, dim: int, bits: int, tables: int, seed: int = SEED):
        self.dim, self.width, self.tables = dim, 1 << max(0, (dim - 1).bit_length()), tables
        full = self.width.bit_length()  # bits of one signed axis among all
        #: Axes, signs not counted, that each part of a bucket chooses from.
        self.parts = [self.width] * (bits // full) + ([1 << (bits % full - 1)] if bits % full else [])
        #: The first coordinate of each part of each table among those of all rotations.
        self.at, used = [], 0
        for axes in self.parts:
            self.at.append(used + axes * np.arange(tables))
            used += -(-axes * tables // self.width) * self.width
        self.signs = np.random.default_rng([seed, dim, bits]).choice(np.array([-1, 1], np.float32), (3, self.width, used // self.width, 1))

    def rotated(self, x: np.ndarray) -> list[np.ndarray]:
        """By part, (vectors, tables, axes) coordinates of vectors scaled to length 1, up to a common factor."""
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        y = np.zeros((self.width, 1, len(x)), np.float32)
        y[: self.dim, 0] = x.T
        for signs in self.signs:
            y = hadamard(y * signs)
        y = y.transpose(2, 1, 0).reshape(len(x), -1)
        return [y[:, at[0] : at[0] + axes * self.tables].reshape(len(x), self.tables, axes) for at, axes in zip(self.at, self.parts, strict=True)]

    def batches(self, x: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(first row, rotated) by as many rows as fit in the processor's caches."""
        step = max(1, _ROTATE_VALUES // max(1, self.signs[0].size))
        for i in range(0, len(x), step):
            yield i, self.rotated(x[i : i + step])

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables) bucket numbers."""
        out = np.zeros((len(x), self.tables), dtype=np.int64)
        for i, parts in self.batches(x):
            for part in parts:
                at = np.abs(part).argmax(axis=2)
                below = np.take_along_axis(part, at[:, :, None], 2)[:, :, 0] < 0
                mine = out[i : i + len(part)]
                mine *= 2 * part.shape[2]
                mine += 2 * at + below
        return out

    def probes(self, x: np.ndarray, most: int) -> Iterator[list[np.ndarray]]:
        """For each vector, by table, the ``most`` buckets of the largest sums of its coordinates, best first.

        The best tuples are extended part by part: a tuple among the best has its beginning among the
        best beginnings.
        """
        for _, parts in self.batches(x):
            for v in range(len(parts[0])):
                found = []
                for t in range(self.tables):
                    code, total = np.zeros(1, np.int64), np.zeros(1, np.float32)
                    for part in parts:
                        scores = np.stack((part[v, t], -part[v, t]), axis=1).ravel()
                        total = (total[:, None] + scores).ravel()
                        code = (code[:, None] * len(scores) + np.arange(len(scores))).ravel()
                        if len(total) > most:
                            top = np.argpartition(-total, most - 1)[:most]
                            total, code = total[top], code[top]
                    found.append(code[np.argsort(-total, kind="stable")])
                yield found


class Sketch:
    """Coordinates of one pseudo-rotation in steps, by which the cosine of two vectors is told nearly."""

    def __init__(self, dim: int, seed: int = SEED + 1):
        self.width = 1 << max(0, (dim - 1).bit_length())
        self.space = Tables(dim, self.width.bit_length(), 1, seed)

    def levels(self, x: np.ndarray) -> np.ndarray:
        """(vectors, coordinates) steps from 0 to 15."""
        out = np.empty((len(x), min(COORDINATES, self.width)), np.int64)
        for i, (part,) in self.space.batches(x):
            y = part[:, 0, :COORDINATES] / self.width  # of variance 1
            out[i : i + len(y)] = np.clip(np.floor((y + CUT) * ((_TOP + 1) / (2 * CUT))), 0, _TOP)
        return out


def _planes(levels: np.ndarray) -> list[np.ndarray]:
    """For each bit of the steps, those of all coordinates as one integer."""
    wide = np.zeros((len(levels), COORDINATES), np.int64)
    wide[:, : levels.shape[1]] = levels
    return [np.packbits((wide >> b & 1).astype(np.uint8), axis=1).view(np.int64)[:, 0] for b in range(LEVEL_BITS)]


def _levels(planes: list[np.ndarray]) -> np.ndarray:
    """The steps that :func:`_planes` packed, as single floats, which hold sums of their products exactly."""
    bits = [np.unpackbits(np.ascontiguousarray(p).view(np.uint8).reshape(-1, 8), axis=1) << b for b, p in enumerate(planes)]
    return sum(bits[1:], bits[0]).astype(np.float32)


def closeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the steps of vectors, row by row: the larger, the closer; the sum of products about the middle step, times two, less what is the same for all."""
    return 2 * (a * b).sum(axis=1) - _TOP * (a.sum(axis=1) + b.sum(axis=1))


def _close() -> Column:
    """Whether an entry (s0 to s3, total) is as close to a query (q0 to q3) as that asks (least), as a column of pairs; :class:`_Held` tells it of whole batches."""
    counts = [F.bit_count(F.col(f"s{i}").bitwiseAND(F.col(f"q{j}"))) * (2 << (i + j)) for i in range(LEVEL_BITS) for j in range(LEVEL_BITS)]
    return sum(counts[1:], counts[0]) - _TOP * F.col("total") >= F.col("least")


def tables_for(n: int) -> int:
    """Tables for n vectors: as many for any n."""
    return TABLES


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix of doubles) for each length of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield int(dim), rows, values[starts[rows][:, None] + np.arange(dim)]


def _best(group: np.ndarray, distance: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` nearest of each group, ties to smaller ids."""
    order = np.lexsort((ids, distance, group))
    group = group[order]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
    place = np.arange(len(group)) - np.repeat(first, np.diff(np.concatenate((first, [len(group)]))))
    return order[place < most]


def _distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows i of a and j of b."""
    out, step = np.empty(len(i)), max(1, _PAIR_VALUES // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        d = a[i[at : at + step]] - b[j[at : at + step]]
        out[at : at + step] = np.sqrt((d * d).sum(axis=1))
    return out


def _truth(classes: DataFrame, sample: list, most: int) -> list:
    """Rows (s, cls, vec, distance): the nearest classes of each sampled query, its own left out, by comparing with all."""
    ids = np.array([r.cls for r in sample], dtype=np.int64)
    groups = {d: (rows, m) for d, rows, m in _by_length(pa.array([list(map(float, r.vec)) for r in sample], pa.list_(pa.float64())))}
    vec_type = dict(classes.dtypes)["vec"]

    def near(batches):
        held = []
        for batch in batches:
            cls = batch.column(0).to_numpy(zero_copy_only=False)
            for dim, rows, x in _by_length(batch.column(1)):
                if dim not in groups:
                    continue
                which, queries = groups[dim]
                for s, q in zip(which, queries, strict=True):
                    other = np.flatnonzero(cls[rows] != ids[s])
                    d = _distances(q[None], x, np.zeros(len(other), np.int64), other)
                    top = _best(np.zeros(len(other), np.int64), d, cls[rows][other], most)
                    held.append(pa.table({"s": pa.array(np.full(len(top), s, np.int32)), "cls": cls[rows][other][top], "vec": batch.column(1).take(pa.array(rows[other][top])), "distance": d[top]}))
            if held:
                all_held = pa.concat_tables(held)
                held = [all_held.take(pa.array(_best(*(all_held.column(c).to_numpy() for c in ("s", "distance", "cls")), most)))]
        for x in held:
            yield from x.to_batches()

    found = classes.select("cls", "vec").mapInArrow(near, f"s int, cls long, vec {vec_type}, distance double")
    place = F.row_number().over(Window.partitionBy("s").orderBy("distance", "cls"))
    return found.withColumn("place", place).filter(F.col("place") <= most).collect()


def fitted(classes: DataFrame, n: int, k: int, tables: int, target: float = TARGET, sample: int = SAMPLE) -> tuple[int, int, dict[int, int]]:
    """(bits of a bucket, probes a table, by length the closeness of any true neighbour) by which a sample of the queries finds ``target`` of its true neighbours."""
    rows = classes.filter("asked").select("cls", "vec").orderBy(F.xxhash64("cls"), "cls").limit(sample).collect()
    bits = min(MOST_BITS, math.ceil(math.log2(max(2, FINENESS * n))))
    truth = _truth(classes, rows, k) if rows and n > 1 else []
    if not truth:
        return bits, 1, {}
    least = {}
    for dim in {len(r.vec) for r in truth}:
        mine = [r for r in truth if len(r.vec) == dim]
        found, asked = (Sketch(dim).levels(np.array([list(map(float, v)) for v in vs])) for vs in ([r.vec for r in mine], [rows[r.s].vec for r in mine]))
        least[dim] = int(closeness(found, asked).min())
    places = np.array([r.s for r in truth])
    needed = math.ceil(target * len(truth))
    while True:
        rank = np.full(len(truth), MOST_PROBES + 1)
        for dim in {len(r.vec) for r in truth}:
            space = Tables(dim, bits, tables)
            mine = np.flatnonzero([len(r.vec) == dim for r in truth])
            codes = space.buckets(np.array([list(map(float, truth[i].vec)) for i in mine]))
            asked = np.unique(places[mine])
            queries = np.array([list(map(float, rows[s].vec)) for s in asked])
            for s, found in zip(asked, space.probes(queries, MOST_PROBES), strict=True):
                of_s = np.flatnonzero(places[mine] == s)
                for t, order in enumerate(found):
                    hit, at = np.nonzero(order[None, :] == codes[of_s, t][:, None])
                    np.minimum.at(rank, mine[of_s[hit]], at + 1)
        probes = int(np.sort(rank)[needed - 1])
        if probes <= MOST_PROBES or bits == 1:
            return bits, min(probes, MOST_PROBES), least
        bits -= 1


def _keys(classes: DataFrame, bits: int, tables: int, probes: int = 0, least: dict[int, int] | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """(dim, tab, bucket, cls) with sketch: the bucket of each class in each table or, with ``probes``, the buckets that it looks into as q and the closeness it asks for. The columns ``carried`` go along."""

    step = max(1, (1 << 16) // (tables * max(1, probes)))  # rows of an output batch, by its entries
    who, letter, last = ("q", "q", "least") if probes else ("cls", "s", "total")
    names = [who, *(f"{letter}{b}" for b in range(LEVEL_BITS)), last]

    def keyed(batches):
        spaces: dict[int, tuple[Tables, Sketch]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                cls = part.column(0).to_numpy(zero_copy_only=False)
                for dim, rows, x in _by_length(part.column(1)):
                    if dim not in spaces:
                        spaces[dim] = Tables(dim, bits, tables), Sketch(dim)
                    space, sketch = spaces[dim]
                    if probes:
                        found = [np.stack(f) for f in space.probes(x, probes)]  # (tables, buckets) of each query
                    else:
                        found = space.buckets(x)[:, :, None]
                    bucket = np.stack(found)
                    tab = np.broadcast_to(np.arange(tables, dtype=np.int32)[None, :, None], bucket.shape)
                    levels = sketch.levels(x)
                    total = levels.sum(axis=1)
                    if probes:
                        total = _TOP * total + (least or {}).get(dim, _ANY)
                    own = [np.repeat(c, bucket[0].size) for c in (cls[rows].astype(np.int64), *_planes(levels), total)]
                    also = [part.column(f"_{c}").take(pa.array(np.repeat(rows, bucket[0].size))) for c in carried]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(bucket.size, dim, np.int32)), pa.array(tab.ravel()), pa.array(bucket.ravel()), *map(pa.array, own), *also], ["dim", "tab", "bucket", *names, *carried])

    kinds = dict(classes.dtypes)
    schema = ["dim int", "tab int", "bucket long", *(f"{c} long" for c in names), *(f"{c} {kinds[c]}" for c in carried)]
    return classes.select("cls", "vec", *(F.col(c).alias(f"_{c}") for c in carried)).mapInArrow(keyed, ", ".join(schema))


class _Held:
    """The queries of a group, and the nearest of each among the vectors that have come by."""

    def __init__(self, most: int):
        self.most, self.ids, self.told = most, np.zeros(0, np.int64), []
        self.x = self.levels = None
        self.best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query's place, cls, n, distance
        self.waiting: list[list[np.ndarray]] = []

    def ask(self, ids: np.ndarray, x: np.ndarray, planes: list[np.ndarray], least: np.ndarray, bound: np.ndarray) -> None:
        """More queries, before any vector."""
        self.told.append((ids, x, _levels(planes), least, bound))

    def _begin(self) -> None:
        ids, x, levels, least, self.bound = (np.concatenate(c) for c in zip(*self.told, strict=True))
        self.ids, self.x, self.told = ids, x, []
        self.squares, self.worst = (x * x).sum(axis=1), self.bound
        if (least > _ANY // 2).all():
            self.levels = np.column_stack((2 * levels, np.full(len(ids), -_TOP), -least)).astype(np.float32).T.copy()

    def meet(self, cls: np.ndarray, n: np.ndarray, x: np.ndarray, planes: list[np.ndarray], total: np.ndarray) -> None:
        if self.told:
            self._begin()
        if not len(self.ids):
            return
        step = max(1, _PAIR_VALUES // len(self.ids))
        told = None if self.levels is None else np.column_stack((_levels(planes), total, np.ones(len(total)))).astype(np.float32)
        for at in range(0, len(cls), step):
            v = x[at : at + step]
            close = None if told is None else told[at : at + step] @ self.levels >= 0
            if close is None or np.count_nonzero(close) * 16 > close.size:
                # Of many pairs, those are left out that are farther than what the query has; what overflows stays.
                with np.errstate(over="ignore", invalid="ignore"):
                    both = (v * v).sum(axis=1)[:, None] + self.squares
                    far = both - 2 * (v @ self.x.T) > self.worst**2 + both * ((v.shape[1] + 8) * 1e-15) + 1e-300
                close = ~far if close is None else close & ~far
            j, i = np.nonzero(close)
            with np.errstate(over="ignore"):
                d = _distances(self.x, v, i, j)
            near = d <= self.worst[i]
            i, j, d = i[near], j[near], d[near]
            self.waiting.append([i, cls[at + j], n[at + j], d])
            if sum(len(w[0]) for w in self.waiting) > max(_WAITING, len(self.best[0])):
                self._settle()

    def _settle(self) -> None:
        i, cls, n, d = (np.concatenate(c) for c in zip(self.best, *self.waiting, strict=True))
        top = _best(i, d, cls, self.most)
        self.best, self.waiting = [c[top] for c in (i, cls, n, d)], []
        full = np.bincount(self.best[0], minlength=len(self.ids)) == self.most
        last = np.zeros(len(self.ids))
        np.maximum.at(last, self.best[0], self.best[3])
        self.worst = np.where(full, last, self.bound)  # what is kept is within the bound

    def found(self) -> pa.RecordBatch:
        if self.waiting:
            self._settle()
        i, cls, n, d = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(cls), pa.array(n), pa.array(d)], ["q", "cls", "n", "distance"])


def _compared(entries: DataFrame, queries: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """(q, cls, n, distance): for each query, the nearest classes of each of its groups.

    ``entries`` has cls, n, vec and sketch, ``queries`` q, vec, sketch and bound, the distance beyond which nothing
    is wanted, or null; the first of the ``keys`` of a group is dim. Queries come first in their group and are held, entries pass by.
    """
    sketch = [f"s{b}" for b in range(LEVEL_BITS)]
    asked = queries.select(*keys, F.lit(None).cast("long").alias("n"), F.col("q").alias("id"), "vec", *(F.col(f"q{b}").alias(s) for b, s in enumerate(sketch)), F.col("least").alias("last"), F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    passing = entries.select(*keys, "n", F.col("cls").alias("id"), "vec", *sketch, F.col("total").alias("last"), F.lit(0.0).alias("bound"))

    def compare(batches):
        group, held = None, _Held(most)
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(len(keys))], axis=1)
            asking = batch.column("n").is_null().to_numpy(zero_copy_only=False)
            new = np.flatnonzero((where[1:] != where[:-1]).any(axis=1) | (asking[1:] != asking[:-1])) + 1
            for at, end in zip((0, *new), (*new, batch.num_rows), strict=True):
                if at == end:
                    continue
                if group != (key := tuple(where[at])):
                    yield held.found()
                    group, held = key, _Held(most)
                part = batch.slice(at, end - at)
                ids, last, *planes = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "last", *sketch))
                x = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), int(where[at, 0]))
                if asking[at]:
                    held.ask(ids, x, planes, last, part.column("bound").to_numpy())
                else:
                    held.meet(ids, part.column("n").to_numpy(zero_copy_only=False), x, planes, last)
        yield held.found()

    rows = asked.unionByName(passing).repartition(*keys).sortWithinPartitions(*keys, F.col("n").asc_nulls_first())
    return rows.mapInArrow(compare, "q long, cls long, n long, distance double")


def _nearest_of(found: DataFrame, most: int) -> DataFrame:
    return found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("distance", "cls"))).filter(F.col("place") <= most).drop("place")


def _blocks(queries: int, values: float, most: int) -> int:
    """Blocks of queries of that many values, by what a task holds of each: vector, sketch and nearest."""
    return max(1, math.ceil(queries * (8 * values + 4 * (COORDINATES + 2) + 48 * most) / HELD_BYTES))


def _dealt(queries: DataFrame, blocks: int, slabs: int) -> DataFrame:
    """Queries with their block, once for each slab."""
    return queries.select(F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), "q", "vector", F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"))


def _without_sketch(rows: DataFrame, letter: str, last: str) -> DataFrame:
    return rows.select("*", *(F.lit(0).cast("long").alias(f"{letter}{b}") for b in range(LEVEL_BITS)), F.lit(_ANY).alias(last))


def _compared_with_all(classes: DataFrame, dealt: DataFrame, blocks: int, slabs: int, most: int) -> DataFrame:
    """(q, cls, n, distance): the nearest of all classes of their length, for queries dealt to so many blocks and slabs."""
    queries = dealt.select(F.size("vector").alias("dim"), "block", "slab", "q", F.col("vector").alias("vec"), F.lit(None).cast("double").alias("bound"))
    entries = classes.withColumn("dim", F.size("vec")).join(queries.select("dim").distinct(), "dim", "left_semi")
    entries = entries.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(slabs)).cast("int").alias("slab"), "cls", "n", "vec")
    found = _compared(_without_sketch(entries, "s", "total"), _without_sketch(queries, "q", "least"), ("dim", "block", "slab"), most)
    return _nearest_of(found, most)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", tables: int | None = None, target: float = TARGET) -> DataFrame:
    """(query, rank, vec_id, score): for each row that ``queries`` holds for, the k nearest other rows found, by Euclidean distance in double precision, nearest first, ties to smaller ids.

    Rows without id and vectors that are null, empty, zero or hold null or non-finite components take no
    part. Vectors are compared with those of their own length only. If a query has fewer than k other
    rows to be compared with, it gets all of them. A row that repeats another's id and vector is a
    candidate of it, at distance 0, but no query of its own; a repeated id with another vector is a
    query of its own. A table without queries gives no rows. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    element = dict(vectors.dtypes)[vec_col]
    vec = F.col(f"`{vec_col}`") if element in ("array<float>", "array<double>") else F.col(f"`{vec_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), vec.alias("vec"), F.coalesce(queries, F.lit(False)).alias("asked"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows, back = numbered_ids(rows.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))), scratch, "vec_id")

    classes = scratch.table("classes", rows.groupBy("vec").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n"), F.max("asked").alias("asked")))
    # The ids of a class: for one that several rows share, its k + 1 smallest, and all that ask.
    several = classes.filter("n > 1").select("vec", "cls")
    shared = rows.join(several, "vec").groupBy("cls", "vec_id").agg(F.count("*").alias("copies"), F.max("asked").alias("asked"))
    shared = scratch.table("shared", shared)
    lone = classes.filter("n = 1")
    place = F.row_number().over(Window.partitionBy("cls").orderBy("vec_id"))
    members = shared.withColumn("place", place).filter(F.col("place") <= k + 1).select("cls", "vec_id", "copies")
    members = scratch.table("members", lone.select("cls", F.col("cls").alias("vec_id"), F.lit(1).cast("long").alias("copies")).unionByName(members))
    asking = lone.filter("asked").select("cls", F.col("cls").alias("query")).unionByName(shared.filter("asked").select("cls", F.col("vec_id").alias("query")))

    total = classes.agg(F.count("*").alias("n"), F.count_if("asked").alias("asked"), F.avg(F.size("vec")).alias("dim")).first()
    tables = tables or tables_for(total.n)
    values = total.dim or 1
    bits, probes, least = fitted(classes, total.n, k, tables, target)
    queried = classes.filter("asked").select(F.col("cls").alias("q"), F.col("vec").alias("vector"), "n")

    # Of a bucket with more than twice its share of the entries, each group gets a part.
    bucket = ("dim", "tab", "bucket")
    index = scratch.table("index", _keys(classes, bits, tables, carried=("n", "vec")))
    share = max(1, math.ceil(2 * total.n / (1 << bits)))
    parts = scratch.table("parts", index.groupBy(*bucket).agg(F.ceil(F.count("*") / share).cast("int").alias("parts")))
    index = index.join(F.broadcast(parts.filter("parts > 1")), [*bucket], "left")  # no more buckets than the shares of all tables
    index = index.withColumn("part", F.pmod(F.xxhash64("cls", F.lit(1)), F.coalesce("parts", F.lit(1))).cast("int"))

    def looked_up(queried: DataFrame, n_queries: int, least: dict[int, int], turn: str) -> tuple[DataFrame, DataFrame]:
        """The nearest of what queries meet in their buckets, and the queries that meet too few."""
        blocks = _blocks(n_queries, values, k + 1)
        dealt = _dealt(queried, blocks, FIRST_SLABS)
        some = classes.filter(F.pmod(F.xxhash64("cls", F.lit(2)), F.lit(FIRST)) == 0)
        first = _compared_with_all(some, dealt, blocks, FIRST_SLABS, k + 1)
        bounds = scratch.table(f"bounds{turn}", first.groupBy("q").agg(F.max("distance").alias("bound"), F.count("*").alias("seen")).filter(F.col("seen") == k + 1).select("q", "bound"))
        asks = dealt.filter("slab = 0").join(bounds, "q", "left").select(F.col("q").alias("cls"), F.col("vector").alias("vec"), "block", "bound")
        looked = _keys(asks, bits, tables, probes, least, carried=("vec", "block", "bound")).join(parts, [*bucket])
        looked = looked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        entries = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = _compared(entries, looked, (*bucket, "part", "block"), k + 1).filter("q != cls")
        met = met.dropDuplicates(["q", "cls"]) if tables > 1 else met
        met = met.unionByName(queried.select("q", F.col("q").alias("cls"), "n", F.lit(0.0).alias("distance")))
        best = scratch.table(f"best{turn}", _nearest_of(met, k + 1))
        return best, scratch.table(f"short{turn}", best.groupBy("q").agg(F.sum("n").alias("met")).filter(F.col("met") < k + 1).select("q"))

    best, short = looked_up(queried, total.asked, least, "")
    n_short = short.count()
    if n_short and least and total.n > k + 1:
        screened = best.join(short, "q", "left_anti")
        best, short = looked_up(scratch.table("unscreened", queried.join(short, "q", "left_semi")), n_short, {}, "-unscreened")
        best, n_short = screened.unionByName(best), short.count()

    # Queries that met too few are compared with all vectors of their length.
    if n_short:
        blocks = _blocks(n_short, values, k + 1)
        again = scratch.table("again", queried.join(short, "q", "left_semi"))
        slabs = min(MOST_SLABS, max(1, math.ceil(total.n * 8 * values / SLAB_BYTES)))
        best = best.join(short, "q", "left_anti").unionByName(_compared_with_all(classes, _dealt(again, blocks, slabs), blocks, slabs, k + 1))

    # Classes become rows; the query's own row goes.
    hits = best.join(members, "cls")
    hits = hits.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id", "cls"))).filter(F.col("place") <= k + 1)
    hits = scratch.table("hits", hits.select("q", "cls", "vec_id", "copies", "distance"))
    rest = F.col("copies") - F.when((F.col("vec_id") == F.col("query")) & (F.col("cls") == F.col("q")), 1).otherwise(0)
    out = asking.withColumnRenamed("cls", "q").join(hits, "q").withColumn("rest", F.least(rest, F.lit(k))).filter("rest > 0")
    out = out.select("q", "query", "vec_id", F.col("distance").alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rest"))).alias("copy"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("q", "query").orderBy("score", "vec_id", "copy"))).filter(F.col("rank") <= k)
    return back(out.select("query", "rank", "vec_id", "score"), "query", "vec_id")
