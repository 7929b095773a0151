"""Nearest neighbours against brute force: exact where tables are small, recall where they are not."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeline.llm import neighbours
from tomeline.llm.neighbours import Tables, hadamard, nearest

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, label int, cls long, n int, q string"


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def brute(rows, asks, k=10):
    """{(query, place of its row): [(vec_id, distance)]} over rows (vec_id, vector)."""
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for at, (i, v) in enumerate(sound):
        if asks(i) and (i, v) not in sound[:at]:
            d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), j) for o, (j, w) in enumerate(sound) if o != at and len(w) == len(v))
            out[i, at] = [(j, x) for x, j in d[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 7, 3, "x") for i, v in rows], SCHEMA).repartition(3)


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append((r.vec_id, r.score, r["rank"]))
    return out


def same(got, wanted):
    assert set(got) == {q for (q, _), found in wanted.items() if found}
    for (q, _), found in wanted.items():
        assert [x[0] for x in got.get(q, [])] == [x[0] for x in found]
        assert [x[1] for x in got.get(q, [])] == pytest.approx([x[1] for x in found], rel=1e-12)
        assert [x[2] for x in got.get(q, [])] == list(range(1, len(found) + 1))


def test_pseudo_rotation():
    x = np.random.default_rng(1).normal(size=(5, 64))
    y = hadamard(x.T).T
    assert np.allclose(hadamard(y.T).T / 64, x) and np.allclose((y**2).sum(1), 64 * (x**2).sum(1))
    t = Tables(40, 17, 3)
    assert t.parts == [64, 64, 4]
    z = np.random.default_rng(2).normal(size=(30, 40))
    codes = t.buckets(z)
    assert codes.shape == (30, 3) and codes.max() < 1 << 17
    for row, found in zip(codes, t.probes(z, 50), strict=True):
        assert [f[0] for f in found] == list(row) and all(len(set(f)) == 50 for f in found)
    one = next(t.probes(z[:1], 128 * 128 * 8))
    y = [part[0, 0] for part in t.rotated(z[:1])]
    assert [len(part) for part in y] == [64, 64, 4]
    sums = {}
    for a in range(128):
        for b in range(128):
            for c in range(8):
                sums[(a * 128 + b) * 8 + c] = sum((-1) ** (i & 1) * y[p][i >> 1] for p, i in enumerate((a, b, c)))
    best = sorted(sums.values(), reverse=True)[:50]
    assert np.allclose([sums[i] for i in one[0][:50]], best, rtol=1e-4)
    assert np.allclose([sums[i] for i in next(t.probes(z[:1], 50))[0]], best, rtol=1e-4)


def test_odd_rows(spark):
    """Nulls, zeros, non-finite components, repeated rows and ids, equal vectors, other lengths."""
    rng = random.Random(2)
    near = lambda v: [x + rng.choice([0, 0.25, -0.5]) for x in v]
    base = [[float(rng.randint(-3, 3)) for _ in range(6)] for _ in range(12)]
    rows = [(i, near(rng.choice(base))) for i in range(150)]
    rows = [(i, v if any(v) else [1.0] * 6) for i, v in rows]
    rows += [(200 + i, base[0]) for i in range(40)] + [(200, base[0])] * 2 + [(205, base[0])]
    rows += [(300, None), (300, []), (300, [0.0] * 6), (300, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (300, [math.nan] * 6), (300, [math.inf] + [1.0] * 5), (None, base[0])]
    rows += [(400 + i, [1.0, 2.0, float(i)]) for i in range(4)] + [(500, [5.0])]
    wanted = brute(rows, lambda i: i % 5 == 0)
    got = results(nearest(frame(spark, rows), F.col("vec_id") % 5 == 0, target=1.0))  # the sample holds all queries
    assert 500 not in got and len(got[400]) == 3
    same(got, wanted)


def test_fewer_than_k_and_empty(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(4)]
    same(results(nearest(frame(spark, rows), F.col("vec_id") == 0)), brute(rows, lambda i: i == 0))
    assert nearest(frame(spark, rows[:1]), F.col("vec_id") == 0).collect() == []
    assert nearest(frame(spark, rows), F.lit(False)).collect() == []
    assert nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).collect() == []


def test_ids_of_any_type(spark):
    rows = [(f"v{i:02}", [float(i), 1.0, 2.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "name string, e array<double>")
    got = nearest(df, F.col("name") == "v07", k=4, id_col="name", vec_col="e").orderBy("rank").collect()
    assert [(r["query"], r.vec_id, r.score) for r in got] == [("v07", "v06", 1.0), ("v07", "v08", 1.0), ("v07", "v05", 2.0), ("v07", "v09", 2.0)]


def test_recall(spark):
    """Against brute force, over vectors without any structure and over near copies of a few."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in table], dtype=float), np.array([r.vec_id for r in table])
    rng = np.random.default_rng(5)
    copies = x[:3].repeat(300, 0) + rng.normal(0, 0.02, (900, 64))
    for vectors, names in ((x, ids), (np.concatenate((x, copies)) * rng.uniform(0.5, 2, (len(x) + 900, 1)), np.concatenate((ids, 10_000 + np.arange(900))))):
        df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(names, vectors, strict=True)], "vec_id long, embedding array<double>")
        got = results(nearest(df, F.col("vec_id") % 50 == 0))
        found = wanted = 0
        for i in names[names % 50 == 0]:
            d = np.sqrt(((vectors - vectors[names == i]) ** 2).sum(1))
            order = [j for j in np.lexsort((names, d)) if names[j] != i][:10]
            assert len(got[int(i)]) == 10 and [s for _, s, _ in got[int(i)]] == pytest.approx([d[names == j][0] for j, _, _ in got[int(i)]])
            found, wanted = found + len({int(names[j]) for j in order} & {j for j, _, _ in got[int(i)]}), wanted + 10
        assert found >= 0.9 * wanted


def test_coarser_buckets_where_probes_run_out(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_PROBES", 4)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(600).collect()]
    got = results(nearest(frame(spark, rows), F.col("vec_id") % 50 == 0, tables=4))
    wanted = brute(rows, lambda i: i % 50 == 0)
    hits = [len({x[0] for x in found} & {x[0] for x in got[q]}) for (q, _), found in wanted.items()]
    assert sum(hits) >= 9 * len(hits)


def test_sketches_tell_cosines():
    rng = np.random.default_rng(3)
    for dim in (1, 3, 64, 200):
        x = rng.normal(size=(400, dim)) * rng.uniform(0.1, 10, (400, 1))
        y = x + rng.normal(size=x.shape) * np.abs(x).mean(axis=1, keepdims=True)
        a, b = (neighbours.Sketch(dim).levels(z) for z in (x, y))
        assert a.min() >= 0 and a.max() <= 15 and a.shape[1] <= 64
        bits = np.stack([np.unpackbits(p.view(np.uint8).reshape(-1, 8), axis=1) for p in neighbours._planes(a)])
        assert ((bits * (1 << np.arange(4))[:, None, None]).sum(0)[:, : a.shape[1]] == a).all()
        if dim == 64:
            cosine = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            told = (2 * neighbours.closeness(a, b) + 225 * 64) / 4 * (2 * neighbours.CUT / 16) ** 2 / 64
            assert np.abs(told - cosine).mean() < 0.03


def test_buckets_are_screened_where_they_meet(spark):
    """The join gives what is as close as neighbours are, not all that shares a bucket, and each such pair of the sample."""
    classes = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("cls"), F.col("embedding").alias("vec"), (F.col("vec_id") % 50 == 0).alias("asked"))
    n = classes.count()
    tables = neighbours.tables_for(n)
    bits, probes, least = neighbours.fitted(classes, n, 10, tables)
    index, looked = neighbours._keys(classes, bits, tables), neighbours._keys(classes.filter("asked"), bits, tables, probes, least)
    met = index.join(looked, ["dim", "tab", "bucket"]).select("cls", "q", neighbours._close().alias("close")).toPandas()
    rows = classes.toPandas().set_index("cls")
    told = {i: neighbours.Sketch(64).levels(np.array([v], dtype=float)) for i, v in rows["vec"].items()}
    assert [neighbours.closeness(told[c], told[q])[0] >= least[64] for c, q in zip(met["cls"][:3000], met["q"][:3000], strict=True)] == list(met["close"][:3000])
    assert 0 < met["close"].sum() < len(met) / 3


def test_queries_without_close_vectors_are_looked_up_again(spark, monkeypatch):
    """A screen that lets nothing pass changes no result."""
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").limit(600).select("vec_id", "embedding").localCheckpoint()
    wanted = results(nearest(vectors, F.col("vec_id") % 50 == 0, target=1.0))
    fitted = neighbours.fitted
    monkeypatch.setattr(neighbours, "fitted", lambda *a, **k: (*fitted(*a, **k)[:2], {64: 1 << 30}))
    compared = []
    monkeypatch.setattr(neighbours, "_dealt", lambda q, *a, dealt=neighbours._dealt: compared.append(q.count()) or dealt(q, *a))
    assert results(nearest(vectors, F.col("vec_id") % 50 == 0, target=1.0)) == wanted and compared == [12, 12]


def test_rows_grow_as_the_vectors(spark):
    """Five times the vectors are five times the entries and no more probes for each query."""
    rng = np.random.default_rng(9)
    made = []
    for n in (1000, 5000):
        classes = spark.createDataFrame([(i, v.tolist(), i % 50 == 0) for i, v in enumerate(rng.normal(size=(n, 64)))], "cls long, vec array<double>, asked boolean").localCheckpoint()
        tables = neighbours.tables_for(n)
        bits, probes, least = neighbours.fitted(classes, n, 10, tables)
        made.append((neighbours._keys(classes, bits, tables).count(), neighbours._keys(classes.filter("asked"), bits, tables, probes, least).count()))
    (entries, probed), (more_entries, more_probed) = made
    assert more_entries == 5 * entries and more_probed <= 5.5 * probed


@pytest.mark.parametrize("bounded", (False, True))
def test_vectors_stream_past_queries(monkeypatch, bounded):
    """Many small batches, ties, and bounds that leave no nearest out."""
    monkeypatch.setattr(neighbours, "_PAIR_VALUES", 100)
    monkeypatch.setattr(neighbours, "_WAITING", 50)
    rng = np.random.default_rng(4)
    x, q = rng.integers(-2, 3, (700, 5)).astype(float), rng.integers(-2, 3, (30, 5)).astype(float)
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    cls = rng.permutation(700)
    bound = np.sort(d, axis=1)[:, 10] if bounded else np.full(30, math.inf)
    none = [np.zeros(700, np.int64)] * neighbours.LEVEL_BITS
    held = neighbours._Held(7)
    for at in (0, 20):
        part = slice(at, at + (20 if at == 0 else 10))
        held.ask(100 + np.arange(30)[part], q[part], [p[:30][part] for p in none], np.full(30, neighbours._ANY)[part], bound[part])
    for at in range(0, 700, 90):
        part = slice(at, at + 90)
        held.meet(cls[part], np.ones(700, np.int64)[part], x[part], [p[part] for p in none], none[0][part])
    found = sorted(zip(*(c.to_pylist() for c in held.found().columns), strict=True), key=lambda r: (r[0], r[3], r[1]))
    assert found == [(100 + i, int(cls[j]), 1, d[i, j]) for i in range(30) for j in np.lexsort((cls, d[i]))[:7]]


def test_long_buckets_and_blocks_of_queries(spark, monkeypatch):
    """A bucket of most vectors is dealt to groups, and queries to blocks; the nearest stay the same."""
    rng = np.random.default_rng(6)
    vectors = np.concatenate((rng.normal(size=(1, 64)) + rng.normal(0, 0.01, (450, 64)), rng.normal(size=(150, 64))))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    monkeypatch.setattr(neighbours, "HELD_BYTES", 5000)
    dealt = []
    compared = neighbours._compared
    monkeypatch.setattr(neighbours, "_compared", lambda entries, queries, keys, most: dealt.append(queries.agg(*(F.max(c) for c in keys if c in ("part", "block"))).first()) or compared(entries, queries, keys, most))
    same(results(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, target=1.0)), brute(rows, lambda i: i % 50 == 0))
    assert all(d["max(block)"] > 0 for d in dealt) and dealt[1]["max(part)"] > 0


def test_far_pairs_are_told_at_any_scale():
    """Products that overflow or vanish leave no near vector out."""
    rng = np.random.default_rng(8)
    none = [np.zeros(300, np.int64)] * neighbours.LEVEL_BITS
    for scale in (1e-170, 1e-161, 1e-160, 1e-155, 1.0, 1e152, 1e160):
        x = rng.normal(size=(300, 8)) * scale
        with np.errstate(over="ignore"):
            d = np.sqrt(((x[0] - x) ** 2).sum(1))
            held = neighbours._Held(5)
            held.ask(np.array([7]), x[:1], [p[:1] for p in none], np.array([neighbours._ANY]), np.sort(d)[9:10])
            for at in range(0, 300, 60):
                held.meet(np.arange(at, at + 60), np.ones(60, np.int64), x[at : at + 60], [p[:60] for p in none], none[0][:60])
                held._settle()
        assert held.found().column("cls").to_pylist() == list(np.lexsort((np.arange(300), d))[:5])
