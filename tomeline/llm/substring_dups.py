"""Exact removal of repeated passages by seed and extend.

1. *Seeds.* Every document is winnowed (Schleimer, Wilkerson, Aiken 2003): of each ``length`` words,
   the smallest hash among their ``seed`` -word grams is an anchor, so two documents that share
   ``length`` words share an anchor. Anchors of one document only are dropped. Each other one has
   its owners: a hash deals documents into ``OWNERS`` classes, and the smallest doc_id of each owns it.
2. *Extend.* Documents meet the earlier owners of their anchors, never each other, so a group of copies
   costs what its members cost. Around each anchor the words to the left and to the right are compared
   with those around the owner's anchor, as far as a window of ``length`` words reaches; a longer match
   goes on from its next anchor. Windows within the match are in the owner, an earlier document.
3. *Edges.* A window that leaves all these matches may still be in a further document. Its anchor, and
   whether a match around that takes all of the window, depend on its words alone: where an earlier
   document lost the window to an owner, so does this one. So these windows need meet only each other. Neighbouring ones form a run; of documents with equal runs all but the
   first lose it whole, and only that one's windows are looked up one by one, each for its smallest
   doc_id.
4. Runs of such windows, joined where they touch or overlap, are the maximal repeats; their words go.

Documents whose whole word sequence occurs in an earlier document are decided from a hash of it,
before any seeds are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .ids import numbered_ids
from .scratch import Scratch

SEED = 5
#: Documents with which those that share an anchor are compared, at most. More leave fewer windows to look up, where owners differ from their copies, but move more words.
OWNERS = 1


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _raw(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def _seeder(length: int):
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, bounds in K.chunks(batch.column(1)):
                words = K.Words(data, bounds)
                whole = K.sequence_hash(words)
                sizes = np.diff(words.first)
                grams, _ = words.windows(SEED)
                _, inside = words.windows(length)
                low = _sliding_min(grams, length - SEED + 1)[: len(inside)]
                new = inside.copy()
                new[1:] &= ~(inside[:-1] & (low[1:] == low[:-1]))
                at = np.flatnonzero(new)
                counts = np.diff(np.searchsorted(at, words.first))
                raw = data.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)), pa.array(sha), K.lists(low[at].view(np.int64), counts, pa.int64())],
                    names=["doc_id", "n_words", "whole_a", "whole_b", "sha", "anchors"],
                )

    return seed


def _around(words: K.Words, place: np.ndarray, length: int) -> np.ndarray:
    """Hashes (uint32) of the words before and after the grams at ``place``, as far as a window reaches, nearest first; 0 beyond the document."""
    doc = np.searchsorted(words.first, place, side="right") - 1
    reach = np.arange(length - SEED)
    out = []
    for at in (place[:, None] - 1 - reach, place[:, None] + SEED + reach):
        inside = (at >= words.first[doc][:, None]) & (at < words.first[doc + 1][:, None])
        h = (words.hash[np.where(inside, at, 0)] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        out.append(np.where(inside, h, np.uint32(0)))
    return np.concatenate(out, axis=1)


def _grams(words: K.Words) -> np.ndarray:
    """Hashes of the grams that lie in one document each, by word; others are given the hash of nothing, 0."""
    grams, inside = words.windows(SEED)
    return np.where(inside, grams, np.uint64(0))


def _own(length: int):
    """(anchor, owner, around) of the first place of each anchor that a document owns; columns: doc_id, text, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = batch.column(2)
            for i, j, data, bounds in K.chunks(batch.column(1)):
                words = K.Words(data, bounds)
                grams, found, places, docs = _grams(words), [], [], []
                for d in range(i, j):
                    f, e = words.first[d - i], words.first[d - i + 1]
                    own = np.unique(anchors[d].values.to_numpy().view(np.uint64))
                    value, at = np.unique(grams[f : max(f, e - SEED + 1)], return_index=True)
                    hit = np.isin(value, own)
                    found.append(value[hit])
                    places.append(f + at[hit])
                    docs.append(np.full(int(hit.sum()), d))
                found, places = np.concatenate(found), np.concatenate(places).astype(np.int64)
                around = _around(words, places, length)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), batch.column(0).take(pa.array(np.concatenate(docs), pa.int64())), pa.array([x.tobytes() for x in around], pa.binary())], names=["anchor", "owner", "around"])

    return run


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true values."""
    turn = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
    return turn[::2], turn[1::2] - 1


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. count - 1 for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _spans(words: K.Words, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the words from each start to before each end."""
    power, inverse = K._power_table(len(words.hash) + 1)
    out = []
    for salt in (0, 1):
        sums = np.zeros(len(words.hash) + 1, dtype=np.uint64)
        np.cumsum(power[: len(words.hash)] * K.mix(words.hash + np.uint64(salt)), out=sums[1:])
        out.append(K.mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) + np.uint64(salt)))
    return out[0], out[1]


def _extender(length: int):
    """Runs of neighbouring windows, as first and last place: those in an owner's match without hashes, those that leave it once for each different run of a document, with hashes of its words and of each of its windows; columns: doc_id, text, seeds (anchor, owner, around)."""
    reach = length - SEED

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seeds = batch.column(0).to_numpy(), batch.column(2)
            for i, j, data, bounds in K.chunks(batch.column(1)):
                words = K.Words(data, bounds)
                grams, whole = _grams(words), K.sequence_hash(words)[0].view(np.int64)
                a, inside = words.windows(length)
                b, _ = words.windows(length, salt=1)
                # Each window's anchor is its smallest gram, the first of equals: the words of the window alone decide it.
                low = _sliding_min(grams, reach + 1)[: len(inside)]
                place = np.zeros(len(low), dtype=np.int64)
                for r in range(reach, -1, -1):
                    place = np.where(grams[r : r + len(low)] == low, np.arange(len(low)) + r, place)
                copied, edge = np.zeros(len(inside), dtype=bool), np.zeros(len(inside), dtype=bool)
                for d in range(i, j):
                    f, e = words.first[d - i], words.first[d - i + 1]
                    if e - f < length:
                        continue
                    rows = seeds[d].values
                    anchor, owner = rows.field("anchor").to_numpy().view(np.uint64), rows.field("owner").to_numpy()
                    order = np.lexsort((owner, anchor))
                    anchor, owner = anchor[order], owner[order]
                    theirs = np.frombuffer(b"".join(rows.field("around").to_pylist()), np.uint32).reshape(-1, 2 * reach)[order]
                    windows = f + np.flatnonzero(np.isin(low[f : e - length + 1], anchor))
                    hits, of = np.unique(place[windows], return_inverse=True)
                    before = place[windows] - windows
                    ours = _around(words, hits, length)
                    row, end = np.searchsorted(anchor, grams[hits], side="left"), np.searchsorted(anchor, grams[hits], side="right")
                    gone, first = np.zeros(len(windows), dtype=bool), np.zeros(len(windows), dtype=bool)
                    for k in range(OWNERS):
                        at = np.minimum(row + k, len(anchor) - 1)
                        same = (ours == theirs[at]) & (ours != 0) & (row + k < end)[:, None]
                        left, right = (np.logical_and.accumulate(same[:, s], axis=1).sum(axis=1) for s in (slice(0, reach), slice(reach, None)))
                        match = (row + k < end)[of] & (left[of] >= before) & (right[of] >= reach - before)
                        gone |= match & (owner[at] < ids[d])[of]
                        if k == 0:  # no document before the first owner has the anchor
                            first = match & (owner[at] == ids[d])[of]
                    copied[windows[gone]] = True
                    edge[windows[~gone & ~first]] = True
                # Runs end with their document: none of its windows reaches into the next one.
                (first, last), (begin, end) = _runs(copied), _runs(edge)
                run_a, run_b = _spans(words, begin, end + length)
                doc = np.searchsorted(words.first, begin, side="right") - 1
                # A periodic text has the same run over and over: one row, with all its places.
                order = np.lexsort((begin, run_b, run_a, doc))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (doc[order][1:] != doc[order][:-1]) | (run_a[order][1:] != run_a[order][:-1]) | (run_b[order][1:] != run_b[order][:-1])
                heads = order[new]
                size = end[heads] - begin[heads]
                of_key = np.repeat(begin[heads], size + 1) + _ramp(size + 1)
                n, m = len(heads), len(first)
                docs = np.concatenate((doc[heads], np.searchsorted(words.first, first, side="right") - 1))
                places = np.concatenate((begin[order], first)) - words.first[np.concatenate((doc[order], docs[n:]))]
                several = np.diff(np.concatenate((np.flatnonzero(new), [len(order)])))
                counts = np.concatenate((size + 1, np.zeros(m, np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((run_a[heads].view(np.int64), np.zeros(m, np.int64))), mask=np.arange(n + m) >= n),
                        pa.array(np.concatenate((run_b[heads].view(np.int64), np.zeros(m, np.int64)))),
                        pa.array(ids[i + docs]),
                        pa.array(whole[docs]),
                        K.lists(places.astype(np.int32), np.concatenate((several, np.ones(m, np.int64))), pa.int32()),
                        pa.array(np.concatenate((size, last - first)).astype(np.int32)),
                        K.lists(a[of_key].view(np.int64), counts, pa.int64()),
                        K.lists((b[of_key] >> np.uint64(32)).astype(np.uint32).view(np.int32), counts, pa.int32()),
                    ],
                    names=["run_a", "run_b", "doc_id", "whole_a", "places", "size", "keys_a", "keys_b"],
                )

    return extend


def _cutter(length: int):
    """Removes the words of the windows that begin at ``runs`` (from each of places, size further ones); columns: doc_id, text, whole_a, runs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wa, out = batch.column(2).to_numpy(), []
            whole = np.concatenate([K.sequence_hash(K.Words(data, bounds))[0] for _, _, data, bounds in K.chunks(batch.column(1))]) if batch.num_rows else []
            for d, raw in enumerate(_raw(batch, 1)):
                words = raw.split()
                if whole[d].view(np.int64) != wa[d]:  # another row with the same doc_id
                    out.append((None, None, None))
                    continue
                gone = np.zeros(len(words) + 1, dtype=np.int32)
                runs = batch.column(3)[d].values
                places = runs.field("places")
                begin = places.flatten().to_numpy()
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + np.repeat(runs.field("size").to_numpy(), places.value_lengths().to_numpy()) + length, -1)
                stays = np.cumsum(gone)[:-1] == 0
                rest = b" ".join(w for w, s in zip(words, stays, strict=True) if s)
                out.append((len(words) - int(stays.sum()), hashlib.sha256(rest).hexdigest(), rest.decode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())],
                names=["doc_id", "whole_a", "n_removed", "kept_sha256", "kept_text"],
            )

    return cut


def remove_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256; ``with_text`` adds kept_text, the kept words joined by spaces.

    A word goes if a window of ``length`` consecutive words that covers it also starts in a document
    with a smaller doc_id; windows are judged on the input, not on what is left. Words are runs
    outside ASCII white space, unchanged. (kept_text is null for rows that lose nothing: their text
    stands as it is. For a row that loses all it is empty.)

    A null or empty text has no words: zeros and the hash of the empty string. Texts under ``length``
    words lose nothing. Rows that repeat a doc_id are judged each on its own text and never remove
    each other's words. A row without doc_id loses nothing and removes nothing. Ids may be of any type
    that has an order. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    docs, back = numbered_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), scratch)
    texts = docs.select("doc_id", "text")
    seeds = scratch.table("seeds", texts.mapInArrow(_seeder(length), "doc_id long, n_words long, whole_a long, whole_b long, sha string, anchors array<long>"))
    able = seeds.filter((F.col("n_words") >= length) & F.col("doc_id").isNotNull())

    whole = ["whole_a", "whole_b"]
    owner = able.select("doc_id", *whole).groupBy(*whole).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    copied = scratch.table("copied", owner.filter("owner < last").drop("last"))
    heads = able.join(copied, whole, "left").filter(F.col("owner").isNull() | (F.col("owner") == F.col("doc_id")))
    heads = scratch.table("heads", heads.select("doc_id", "anchors"))

    places = heads.select("doc_id", F.explode(F.array_distinct("anchors")).alias("anchor"))
    classes = [F.min(F.when(F.pmod(F.xxhash64("doc_id"), F.lit(OWNERS)) == c, F.col("doc_id"))) for c in range(OWNERS)]
    shared = places.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.array_compact(F.array(*classes)).alias("owners")).filter("lo < hi")
    shared = scratch.table("shared", shared.select("anchor", F.explode("owners").alias("owner")))
    # What stands around each shared anchor in its owners; of several rows of one doc_id, one.
    owned = texts.join(shared.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("anchor").alias("anchors")), "doc_id")
    around = owned.select("doc_id", "text", "anchors").mapInArrow(_own(length), "anchor long, owner long, around binary")
    around = scratch.table("around", around.groupBy("anchor", "owner").agg(F.min("around").alias("around")))
    scratch.drop("shared")
    suspects = places.join(around, "anchor").filter(F.col("owner") <= F.col("doc_id")).groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "owner", "around")).alias("seeds"))
    suspects = scratch.table("suspects", suspects)
    scratch.drop("around", "heads")

    found = texts.join(suspects, "doc_id").select("doc_id", "text", "seeds")
    found = scratch.table("found", found.mapInArrow(_extender(length), "run_a long, run_b long, doc_id long, whole_a long, places array<int>, size int, keys_a array<long>, keys_b array<int>"))
    scratch.drop("suspects")
    run = ["run_a", "run_b"]
    edges = found.filter("run_a is not null")
    heads = scratch.table("run-heads", edges.groupBy(*run).agg(F.min("doc_id").alias("head")))
    edges = edges.join(heads, run)
    equal = edges.filter("doc_id > head").select("doc_id", "whole_a", "places", "size")
    windows = edges.filter("doc_id = head").select("doc_id", "whole_a", "places", F.posexplode(F.arrays_zip("keys_a", "keys_b")).alias("nr", "key"))
    windows = scratch.table("windows", windows.select("key.keys_a", "key.keys_b", "doc_id", "whole_a", F.expr("transform(places, p -> p + nr)").alias("places")))
    key = ["keys_a", "keys_b"]
    first = windows.groupBy(*key).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi")).filter("owner < hi").drop("hi")
    first = scratch.table("first", first)
    runs = windows.join(first, key).filter("doc_id > owner").select("doc_id", "whole_a", "places", F.lit(0).alias("size"))
    runs = runs.unionByName(equal).unionByName(found.filter("run_a is null").select("doc_id", "whole_a", "places", "size"))
    marked = scratch.table("marked", runs.groupBy("doc_id", "whole_a").agg(F.collect_set(F.struct("places", "size")).alias("runs")))
    scratch.drop("found", "run-heads", "windows", "first")

    cut = texts.join(marked, "doc_id").select("doc_id", "text", "whole_a", "runs")
    cut = cut.mapInArrow(_cutter(length), "doc_id long, whole_a long, n_removed long, kept_sha256 string, kept_text string").filter("n_removed is not null")
    cut = scratch.table("cut", (cut if with_text else cut.drop("kept_text")).dropDuplicates(["doc_id", "whole_a", "kept_sha256"]))
    scratch.drop("marked")

    out = seeds.select("doc_id", "n_words", *whole, "sha").join(copied, whole, "left").join(cut, ["doc_id", "whole_a"], "left")
    gone = F.col("owner").isNotNull() & (F.col("doc_id") > F.col("owner"))
    empty = hashlib.sha256(b"").hexdigest()
    columns = [
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    return back(out.select(*columns, *([F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else [])), "doc_id")
