"""Vectorised text kernels shared by the Arrow operators of this subpackage.

Everything here works on the raw UTF-8 bytes of a whole Arrow string column at once: word
boundaries, word hashes and hashes of word windows are numpy expressions over the buffer, so a
document costs no per-word Python object. Words are the runs of bytes outside space and
``\\x09-\\x0d``; as UTF-8 continuation bytes never fall in that set, byte runs are exactly the
character runs of ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel call works on; temporaries take about 40 bytes for each of them.
CHUNK_BYTES = 1 << 19
#: Rows of one kernel call, for columns of very short texts.
CHUNK_ROWS = 4096

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of letters and digits, every byte of a character beyond ASCII included.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = _U(base)
        np.multiply.accumulate(out, out=out)
    return out


_tables: dict[int, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if 0 not in _tables or len(_tables[0]) < n:
        size = 1 << max(16, n.bit_length())
        _tables[0], _tables[1] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _tables[0], _tables[1]


class Words:
    """Words of a run of documents.

    ``hash``: 64-bit hash of each word; ``start``/``end``: its byte range in the buffer;
    ``first``: index of each document's first word, with the total as last entry.
    """

    __slots__ = ("end", "first", "hash", "start")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False, alphabet: np.ndarray = _IS_WORD):
        size = len(data)
        if lower:
            data = _LOWER[data]
        word = np.zeros(size + 1, dtype=bool)
        np.take(alphabet, data, out=word[:size])
        opens = word[:-1].copy()
        opens[1:] &= ~word[: size - 1] if size > 1 else opens[1:]
        cuts = bounds[(bounds > 0) & (bounds < size)]
        opens[cuts] = word[cuts]
        self.start = np.flatnonzero(opens)
        closes = word[:-1] & ~word[1:]
        ends = cuts - 1
        closes[ends] = word[ends]
        self.end = np.flatnonzero(closes) + 1
        power, inverse = _power_table(size + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(power[:size] * (data.astype(np.uint64) + _U(1)), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, bounds)

    def windows(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside one document, by word index of the first; and which of them are inside."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            out += self.hash[i : n - k + 1 + i] * _U(_odd(salt * 1000 + i))
        inside = np.ones(n - k + 1, dtype=bool)
        for f in self.first[1:-1]:
            inside[max(0, f - k + 1) : f] = False
        return mix(out), inside


def _odd(i: int) -> int:
    """A fixed odd 64-bit multiplier for place i."""
    x = (i + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1
    x ^= x >> 29
    x = x * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return x ^ x >> 32 | 1


def sequence_hash(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's whole word sequence."""
    power, inverse = _power_table(len(words.hash) + 1)
    out = []
    for salt in (0, 1):
        sums = np.zeros(len(words.hash) + 1, dtype=np.uint64)
        np.cumsum(power[: len(words.hash)] * mix(words.hash + _U(salt)), out=sums[1:])
        a, b = words.first[:-1], words.first[1:]
        out.append(mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) + _U(salt)))
    return out[0], out[1]


def chunks(text: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) over a string column; nulls are empty; a chunk has one row at least."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + chunk_bytes, side="right")) - 1)
        j = min(j, n, i + CHUNK_ROWS)
        yield i, j, raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 * CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose string column has about ``most`` bytes, for operators that copy it; a part has one row at least."""
    for batch in batches:
        sizes = np.cumsum(np.concatenate(([0], np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64)))))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + most, side="right")) - 1)
            yield batch.slice(i, min(j, batch.num_rows) - i)
            i = j
    pa.default_memory_pool().release_unused()


def per_doc(flags_first: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Document index of each word position."""
    return np.searchsorted(flags_first, positions, side="right") - 1


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array: the values dealt out by counts."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
