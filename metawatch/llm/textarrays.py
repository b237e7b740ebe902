"""Vectorised words and n-gram hashes over Arrow string columns.

All functions work on the bytes of a whole batch at once.  Null texts count as empty.
Hashes are 64-bit, the same in every process and for equal words at any place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P, _C1, _C2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_PINV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = (x ^ (x >> U(30))) * _C1
    x = (x ^ (x >> U(27))) * _C2
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_POW = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, at least, of the hashes' base and of its inverse."""
    if len(_POW["p"]) < n:
        size = max(n, 2 * len(_POW["p"]))
        for name, base in (("p", _P), ("i", _PINV)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POW[name] = np.cumprod(x, dtype=np.uint64)
    return _POW["p"], _POW["i"]


#: Bytes of words divided by ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of normalised words: ASCII letters and digits, and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def strings(col) -> pa.Array:
    """A string array without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.fill_null(col.cast(pa.string()), "")


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, offsets of each text in them)."""
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of text and ``rows`` rows at most, one row at least, so that memory stays bounded."""
    _, off = raw(strings(batch.column(column)))
    i = 0
    while i < batch.num_rows:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1), i + rows)
        yield batch.slice(i, j - i)
        i = j


def words(data: np.ndarray, off: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of each text's words) of the maximal runs of ``letter`` bytes."""
    m = letter[data]
    edge = off[(off > 0) & (off < len(data))]
    before = np.zeros(len(m), bool)
    before[1:] = m[:-1]
    before[edge] = False
    starts = np.flatnonzero(m & ~before)
    after = np.zeros(len(m), bool)
    after[:-1] = m[1:]
    after[edge - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]."""
    p, inv = powers(len(data) + 1)
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p[: len(data)], out=h[1:])
    return mix((h[ends] - h[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def hash_grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n values in a row; len(values) - n + 1 of them, across texts too."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    p, inv = powers(len(values) + 1)
    h = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=h[1:])
    return mix((h[n:] - h[:-n]) * inv[: len(values) - n + 1] + U(n))


def texts_of(counts: np.ndarray) -> np.ndarray:
    """The text number of each element, from the offsets of the texts."""
    return np.repeat(np.arange(len(counts) - 1), np.diff(counts))


def runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 200_000) -> Iterator[pa.Table]:
    """Tables in which every key's rows are whole, from batches sorted by key; many keys in each."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
            rows = len(k) - cut
    if held:
        yield pa.Table.from_batches(held)
