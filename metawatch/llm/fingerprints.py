"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A version of a document is a set of paragraph digests (the first 60 bits of each paragraph's
MD5).  Its sketch has cells (count, sum of digests, sum of check hashes); each digest goes into
three cells, one in each third of the table.  Subtracting the sketches of two versions leaves
the digests in which they differ, and peeling cells that hold a single digest recovers them.
Where peeling gets stuck, the pair is sketched again with twice the cells and new hashes.

Defined results: paragraphs are the lines of a text; empty lines are none, and a null text has
none; a paragraph that repeats in a version counts once; equal versions give no rows; repeated
rows give repeated results; empty tables give no rows; further columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches
from .textarrays import U, mix, pieces

HASHES = 3


def digest(paragraph: str) -> int:
    """60 bits of the paragraph's MD5."""
    return int.from_bytes(hashlib.md5(paragraph.encode()).digest()[:8], "big") >> 4


def cells_of(keys: np.ndarray, sizes: np.ndarray, salt: int) -> np.ndarray:
    """For each key its cell in each third of a table of 3 * sizes cells."""
    spots = [mix(keys + mix(np.array([salt * HASHES + j + 1], np.uint64))) % sizes.astype(np.uint64) + U(j) * sizes.astype(np.uint64) for j in range(HASHES)]
    return np.stack(spots).astype(np.int64)


def check_of(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ U(0xA5A5A5A5A5A5A5A5))


class Sketches:
    """Sketches of many documents side by side: ``thirds[i]`` cells in each third of document i's table."""

    def __init__(self, thirds: np.ndarray, salt: int):
        self.thirds, self.salt = thirds, salt
        self.base = np.concatenate([[0], np.cumsum(thirds * HASHES)])
        size = int(self.base[-1])
        self.count, self.keys, self.checks = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)

    def add(self, docs: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> None:
        if not len(keys):
            return
        spots = (cells_of(keys, self.thirds[docs], self.salt) + self.base[docs]).ravel()
        s = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        w = s.astype(np.uint64)
        np.add.at(self.count, spots, np.tile(s, HASHES))
        np.add.at(self.keys, spots, np.tile(keys * w, HASHES))
        np.add.at(self.checks, spots, np.tile(check_of(keys) * w, HASHES))

    def __sub__(self, other: Sketches) -> Sketches:
        out = Sketches(self.thirds, self.salt)
        out.count, out.keys, out.checks = self.count - other.count, self.keys - other.keys, self.checks - other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents, keys, signs, documents that got stuck); empties the sketches."""
        owner = np.repeat(np.arange(len(self.thirds)), self.thirds * HASHES)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(int(self.thirds.max(initial=1)) * HASHES + 1):
            one = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[one]
            key = self.keys[one] * sign.astype(np.uint64)
            real = self.checks[one] * sign.astype(np.uint64) == check_of(key)
            if not real.any():
                break
            triple = np.unique(np.rec.fromarrays([owner[one[real]], key[real], sign[real]], names="d,k,s"))
            d, k, s = triple["d"], triple["k"], triple["s"]
            self.add(d, k, -s)
            found.append((d, k, s))
        stuck = np.unique(owner[(self.count != 0) | (self.keys != 0) | (self.checks != 0)])
        whole = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        return whole[0], whole[1], whole[2], stuck


def differences(old: list[set[int]], new: list[set[int]], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign, cells used) of every digest in only one set of a pair; sign 1 for the old one."""

    def flat(sets: list[set[int]]) -> tuple[np.ndarray, np.ndarray]:
        n = [len(s) for s in sets]
        return np.repeat(np.arange(len(sets)), n), np.fromiter((x for s in sets for x in s), np.uint64, sum(n))

    (da, ka), (db, kb) = flat(old), flat(new)
    todo, third, salt, out = np.arange(len(old)), max(1, -(-cells // HASHES)), 0, []
    while len(todo):
        place = np.full(len(old), -1)
        place[todo] = np.arange(len(todo))
        a, b = Sketches(np.full(len(todo), third), salt), Sketches(np.full(len(todo), third), salt)
        for sk, d, k in ((a, da, ka), (b, db, kb)):
            live = place[d] >= 0
            sk.add(place[d[live]], k[live])
        d, k, s, stuck = (a - b).peel()
        good = ~np.isin(d, stuck)
        out.append((todo[d[good]], k[good], s[good], np.full(int(good.sum()), third * HASHES)))
        todo, third, salt = todo[stuck], third * 2, salt + 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))


def changed_paragraphs(docs: DataFrame, old: Column, new: Column, cells: int = 12, key: str = "doc_id") -> DataFrame:
    """(doc_id, side, digest): the digests of paragraphs that only the old ("removed") or new ("added") version has.

    old, new: texts of the two versions.  cells: of the first sketch of a pair.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in pieces(big, "a"):
                sets = [[{digest(p) for p in (t or "").split("\n") if p} for t in b.column(i).to_pylist()] for i in (1, 2)]
                d, k, s, _ = differences(*sets, cells)
                order = np.lexsort((k, s, d))
                d, k, s = d[order], k[order], s[order]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array(np.where(s > 0, "removed", "added")), pa.array(k.astype(np.int64))], ["doc_id", "side", "digest"])

    bounded_batches(docs.sparkSession)
    kind = f"doc_id {docs.schema[key].dataType.simpleString()}, side string, digest long"
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(old, F.lit("")).alias("a"), F.coalesce(new, F.lit("")).alias("b")).mapInArrow(part, kind)
