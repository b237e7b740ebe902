"""Sharding by histogram sort.

Documents are sorted over all shards by a key and cut into shards of equal bytes.  The cut
keys (splitters) are found on a narrow written table of (key, bytes): each round draws probe
keys from inside the intervals that still hold a splitter, counts the exact bytes up to each
probe in every partition, and narrows the intervals.  When every splitter meets the tolerance
the documents are exchanged once, straight to their shard, and sorted there.

Defined results: a null key part sorts first; a null text weighs 0 bytes; rows with one key
stay in one shard, ordered by text; an empty table gives no rows; columns of the input called
shard or pos are replaced, others stay whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from heapq import nsmallest
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh, written

_KEY, _BYTES, _SHARD = "__key", "__bytes", "__shard"


def order_key(df: DataFrame, columns: list[str]) -> Column:
    """A string whose byte order is the order of the columns; whole numbers, else text."""
    parts = []
    for c in columns:
        if isinstance(df.schema[c].dataType, T.IntegralType):
            coded = F.lpad(F.hex(F.col(c).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
        else:
            coded = F.concat(F.hex(F.col(c).cast("string")), F.lit(" "))
        parts.append(F.coalesce(F.concat(F.lit("1"), coded), F.lit("0")))
    return F.concat(*parts)


def _count(sizes: DataFrame, probes: list[str]) -> list[int]:
    """Exact bytes of the keys up to each probe; at the end those of all keys."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = np.fromiter((bisect_left(probes, k) for k in b.column(0).to_pylist()), np.int64, b.num_rows)
            np.add.at(total, at, b.column(1).to_numpy())
        bins = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(total[bins])], ["bin", "bytes"])

    found = sizes.mapInArrow(part, "bin long, bytes long").groupBy("bin").agg(F.sum("bytes").alias("bytes")).collect()
    total = np.zeros(len(probes) + 1, np.int64)
    for r in found:
        total[r["bin"]] = r["bytes"]
    return np.cumsum(total).tolist()


def _draw(sizes: DataFrame, intervals: list[tuple[str, str]], want: list[int], seed: int) -> dict[int, list[str]]:
    """For each open interval, ``want`` of the keys strictly inside (all, if they are fewer)."""
    lows, highs = [a for a, _ in intervals], [b for _, b in intervals]

    def rank(i: int, key: str) -> tuple:
        return (crc32(key.encode(), seed), key)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside: dict[int, set[str]] = {}
        for b in batches:
            for k in b.column(0).to_pylist():
                i = bisect_left(lows, k) - 1
                if i >= 0 and k < highs[i]:
                    inside.setdefault(i, set()).add(k)
        rows = [(i, k, r) for i, ks in inside.items() for r, k in nsmallest(want[i], (rank(i, k) for k in ks))]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["i", "k", "r"])

    wanted = F.element_at(F.array(*[F.lit(w) for w in want]), (F.col("i") + 1).cast("int"))
    drawn = (
        sizes.mapInArrow(part, "i long, k string, r long").distinct()
        .withColumn("n", F.row_number().over(Window.partitionBy("i").orderBy("r", "k")))
        .filter(F.col("n") <= wanted).select("i", "k").collect()
    )
    out: dict[int, list[str]] = {}
    for r in drawn:
        out.setdefault(r["i"], []).append(r["k"])
    return out


def splitters(sizes: DataFrame, shards: int, tolerance: float = 0.0, probes: int = 32) -> list[str]:
    """The shards - 1 cut keys of a (key, bytes) table.

    Splitter j is the least key whose bytes up to and with it reach j / shards of all bytes,
    or, with a tolerance above 0, a probe whose bytes miss that by no more than this share of a shard.
    """
    span = sizes.agg(F.sum(_BYTES).alias("t"), F.max(_KEY).alias("k")).first()
    if not span["t"]:
        return []
    total, slack = int(span["t"]), tolerance * int(span["t"]) / shards
    low, high = {j: "" for j in range(1, shards)}, {j: span["k"] for j in range(1, shards)}
    open_, seed = set(low), 0
    while open_:
        seed += 1
        intervals = sorted({(low[j], high[j]) for j in open_})
        want = [probes * sum((low[j], high[j]) == x for j in open_) for x in intervals]
        drawn = _draw(sizes, intervals, want, seed)
        open_ = {j for j in open_ if drawn.get(intervals.index((low[j], high[j])))}
        keys = sorted({k for ks in drawn.values() for k in ks})
        if not keys:
            break
        below = _count(sizes, keys)
        for j in list(open_):
            lo, hi = bisect_left(keys, low[j]), bisect_left(keys, high[j])
            for k, b in zip(keys[lo:hi], below[lo:hi]):
                if b * shards >= j * total:
                    high[j] = k
                    break
                if k > low[j]:
                    low[j] = k
            for k, b in zip(keys[lo:hi], below[lo:hi]):
                if slack and abs(b - j * total / shards) <= slack:
                    high[j] = k
                    open_.discard(j)
                    break
    return [high[j] for j in range(1, shards)]


def histogram_sort(
    docs: DataFrame, keys: tuple[str, ...] = ("source", "doc_id"), text: str = "text", shard_bytes: int = 32 << 20,
    least_shards: int = 8, tolerance: float = 0.0, probes: int = 32,
) -> DataFrame:
    """All rows of docs with shard and pos (place in the shard), sorted by keys over all shards.

    There are max(least_shards, bytes of all texts / shard_bytes) shards.  tolerance: how far, as a
    share of a shard, a cut may lie from the even one; at 0 the cuts are the exact ones, whatever the
    partitions.  probes: keys tried for each open splitter in a round.
    """
    weighed = docs.select(order_key(docs, list(keys)).alias(_KEY), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias(_BYTES))
    sizes = written(weighed, "sizes")
    total = sizes.agg(F.sum(_BYTES)).first()[0] or 0
    shards = max(least_shards, -(-total // shard_bytes))
    cuts = splitters(sizes, shards, tolerance, probes)

    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        return pd.Series([bisect_left(cuts, k) for k in key], dtype="int32")

    key, at = fresh(docs, _KEY, _SHARD)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "pos")]
    rows = docs.withColumn(key, order_key(docs, list(keys))).withColumn(at, shard_of(F.col(key)))
    placed = rows.repartitionById(shards, F.col(at)).sortWithinPartitions(at, key, text)
    by = Window.partitionBy(at).orderBy(key, text)
    return placed.select(*kept, F.col(at).alias("shard"), (F.row_number().over(by) - 1).alias("pos"))
