"""Packing documents into sequences of one length by bin completion.

A document longer than a sequence is cut into full sequences and a rest; rests are packed
whole.  Documents are dealt by hash into groups of about ``group_chars``, which are packed on
their own: each by best-fit decreasing, and where that needs more sequences than the lower
bound, by a branch-and-bound search that fills the sequence of the largest document left with
every undominated set of others, least waste first, and cuts off what cannot beat the incumbent.

Defined results: null and empty texts take no room and have no piece; repeated rows are packed
as often as they come; documents of one length are taken in the order of their ids; an empty
table gives no rows; further columns are not looked at, whatever their names; ids may be of any type, and null.
"""

from __future__ import annotations

import sys
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAVES = 16


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins of positions in sizes (falling), each size put where the least room stays."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i, s in enumerate(sizes):
        k = bisect_left(free, (s, -1))
        if k == len(free):
            bins.append([i])
            left, b = room - s, len(bins) - 1
        else:
            left, b = free.pop(k)
            left -= s
            bins[b].append(i)
        if left:
            insort(free, (left, b))
    return bins


def lower_bound(sizes: list[int], room: int) -> int:
    """No packing of sizes (falling) has fewer bins: sizes over half a bin, and all the volume beside the barred waste."""
    total = sum(sizes)
    best = -(-total // room)
    big = sum(2 * s > room for s in sizes)
    best = max(best, big)
    for k in {s for s in sizes if 2 * s <= room}:
        alone = [s for s in sizes if s > room - k]
        half = [s for s in sizes if room - k >= s and 2 * s > room]
        rest = sum(s for s in sizes if k <= s and 2 * s <= room) - (len(half) * room - sum(half))
        best = max(best, len(alone) + len(half) + max(0, -(-rest // room)))
    return best


def volume_bound(sizes: list[int], room: int) -> int:
    return max(-(-sum(sizes) // room), sum(2 * s > room for s in sizes))


def fillings(sizes: list[int], room: int, steps: list[int]) -> Iterator[list[int]]:
    """Undominated sets of positions in sizes (falling) that fit into room, larger ones tried first.

    A set is dominated if an unused size fits into its waste, or can take the place of one or two
    of the set's smaller sizes without overflow: what that frees packs no worse elsewhere.  Each set looked at takes one from steps[0]; at 0 it ends.
    """
    n = len(sizes)

    def grow(i: int, left: int, chosen: list[int]) -> Iterator[list[int]]:
        if steps[0] <= 0:
            return
        while i < n and sizes[i] > left:
            i += 1
        if i == n:
            steps[0] -= 1
            taken = set(chosen)
            out = [sizes[j] for j in range(n) if j not in taken]
            if out and out[-1] <= left:
                return
            mine = [sizes[j] for j in chosen]
            swaps = set(mine) | {a + b for k, a in enumerate(mine) for b in mine[k + 1 :]}
            rising = out[::-1]
            for y in swaps:
                k = bisect_left(rising, y + (y in mine))
                if k < len(rising) and rising[k] <= y + left:
                    return
            yield list(chosen)
            return
        yield from grow(i + 1, left - sizes[i], [*chosen, i])
        j = i + 1
        while j < n and sizes[j] == sizes[i]:
            j += 1
        yield from grow(j, left, chosen)

    yield from grow(0, room, [])


def solve(sizes: list[int], room: int, nodes: int) -> tuple[list[list[int]], bool]:
    """The best packing of sizes (falling) found, and whether the search ended before its budget, so that it is the optimum.

    The budget is ``nodes`` search nodes for each hundred sizes, and apart from them LEAVES times as many fillings looked at.
    """
    best = best_fit(sizes, room)
    floor = volume_bound(sizes, room)
    if len(best) > floor:
        floor = lower_bound(sizes, room)
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * len(sizes) + 1000))
    steps = [nodes * max(1, -(-len(sizes) // 100))]
    leaves = [LEAVES * steps[0]]
    ended = True

    def search(left: list[int], done: list[list[int]], waste: int) -> bool:
        nonlocal best, ended
        if not left:
            if len(done) < len(best):
                best = list(done)
            return len(best) == floor
        if steps[0] <= 0:
            ended = False
            return True
        steps[0] -= 1
        mine = [sizes[i] for i in left]
        if waste > (len(best) - 1) * room - sum(sizes) or len(done) + volume_bound(mine, room) >= len(best):
            return False
        tail = best_fit(mine, room)
        if len(done) + len(tail) < len(best):
            best = done + [[left[i] for i in b] for b in tail]
            if len(best) == floor:
                return True
        found = fillings(mine[1:], room - mine[0], leaves)
        # by the handful, so that a node of many fillings does not use up the leaves before the first is followed
        while options := sorted(islice(found, 50), key=lambda f: -sum(mine[1 + i] for i in f)):
            for f in options:
                taken = {0, *(1 + i for i in f)}
                gap = room - sum(mine[i] for i in taken)
                rest = [x for i, x in enumerate(left) if i not in taken]
                if search(rest, [*done, [left[i] for i in sorted(taken)]], waste + gap):
                    return True
        if leaves[0] <= 0:
            ended = False
            return True
        return False

    if len(best) > floor:
        search(list(range(len(sizes))), [], 0)
    return best, ended


def complete(sizes: list[int], room: int, nodes: int) -> list[list[int]]:
    """The packing of solve()."""
    return solve(sizes, room, nodes)[0]


def _sortable(kind: pa.DataType) -> bool:
    return not pa.types.is_nested(kind)


def pack(docs: DataFrame, capacity: int = 16384, group_chars: int = 1 << 20, nodes: int = 500, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pieces of all documents: bin_group, bin, place (from 0 in the bin), doc_id, start and length in characters, at (offset in the bin), proven.

    proven: whether no packing of the group has fewer sequences; false where the search ended on its budget, so that it
    may be (it is never worse than best fit).

    capacity: characters of a sequence.  group_chars: characters packed together on one worker.
    nodes: steps of the search for each hundred rests of a group, after which its best packing so far stands.
    """
    sized = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.length(F.col(text)), F.lit(0)).cast("long").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // group_chars))
    sized = sized.filter("n > 0").withColumn("bin_group", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n", "descending"), ("doc_id", "ascending")]) if _sortable(rows.schema.field("doc_id").type) else rows.sort_by([("n", "descending")])
        lengths = rows.column("n").to_pylist()
        out, b = [], 0
        for i, n in enumerate(lengths):
            for start in range(0, n - capacity + 1, capacity):
                out.append((b, 0, i, start, capacity, 0))
                b += 1
        rests = sorted(((-(n % capacity), i) for i, n in enumerate(lengths) if n % capacity))
        bins, proven = solve([-s for s, _ in rests], capacity, nodes)
        for chosen in bins:
            at = 0
            for place, j in enumerate(chosen):
                size, i = -rests[j][0], rests[j][1]
                out.append((b, place, i, lengths[i] - size, size, at))
                at += size
            b += 1
        bin_, place, row, start, length, at_ = (pa.array(c, pa.int64()) for c in zip(*out))
        m = len(out)
        group = pa.array([rows.column("bin_group")[0].as_py()] * m, pa.int64())
        ids = rows.column("doc_id").take(row)  # never through numbers of another kind
        return pa.Table.from_arrays([group, bin_, place, ids, start, length, at_, pa.array([proven] * m)], names=["bin_group", "bin", "place", "doc_id", "start", "length", "at", "proven"])

    kind = f"bin_group long, bin long, place long, doc_id {docs.schema[key].dataType.simpleString()}, start long, length long, at long, proven boolean"
    return sized.groupBy("bin_group").applyInArrow(one, kind)
