"""Substring deduplication with suffix automata.

A passage of at least ``least`` words that an earlier document (of lower id) has word by word is cut
out; its first occurrence stays.  What may repeat is narrowed first: winnowed fingerprints (hashes of
25 words, the least in each stretch of 26) are the same wherever a passage of 50 words is, so only the
neighbourhood of a fingerprint that two documents share can hold one.  Neighbourhoods that no lower
document has word by word make up the reference text.  It is split into shards by the place where a
fingerprint first occurs; a shard's suffix automaton is sent to where the documents are that share its
fingerprints, and their neighbourhoods are streamed through it for matching statistics.  (Sending every
automaton to every executor would ship a share of the corpus to each.)  Each state knows the lowest
document that it occurs in, and the statistic counts for a document where that one is lower.

Words are the runs without ASCII white space, compared byte by byte.  A cut takes the words and the
white space after each.

Defined results: a null text stays null and an empty one empty; a document all of whose words repeat
keeps only the white space before its first word; repeats inside one document stay; rows that share an
id are cut each by what documents of lower ids have, never by one another; rows without an id are not searched
and keep their text; an empty table gives no rows; further columns stay, whatever their names, but for
cut_words, which is replaced.  Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, fresh, written
from .textarrays import SPACED, hash_grams, hash_spans, mix, pieces, powers, raw, runs, strings, texts_of, words

#: Words of the first occurrence that go to one shard together.
BLOCK = 256
#: Shared fingerprints of a place that are looked into in one go, about.
LOT = 100_000


class Names(NamedTuple):
    """Columns that are added to the input, under names it does not have."""

    id: str
    mark: str
    doc: str
    of: str
    spots: str
    spans: str
    done: str


def winnow(h: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(positions, fingerprints, k): of every ``least`` words of a text at least one k-gram is chosen, by its content alone."""
    k = (least + 1) // 2
    span = least - k + 1
    g = hash_grams(h, k)
    doc = texts_of(off)
    if len(g) < span:
        return np.zeros(0, np.int64), g[:0], k
    # the least of each span grams in a row, by doubling
    low, width = g.copy(), 1
    while width < span:
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    inside = doc[: len(low)] == doc[np.arange(len(low)) + span + k - 2]
    chosen = np.zeros(len(g), bool)
    for j in range(span):
        chosen[j : j + len(low)] |= inside & (g[j : j + len(low)] == low)
    at = np.flatnonzero(chosen)
    return at, g[at], k


def _fingerprints(docs: DataFrame, least: int) -> DataFrame:
    """(fp, doc, mark, pos, near): pos in words; near: hash of all words that a passage around the fingerprint can hold; mark: tells texts of one id apart."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in pieces(big, "text"):
                data, off = raw(strings(b.column(1)))
                starts, ends, woff = words(data, off, SPACED)
                h = hash_spans(data, starts, ends)
                at, fp, k = winnow(h, woff, least)
                doc = texts_of(woff)[at] if len(at) else np.zeros(0, np.int64)
                lo, hi = np.maximum(at - (least - k), woff[doc]), np.minimum(at + least, woff[doc + 1])
                near = mix(hash_spans_of(h, lo, hi) ^ mix((at - lo).astype(np.uint64)))
                ids = b.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(fp.astype(np.int64)), pa.array(ids[doc]), b.column(2).take(pa.array(doc)), pa.array((at - woff[doc]).astype(np.int32)), pa.array(near.astype(np.int64))], ["fp", "doc", "mark", "pos", "near"])

    return docs.mapInArrow(part, "fp long, doc long, mark long, pos int, near long")


def hash_spans_of(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of values[lo[i]:hi[i]]."""
    p, inv = powers(len(values) + 1)
    run = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[: len(values)], out=run[1:])
    return mix((run[hi] - run[lo]) * inv[lo] + (hi - lo).astype(np.uint64))


def _shared(prints: DataFrame) -> DataFrame:
    """(doc, mark, pos, home, block, first): fingerprints that several documents have; home and place: where the lowest has it; first: no lower document has the same neighbourhood."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "fp"):
            fp, doc, mark, pos, near = (t.column(c).to_numpy() for c in ("fp", "doc", "mark", "pos", "near"))
            head = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            n = np.diff(np.append(head, len(fp)))
            row = np.repeat(np.arange(len(head)), n)
            home, place = doc[head][row], pos[head][row]
            several = (np.maximum.reduceat(doc, head) > doc[head])[row]
            order = np.lexsort((pos, doc, near, row))
            new = np.concatenate([[True], (row[order][1:] != row[order][:-1]) | (near[order][1:] != near[order][:-1])])
            first = np.zeros(len(fp), bool)
            first[order[new]] = True
            s = several
            yield pa.RecordBatch.from_arrays([pa.array(doc[s]), pa.array(mark[s]), pa.array(pos[s]), pa.array(home[s]), pa.array(place[s] // BLOCK), pa.array(first[s])], ["doc", "mark", "pos", "home", "block", "first"])

    sorted_ = prints.repartition("fp").sortWithinPartitions("fp", "doc", "pos")
    return sorted_.mapInArrow(part, "doc long, mark long, pos int, home long, block int, first boolean")


class SuffixAutomaton:
    """Of several word sequences; each state knows the lowest document of its occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.low = [-1], [0], [1 << 62]

    def _state(self, moves: dict[int, int], link: int, length: int, low: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.low.append(low)
        return len(self.next) - 1

    def add(self, sequence: list[int], doc: int) -> None:
        """Take in one sequence of a document."""
        last = 0
        for c in sequence:
            last = self._extend(last, c, doc)

    def _extend(self, last: int, c: int, doc: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                self.low[q] = min(self.low[q], doc)
                return q
            clone = self._split(last, c, q)
            self.low[clone] = min(self.low[clone], doc)
            return clone
        cur = self._state({}, 0, length[last] + 1, doc)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        clone = self._state(dict(nxt[q]), link[q], self.length[p] + 1, self.low[q])
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def finish(self) -> None:
        """Hand each state's lowest document on to its suffixes."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if self.low[s] < self.low[p]:
                self.low[p] = self.low[s]

    def covered(self, sequence: list[int], doc: int, least: int) -> list[tuple[int, int]]:
        """Maximal spans of the sequence made of matches of at least ``least`` words that a lower document has."""
        nxt, link, length, low = self.next, self.link, self.length, self.low
        out: list[tuple[int, int]] = []
        s = n = 0
        for i, c in enumerate(sequence):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                n += 1
            else:
                s = n = 0
            if n >= least:
                t, m = s, n
                while m >= least and low[t] >= doc:
                    t = link[t]
                    m = length[t]
                if m >= least:
                    if out and i + 1 - m <= out[-1][1]:
                        begin = min(out[-1][0], i + 1 - m)
                        out.pop()
                        while out and out[-1][1] >= begin:
                            begin = min(begin, out.pop()[0])
                        out.append((begin, i + 1))
                    else:
                        out.append((i + 1 - m, i + 1))
        return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _neighbourhoods(base: DataFrame, at: Names, shared: DataFrame, least: int, shards: int) -> DataFrame:
    """(home, block, doc, mark, start, ref, words, shard, lot): the stretches of text around shared fingerprints.

    A place where very many documents meet has its queries dealt to several lots, with the reference text in each.
    """
    k = (least + 1) // 2
    hot = shared.groupBy("home", "block").count().filter(F.col("count") > LOT).select("home", "block", F.ceil(F.col("count") / LOT).alias("lots"))
    dealt = shared.join(hot, ["home", "block"], "left")
    spots = dealt.groupBy(F.col("doc").alias(at.doc), F.col("mark").alias(at.of)).agg(F.collect_list(F.struct("home", "block", "pos", "first", F.coalesce("lots", F.lit(1).cast("long")).alias("lots"))).alias(at.spots))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            big = big.select([text_at, doc_at, of_at, spots_at]).rename_columns(["text", "doc", "mark", "spots"])
            big = big.filter(big.column("spots").is_valid())
            for b in pieces(big, "text"):
                data, off = raw(strings(b.column("text")))
                starts, ends, woff = words(data, off, SPACED)
                blob = data.tobytes()
                out: list[tuple] = []
                for i, (doc, mark, spots_) in enumerate(zip(b.column("doc").to_pylist(), b.column("mark").to_pylist(), b.column("spots").to_pylist())):
                    kinds: dict[tuple, list] = {}
                    size = int(woff[i + 1] - woff[i])
                    for x in spots_:
                        span = (max(x["pos"] - (least - k), 0), min(x["pos"] + least, size))
                        kinds.setdefault((x["home"], x["block"], x["lots"], False), []).append(span)
                        if x["first"]:
                            kinds.setdefault((x["home"], x["block"], x["lots"], True), []).append(span)
                    for (home, block, lots, ref), spans in kinds.items():
                        for lo, hi in _merged(spans):
                            a, z = starts[woff[i] + lo], ends[woff[i] + hi - 1]
                            text = blob[a:z].decode()
                            out += [(home, block, doc, mark, lo, ref, text, lot) for lot in (range(lots) if ref else (doc % lots,))]
                cols = list(zip(*out)) or [[]] * 8
                kinds_ = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_)], ["home", "block", "doc", "mark", "start", "ref", "words", "lot"])

    # a left join over all columns, so that this plan's exchange of base is the one that remove_repeats() reads again
    joined = base.join(spots, (base[at.id] == spots[at.doc]) & (base[at.mark] == spots[at.of]), "left")
    text_at, doc_at, of_at, spots_at = (joined.columns.index(c) for c in ("text", at.doc, at.of, at.spots))
    return joined.mapInArrow(part, "home long, block int, doc long, mark long, start int, ref boolean, words string, lot long").withColumn("shard", F.pmod(F.xxhash64("home", "block"), F.lit(shards)))


def _matches(near: DataFrame, least: int, most_words: int) -> DataFrame:
    """(doc, mark, start, end) in words: what a document shares with lower ones, from the automata of its shards."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "shard", 2000):
            shard, lot = t.column("shard").to_numpy(), t.column("lot").to_numpy()
            heads = np.append(np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (lot[1:] != lot[:-1])])), len(shard))
            out: list[tuple[int, int, int, int]] = []
            for a, b in zip(heads[:-1], heads[1:]):
                rows = t.slice(a, b - a)
                ids: dict[bytes, int] = {}
                text = [[ids.setdefault(w, len(ids)) for w in x.encode().split()] for x in rows.column("words").to_pylist()]
                key = list(zip(rows.column("home").to_pylist(), rows.column("block").to_pylist()))
                doc, mark, start, ref = (rows.column(c).to_pylist() for c in ("doc", "mark", "start", "ref"))
                refs = [i for i, r in enumerate(ref) if r]
                at = 0
                while at < len(refs):
                    made, room, homes = SuffixAutomaton(), most_words, set()
                    while at < len(refs) and (room > 0 or not homes):
                        i = refs[at]
                        made.add(text[i], doc[i])
                        room -= len(text[i])
                        homes.add(key[i])
                        at += 1
                    made.finish()
                    for i, r in enumerate(ref):
                        if not r and key[i] in homes:
                            out += [(doc[i], mark[i], start[i] + x, start[i] + y) for x, y in made.covered(text[i], doc[i], least)]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc", "mark", "start", "end"])

    placed = near.repartition("shard", "lot").sortWithinPartitions("shard", "lot", "home", "block", "doc", "mark", "start")
    return placed.mapInArrow(part, "doc long, mark long, start int, end int")


def repeated_spans(base: DataFrame, at: Names, least: int = 50, shard_words: int = 20_000) -> DataFrame:
    """(at.doc, at.of, at.spans: of the words that go, as pairs of first word and the one after the last), only documents that have some.

    base: the rows, with an id and a mark.  shard_words: of reference text in a shard, about, and the most that one automaton takes in.
    """
    one = base.filter(F.col(at.id).isNotNull()).select(F.col(at.id).alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.col(at.mark).alias("mark"))
    shared = written(_shared(_fingerprints(one, least)), "shared-prints")
    size = shared.filter("first").count() * (least // 2)
    near = _neighbourhoods(base.repartition(at.id, at.mark), at, shared, least, max(1, -(-size // shard_words)))
    spans = _matches(near, least, shard_words)
    return spans.groupBy(F.col("doc").alias(at.doc), F.col("mark").alias(at.of)).agg(F.collect_list(F.struct("start", "end")).alias(at.spans))


def _cut(text: str, spans: list) -> tuple[str, int]:
    data = text.encode()
    starts, _, _ = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), SPACED)
    edges = np.append(starts, len(data)).tolist()
    kept, at, gone = [], 0, 0
    for a, b in _merged([(x["start"], min(x["end"], len(starts))) for x in spans if x["start"] < len(starts)]):
        kept.append(data[at : edges[a]])
        at = edges[b]
        gone += b - a
    kept.append(data[at:])
    return b"".join(kept).decode(), gone


def remove_repeats(docs: DataFrame, least: int = 50, shard_words: int = 20_000) -> DataFrame:
    """The rows of docs with the repeated passages cut out of text, and cut_words, the number of words cut.

    least: words of the shortest passage that goes.  shard_words: as in repeated_spans().
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != "cut_words"]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = Names(*fresh(docs, "id", "mark", "doc", "of", "spots", "spans", "done"))
    marked = docs.withColumn(at.id, F.col("doc_id").cast("long")).withColumn(at.mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    spans = repeated_spans(marked, at, least, shard_words)
    base = marked.repartition(at.id, at.mark)

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, found in batches:
            out = [_cut(t, x) if t and x else (t, 0) for t, x in zip(text.to_pylist(), found.to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([t for t, _ in out], pa.string()), pa.array([n for _, n in out], pa.int32())], ["text", "n"])

    cutter = F.arrow_udf(cut, "text string, n int")
    joined = base.join(spans, (base[at.id] == spans[at.doc]) & (base[at.mark] == spans[at.of]), "left")
    done = joined.withColumn(at.done, F.when(F.col(at.spans).isNull(), F.struct(F.col("text").alias("text"), F.lit(0).alias("n"))).otherwise(cutter(F.col("text"), F.col(at.spans))))
    return done.select(*[F.col(f"{at.done}.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in kept], F.col(f"{at.done}.n").alias("cut_words"))
