"""Near-duplicate join: classes of documents whose sets of word n-grams have a Jaccard index of at least a limit.

Documents with one set of tokens (n-gram hashes) are one node, however many they are.  A token-group
matrix holds down the work: documents are partitioned into groups by one of the tokens that most others
share with them, which similar ones mostly agree on, and the matrix says which groups hold which tokens.

Which groups a document has to look into follows from bounds alone; nothing is sampled.  All tokens have
one order, rare ones first as far as two tables of 2^20 counters over all texts tell, one of tokens and one
of words.  Two sets that are
similar enough have so many tokens in common that at least ``need`` of them lie among the first
``leading`` tokens of both.  Those go to the place of their token, where the ones that no other set has
drop out; a document left with fewer than ``need`` has no partner.  By the same argument the rarest of
the tokens left are enough to count, for each document and group, the tokens that the group's union
shares with it, and only groups that reach the bound are asked.  There the whole sets are compared: a
group opens for a query only if its members' union holds enough of the query's tokens.

Groups are split into blocks of at most about ``block`` members, and a block's queries into lots; a token
that more than ``hot`` sets may have is spread over several places, with its groups made known to all.

Words are the runs of ASCII letters, digits and characters beyond ASCII in the lower-cased text; a
document of fewer than n words has one token, of all of them.

Defined results: null and empty texts have no tokens and no partners; a row without an id is left
out; rows that share an id are one document, with the token set of the least hash among theirs; equal
sets have index 1; an empty table gives no rows; further columns are dropped, whatever their names.
Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, fresh, written
from .textarrays import ALNUM, U, hash_grams, hash_spans, mix, pieces, raw, strings, texts_of, words

#: Counters of the frequency table, and how many go into one row of it.
COUNTERS, CHUNK = 1 << 20, 1 << 14
#: How many leading tokens go beyond the fewest that would do, as a share of a set; more of them make the bounds sharper.
SURPLUS = 0.1
#: Leading tokens that are handled together in one task, about.
PLACE = 1 << 21
#: Marks a document's own group among the numbers of overlaps.
OWN = 1 << 40
_LOW = U((1 << 40) - 1)


def token_sets(texts: pa.Array, n: int, seen: np.ndarray | None = None, weights: np.ndarray | None = None):
    """(offsets, tokens): each text's set of tokens, rising; with weights of words also the sum of them for each token.  seen: counters that all words are added to."""
    data, off = raw(pc.utf8_lower(strings(texts)))
    starts, ends, woff = words(data, off, ALNUM)
    h = hash_spans(data, starts, ends)
    if seen is not None:
        seen += np.bincount(_counter(h), minlength=COUNTERS)
    many = np.diff(woff)
    grams = hash_grams(h, n)
    doc = texts_of(woff)
    whole = np.flatnonzero(doc[: len(grams)] == doc[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
    few = np.flatnonzero((many > 0) & (many < n))
    short = np.array([mix(np.array([int(hash_grams(h[woff[i] : woff[i + 1]], int(many[i]))[0])], np.uint64))[0] for i in few], np.uint64)
    of, tok = np.concatenate([doc[whole], few]), np.concatenate([grams[whole], short])
    order = np.lexsort((tok, of))
    of, tok = of[order], tok[order]
    if len(of):
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (tok[1:] != tok[:-1])
        of, tok, order = of[new], tok[new], order[new]
    off = np.searchsorted(of, np.arange(len(texts) + 1))
    if weights is None:
        return off, tok
    run = np.concatenate([[0], np.cumsum(weights[_counter(h)])])
    return off, tok, np.concatenate([run[whole + n] - run[whole], run[woff[few + 1]] - run[woff[few]]])[order]


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U(COUNTERS - 1)).astype(np.int64)

def signatures(off: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two unlike 64-bit hashes of each set."""
    return tuple((s[off[1:]] - s[off[:-1]]) for s in (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tok ^ U(salt)), dtype=np.uint64)]) for salt in (0, 0xA5A5A5A5A5A5A5A5)))


class Bounds:
    """What the limit demands of a set, from its size alone."""

    def __init__(self, limit: float):
        self.limit, self.surplus = limit, min(SURPLUS, limit)

    def least(self, size: np.ndarray) -> np.ndarray:
        """Tokens in common with any partner, and the size of the smallest partner."""
        return np.maximum(np.ceil(self.limit * size - 1e-9), 1).astype(np.int64)

    def _more(self, size: np.ndarray) -> np.ndarray:
        return np.maximum(self.surplus * size, 1).astype(np.int64)

    def leading(self, size: np.ndarray) -> np.ndarray:
        return np.minimum(size - self.least(size) + self._more(size), size)

    def need(self, size: np.ndarray) -> np.ndarray:
        """Leading tokens in common with any partner: the surplus of the smaller of the two."""
        return self._more(self.least(size))

    def _counted(self, size: np.ndarray) -> np.ndarray:
        return np.maximum(self.need(size) * 3 // 4, 1)

    def kept(self, size: np.ndarray, left: np.ndarray) -> np.ndarray:
        """How many of the ``left`` leading tokens that others have are counted in groups."""
        return np.minimum(left - self.need(size) + self._counted(size), left)

    def asked(self, size: np.ndarray) -> np.ndarray:
        """Of those, how many a group must hold."""
        return np.minimum(self._counted(size), self._counted(self.least(size)))


def _surveyed(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, sig, size, chunk -1) of each row, and (chunk, counts) of each partition's counters of tokens and of words; written."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * COUNTERS, np.int64)
        for big in batches:
            for b in pieces(big, "text"):
                off, tok = token_sets(b.column(1), n, counts[COUNTERS:])
                key, sig = signatures(off, tok)
                counts[:COUNTERS] += np.bincount(_counter(tok), minlength=COUNTERS)
                m = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key.view(np.int64)), pa.array(sig.view(np.int64)), pa.array(np.diff(off).astype(np.int64)), pa.array(np.full(m, -1, np.int32)), pa.nulls(m, pa.binary())], names)
        if counts.any():
            rows = [c.astype(np.uint32).tobytes() for c in np.minimum(counts, 0xFFFFFFFF).reshape(-1, CHUNK)]
            m = len(rows)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(np.arange(m, dtype=np.int32)), pa.array(rows, pa.binary())], names)

    names = ["doc_id", "key", "sig", "size", "chunk", "counts"]
    return written(docs.mapInArrow(part, "doc_id long, key long, sig long, size long, chunk int, counts binary"), "token-survey")


def _frequencies(survey: DataFrame) -> np.ndarray:
    """How often each counter of tokens and each of words was met, over all texts; of one length however many there are."""

    def summed(kind: type):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for c, x in zip(b.column(0).to_pylist(), b.column(1)):
                    total[c] = total.get(c, 0) + np.frombuffer(x.as_py(), kind).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

        return part

    kind = "chunk int, counts binary"
    rows = survey.filter("chunk >= 0").select("chunk", "counts").mapInArrow(summed(np.uint32), kind).repartition("chunk").mapInArrow(summed(np.int64), kind).collect()
    out = np.zeros(2 * COUNTERS, np.int64)
    for r in rows:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return out


class Places:
    """Where a token is handled: one place, or for a hot token as many as its counter tells, one for each lot of sets.

    A token is known by its place and its last 40 bits; two that share both are taken for one, which can only add candidates.
    """

    def __init__(self, counts: np.ndarray, places: int, hot: int):
        self.weights = np.ceil(4 * np.log2(np.maximum(counts[COUNTERS:], 1))).astype(np.int64)
        usual = counts[:COUNTERS].mean()
        self.level = 1000 * np.ceil(np.log2(1 + np.maximum(counts[:COUNTERS] - usual - 4 * np.sqrt(usual), 0))).astype(np.int64)
        self.lots = np.minimum(np.maximum(counts[:COUNTERS] // hot, 1), places).astype(np.int64)
        self.places = places

    def lots_of(self, tok: np.ndarray) -> np.ndarray:
        return self.lots[_counter(tok)]

    def place(self, tok: np.ndarray, key: np.ndarray) -> np.ndarray:
        first = ((tok >> U(32)) * U(self.places)) >> U(32)
        return (first.astype(np.int64) + (key % self.lots_of(tok).astype(np.uint64)).astype(np.int64)) % self.places


_DOC = np.dtype([("key", "<u8"), ("grp", "<u8"), ("size", "<u4"), ("n", "<u4")])


def _sent(to: np.ndarray, doc: np.ndarray, tok: np.ndarray, extra: np.ndarray, docs: np.ndarray, origin: int = 0) -> pa.RecordBatch:
    """(place, blob): tokens of docs (an array of _DOC; doc: its row for each token), packed for each place they go to."""
    order = np.lexsort((doc, to))
    to, doc, tok, extra = to[order], doc[order], tok[order] & _LOW, extra[order]
    low, high = tok.astype(np.uint32), (tok >> U(32)).astype(np.uint8)
    cut = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), len(to)) if len(to) else np.zeros(1, np.int64)
    blobs = []
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
        head = np.flatnonzero(np.concatenate([[True], doc[a + 1 : z] != doc[a : z - 1]]))
        own = docs[doc[a + head]].copy()
        own["n"] = np.diff(np.append(head, z - a))
        blobs.append(np.array([len(own), origin], np.uint32).tobytes() + own.tobytes() + low[a:z].tobytes() + high[a:z].tobytes() + extra[a:z].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(to[cut[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["place", "blob"])


def _received(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(docs, each once; row of the doc, token, extra and origin of each token)."""
    docs, tok, extra, origin = [np.zeros(0, _DOC)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    for x in blobs:
        m, src = np.frombuffer(x, np.uint32, 2).tolist()
        own = np.frombuffer(x, _DOC, m, 8)
        n = int(own["n"].sum())
        at = 8 + m * _DOC.itemsize
        docs.append(own)
        tok.append(np.frombuffer(x, np.uint32, n, at).astype(np.uint64) | (np.frombuffer(x, np.uint8, n, at + 4 * n).astype(np.uint64) << U(32)))
        extra.append(np.frombuffer(x, np.uint8, n, at + 5 * n))
        origin.append(np.full(n, src, np.int64))
    every = np.concatenate(docs)
    _, first, of = np.unique(every["key"], return_index=True, return_inverse=True)
    one = every[first].copy()
    np.minimum.at(one["size"], of, every["size"])  # of unlike sets with one key the smaller demands less
    return one, np.repeat(of, every["n"]), *map(np.concatenate, (tok, extra, origin))


def _exchanged(df: DataFrame, places: int) -> DataFrame:
    return df.repartitionById(places, F.col("place")).sortWithinPartitions("place")


def _by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(place, its blobs), one place after another."""
    now, held = -1, []
    for b in batches:
        for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if p != now:
                if held:
                    yield now, held
                now, held = p, []
            held.append(x)
    if held:
        yield now, held


_BLOB = "place int, blob binary"


def _leading(docs: DataFrame, n: int, bounds: Bounds, where: Broadcast) -> DataFrame:
    """The leading tokens of every text, packed for their places; copies of a set within a task are sent once, but for very many unlike sets."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: Places = where.value
        seen: set[int] = set()
        held: list[tuple] = []
        many = base = 0

        def flushed() -> pa.RecordBatch:
            to, doc, tok, own = (np.concatenate(x) for x in zip(*held))
            return _sent(to, doc, tok, np.zeros(len(tok), np.uint8), own)

        for big in batches:
            for b in pieces(big, "text"):
                off, tok, level = token_sets(b.column(1), n, weights=places.weights)
                size = np.diff(off)
                key, _ = signatures(off, tok)
                new = np.array([s > 0 and k not in seen and not seen.add(k) for k, s in zip(key.tolist(), size.tolist())], bool)
                if len(seen) > 1 << 20:
                    seen.clear()
                row = texts_of(off)
                tok, level, row = tok[new[row]], level[new[row]], (np.cumsum(new) - 1)[row[new[row]]]
                key, size = key[new], size[new]
                if not len(tok):
                    continue
                first = np.concatenate([[0], np.cumsum(size)])[:-1]
                own = np.zeros(len(key), _DOC)
                own["key"], own["size"] = key, size
                order = np.lexsort((tok, places.level[_counter(tok)] + level, row))
                sel = order[np.arange(len(tok)) - first[row] < bounds.leading(size)[row]]
                tok, row = tok[sel], row[sel]
                held.append((places.place(tok, key[row]), row + base, tok, own))
                base += len(own)
                many += len(tok)
                if many > PLACE:
                    yield flushed()
                    held, many, base = [], 0, 0
        if held:
            yield flushed()

    return docs.select("doc_id", "text").mapInArrow(part, _BLOB)


def _met(leading: DataFrame, where: Broadcast) -> DataFrame:
    """Of the leading tokens those that several sets have, packed for the place of their document; extra: how frequent they are."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: Places = where.value
        for place, blobs in _by_place(batches):
            docs, doc, tok, _, _ = _received(blobs)
            order = np.lexsort((doc, tok))
            tok, doc = tok[order], doc[order]
            new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])])
            tok, doc = tok[new], doc[new]
            head = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            n = np.diff(np.append(head, len(tok)))
            level = np.minimum(8 * np.log2(n), 254).astype(np.uint8)
            hot = places.lots_of(tok[head]) > 1
            level[hot] = 255
            keep = np.repeat((n > 1) | hot, n)
            to = (docs["key"] % U(places.places)).astype(np.int64)[doc[keep]]
            yield _sent(to, doc[keep], tok[keep], np.repeat(level, n)[keep], docs, place)

    return _exchanged(leading, where.value.places).mapInArrow(part, _BLOB)


def _group(docs: np.ndarray, doc: np.ndarray, tok: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The group of each document: the least scrambled one of its tokens that about as many others have as its commonest one."""
    top = np.zeros(len(docs), np.int64)
    np.maximum.at(top, doc, level)
    common = level + 8 >= top[doc]
    least = np.full(len(docs), 0xFFFFFFFFFFFFFFFF, np.uint64)
    np.minimum.at(least, doc[common], mix(tok[common]))
    return least


def _counted(met: DataFrame, bounds: Bounds, where: Broadcast) -> DataFrame:
    """Each document's rarest tokens that others have, packed for their places; a hot token's groups go to all its places (extra 1)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: Places = where.value
        for _, blobs in _by_place(batches):
            docs, doc, tok, level, origin = _received(blobs)
            lots = places.lots_of(tok)
            lot = (docs["key"][doc] % lots.astype(np.uint64)).astype(np.int64)
            first = (origin - lot) % places.places
            docs["grp"] = _group(docs, doc, tok | (first.astype(np.uint64) << U(40)), level.astype(np.int64))
            order = np.lexsort((first, tok, level, doc))
            size, left = docs["size"].astype(np.int64), np.bincount(doc, minlength=len(docs))
            many = np.where(left >= bounds.need(size), bounds.kept(size, left), 0)
            begin = np.concatenate([[0], np.cumsum(left)])[:-1]
            sel = order[np.arange(len(doc)) - begin[doc[order]] < many[doc[order]]]
            to, doc, tok, extra = origin[sel], doc[sel], tok[sel], np.zeros(len(sel), np.uint8)
            spread = np.flatnonzero(lots[sel] > 1)
            if len(spread):
                n = lots[sel][spread]
                again = np.repeat(spread, n)
                other = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                cell = (first[sel][again] + other) % places.places
                away = other != lot[sel][again]
                again, cell = again[away], cell[away]
                _, once = np.unique(np.rec.fromarrays([cell, tok[again], docs["grp"][doc[again]]]), return_index=True)
                again, cell = again[once], cell[once]
                to, doc, tok, extra = (np.concatenate(x) for x in ((to, cell), (doc, doc[again]), (tok, tok[again]), (extra, np.ones(len(again), np.uint8))))
            some = np.flatnonzero(many)
            if len(some):  # and one row for each document, which tells its group
                home = (docs["key"][some] % U(places.places)).astype(np.int64)
                to, doc, tok, extra = (np.concatenate(x) for x in ((to, home), (doc, some), (tok, np.zeros(len(some), np.uint64)), (extra, np.full(len(some), 2, np.uint8))))
                yield _sent(to, doc, tok, extra, docs)

    return _exchanged(met, where.value.places).mapInArrow(part, _BLOB)


def _overlaps(counted: DataFrame, bounds: Bounds, where: Broadcast, most: int = 1 << 22) -> DataFrame:
    """(key, grp, asked, n): how many of a document's tokens other members of a group have; asked: the least n that counts; OWN is added to n in its own group."""

    def rows_of(docs: np.ndarray, grp: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        asked = bounds.asked(docs["size"].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(docs["key"].astype(np.int64)), pa.array(grp.astype(np.int64)), pa.array(asked.astype(np.int32)), pa.array(n)], ["key", "grp", "asked", "n"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _by_place(batches):
            docs, doc, tok, away, _ = _received(blobs)
            told = doc[away == 2]
            if len(told):
                yield rows_of(docs[told], docs["grp"][told], np.full(len(told), OWN, np.int64))
            doc, tok, away = doc[away < 2], tok[away < 2], away[away < 2]
            if not len(doc):
                continue
            groups, group = np.unique(docs["grp"], return_inverse=True)
            order = np.lexsort((doc, away, group[doc], tok))
            tok, doc, away = tok[order], doc[order], away[order].astype(bool)
            grp = group[doc]
            new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (grp[1:] != grp[:-1])])
            cell = np.flatnonzero(new)
            here = np.add.reduceat(~away, cell)
            there = np.logical_or.reduceat(away, cell)
            heads = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            cell_of = np.searchsorted(cell, heads)
            cells = np.diff(np.append(cell_of, len(cell)))
            rows = np.flatnonzero(~away)
            token = np.searchsorted(heads, rows, "right") - 1
            total = np.cumsum(cells[token])
            codes: list[tuple[np.ndarray, np.ndarray]] = []
            i = 0
            while i < len(rows):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
                n = cells[token[i:j]]
                q = np.repeat(rows[i:j], n)
                c = np.repeat(cell_of[token[i:j]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                g = grp[cell[c]]
                other = (g != grp[q]) | (here[c] > 1) | there[c]
                codes.append(np.unique(doc[q[other]] * len(groups) + g[other], return_counts=True))
                i = j
                if sum(len(x) for x, _ in codes) > most or i == len(rows):
                    code, of = np.unique(np.concatenate([x for x, _ in codes]), return_inverse=True)
                    n = np.bincount(of, weights=np.concatenate([x for _, x in codes]), minlength=len(code)).astype(np.int64)
                    codes = [(code, n)]
                    if i == len(rows) or len(code) > most:
                        codes = []
                        yield rows_of(docs[code // len(groups)], groups[code % len(groups)], n)

    return _exchanged(counted, where.value.places).mapInArrow(part, "key long, grp long, asked int, n long")


class Room:
    """A block of a group: its members' sets, and what queries share with them."""

    def __init__(self, limit: float):
        self.limit = limit
        self.docs: list[int] = []
        self.copies: list[int] = []
        self.sets: list[np.ndarray] = []
        self.asking: list[int] = []
        self.root: dict[int, int] = {}
        self.ready = False

    def add(self, doc: int, copies: int, tokens: np.ndarray, asks: bool) -> None:
        if asks:
            self.asking.append(len(self.docs))
        self.docs.append(doc)
        self.copies.append(copies)
        self.sets.append(tokens)

    def _top(self, i: int) -> int:
        root = self.root
        while root.setdefault(i, i) != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def _open(self) -> None:
        self.ids, self.weight, self.size = np.array(self.docs, np.int64), np.array(self.copies, np.int64), np.array([len(s) for s in self.sets], np.int64)
        flat = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        self.union, place = np.unique(flat, return_inverse=True)
        self.post = np.repeat(np.arange(len(self.sets)), self.size)[np.argsort(place, kind="stable")]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(self.union)))])
        self.ready = True

    def query(self, doc: int, tokens: np.ndarray) -> tuple[int, list[int]] | None:
        """(documents like this one among the members, members to link it to so that all that are linked hang together)."""
        if not self.ready:
            self._open()
        if not len(self.union) or not len(tokens):
            return None
        spot = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        spot = spot[self.union[spot] == tokens]
        if len(spot) < self.limit * len(tokens) - 1e-9:
            return None  # the union holds too few of its tokens: the group stays closed
        n = self.at[spot + 1] - self.at[spot]
        hits = self.post[np.repeat(self.at[spot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        both = np.bincount(hits, minlength=len(self.ids))
        like = np.flatnonzero((both >= self.limit * (self.size + len(tokens) - both)) & (self.ids != doc) & (both > 0))
        if not len(like):
            return None
        links, mine = [], self._top(doc)
        for m in self.ids[like].tolist():
            if (top := self._top(m)) != mine:
                self.root[top] = mine
                links.append(m)
        return int(self.weight[like].sum()), links

    def waiting(self) -> Iterator[tuple[int, tuple[int, list[int]] | None]]:
        """Members that are queries too, once all are there."""
        for i in self.asking:
            yield self.docs[i], self.query(self.docs[i], self.sets[i])
        self.asking = []


def _compared(rows: DataFrame, n: int, limit: float) -> DataFrame:
    """(doc, links, other): for each query and room how many documents are like it, and the links that hold them together."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, room = None, Room(limit)
        out: list[tuple] = []

        def said(doc: int, found: tuple[int, list[int]] | None) -> None:
            if found:
                out.append((doc, found[0], None))
                out.extend((doc, 0, m) for m in found[1])

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["doc", "links", "other"])

        for big in batches:
            for b in pieces(big, "text"):
                off, tok = token_sets(b.column("text"), n)
                sig = signatures(off, tok)[1].view(np.int64).tolist()
                cols = [b.column(c).to_pylist() for c in ("grp", "block", "lot", "member", "asks", "doc", "copies", "sig")]
                for i, (grp, block, lot, member, asks, doc, copies, right) in enumerate(zip(*cols)):
                    if (grp, block, lot) != now:
                        for x in room.waiting():
                            said(*x)
                        now, room = (grp, block, lot), Room(limit)
                    if sig[i] != right or room.docs and member and room.docs[-1] == doc:
                        continue  # another row of the same id
                    mine = tok[off[i] : off[i + 1]]
                    if member:
                        room.add(doc, copies, mine.copy(), asks)
                        continue
                    for x in room.waiting():
                        said(*x)
                    said(doc, room.query(doc, mine))
                if len(out) > 50_000:
                    yield batch()
        for x in room.waiting():
            said(*x)
        if out:
            yield batch()

    placed = rows.repartition("grp", "block", "lot").sortWithinPartitions("grp", "block", "lot", F.desc("member"), "doc")
    return placed.mapInArrow(part, "doc long, links long, other long")


def _roles(asked: DataFrame, sets: DataFrame, block: int, lot: int) -> DataFrame:
    """(grp, block, lot, doc, copies, sig, member, asks): who goes to which room, blocks and lots by the sizes of the groups."""
    info = sets.select("key", "sig", "doc", "copies")
    met = asked.filter("asks").select("key", "grp").join(info, "key")
    members = asked.filter("own").select("key", "grp").join(info, "key")
    # whoever has a partner asks for that one's group
    queries, members = met, members.join(met.select("grp").distinct(), "grp", "left_semi").join(met.select("key").distinct(), "key", "left_semi")
    size = members.groupBy("grp").agg(F.count("*").alias("n_members")).join(queries.groupBy("grp").agg(F.count("*").alias("n_asks")), "grp")
    size = size.select("grp", F.ceil(F.col("n_members") / block).alias("blocks"), F.ceil(F.col("n_asks") / lot).alias("lots"))
    spot = lambda salt, n: F.pmod(F.xxhash64("doc", F.lit(salt)), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ["grp", "doc", "copies", "sig"]
    held = members.join(size, "grp").select(*kept, spot(1, "blocks").alias("block"), all_of("lots").alias("lot"), F.lit(True).alias("member"), F.lit(False).alias("asks"))
    come = queries.join(size, "grp").select(*kept, all_of("blocks").alias("block"), spot(2, "lots").alias("lot"), F.lit(False).alias("member"), F.lit(True).alias("asks"))
    return held.unionByName(come).groupBy(*kept, "block", "lot").agg(F.max("member").alias("member"), F.max("asks").alias("asks"))


def _similar(docs: DataFrame, n: int, limit: float, block: int, lot: int, hot: int, place: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their sets, sets with their least document and number, what comparing gave)."""
    if not 0 < limit <= 1:
        raise ValueError("a limit lies above 0 and is 1 at most")
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    survey = _surveyed(docs, n)
    ids = survey.filter("chunk < 0").groupBy("doc_id").agg(F.min(F.struct("key", "sig", "size")).alias("s")).select("doc_id", "s.*")
    sets = written(ids.filter("size > 0").groupBy("key", "sig").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.max("size").alias("size")), "token-sets")
    bounds = Bounds(limit)
    tokens = sets.agg(F.sum("size")).first()[0] or 0
    places = max(1, int(tokens * (1 - limit + bounds.surplus)) // place)
    where = docs.sparkSession.sparkContext.broadcast(Places(_frequencies(survey), places, hot))
    counted = _counted(_met(_leading(docs, n, bounds, where), where), bounds, where)
    overlap = _overlaps(counted, bounds, where).groupBy("key", "grp").agg(F.sum("n").alias("n"), F.min("asked").alias("asked"))
    overlap = overlap.select("key", "grp", (F.col("n") >= OWN).alias("own"), (F.col("n") % OWN >= F.col("asked")).alias("asks"))
    asked = written(overlap.filter("own or asks"), "asked-groups")
    roles = _roles(asked, sets, block, lot)
    rows = roles.join(docs, F.col("doc") == F.col("doc_id")).drop("doc_id")
    return ids, sets, written(_compared(rows, n, limit), "compared")


def similar_classes(docs: DataFrame, n: int = 3, limit: float = 0.6, block: int = 512, lot: int = 1 << 14, hot: int = 1 << 20, place: int = PLACE) -> DataFrame:
    """For each document: doc_id, class_id (the least id that similar documents lead to from it) and links (the number of other documents with an index of at least ``limit``).

    n: words of a token.  block, lot: members of a group, and queries, that are compared in one go.  hot: sets that may
    have a token, as far as is known, before it is spread over places.  place: leading tokens of a place.  Results do
    not depend on the last four.
    """
    ids, sets, compared = _similar(docs, n, limit, block, lot, hot, place)
    links = compared.groupBy("doc").agg(F.sum("links").alias("links"))
    roots = components(compared.filter("other is not null").select(F.col("doc").alias("doc_a"), F.col("other").alias("doc_b")))
    known = sets.join(links, "doc", "left").join(roots, "doc", "left")
    known = known.select("key", "sig", F.coalesce("root", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    of = ids.join(known, ["key", "sig"], "left")
    return of.select("doc_id", F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("size") > 0, F.col("links")).otherwise(F.lit(0)).cast("long").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(doc, root) of all nodes of edges (doc_a, doc_b); root: the least node of its connected component.

    Stars are folded (every neighbour linked to the least one, to and fro) until nothing moves; each round
    is written to the shared folder.
    """
    links = written(edges.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).filter("u > v").distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        folded = written(small.select("v", "m").filter("v > m").toDF("u", "v").unionByName(low.toDF("u", "v")).distinct(), "links")
        before, after = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (links, folded))
        links = folded
        if before == after:
            return links.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "doc")


def one_of_each_group(docs: DataFrame, n: int = 3, limit: float = 0.6) -> DataFrame:
    """The rows of docs but for those whose document has a lower id in its class of similar_classes(); rows without an id stay."""
    (gone,) = fresh(docs, "gone")
    drop = similar_classes(docs, n, limit).filter("class_id < doc_id").select(F.col("doc_id").alias(gone))
    return docs.join(drop, docs["doc_id"] == drop[gone], "left_anti")
