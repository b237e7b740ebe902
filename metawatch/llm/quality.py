"""Quality rules: how far a document's histograms lie from those of its language.

Two histograms are taken of each document: of its characters over seven classes, and of its
words over the language's most common words and all others.  The references are the same
histograms over all documents of the language.  The distance is Jensen-Shannon (the root of the
divergence in bits, from 0 to 1).  A document goes where a distance is above its limit; short
documents, whose histograms are noise, are not judged by them.

Words are the runs of ASCII letters, digits and characters beyond ASCII in the lower-cased text.

Defined results: null and empty texts have no characters, distance 0, and stay; documents of a
null language have a reference of their own; words of one count are taken in byte order; each
repeated row counts and is judged; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches
from .textarrays import ALNUM, hash_spans, pieces, raw, strings, texts_of, words

#: Lower case, upper case, digits, white space, common punctuation, other ASCII, beyond ASCII; -1: not the first byte of a character.
CLASSES = 7
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]] = 0, 1, 2, 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[128:192], _CLASS[192:] = -1, 6


def class_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Characters of each class in each text."""
    k = _CLASS[data]
    at = texts_of(off) * CLASSES + k
    return np.bincount(at[k >= 0], minlength=(len(off) - 1) * CLASSES).reshape(-1, CLASSES)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, the distance of two tables of counts; 0 where a row is empty."""
    a, b = (x / np.maximum(x.sum(1, keepdims=True), 1) for x in (p, q))
    m = (a + b) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = sum(np.where(x > 0, x * np.log2(x / m), 0.0).sum(1) for x in (a, b)) / 2
    return np.where(p.sum(1) > 0, np.sqrt(np.maximum(d, 0)), 0.0)


def references(docs: DataFrame, common: int = 64) -> dict[str | None, tuple[list[int], list[tuple[str, int]], int]]:
    """By language: characters of each class, the most common words with counts, and the number of all words; over all documents."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str | None, np.ndarray] = {}
        found: dict[str | None, dict[int, list]] = {}
        for big in batches:
            for b in pieces(big, "text"):
                langs = b.column(1).to_pylist()
                text = strings(b.column(0))
                counts = class_counts(*raw(text))
                low = pc.utf8_lower(text)
                data, off = raw(low)
                starts, ends, woff = words(data, off, ALNUM)
                h = hash_spans(data, starts, ends)
                kinds = {k: i for i, k in enumerate(dict.fromkeys(langs))}
                of = np.array([kinds[k] for k in langs])
                wof = of[texts_of(woff)]
                blob = data.tobytes()
                for lang, i in kinds.items():
                    chars[lang] = chars.get(lang, 0) + counts[of == i].sum(0)
                    mine = np.flatnonzero(wof == i)
                    u, first, n = np.unique(h[mine], return_index=True, return_counts=True)
                    known = found.setdefault(lang, {})
                    for x, f, c in zip(u.tolist(), mine[first].tolist(), n.tolist()):
                        e = known.get(x)
                        if e is None:
                            known[x] = [blob[starts[f] : ends[f]].decode(), c]
                        else:
                            e[1] += c
        for lang, c in chars.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * CLASSES, "kind": list(range(CLASSES)), "word": [""] * CLASSES, "n": c.tolist()}, schema=shape)
        for lang, known in found.items():
            rows = list(known.values())
            for i in range(0, len(rows), 50_000):
                w, c = zip(*rows[i : i + 50_000])
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(w), "kind": [-1] * len(w), "word": w, "n": c}, schema=shape)

    bounded_batches(docs.sparkSession)
    shape = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
    counted = docs.select("text", "lang").mapInArrow(part, "lang string, kind int, word string, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a partition's words the most common of each language (kind -1) and the number of all (-2); classes as they are."""
        most: dict[str | None, list] = {}
        total: dict[str | None, int] = {}
        for b in batches:
            b = b.select(["lang", "kind", "word", "n"])
            own = b.column("kind").to_numpy() >= 0
            if own.any():
                yield b.filter(pa.array(own))
            words_ = b.filter(pa.array(~own))
            for lang in words_.column("lang").unique().to_pylist():
                same = pc.is_null(words_.column("lang")) if lang is None else pc.equal(words_.column("lang"), lang)
                mine = words_.filter(same)
                total[lang] = total.get(lang, 0) + pc.sum(mine.column("n")).as_py()
                n = mine.column("n").to_numpy()
                if len(n) > common:
                    mine = mine.filter(pa.array(n >= np.partition(n, -common)[-common]))
                most[lang] = sorted(most.get(lang, []) + [(-n, w) for n, w in zip(mine.column("n").to_pylist(), mine.column("word").to_pylist())], key=lambda x: (x[0], x[1].encode()))[:common]
        for lang, found in most.items():
            rows = [(-1, w, -n) for n, w in found] + [(-2, "", total[lang])]
            kind, word, n = zip(*rows)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(rows), "kind": kind, "word": word, "n": n}, schema=shape)

    # no task sees a language's whole vocabulary: partitions give their best, and only those are ranked
    few = counted.mapInArrow(best, "lang string, kind int, word string, n long").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "word")))
    few = few.filter(f"kind <> -1 or rank <= {common}").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"), F.min("rank").alias("rank"))
    out: dict = {}
    for r in few.collect():
        chars, most, all_ = out.setdefault(r["lang"], ([0] * CLASSES, [], [0]))
        if r["kind"] >= 0:
            chars[r["kind"]] = r["n"]
        elif r["kind"] == -1:
            most.append((r["rank"], r["word"], r["n"]))
        else:
            all_[0] = r["n"]
    return {k: (c, [(w, n) for _, w, n in sorted(m)], a[0]) for k, (c, m, a) in out.items()}


class Judge:
    """Distances of texts from the references of their languages."""

    def __init__(self, refs: dict):
        self.tables = {}
        for lang, (chars, most, total) in refs.items():
            joined = [w.encode() for w, _ in most]
            ends = np.cumsum([len(w) for w in joined]).astype(np.int64)
            h = hash_spans(np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(joined)], ends)
            order = np.argsort(h)
            counts = np.array([n for _, n in most] + [total - sum(n for _, n in most)], float)
            self.tables[lang] = (np.array(chars, float), h[order], order, counts)

    def distances(self, texts: pa.Array, langs: list, least_chars: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(character distance, word distance) to six places, 0 where a text is too short."""
        text = strings(texts)
        chars = class_counts(*raw(text))
        data, off = raw(pc.utf8_lower(text))
        starts, ends, woff = words(data, off, ALNUM)
        h, doc = hash_spans(data, starts, ends), texts_of(woff)
        cjs, wjs = np.zeros(len(langs)), np.zeros(len(langs))
        for lang in dict.fromkeys(langs):
            ref, keys, order, counts = self.tables[lang]
            rows = np.array([x == lang for x in langs])
            at = np.full(len(langs), -1)
            at[rows] = np.arange(rows.sum())
            mine = rows[doc]
            spot = np.minimum(np.searchsorted(keys, h[mine]), max(len(keys) - 1, 0))
            slot = np.where(keys[spot] == h[mine], order[spot], len(keys)) if len(keys) else np.zeros(int(mine.sum()), np.int64)
            hist = np.bincount(at[doc[mine]] * (len(keys) + 1) + slot, minlength=int(rows.sum()) * (len(keys) + 1)).reshape(-1, len(keys) + 1)
            cjs[rows] = js_distance(chars[rows], np.broadcast_to(ref, (int(rows.sum()), CLASSES)))
            wjs[rows] = js_distance(hist, np.broadcast_to(counts, hist.shape))
        return np.where(chars.sum(1) >= least_chars, np.round(cjs, 6), 0.0), np.where(np.diff(woff) >= least_words, np.round(wjs, 6), 0.0)


def divergence_rules(
    docs: DataFrame, common: int = 64, least_chars: int = 200, least_words: int = 50, char_limit: float = 0.3, word_limit: float = 0.45,
) -> DataFrame:
    """For each document: doc_id, char_js, word_js (to six places) and keep.

    common: words of a language's reference.  least_chars, least_words: shorter documents are not judged by
    that histogram (their distance is given as 0).  char_limit, word_limit: greatest distances that stay.
    """
    docs = docs.select("doc_id", "text", "lang")
    refs = references(docs, common)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(refs)
        for big in batches:
            for b in pieces(big, "text"):
                cjs, wjs = judge.distances(b.column("text"), b.column("lang").to_pylist(), least_chars, least_words)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(cjs), pa.array(wjs), pa.array((cjs <= char_limit) & (wjs <= word_limit))], ["doc_id", "char_js", "word_js", "keep"])

    return docs.mapInArrow(part, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, char_js double, word_js double, keep boolean")


def passing(
    docs: DataFrame, common: int = 64, least_chars: int = 200, least_words: int = 50, char_limit: float = 0.3, word_limit: float = 0.45,
) -> DataFrame:
    """The rows of docs that divergence_rules() keeps, with all their columns."""
    refs = references(docs.select("text", "lang"), common)

    def keep(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        judge = Judge(refs)
        for text, lang in batches:
            out = [np.zeros(0, bool)]
            for b in pieces(pa.RecordBatch.from_arrays([text, lang], ["text", "lang"]), "text"):
                cjs, wjs = judge.distances(b.column(0), b.column(1).to_pylist(), least_chars, least_words)
                out.append((cjs <= char_limit) & (wjs <= word_limit))
            yield pa.array(np.concatenate(out))

    return docs.filter(F.arrow_udf(keep, "boolean")(F.col("text"), F.col("lang")))
