"""Language identification by nearest centroid.

A document is a TF-IDF vector of hashed trigrams of the bytes of its lower-cased letters, scaled
to length 1.  Each language has several centroids, found by clustering a bounded sample of
labelled documents by cosine; document frequencies are those of all documents.  A document gets
the language of the centroid of greatest cosine, and is rejected where that lies below a limit
that grows with the number of trigrams, because short texts fill few places of the vector.

Defined results: null texts and texts without letters have cosine 0 and are rejected, with a null
language; documents of a null language are no training examples; ties go to the language first in
byte order; repeated rows are judged each; without any labelled document all are rejected; an
empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches
from .textarrays import U, pieces, raw, strings, texts_of

PLACES = 4096
#: Texts whose dense vectors are held at once, at most.
ROWS = 256
_LETTER = np.full(256, 32, np.uint64)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigram_counts(texts: pa.Array) -> np.ndarray:
    """How often each text has each hashed trigram."""
    data, off = raw(pc.utf8_lower(strings(texts)))
    n = len(texts)
    if len(data) < 3:
        return np.zeros((n, PLACES), np.float32)
    c = _LETTER[data]
    code = (c[:-2] << U(16)) | (c[1:-1] << U(8)) | c[2:]
    doc = texts_of(off)
    good = (doc[:-2] == doc[2:]) & (c[1:-1] != 32) & ((c[:-2] != 32) | (c[2:] != 32))
    spot = ((code[good] * U(0x9E3779B97F4A7C15)) >> U(52)).astype(np.int64)
    return np.bincount(doc[:-2][good] * PLACES + spot, minlength=n * PLACES).reshape(n, PLACES).astype(np.float32)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and in how many of them each place is filled; over all documents."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(PLACES, np.int64)
        for big in batches:
            for b in pieces(big, "text", rows=ROWS):
                df += (trigram_counts(b.column(0)) > 0).sum(0)
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, PLACES)), pa.array(np.concatenate([[n], df]))], ["place", "n"])

    bounded_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(part, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(PLACES + 1, np.int64)
    for r in found:
        out[r["place"] + 1] = r["n"]
    return int(out[0]), out[1:]


def cluster(v: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k centroids of length 1 by spherical k-means, started far apart."""
    rng = np.random.default_rng(seed)
    centres = v[[rng.integers(len(v))]]
    while len(centres) < min(k, len(v)):
        gap = np.maximum(1 - (v @ centres.T).max(1), 0)
        if gap.sum() <= 1e-6:
            break
        centres = np.vstack([centres, v[rng.choice(len(v), p=gap / gap.sum())]])
    for _ in range(rounds):
        near = (v @ centres.T).argmax(1)
        sums = np.stack([v[near == i].sum(0) if (near == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres.astype(np.float32)


def limit(trigrams: np.ndarray, floor: float, full: int) -> np.ndarray:
    """The least cosine that stays: floor from ``full`` trigrams on, falling with the root of their number below."""
    return floor * np.sqrt(np.minimum(trigrams, full) / full)


def fit(docs: DataFrame, rows_per_language: int = 600, clusters: int = 4) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(inverse document frequencies, centroids, language of each).

    rows_per_language: labelled documents of each language that the centroids are fitted on, those of least
    hashed id.  Document frequencies cover all documents.
    """
    n, df = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    order = (F.xxhash64("doc_id"), "doc_id")
    known = docs.filter("lang is not null")
    ranked = lambda d, *o: d.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*o))).filter(f"n <= {rows_per_language}").drop("n")
    # ids are ranked without their texts; the texts of the chosen are few, but where one id has very many rows
    chosen = ranked(known.select("lang", "doc_id"), *order).distinct().select(F.col("lang").alias("l"), F.col("doc_id").alias("d"))
    texts_ = known.join(chosen, F.col("lang").eqNullSafe(F.col("l")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select("lang", "doc_id", "text")
    sample = ranked(texts_, *order, F.xxhash64("text")).select("lang", "text").toArrow()
    langs = np.array(sample.column("lang").to_pylist(), dtype=object)
    texts = strings(sample.column("text"))
    centres, names = [np.zeros((0, PLACES), np.float32)], []
    for lang in sorted(set(langs)):
        counts = np.vstack([trigram_counts(texts.take(pa.array([i]))) for i in np.flatnonzero(langs == lang)])
        v = vectors(counts[counts.sum(1) > 0], idf)
        if len(v):
            centres.append(cluster(v, clusters))
            names += [lang] * len(centres[-1])
    return idf, np.vstack(centres), names


def judge(texts: pa.Array, model: tuple, floor: float, full: int) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """(language or None, cosine to four places, whether it stays) of each text."""
    idf, centres, names = model
    counts = trigram_counts(texts)
    n = counts.sum(1)
    cos = vectors(counts, idf) @ centres.T if names else np.zeros((len(n), 1))
    best, sim = cos.argmax(1), np.round(cos.max(1).astype(float), 4)
    keep = (n > 0) & (sim >= limit(n, floor, full)) & bool(names)
    return [names[i] if k else None for i, k in zip(best, keep)], sim, keep


def identify(docs: DataFrame, rows_per_language: int = 600, clusters: int = 4, floor: float = 0.4, full: int = 400) -> DataFrame:
    """For each document: doc_id, language (null if rejected), similarity and keep.

    clusters: centroids of each language.  floor, full: a document of ``full`` or more trigrams is rejected below the
    cosine ``floor``; shorter ones by limit().
    """
    docs = docs.select("doc_id", "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, rows_per_language, clusters))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in pieces(big, "text", rows=ROWS):
                said, sim, keep = judge(b.column(1), model.value, floor, full)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string()), pa.array(sim), pa.array(keep)], ["doc_id", "language", "similarity", "keep"])

    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, language string, similarity double, keep boolean"
    return docs.select("doc_id", "text").mapInArrow(part, kind)


def accepted(docs: DataFrame, rows_per_language: int = 600, clusters: int = 4, floor: float = 0.4, full: int = 400) -> DataFrame:
    """The rows of docs that identify() keeps, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang"), rows_per_language, clusters))

    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            b = pa.RecordBatch.from_arrays([text], ["text"])
            yield pa.array(np.concatenate([judge(x.column(0), model.value, floor, full)[2] for x in pieces(b, "text", rows=ROWS)] or [np.zeros(0, bool)]))

    return docs.filter(F.arrow_udf(keep, "boolean")(F.col("text")))
