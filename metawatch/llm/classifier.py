"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its features, which are its words (runs without
white space) and their n-grams of bytes, hashed into buckets; a softmax layer gives the classes.  Vectors and layer are
trained by stochastic gradient descent in numpy, with steps scaled by the gradients so far, on a
bounded sample of labelled documents.  The classes are the four pairs of the labels quality and
toxic.  As the average and the layer are linear, scoring needs one number for each bucket and class.

Defined results: null and empty texts have no features and get the layer's bias alone; documents
without a label, or with one that is null or neither 0 nor 1, are no examples; of several labels of a
document the one of least class counts; repeated rows are scored each; with no label
at all every class is as likely and all documents stay; an empty table gives no rows; further
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches
from .textarrays import SPACED, U, hash_spans, mix, pieces, raw, strings, words

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
CLASSES = 4  # 2 * quality + toxic


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the texts' words, for each word its place among the unlike words, and the unlike words' features as pairs of word and bucket)."""
    data, off = raw(strings(texts))
    starts, ends, woff = words(data, off, SPACED)
    h = hash_spans(data, starts, ends)
    unlike, first, place = np.unique(h, return_index=True, return_inverse=True)
    if not len(unlike):
        return woff, place, np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, size = starts[first], (ends - starts)[first]
    at = np.concatenate([[0], np.cumsum(size + 1)])
    line = np.full(at[-1] + 1, 32, np.uint8)
    inside = np.repeat(np.arange(len(s)), size)
    step = np.arange(len(inside)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    line[at[inside] + 1 + step] = data[s[inside] + step]
    gap = np.concatenate([[0], np.cumsum(line == 32)])
    owner = np.maximum(np.cumsum(line == 32) - 1, 0)
    w, b = [np.arange(len(s))], [(mix(unlike) % U(BUCKETS)).astype(np.int64)]
    for n in GRAMS:
        i = np.arange(len(line) - n + 1)
        i = i[gap[i + n - 1] == gap[i + 1]]
        w.append(owner[i + 1])
        b.append((hash_spans(line, i, i + n) % U(BUCKETS)).astype(np.int64))
    return woff, place, np.concatenate(w), np.concatenate(b)


def averages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's average as (offsets, buckets, weights)."""
    size, buckets, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for b in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), "text", 1 << 19, 256):
        woff, place, w, feature = features(b.column(0))
        n = b.num_rows
        if not len(w):
            size.append(np.zeros(n, np.int64))
            continue
        unlike = int(place.max()) + 1
        pair, much = np.unique(np.repeat(np.arange(n), np.diff(woff)) * unlike + place, return_counts=True)  # (text, word) and how often
        order = np.argsort(w, kind="stable")
        feature, many = feature[order], np.bincount(w, minlength=unlike)
        begin = np.cumsum(many) - many
        k = many[pair % unlike]
        at = np.repeat(begin[pair % unlike] - np.cumsum(k) + k, k) + np.arange(k.sum())
        code, of = np.unique(np.repeat(pair // unlike, k) * BUCKETS + feature[at], return_inverse=True)
        total = np.bincount(of, weights=np.repeat(much, k))
        text = code // BUCKETS
        buckets.append(code % BUCKETS)
        weights.append(total / np.bincount(text, weights=total, minlength=n)[text])
        size.append(np.bincount(text, minlength=n))
    return np.concatenate([[0], np.cumsum(np.concatenate(size))]), np.concatenate(buckets), np.concatenate(weights).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: pa.Array, classes: np.ndarray, width: int = 8, epochs: int = 8, rate: float = 1.0, batch: int = 32, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(score of each bucket and class, bias of each class)."""
    rng = np.random.default_rng(seed)
    off, buckets, weights = averages(texts)
    vec = rng.uniform(-0.5, 0.5, (BUCKETS, width)).astype(np.float32) / width
    layer, bias = rng.normal(0, 0.5, (width, CLASSES)).astype(np.float32), np.zeros(CLASSES, np.float32)
    seen_v, seen_l, seen_b = np.full((BUCKETS, 1), 1e-8, np.float32), np.full_like(layer, 1e-8), np.full_like(bias, 1e-8)
    hot = np.eye(CLASSES, dtype=np.float32)[classes]
    some = np.flatnonzero(np.diff(off))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = rng.permutation(some)
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            n = off[rows + 1] - off[rows]
            begin = np.concatenate([[0], np.cumsum(n)[:-1]])
            at = np.repeat(off[rows] - begin, n) + np.arange(n.sum())
            b, w = buckets[at], weights[at][:, None]
            mean = np.add.reduceat(vec[b] * w, begin, axis=0)
            wrong = softmax(mean @ layer + bias) - hot[rows]
            g_layer, g_bias, g_mean = mean.T @ wrong / len(rows), wrong.mean(0), wrong @ layer.T / len(rows)
            u, inv = np.unique(b, return_inverse=True)
            g = np.stack([np.bincount(inv, weights=c) for c in (np.repeat(g_mean, n, axis=0) * w).T], 1).astype(np.float32)
            seen_v[u] += (g**2).mean(1, keepdims=True)
            seen_l += g_layer**2
            seen_b += g_bias**2
            vec[u] -= step * g / np.sqrt(seen_v[u])
            layer -= step * g_layer / np.sqrt(seen_l)
            bias -= step * g_bias / np.sqrt(seen_b)
    return vec @ layer, bias


def score(texts: pa.Array, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Class probabilities of each text."""
    woff, place, w, b = features(texts)
    n = len(texts)
    if not len(place):
        return np.repeat(softmax(bias[None].astype(float)), n, axis=0)
    unlike = int(place.max()) + 1
    cols = [np.bincount(w, minlength=unlike).astype(float)] + [np.bincount(w, weights=table[b, c], minlength=unlike) for c in range(CLASSES)]
    run = [np.concatenate([[0], np.cumsum(c[place])]) for c in cols]
    total = [r[woff[1:]] - r[woff[:-1]] for r in run]
    return softmax(np.stack(total[1:], 1) / np.maximum(total[0], 1)[:, None] + bias)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 6000) -> tuple[np.ndarray, np.ndarray]:
    """The model; train_rows: about how many labelled documents it is fitted on, those of least hashed id (all, if there are fewer)."""
    known = labels.filter("quality in (0, 1) and toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min(2 * F.col("quality") + F.col("toxic")).cast("int").alias("class"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = known.orderBy(*order).limit(train_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(*order, F.xxhash64("text")).limit(train_rows).select("text", "class").toArrow()
    if not rows.num_rows:
        return np.zeros((BUCKETS, CLASSES), np.float32), np.zeros(CLASSES, np.float32)
    return train(strings(rows.column("text")), rows.column("class").to_numpy())


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = 6000, toxic_limit: float = 0.5, poor_limit: float = 0.5) -> DataFrame:
    """For each document: doc_id, good (probability of quality 1), toxic (probability of toxic 1) and keep.

    toxic_limit, poor_limit: a document goes where toxic, or 1 - good, is above them.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value
        for big in batches:
            for b in pieces(big, "text"):
                p = score(b.column(1), table, bias)
                good, toxic = p[:, 2] + p[:, 3], p[:, 1] + p[:, 3]
                keep = (toxic <= toxic_limit) & (1 - good <= poor_limit)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(good, 4)), pa.array(np.round(toxic, 4)), pa.array(keep)], ["doc_id", "good", "toxic", "keep"])

    return docs.mapInArrow(part, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, good double, toxic double, keep boolean")
