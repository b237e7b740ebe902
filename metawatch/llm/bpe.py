"""Byte-level BPE encoding and decoding through a table of distinct words.

Spark splits the texts into words by the tokenizer's pattern.  Documents are taken in blocks; a block's
distinct words go to the places that their hashes tell, where the table of distinct words is made place
by place and each word is encoded once, and the ids come back to the block, where every document gets
them by the positions of its words.  A word is sent once for each block, so that a common one weighs no
more than others; the plan is the same for all sizes.  Decoding looks each id up in the table of the
pieces of the vocabulary, whose number is fixed by the tokenizer, without leaving the JVM: what a join by
id with a broadcast table gives, but for the rows of one id each and the exchange that put them together again.

Defined results: null and empty texts have no ids, and no ids decode to the empty text; ids outside
the vocabulary, and null ones, decode to nothing; bytes that are no UTF-8 decode to U+FFFD; repeated
rows are encoded each; empty tables give no rows; columns that are not asked for are dropped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches
from .textarrays import hash_spans, raw, strings

#: The pattern of the public 50k vocabularies, with white space as Unicode has it.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MADE: dict[int, tiktoken.Encoding] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: bytes of a piece and its id on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}


def _encoding(ranks: Broadcast) -> tiktoken.Encoding:
    key = id(ranks.value)  # one object as long as the worker lives
    if key not in _MADE:
        _MADE[key] = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks.value, special_tokens={})
    return _MADE[key]


def packed(ranks: dict[bytes, int]) -> type:
    """The narrowest of two number types that holds all ids."""
    return np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.uint32


class Places:
    """Sizes of the exchange: bytes of text in a block, and the number of places that words are dealt to."""

    def __init__(self, block: int, places: int):
        self.block, self.places = block, places


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32, all their lowest bytes first: small ones compress well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes, n: int, at: int = 0) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel().astype(np.int64)


_ZSTD = pa.Codec("zstd", compression_level=3)


def _packed(data: bytes) -> bytes:
    """The length and the data, compressed: exchanges are compressed too, but without coding by frequency."""
    return np.uint32(len(data)).tobytes() + _ZSTD.compress(data, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    size = int(np.frombuffer(data, np.uint32, 1)[0])
    return _ZSTD.decompress(data[4:], size, asbytes=True) if size else b""


def _bundle(numbers: np.ndarray, sizes: np.ndarray, body: bytes) -> bytes:
    """Things with rising numbers: how many there are, numbers, sizes, and all of them in a row."""
    return np.uint32(len(numbers)).tobytes() + _planes(np.diff(numbers, prepend=0)) + _planes(sizes) + body


def _unbundled(data: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    return np.cumsum(_numbers(data, n, 4)), _numbers(data, n, 4 + 4 * n), data[4 + 8 * n :]


def _slices(b: pa.RecordBatch, column: int, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many list elements, one row at least."""
    off = np.asarray(b.column(column).offsets)
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield b.slice(i, j - i)
        i = j


DOC, WORDS, IDS = 0, 1, 2


def _blocks(split: DataFrame, sizes: Places) -> DataFrame:
    """(to, kind, k, data): documents with the numbers of their words, to their block; and each block's distinct words, to their places.

    A block is named by a hash of what is in it.  Words are numbered within it, common ones first.
    """
    kept = split.schema["k"].dataType

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = pa.concat_arrays([b.column(1).flatten() for b in held])
        coded = flat.dictionary_encode()
        at, known = coded.indices.to_numpy(), coded.dictionary
        del flat, coded
        order = np.argsort(-np.bincount(at, minlength=len(known)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        at = rank[at]
        data, off = raw(strings(known.take(pa.array(order))))
        name = hashlib.blake2b(at.tobytes(), digest_size=8)
        name.update(data.tobytes())
        name.update(off.tobytes())
        block = int.from_bytes(name.digest(), "big") >> 1
        begin = 0
        for b in held:
            ends = np.asarray(b.column(1).offsets).astype(np.int64)
            ends = ends - ends[0] + begin
            rows = [_packed(_planes(at[a:z])) for a, z in zip(ends[:-1], ends[1:])]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.full(n, DOC, np.int32)), b.column(0), pa.array(rows, pa.binary())], names)
            begin = int(ends[-1])
        place = (hash_spans(data, off[:-1], off[1:]) % np.uint64(sizes.places)).astype(np.int64)
        by = np.argsort(place, kind="stable")
        cut = np.searchsorted(place[by], np.arange(sizes.places + 1))
        blob, out = data.tobytes(), []
        for p in range(sizes.places):
            mine = by[cut[p] : cut[p + 1]]
            if len(mine):
                body = b"".join([blob[a:z] for a, z in zip(off[mine].tolist(), off[mine + 1].tolist())])
                out.append((-1 - p, np.int64(block).tobytes() + _packed(_bundle(mine, off[mine + 1] - off[mine], body))))
        if out:
            to, rows = zip(*out)
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.full(n, WORDS, np.int32)), pa.nulls(n, held[0].column(0).type), pa.array(rows, pa.binary())], names)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for big in batches:
            for b in _slices(big, 1):
                held.append(b)
                size += b.column(1).flatten().nbytes
                if size > sizes.block:
                    yield from made(held)
                    held, size = [], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield from made(held)

    names = ["to", "kind", "k", "data"]
    return split.mapInArrow(part, f"to long, kind int, k {kept.simpleString()}, data binary")


def _word_table(sent: DataFrame, ranks: Broadcast) -> DataFrame:
    """(to, kind, data): the ids of each block's words, back to the block; at its place every distinct word is encoded once."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = _encoding(ranks).encode_ordinary, packed(ranks.value)
        size = np.dtype(kind).itemsize
        table: dict[bytes, bytes] = {}
        now = None
        for b in batches:
            to, out = b.column(0).to_pylist(), []
            for i in np.flatnonzero(b.column(1).to_numpy() == WORDS).tolist():
                if to[i] != now:
                    now, table = to[i], {}
                data = b.column(3)[i].as_py()
                block = int(np.frombuffer(data, np.int64, 1)[0])
                numbers, sizes, body = _unbundled(_unpacked(data[8:]))
                ends = np.cumsum(sizes)
                ids = []
                for a, z in zip((ends - sizes).tolist(), ends.tolist()):
                    w = body[a:z]
                    x = table.get(w)
                    if x is None:
                        x = table[w] = np.array(encode(w.decode()), kind).tobytes()
                    ids.append(x)
                out.append((block, _packed(_bundle(numbers, np.array([len(x) // size for x in ids]), b"".join(ids)))))
            if out:
                blocks, rows = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(np.full(len(out), IDS, np.int32)), pa.array(rows, pa.binary())], ["to", "kind", "data"])

    return sent.mapInArrow(part, "to long, kind int, data binary")  # all columns, so that the exchange is the one that the documents come by


def encode(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = 8 << 20, pattern: str = PATTERN) -> DataFrame:
    """The columns ``keep`` of docs and ids, the ids of text in a list; a kept column called ids is replaced.

    vocabulary: path of a rank file, read on the driver.  block_bytes: of words in a block of documents, about.
    """
    bounded_batches(docs.sparkSession)
    keep = [c for c in keep if c != "ids"]
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    sizes = Places(block_bytes, max(4, -(-total // block_bytes)))
    ranks = load_ranks(vocabulary)
    kind = packed(ranks)
    split = docs.select(F.struct(F.lit(0).alias("none"), *keep).alias("k"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("words"))
    # one exchange for both, read twice: the words at their places give what the documents then meet at their blocks
    sent = _blocks(split, sizes).repartition(sizes.places, "to").sortWithinPartitions("to")
    back = _word_table(sent, docs.sparkSession.sparkContext.broadcast(ranks)).repartition(sizes.places, "to")

    def placed(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.filter(pa.array(left.column("kind").to_numpy() == DOC)).combine_chunks()
        got = [_unbundled(_unpacked(x)) for x in right.column("data").to_pylist()]
        n = 1 + max((int(x[0][-1]) for x in got), default=-1)
        many, spot = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        ids = np.frombuffer(b"".join(x[2] for x in got), kind)
        begin = 0
        for numbers, size, _ in got:
            spot[numbers] = begin + np.cumsum(size) - size
            many[numbers] = size
            begin += int(size.sum())
        off, out = [0], [np.zeros(0, np.int32)]
        for data in map(_unpacked, left.column("data").to_pylist()):
            at = _numbers(data, len(data) // 4)
            if len(at) and (at.max() >= n or many[at].min() < 0):
                raise ValueError("the words of a block are not those that were sent; its input was not the same twice")
            m = many[at]
            end = np.cumsum(m)
            out.append(ids[np.repeat(spot[at] - end + m, m) + np.arange(m.sum())].astype(np.int32))
            off.append(off[-1] + len(out[-1]))
        flat = np.concatenate(out)
        del out
        lists = pa.LargeListArray.from_arrays(pa.array(off, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int32()))
        pa.default_memory_pool().release_unused()
        k = left.column("k").combine_chunks() if left.num_rows else None
        cols = [k.field(1 + i) if k is not None else pa.nulls(0, left.schema.field("k").type.field(1 + i).type) for i in range(len(keep))]
        return pa.Table.from_arrays([*cols, lists], names=[*keep, "ids"])

    shape = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>"])
    return sent.groupBy("to").cogroup(back.groupBy("to")).applyInArrow(placed, shape)


def decode(encoded: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The columns ``keep`` of encoded and text, put together from the pieces of ids.

    The table of pieces is one constant of the plan, of a size that the vocabulary fixes; each id looks its piece up there.
    """
    ranks = load_ranks(vocabulary)
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    keep = [c for c in keep if c != "text"]
    # a byte stands as the character of its number; folded to an array once, when the plan is made
    table = F.split(F.lit("\u0100".join(x.decode("latin-1") for x in pieces)), "\u0100")
    joined = F.array_join(F.transform(F.coalesce("ids", F.array().cast("array<int>")), lambda i: F.get(table, i)), "")
    return encoded.select(*keep, F.make_valid_utf8(F.encode(joined, "ISO-8859-1").cast("string")).alias("text"))
