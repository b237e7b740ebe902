"""Rows made of rows in Python, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes that are gathered before they leave Python, and the most rows.
SLICE, ROWS = 1 << 20, 4096
#: Bytes of an Arrow batch into Python; the session's own limit stands where it is lower.
BATCH = 8 << 20

TYPES = {"string": (pa.string(), T.StringType()), "binary": (pa.binary(), T.BinaryType()), "int": (pa.int32(), T.IntegerType())}


def small_batches(df: DataFrame) -> None:
    """Lower the session's limit on the bytes of an Arrow batch.  Results do not depend on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(name).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH:
        df.sparkSession.conf.set(name, str(BATCH))


def arrow_list(fields: list[tuple[str, str]]) -> pa.DataType:
    """A list of rows of fields."""
    return pa.list_(pa.struct([(n, TYPES[t][0]) for n, t in fields]))


def sliced(batches: Iterable[pa.RecordBatch], column: str, names: list[str], types: list[pa.DataType], each: Callable[[Any], list[tuple]]) -> Iterator[pa.RecordBatch]:
    """The batches without column, every row once for each tuple that ``each`` makes of its value there.

    One value and what comes of it is held at a time, besides the batch and a slice.
    """
    for batch in batches:
        values, kept = batch.column(column), batch.drop_columns([column])
        own = kept.nbytes // max(batch.num_rows, 1) + 1
        at: list[int] = []
        out: list[tuple] = []
        size = 0

        def gathered() -> pa.RecordBatch:
            rows = kept.take(pa.array(at, pa.int32()))
            made = [pa.array(x, t) for x, t in zip(zip(*out), types)]
            return pa.RecordBatch.from_arrays([*rows.columns, *made], [*rows.schema.names, *names])

        for i in range(batch.num_rows):
            for row in each(values[i].as_py()):
                at.append(i)
                out.append(row)
                size += own + sum(len(x) for x in row if isinstance(x, (str, bytes)))
                if size >= SLICE or len(at) >= ROWS:
                    yield gathered()
                    at, out, size = [], [], 0
        if at:
            yield gathered()


def spread(rows: DataFrame, column: str, fields: list[tuple[str, str]], each: Callable[[Any], list[tuple]]) -> DataFrame:
    """rows without column, once for each tuple of fields (name and string, binary or int) that ``each`` makes of its value."""
    small_batches(rows)
    names, types = [n for n, _ in fields], [TYPES[t][0] for _, t in fields]
    schema = T.StructType([f for f in rows.schema if f.name != column])
    for n, t in fields:
        schema = schema.add(n, TYPES[t][1])
    return rows.mapInArrow(lambda batches: sliced(batches, column, names, types, each), schema)
