"""Arrow batches in bounded pieces for the Python stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import ship_package

#: A piece holds at most so many characters (one longer text makes a piece of its own) and rows.
PIECE_CHARS, PIECE_ROWS = 600_000, 4_000


def pieces(cols: dict[str, list], texts: tuple[str, ...]) -> Iterator[dict[str, list]]:
    n = len(next(iter(cols.values()))) if cols else 0
    at, chars = 0, 0
    sizes = [0] * n
    for t in texts:
        sizes = [s + len(v) if v else s for s, v in zip(sizes, cols[t])]
    for i, size in enumerate(sizes):
        if i > at and (chars + size > PIECE_CHARS or i - at >= PIECE_ROWS):
            yield {k: v[at:i] for k, v in cols.items()}
            at, chars = i, 0
        chars += size
    if n > at:
        yield {k: v[at:n] for k, v in cols.items()}


def map_pieces(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, object]], texts: tuple[str, ...]) -> DataFrame:
    """fn turns the columns of a piece (lists) into the columns of any number of rows (lists or numpy arrays)."""
    spark = df.sparkSession
    ship_package(spark)
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {f.name: batch.column(i).to_pylist() for i, f in enumerate(batch.schema)}
            for piece in pieces(cols, texts):
                out = fn(piece)
                if len(out[arrow.names[0]]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def fold_partitions(df: DataFrame, schema: str, start: Callable[[], object], step: Callable[[object, dict[str, list]], None], end: Callable[[object], dict[str, object]], texts: tuple[str, ...]) -> DataFrame:
    """One accumulator a partition: step takes in each piece, end gives the partition's rows."""
    spark = df.sparkSession
    ship_package(spark)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            cols = {f.name: batch.column(i).to_pylist() for i, f in enumerate(batch.schema)}
            for piece in pieces(cols, texts):
                step(state, piece)
        out = end(state)
        n = len(out[arrow.names[0]])
        for i in range(0, n, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name][i : i + 10_000], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def scan_partitions(df: DataFrame, schema: str, start: Callable[[], object], step: Callable[[object, dict[str, list]], dict[str, object] | None], end: Callable[[object], dict[str, object]], texts: tuple[str, ...]) -> DataFrame:
    """Rows of each piece and, from one accumulator a partition, rows at its end: two results of one scan."""
    ship_package(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def batch_of(out: dict[str, object]) -> Iterator[pa.RecordBatch]:
        n = len(next(iter(out.values())))
        for i in range(0, n, 10_000):
            m = min(n, i + 10_000) - i
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name][i : i + m], type=f.type) if f.name in out else pa.nulls(m, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            cols = {f.name: batch.column(i).to_pylist() for i, f in enumerate(batch.schema)}
            for piece in pieces(cols, texts):
                if out := step(state, piece):
                    yield from batch_of(out)
        yield from batch_of(end(state))

    return df.mapInArrow(run, schema)
