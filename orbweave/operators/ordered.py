"""Ordered state machines as streaming folds.

A key's rows come to one task in order and pass once through a small state; rows leave as they are made, so a
task holds a state and a batch, however many rows a key has. Keys are the unit of parallelism: a machine
whose next state depends on the one before can't be split within a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
_EMIT = 8192


def fields_of(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(name, _KINDS[kind]) for name, kind in (part.split() for part in schema.split(","))]


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: str, *, frame: int = 0, finish: Callable | None = None) -> DataFrame:
    """Rows that ``step(state, row)`` makes of each key's rows, in order; ``start()`` gives a key's first state.

    A row is a tuple of ``df``'s columns. With ``frame`` > 0, rows that agree in the keys and the first
    ``frame`` order columns come together, as ``step(state, rows)``. ``finish(state)`` may add rows at a key's
    end. Rows leave as tuples of the schema (simple types). Columns must begin with the keys and order columns.
    """
    if df.columns[: len(keys) + len(order)] != [*keys, *order]:
        df = df.select(*keys, *order, *[c for c in df.columns if c not in {*keys, *order}])
    fields, n_keys, n_frame = fields_of(schema), len(keys), len(keys) + frame

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    def frames_of(rows: Iterable[tuple]) -> Iterator[tuple[tuple, object]]:
        if not frame:
            for row in rows:
                yield row[:n_keys], row
            return
        held: list[tuple] = []
        for row in rows:
            if held and held[0][:n_frame] != row[:n_frame]:
                yield held[0][:n_keys], held
                held = []
            held.append(row)
        if held:
            yield held[0][:n_keys], held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            batch = pa.record_batch([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])
            out.clear()
            return batch

        at, state = None, None
        for key, rows in frames_of(rows_of(batches)):
            if state is None or key != at:
                if state is not None and finish:
                    out.extend(finish(state))
                at, state = key, start()
            out.extend(step(state, rows))
            if len(out) >= _EMIT:
                yield made()
        if state is not None and finish:
            out.extend(finish(state))
        if out:
            yield made()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
