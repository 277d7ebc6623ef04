"""Bitmaps of hash values, gathered from a table by blocks: they tell most rows that another table doesn't name without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.llm.memory import trimmed

FILTER_BITS, BLOCK_BITS = 26, 16


def gather(rows: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of 2**bits places whose blocks ``rows`` (block, bits) hold."""
    bitmap, size = np.zeros((1 << bits) // 8, dtype=np.uint8), (1 << BLOCK_BITS) // 8
    for b, made in rows.collect():  # 2**bits bits in all
        bitmap[b * size : (b + 1) * size] = np.frombuffer(made, np.uint8)
    return bitmap


def is_set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


@trimmed
def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, bit) in block order to one bitmap for each block, as 64-bit numbers."""
    held, bits = None, np.zeros(1 << BLOCK_BITS, dtype=bool)

    def out():
        return pa.record_batch([pa.array([held], pa.int32()), pa.array([np.packbits(bits, bitorder="little").view("<i8")], pa.list_(pa.int64()))], names=["block", "words"])

    for batch in batches:
        block, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
        for i, j in zip(cut, np.append(cut[1:], len(block)), strict=True):
            if held != block[i]:
                if held is not None:
                    yield out()
                held = int(block[i])
                bits[:] = False
            bits[bit[i:j]] = True
    if held is not None:
        yield out()


def _place(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << FILTER_BITS)).cast("int")


def marks_of(named: DataFrame, key: list[str]) -> DataFrame:
    """(block, words): a bitmap of FILTER_BITS hash values of the ``key`` columns, 2**FILTER_BITS bits in all."""
    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = _place(key)
    bits = named.select(F.shiftright(at, BLOCK_BITS).alias("block"), at.bitwiseAND((1 << BLOCK_BITS) - 1).alias("bit")).distinct()
    return bits.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_mark, "block int, words array<long>")


def among(rows: DataFrame, marks: DataFrame, own: list[str], name: str) -> DataFrame:
    """``rows`` with a column ``name`` that holds for each row whose ``own`` columns equal the key of a row marked in ``marks``.

    It holds for few others, and for more of them as the bitmap fills. The bitmap is broadcast and looked up by Spark itself: a
    Python function here would be a second Python worker for each task of a stage that reads texts in Python.
    """
    at = _place(own)
    low = at.bitwiseAND((1 << BLOCK_BITS) - 1)
    bit = F.getbit(F.get(marks["words"], F.shiftright(low, 6)), low.bitwiseAND(63))
    looked = rows.join(F.broadcast(marks), F.shiftright(at, BLOCK_BITS) == marks["block"], "left")
    return looked.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(marks["block"], marks["words"])
