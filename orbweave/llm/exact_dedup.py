"""Exact deduplication through an extendible-hash index kept on shared files.

1. The distinct 64-bit keys are counted by hash prefix, and a directory is grown from one bucket by
   doubling: a bucket over its capacity is split on the next hash bit.
2. Map tasks fold equal texts (same bytes) before anything is shuffled, so a text that makes up a third of
   all rows reaches its owner once per map task, not once per row.
3. Owner tasks take whole buckets (ranges of the key), read them in key order, chain entries whose keys
   collide, and compare bytes along the chain. The chains are written as the index.
4. Documents look their entry up by digest; digests that many rows have don't shuffle together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.memory import trimmed
from orbweave.llm.shared import look_up, settle, shared_folder, table, whole_text

PREFIX_BITS = 16
BUCKET_CAPACITY = 256
FOLD_BYTES = 48 << 20

_FOLDED = "bucket int, key long, sha string, text binary, keep_id long, group_size long"
_INDEX = "bucket int, key long, chain int, sha string, n_bytes long, keep_id long, group_size long"


def grow_directory(counts: np.ndarray, capacity: int) -> np.ndarray:
    """The directory: for each prefix of the global depth, its bucket's number.

    ``counts`` has the number of keys for every prefix of the deepest level (a power of two). Buckets are
    numbered in key order; a bucket splits while it is over capacity and has bits left.
    """
    deepest = len(counts).bit_length() - 1
    before = np.concatenate([[0], np.cumsum(counts)])
    directory, depth = [0], 0
    local, span = {0: 0}, {0: (0, len(counts))}
    todo = [0]
    while todo:
        b = todo.pop()
        lo, hi = span[b]
        if before[hi] - before[lo] <= capacity or local[b] == deepest:
            continue
        if local[b] == depth:
            directory, depth = [x for x in directory for _ in (0, 1)], depth + 1
        new, mid = len(span), (lo + hi) // 2
        local[b] = local[new] = local[b] + 1
        span[b], span[new] = (lo, mid), (mid, hi)
        width = len(counts) >> depth
        directory[mid // width : hi // width] = [new] * (hi // width - mid // width)
        todo += [b, new]
    rank = {b: i for i, b in enumerate(sorted(span, key=span.get))}
    return np.array([rank[b] for b in directory], dtype=np.int32)


def _fold(directory: np.ndarray, shift: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            rows = list(held.items())
            for i in range(0, len(rows), 2000):
                part = rows[i : i + 2000]
                keys = np.array([v[0] for _, v in part], dtype=np.int64)
                prefix = keys.view(np.uint64) >> np.uint64(shift) if shift < 64 else np.zeros(len(keys), np.uint64)
                yield pa.record_batch(
                    [pa.array(directory[prefix.astype(np.int64)]), pa.array(keys), pa.array([v[1] for _, v in part]), pa.array([k for k, _ in part], pa.binary()), pa.array([v[2] for _, v in part], pa.int64()), pa.array([v[3] for _, v in part], pa.int64())],
                    names=["bucket", "key", "sha", "text", "keep_id", "group_size"],
                )

        for batch in batches:
            ids, keys, shas, texts = (batch.column(i).to_pylist() for i in range(4))
            for doc, key, sha, text in zip(ids, keys, shas, texts, strict=True):
                entry = held.get(text)
                if entry is None:
                    held[text] = [key, sha, doc, 1]
                    size += len(text) + 200
                else:
                    entry[3] += 1
                    if doc is not None and (entry[2] is None or doc > entry[2]):
                        entry[2] = doc
                if size > FOLD_BYTES:
                    yield from flush()
                    held.clear()
                    size = 0
        yield from flush()

    return run


@trimmed
def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in key order: the chain of one key is in memory, a single text for all but colliding keys."""
    done: list[tuple] = []
    at, chain = None, []

    def close():
        if len({e[1] for e in chain}) != len(chain):
            raise ValueError("two different texts have one SHA-256 digest")
        done.extend((at[0], at[1], i, e[1], len(e[0]), e[2], e[3]) for i, e in enumerate(chain))

    def out():
        columns = list(zip(*done, strict=True)) or [[]] * 7
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        made = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "key", "chain", "sha", "n_bytes", "keep_id", "group_size"])
        done.clear()
        return made

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for bucket, key, sha, text, keep, size in zip(*columns, strict=True):
            if at != (bucket, key):
                if at is not None:
                    close()
                at, chain = (bucket, key), []
            for entry in chain:
                if entry[0] == text:
                    entry[2] = max((x for x in (entry[2], keep) if x is not None), default=None)
                    entry[3] += size
                    break
            else:
                chain.append([text, sha, keep, size])
        if len(done) > 5000:
            yield out()
    if at is not None:
        close()
    yield out()


def build_index(docs: DataFrame, key_bits: int = 64, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """The index of distinct texts, written to shared files and read back.

    ``key_bits`` under 64 makes keys collide (for tests of the chains). One row for each distinct text:
    bucket, key, chain (position among entries of one key), sha, n_bytes, keep_id (largest doc_id, null only
    if all are null) and group_size.
    """
    spark = docs.sparkSession
    key = F.xxhash64(whole_text())
    key = key if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - key_bits), 64 - key_bits)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), F.sha2(whole_text(), 256).alias("sha"), F.encode(whole_text(), "UTF-8").alias("text"))
    prefix = F.shiftrightunsigned("key", 64 - PREFIX_BITS).cast("int").alias("prefix")
    counts = np.zeros(1 << PREFIX_BITS, dtype=np.int64)
    for row in keyed.select("key").distinct().groupBy(prefix).count().collect():  # at most 2**PREFIX_BITS rows
        counts[row["prefix"]] = row["count"]
    directory = grow_directory(counts, max(capacity, int(counts.sum()) >> PREFIX_BITS))
    depth = len(directory).bit_length() - 1
    folded = keyed.mapInArrow(_fold(directory, 64 - depth), _FOLDED)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owned = folded.repartition(parts, "bucket").sortWithinPartitions("bucket", "key").mapInArrow(_own, _INDEX)
    path = shared_folder(spark, "dedup-index")
    owned.write.parquet(path)
    return spark.read.schema(_INDEX).parquet(path)


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the largest doc_id stays; rows that repeat one doc_id with one
    text are the same document and share its decision (``deduplicate`` keeps one of them). A row with a null
    doc_id stays only if its whole group has none. An empty table gives an empty result.
    """
    index = build_index(docs, **options).select("sha", "keep_id", "group_size")
    rows = docs.select("doc_id", F.sha2(whole_text(), 256).alias("sha"))
    return look_up(rows, index, "sha", "group_size", "doc_id").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that another row's equal text replaces; columns stay as they are.

    Decisions hold for an id with its text: other texts of a repeated id, or of rows without an id, are judged for
    themselves, and of rows that repeat both one stays. Null and empty texts are equal. An empty table stays empty.
    """
    decided = exact_duplicates(docs).select("doc_id", F.col("text_sha256").alias("digest"), "kept")
    return settle(docs, decided, F.sha2(whole_text(), 256))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
