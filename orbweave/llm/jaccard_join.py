"""Exact Jaccard join of word-shingle sets, in size-banded tiles with bitmap signatures.

Documents with equal sets are one class (``set_id``), so copies cost nothing beyond the first pass.
Pairs of classes are found without a cross join:

1. A fixed-size table of counters gives every shingle an estimate of how common it is; shingles are ordered
   by (estimate, hash). Any order that all documents share is valid for prefix filtering, so collisions in
   the table cost only speed.
2. Two sets that reach the threshold share a shingle among the first n - ceil(t*n) + 1 of that order. Map
   tasks send those prefixes to hash buckets; equal shingles there give candidate edges along runs of
   compatible sizes (linear in the postings; runs are shortened before the shuffle too).
3. What is too much for one tile of a component gets new candidates, from counters of such components' sets alone: once
   there are many more shingles than counters, all counters are much alike, and sets that share no more than a
   passage meet. There a bitmap of eight places a shingle, or of 2^MARK_BITS, also parts shingles that no other set
   has from the rest. Sets stay together that both candidates join. That is repeated while it halves the shingles of
   these components.
4. Components of the candidate edges are cut into tiles: bands of sizes within the threshold's ratio, split
   into blocks of bounded size. In a tile the signatures' bit counts bound each overlap from above; what
   remains is decided by exact intersection of sorted arrays. Pairs already connected aren't compared again.
5. Components over the verified links give each class, and through it each document, its component.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import words as w
from orbweave.llm.bitmaps import BLOCK_BITS, among, gather, is_set, marks_of
from orbweave.llm.components import connected_components
from orbweave.llm.memory import trimmed
from orbweave.llm.shared import discard, freed, look_up, settle, stage, table, text_digest, whole_text

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
COUNTER_BITS, MARK_BITS = 24, 29
BUCKET_POSTINGS = 1 << 20
TILE_SETS, TILE_SHINGLES = 1024, 1 << 20
SIGNATURE_WORDS = 16
_POSTING = np.dtype([("shingle", "<u8"), ("set_id", "<i8"), ("n", "<u4")])
_BEYOND = np.dtype([("at", "<u2"), ("count", "<u4")])


def document_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes, where each document's begin), slice by slice."""
    for i, _, data, offsets in w.slices(texts):
        yield i, *w.distinct_sorted(*w.shingle_hashes(w.split_words(data, offsets, w.BLANK_SEPARATED), SHINGLE))


def set_ids(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each document's set (a sum of mixed members, so independent of order)."""
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(w.mix(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)), out=total[1:])
    n = np.diff(first).astype(np.uint64)
    return w.mix(total[first[1:]] - total[first[:-1]] + n * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


class _Counters:
    """Counts of shingles by their first COUNTER_BITS bits."""

    def __init__(self):
        self.counts = np.zeros(1 << COUNTER_BITS, dtype=np.uint32)
        self.waiting, self.size = [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append((hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.uint32))
        self.size += len(hashes)
        if self.size > 1 << 21:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            at, c = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.counts[at] += c.astype(np.uint32)
        self.waiting.clear()
        self.size = 0

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(block, its counts up to 255 as deflated bytes, what larger ones have beyond that)."""
        self.settle()
        for b in range(1 << (COUNTER_BITS - BLOCK_BITS)):
            part = self.counts[b << BLOCK_BITS : (b + 1) << BLOCK_BITS]
            if part.any():
                at = np.flatnonzero(part > 255)
                beyond = np.zeros(len(at), dtype=_BEYOND)
                beyond["at"], beyond["count"] = at, part[at] - 255
                deflate = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)  # small counts are a bit or two each
                yield b, deflate.compress(np.minimum(part, 255).astype(np.uint8).tobytes()) + deflate.flush(), beyond.tobytes()


@trimmed
def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, digest, n, set_id), and at the end the partition's shingle counters by block."""
    counters = _Counters()
    names = ["doc_id", "digest", "n", "set_id", "block", "counts", "beyond"]

    def rows(ids, digests, n, sets, block, counts, beyond):
        return pa.record_batch([pa.array(ids, pa.int64()), pa.array(digests, pa.int64()), pa.array(n, pa.int64()), pa.array(sets, pa.int64()), pa.array(block, pa.int32()), pa.array(counts, pa.binary()), pa.array(beyond, pa.binary())], names=names)

    for batch in batches:
        ids, digests, n, sets = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], []
        for _, hashes, first in document_sets(batch.column(2)):
            counters.add(hashes)
            k = np.diff(first)
            n += k.tolist()
            sets += [s if x else None for s, x in zip(set_ids(hashes, first).tolist(), k, strict=True)]
        none = [None] * len(ids)
        yield rows(ids, digests, n, sets, none, none, none)
    for b, counts, beyond in counters.blocks():
        yield rows([None], [None], [None], [None], [b], [counts], [beyond])


@trimmed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's counters of texts, as ``_profile`` gives them."""
    counters = _Counters()
    for batch in batches:
        for _, hashes, _ in document_sets(batch.column(0)):
            counters.add(hashes)
    for b, counts, beyond in counters.blocks():
        yield pa.record_batch([pa.array([b], pa.int32()), pa.array([counts], pa.binary()), pa.array([beyond], pa.binary())], names=["block", "counts", "beyond"])


@trimmed
def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum a block's counters over all partitions and keep them on a logarithmic scale of one byte."""
    held, total = None, np.zeros(1 << BLOCK_BITS, dtype=np.int64)

    def out():
        level = np.minimum(255, np.ceil(8 * np.log2(1 + total))).astype(np.uint8)
        return pa.record_batch([pa.array([held], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "levels"])

    for batch in batches:
        for block, counts, beyond in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if held != block:
                if held is not None:
                    yield out()
                held = block
                total[:] = 0
            total += np.frombuffer(zlib.decompress(counts), np.uint8)
            more = np.frombuffer(beyond, _BEYOND)
            total[more["at"]] += more["count"]
    if held is not None:
        yield out()


def _shorten(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate edges of postings, and the postings that still stand for their runs.

    A run is a shingle's sets in order of size, cut where the next set is too large for the one before; any
    two sets of the shingle that can reach the threshold are in one run. The run's first set is linked with
    each other one. A chain of its sets stands for it, from the first to the last, in which each next one is the
    largest that is not too large for the one before: whatever fits a set of the run fits one of the chain, and
    a chain has few sets, as any two of its steps exceed the threshold's ratio.
    """
    p = p[np.lexsort((p["set_id"], p["n"], p["shingle"]))]
    if len(p) < 2:
        return np.zeros((0, 2), np.int64), p
    n = p["n"].astype(np.int64)
    joined = (p["shingle"][1:] == p["shingle"][:-1]) & (DENOMINATOR * n[:-1] >= NUMERATOR * n[1:])
    head = np.flatnonzero(np.concatenate([[True], ~joined]))
    mine = np.repeat(head, np.diff(np.append(head, len(p))))
    edges = np.stack([p["set_id"][mine], p["set_id"]], axis=1)
    edges = edges[edges[:, 0] != edges[:, 1]]
    place = (np.cumsum(~np.concatenate([[False], joined])) << 35) + n  # by run and size; sizes have 32 bits
    step = np.searchsorted(place, place - n + DENOMINATOR * n // NUMERATOR, "right") - 1
    stands = np.zeros(len(p), dtype=bool)
    at = head
    while len(at):
        stands[at] = True
        at = step[at][step[at] > at]
    return np.unique(edges, axis=0), p[stands]


def _places(bits: int):
    """(block, places) of the texts' shingles among 2**bits."""

    def rows(slots: np.ndarray) -> pa.RecordBatch:
        slots.sort()
        block = slots >> np.uint64(BLOCK_BITS)
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        places = (slots & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u2")
        return pa.record_batch([pa.array(block[cut].astype(np.int32), pa.int32()), pa.array([places[i:j].tobytes() for i, j in zip(cut, np.append(cut[1:], len(slots)), strict=True)], pa.binary())], names=["block", "places"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for _, hashes, _ in document_sets(batch.column(0)):
                waiting.append(hashes >> np.uint64(64 - bits))
                size += len(hashes)
                if size > 1 << 22:
                    yield rows(np.concatenate(waiting))
                    waiting, size = [], 0
        if size:
            yield rows(np.concatenate(waiting))

    return run


@trimmed
def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in block order: a bitmap of the block's places that came more than once."""
    held, once, again = None, np.zeros(1 << BLOCK_BITS, dtype=bool), np.zeros(1 << BLOCK_BITS, dtype=bool)

    def out():
        return pa.record_batch([pa.array([held], pa.int32()), pa.array([np.packbits(again, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    for batch in batches:
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held != block:
                if held is not None:
                    yield out()
                held = block
                once[:] = again[:] = False
            p = np.frombuffer(blob, "<u2")  # sorted
            again[p[1:][p[1:] == p[:-1]]] = True
            again[p] |= once[p]
            once[p] = True
    if held is not None:
        yield out()


def _send(levels, buckets: int, marks=None, bits: int = 0):
    """``marks``: a bitmap of 2**bits places, of shingles that more than one set may have."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = levels.value
        waiting, size, seen = [], 0, set()

        def flush():
            edges, p = _shorten(np.concatenate(waiting))
            waiting.clear()
            to = ((p["shingle"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            p, to = p[order], to[order]
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            yield pa.record_batch([pa.array(to[cut], pa.int32()), pa.array([p[i:j].tobytes() for i, j in zip(cut, np.append(cut[1:], len(p)), strict=True)], pa.binary())], names=["bucket", "postings"])
            if len(edges):
                yield pa.record_batch([pa.array([-1], pa.int32()), pa.array([edges.astype("<i8").tobytes()], pa.binary())], names=["bucket", "postings"])

        for batch in batches:
            for _, hashes, first in document_sets(batch.column(0)):
                sets, n = set_ids(hashes, first), np.diff(first)
                fresh = np.zeros(len(n), dtype=bool)
                for d, s in enumerate(sets.tolist()):
                    if n[d] and s not in seen:
                        seen.add(s)
                        fresh[d] = True
                if len(seen) > 1 << 20:
                    seen.clear()
                owner = np.repeat(np.arange(len(n)), n)
                level = common[(hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                if marks is not None:
                    level = level.astype(np.int64) + 256 * is_set(marks.value, (hashes >> np.uint64(64 - bits)).astype(np.int64))
                order = np.lexsort((hashes, level, owner))
                rank = np.arange(len(owner)) - first[owner]  # owners are in order before and after
                prefix = n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1
                chosen = (rank < prefix[owner]) & fresh[owner]
                p = np.zeros(int(chosen.sum()), dtype=_POSTING)
                p["shingle"], o = hashes[order][chosen], owner[chosen]
                p["set_id"], p["n"] = sets[o], n[o]
                if len(p):
                    waiting.append(p)
                    size += len(p)
                if size > BUCKET_POSTINGS:
                    yield from flush()
                    size = 0
        if waiting:
            yield from flush()

    return run


def _edge_rows(edges: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(edges[:, 0], pa.int64()), pa.array(edges[:, 1], pa.int64())], names=["a", "b"])


@trimmed
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in bucket order: a bucket's postings meet; its memory is bounded, as long runs were shortened."""
    held, parts, size = None, [], 0

    def close(last: bool):
        edges, rest = _shorten(np.unique(np.concatenate(parts)))
        parts[:] = [] if last else [rest]
        return edges

    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket < 0:
                yield _edge_rows(np.frombuffer(blob, "<i8").reshape(-1, 2))
                continue
            if bucket != held and parts:
                yield _edge_rows(close(True))
                size = 0
            held = bucket
            parts.append(np.frombuffer(blob, dtype=_POSTING))
            size += len(parts[-1])
            if size > 4 * BUCKET_POSTINGS:
                yield _edge_rows(close(False))
                size = len(parts[0]) // 2
    if parts:
        yield _edge_rows(close(True))


def signatures(arrays: list[np.ndarray]) -> np.ndarray:
    """Hashed bitmaps of SIGNATURE_WORDS * 64 bits, one row for each set."""
    out = np.zeros((len(arrays), SIGNATURE_WORDS * 64), dtype=bool)
    for i, a in enumerate(arrays):
        out[i, (a % np.uint64(SIGNATURE_WORDS * 64)).astype(np.int64)] = True
    return np.packbits(out, axis=1).view(np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def link_tile(arrays: list[np.ndarray], side: np.ndarray, guest: np.ndarray, cross: bool) -> list[tuple[int, int]]:
    """Links that connect the tile's sets as all its links do.

    ``cross``: only pairs from different sides (blocks). Guests (sets of the next band) meet only owners.
    """
    count = len(arrays)
    n = np.array([len(a) for a in arrays], dtype=np.int64)
    bits = signatures(arrays)
    label, found = np.arange(count), []
    for i in range(count):
        ok = np.zeros(count, dtype=bool)
        ok[i + 1 :] = True
        ok &= ~(guest & guest[i]) & (label != label[i])
        if cross:
            ok &= side != side[i]
        small, large = np.minimum(n, n[i]), np.maximum(n, n[i])
        ok &= DENOMINATOR * small >= NUMERATOR * large
        j = np.flatnonzero(ok)
        if not len(j):
            continue
        # least overlap that reaches the threshold: inter >= t * (n_i + n_j) / (1 + t)
        need = -(-NUMERATOR * (n[j] + n[i]) // (NUMERATOR + DENOMINATOR))
        most = np.minimum(n[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(axis=1, dtype=np.int64), n[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(axis=1, dtype=np.int64))
        for k in j[most >= need]:
            if label[k] == label[i]:
                continue
            x = overlap(arrays[i], arrays[k])
            if DENOMINATOR * x >= NUMERATOR * (n[i] + n[k] - x):
                found.append((i, int(k)))
                label[label == label[k]] = label[i]
    return found


@trimmed
def _link_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in tile order: one tile's sets are in memory at a time."""
    held, sets = None, {}

    def close():
        ids = sorted(sets, key=lambda s: (len(sets[s][2]), s))
        pairs = link_tile([np.frombuffer(sets[s][2], "<u8") for s in ids], np.array([sets[s][0] for s in ids]), np.array([sets[s][1] for s in ids], dtype=bool), held[2] != held[3])
        sets.clear()
        return _edge_rows(np.array([(ids[i], ids[j]) for i, j in pairs], dtype=np.int64).reshape(-1, 2))

    for batch in batches:
        for c, band, i, j, block, guest, set_id, blob in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            if held != (c, band, i, j) and sets:
                yield close()
            held = (c, band, i, j)
            sets.setdefault(set_id, (block, guest, blob))  # rows that repeat id and text repeat the set
    if sets:
        yield close()


def _asked_for(texts: DataFrame, wanted: DataFrame, bitmap: DataFrame | None = None) -> DataFrame:
    """``texts`` without most rows whose doc_id and digest no row of ``wanted`` has; no wanted row goes.

    ``bitmap``: that of ``wanted``, where several queries use it.
    """
    key = ["doc_id", "digest"]
    return among(texts, marks_of(wanted, key) if bitmap is None else bitmap, key, "asked").where("asked").drop("asked")


@trimmed
def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_id, tiles, text) to (set_id, tiles, shingles), for texts that have the wanted set.

    Rows that repeat an id and its text come one after another; the first stands for them.
    """
    last = None
    for batch in batches:
        wanted, blobs, kept = batch.column(0).to_pylist(), [], []
        for i, hashes, first in document_sets(batch.column(2)):
            for k, has in enumerate(set_ids(hashes, first).tolist(), i):
                if has == wanted[k] != last:
                    last = has
                    kept.append(k)
                    blobs.append(hashes[first[k - i] : first[k - i + 1]].astype("<u8").tobytes())
        rows = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(blobs, pa.binary())], names=["set_id", "tiles", "shingles"])


def _blocks(members: DataFrame, *key: str) -> DataFrame:
    """(key, blocks): in how many blocks of a tile's bounds the sets of ``key`` are split."""
    sums = members.groupBy(*key).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    return sums.select(*key, F.greatest(F.ceil(F.col("m") / TILE_SETS), F.ceil(F.col("total") / TILE_SHINGLES)).cast("int").alias("blocks"))


def _tiles(members: DataFrame) -> DataFrame:
    """(component, band, i, j, block, guest, set_id, doc_id, digest) for (component, set_id, doc_id, digest, n)."""
    sized = members.join(_blocks(members, "component").select("component", (F.col("blocks") > 1).alias("wide")), "component")
    band = F.floor(F.log("n") / F.lit(math.log(DENOMINATOR / NUMERATOR)) + 1e-9).cast("int")
    # a set is an owner of its band and a guest of the band below: sizes within the ratio are at most one band apart
    roles = F.when(F.col("wide"), F.array(F.struct(band.alias("band"), F.lit(False).alias("guest")), F.struct((band - 1).alias("band"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.lit(-1).alias("band"), F.lit(False).alias("guest"))))
    placed = sized.withColumn("role", F.explode(roles)).select("component", "role.*", "set_id", "doc_id", "digest", "n")
    placed = placed.join(_blocks(placed, "component", "band"), ["component", "band"]).withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return placed.withColumn("other", other).select("component", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "guest", "set_id", "doc_id", "digest")


def _near(texts: DataFrame, blocks: DataFrame, total: int, marked: bool = False) -> DataFrame:
    """(node, component) of the sets of ``texts`` (text) by candidate edges.

    ``blocks`` are counters of their ``total`` shingles, by partition; ``marked``: a bitmap tells shingles that no other set has.
    """
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels = np.zeros(1 << COUNTER_BITS, dtype=np.uint8)
    marks, bits = None, 0
    with freed(spark):
        for b, made in blocks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_sum_blocks, "block int, levels binary").collect():  # 2**COUNTER_BITS bytes in all
            levels[b << BLOCK_BITS : (b + 1) << BLOCK_BITS] = np.frombuffer(made, np.uint8)
        if marked:
            bits = min(max(BLOCK_BITS, (8 * total - 1).bit_length()), MARK_BITS)
            placed = texts.mapInArrow(_places(bits), "block int, places binary").repartition(parts, "block").sortWithinPartitions("block")
            marks = spark.sparkContext.broadcast(gather(placed.mapInArrow(_repeated, "block int, bits binary"), bits))
    buckets = max(parts, -(-total // (4 * BUCKET_POSTINGS)))
    sent = texts.mapInArrow(_send(spark.sparkContext.broadcast(levels), buckets, marks, bits), "bucket int, postings binary")
    spread = F.when(F.col("bucket") < 0, F.xxhash64("postings")).otherwise(F.col("bucket"))
    return connected_components(sent.repartition(parts, spread).sortWithinPartitions("bucket").mapInArrow(_meet, "a long, b long"))


def _spoken(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (with doc_id and digest) beside the texts they name."""
    # one plan at every size: Spark would broadcast the wanted rows while they are few
    named = _asked_for(texts, wanted).withColumnsRenamed({"doc_id": "id", "digest": "own"})
    return named.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("digest")))


def _narrowed(texts: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (component, set_id, doc_id, digest, n), staged, with components of several blocks split by new candidates.

    Sets that no other of their component meets again have no link, and go. The texts are read where they lie, three times
    a round: a shuffle or a copy of them would be most of the disk.
    """
    members, before = stage(members, "jaccard-members"), None
    while True:
        large = _blocks(members, "component").where("blocks > 1").select("component")
        wide = stage(members.join(large, "component"), "jaccard-wide")
        total = wide.agg(F.sum("n")).first()[0] or 0
        if not total or before is not None and 2 * total > before:
            discard(wide)
            return members
        before = total
        bitmap = stage(marks_of(wide, ["doc_id", "digest"]), "bitmap")
        named = _asked_for(texts, wide, bitmap).select("text")
        near = _near(named, named.mapInArrow(_count, "block int, counts binary, beyond binary"), total, marked=True).toDF("set_id", "near")
        # linked sets are in one component both times; a hash that two such pairs share would only join two tiles
        both = wide.join(near, "set_id").withColumn("component", F.xxhash64("component", "near"))
        met = both.groupBy("component").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("component")
        split = both.join(met, "component").select(*members.columns)
        was, members = members, stage(members.join(large, "component", "left_anti").unionAll(split), "jaccard-members")
        for done in (was, wide, bitmap):
            discard(done)


def _components(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, digest, n, set_id, and ``best``: the row that speaks for its component."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), whole_text().alias("text"))
    profile = stage(texts.mapInArrow(_profile, "doc_id long, digest long, n long, set_id long, block int, counts binary, beyond binary"), "jaccard-profile")
    rows = stage(profile.where("block is null").select("doc_id", "digest", "n", "set_id"), "jaccard-rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    near = _near(texts.select("text"), profile.where("block is not null").select("block", "counts", "beyond"), total)
    discard(profile)
    # one row speaks for its class: of those with an id, if there are any, the one with the least
    speaker = F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "digest")
    sets = rows.where("set_id is not null").groupBy("set_id").agg(F.min(speaker).alias("own"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows")).select("set_id", "own", "own.doc_id", "own.digest", "n", "rows")
    members = near.withColumnRenamed("node", "set_id").join(sets, "set_id").select("component", "set_id", "doc_id", "digest", "n")
    narrowed = _narrowed(texts, members)
    tiles = stage(_tiles(narrowed), "jaccard-tiles")
    discard(narrowed)
    # the speaker's text is fetched once for all its tiles; its id alone may stand for several texts
    wanted = tiles.groupBy("set_id", "doc_id", "digest").agg(F.collect_list(F.struct("component", "band", "i", "j", "block", "guest")).alias("tiles"))
    arrays = _spoken(texts, wanted).select("set_id", "tiles", "text").mapInArrow(_arrays, "set_id long, tiles array<struct<component:long,band:int,i:int,j:int,block:int,guest:boolean>>, shingles binary")
    dealt = arrays.select("set_id", "shingles", F.explode("tiles").alias("t")).select("t.*", "set_id", "shingles")
    key = ["component", "band", "i", "j"]
    links = dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_link_tiles, "a long, b long")
    joined = connected_components(links).withColumnRenamed("node", "set_id")
    discard(tiles)
    named = joined.join(sets.select("set_id", "own"), "set_id")
    least = named.groupBy("component").agg(F.min("own").alias("best"))
    linked = named.select("set_id", "component").join(least, "component").select("set_id", "best")
    by_set = stage(sets.select("set_id", "own", "rows").join(linked, "set_id", "left").select("set_id", F.coalesce("best", "own").alias("best"), "rows"), "jaccard-sets")
    return look_up(rows, by_set, "set_id", "rows", "doc_id").select("doc_id", "digest", "n", "set_id", "best")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, set_id.

    Words are runs of non-blank bytes after lower-casing A-Z; a set holds the distinct runs of five words (a
    shorter text's whole sequence as one). Texts without words and nulls have no set (n_shingles 0, set_id
    null) and stay alone. Two documents link when 100 * intersection >= 75 * union; component_id is the
    smallest doc_id reachable. An empty table gives an empty result. Repeated doc_ids are rows of their own; null doc_ids never name a component
    unless all its members lack one.
    """
    found = _components(docs)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"), "set_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row (of the smallest doc_id) of each component; columns stay as they are.

    Decisions hold for an id with its text, as in ``deduplicate``; of rows that repeat both one stays. Documents
    without words stay. An empty table stays empty.
    """
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))
    return settle(docs, _components(docs).where("set_id is not null").select("doc_id", "digest", kept.alias("kept")), text_digest())


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and component."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
