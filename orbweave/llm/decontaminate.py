"""Benchmark decontamination by SimHash over item-sized windows.

The benchmark is the stated query set: it is read in blocks of bounded size, and each block meets all
documents. Windows are looked at where they can matter: near five-word shingles that a document shares with
items of their size, if an item has enough of them there to reach the threshold at all (a window that passes
holds at least ``threshold`` of the item's shingle weight, so this loses nothing). Every such window, as long
as the items of one size, gets a 64-bit SimHash of its weighted shingles. A multi-index over blocks of the
fingerprints then names the candidates: all items of that size within the item's radius (by the pigeonhole
principle one block differs in few bits). Exact weighted-shingle similarity (sum of smaller over sum of larger
counts) decides, after a bound from the number of shared places in the window.

The radius is the item's own (``radius``). How many bits a window at the threshold can differ in depends on how far the
item's sums of votes are from zero, and on how heavy the shingles may be that it loses or gains: a word more at the end of
"x y x y x y ..." turns over a quarter of the bits. Each bit's chance to turn over follows from both, for the heaviest loss and the
heaviest gain that the threshold allows, and the radius is the least that more bits exceed with a chance below ``MISSED``. Such
radii are wide (30 to 50 of 64 bits for texts of 30 words and more, all 64 for the shortest), so it is the
bound from shared places that parts most windows from an item.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import words as w
from orbweave.llm.memory import trimmed
from orbweave.llm.shared import table, whole_text

SHINGLE = 5
THRESHOLD = 0.75
MISSED = 1e-12  # chance that a window at the threshold lies outside the radius
BLOCKS = 9  # of the fingerprint: eight of 7 bits and one of 8
BLOCK_ITEMS, BLOCK_CHARS = 4096, 8 << 20
_SCHEMA = "doc_id long, item_id long, similarity double, start_word long, window_words long, hamming int"
_BIT_AT = [*range(0, 56, 7), 56, 64]


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words in one sequence, as ``words.shingle_hashes`` makes them."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.full(n, size, dtype=np.uint64) if size < SHINGLE else np.zeros(n, dtype=np.uint64)
    for k in range(size):
        x = x * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
    return w.mix(x)


def votes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 fingerprint bits, one row for each shingle."""
    bits = np.unpackbits(w.mix(shingles + np.uint64(0x51ED270B0A1B2C3D)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHash values of summed votes, one row each."""
    return np.packbits(sums > 0, axis=1, bitorder="little").reshape(-1, 8).copy().view(np.uint64)[:, 0]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    low = sum(min(n, b[s]) for s, n in a.items() if s in b)
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


def radius(bag: Counter, sums: np.ndarray) -> int:
    """Bits in which windows as similar to an item as the threshold asks may differ from it (see above).

    It may lose the heaviest shingles, a share of 1 - threshold of the item's weight in a document shorter than the item, and gain
    one shingle again and again (a run of one word, with the SHINGLE - 1 shingles that lead into it).
    """
    weights = sorted(bag.values(), reverse=True)
    part = int((1 - THRESHOLD) / (1 + THRESHOLD) * sum(weights))
    lost, left = 0, int((1 - THRESHOLD) * sum(weights))
    for x in weights:
        lost += min(x, left) ** 2
        left -= min(x, left)
    gained = part if part < SHINGLE else (part - SHINGLE + 1) ** 2 + SHINGLE - 1
    share = lost / sum(x * x for x in weights)  # of what the sums owe to the lost shingles
    spread = lost * (1 - share) + gained
    if not spread:
        return 0
    turns = [0.5 * erfc(abs(x) * (1 - share) / sqrt(2 * spread)) for x in sums.tolist()]
    chance = np.array([1.0])  # of 0, 1, 2, ... bits turned over
    for p in turns:
        chance = np.append(chance * (1 - p), 0.0) + np.insert(chance * p, 0, 0.0)
    beyond = np.cumsum(chance[::-1])[::-1]  # of as many or more
    return int(np.flatnonzero(np.append(beyond[1:], 0.0) < MISSED)[0])


@dataclass
class HammingIndex:
    """Items of one window size, each with its radius: which of them a block's value is near to."""

    items: np.ndarray
    prints: np.ndarray
    radii: np.ndarray
    near: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        for lo, hi in zip(_BIT_AT, _BIT_AT[1:], strict=False):
            values = np.arange(1 << (hi - lo), dtype=np.uint64)
            mine = (self.prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
            self.near.append(np.bitwise_count(values[:, None] ^ mine[None, :]) <= self.radii // BLOCKS)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the item's radius."""
        found = np.zeros((len(prints), len(self.items)), dtype=bool)
        for near, lo, hi in zip(self.near, _BIT_AT, _BIT_AT[1:], strict=False):
            found |= near[((prints >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)]
        i, j = np.nonzero(found)
        far = np.bitwise_count(prints[i] ^ self.prints[j]).astype(np.int64)
        ok = far <= self.radii[j]
        return i[ok], j[ok], far[ok]


class BenchmarkBlock:
    """What tasks need of a block of items: shingle lists, counts, and an index for each window size."""

    def __init__(self, item_ids: list, texts: list[str]):
        column = pa.array(texts, pa.string())
        self.item_ids, self.sizes, self.bags = item_ids, [], []
        for _, _, data, offsets in w.slices(column):
            ws = w.split_words(data, offsets, w.LETTERS_DIGITS)
            hashes, first = w.shingle_hashes(ws, SHINGLE)
            self.sizes += np.diff(ws.first).tolist()
            self.bags += [Counter(hashes[i:j].tolist()) for i, j in zip(first, first[1:], strict=False)]
        self.weights = np.array([sum(b.values()) for b in self.bags], dtype=np.int64)
        pairs = sorted((s, k) for k, b in enumerate(self.bags) for s in b)
        self.shingles, at = np.unique(np.array([s for s, _ in pairs], dtype=np.uint64), return_index=True)
        self.begin = np.append(at, len(pairs)).astype(np.int64)
        self.owners = np.array([k for _, k in pairs], dtype=np.int64)
        self.short = sorted({n for n in self.sizes if 0 < n < SHINGLE})
        self.table = np.zeros(1 << 20, dtype=bool)
        self.table[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        self.index = {}
        for n in {n for n in self.sizes if n}:
            items = np.array([k for k, m in enumerate(self.sizes) if m == n])
            sums = np.stack([(votes(np.array(list(b), dtype=np.uint64)) * np.array(list(b.values()))[:, None]).sum(axis=0) for b in (self.bags[k] for k in items)])
            self.index[n] = HammingIndex(items, fingerprints(sums), np.array([radius(self.bags[k], x) for k, x in zip(items.tolist(), sums, strict=True)]))

    def shared(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) of all places whose shingle an item has."""
        at = np.flatnonzero(self.table[(hashes >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(self.shingles, hashes[at])
        k[k == len(self.shingles)] = 0
        same = self.shingles[k] == hashes[at] if len(self.shingles) else np.zeros(len(at), bool)
        at, k = at[same], k[same]
        n = self.begin[k + 1] - self.begin[k]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.owners[np.repeat(self.begin[k], n) + inside]


def windows_near(block: BenchmarkBlock, h: np.ndarray, size: int, places: dict[int, np.ndarray]) -> dict[int, tuple[float, int, int, int]]:
    """Best verified window of each item of one size in a document: (similarity, start, words, differing bits).

    ``places``: by item, where the document has its shingles, in order. Windows that hold one of them get a
    fingerprint; the index names the items that each comes near to.
    """
    best: dict[int, tuple[float, int, int, int]] = {}
    n = min(size, len(h))
    run = min(SHINGLE, size)
    last, span = len(h) - n, n - run + 1
    if span < 1:
        return best
    index = block.index[size]
    reach = np.unique(np.clip(np.concatenate(list(places.values()))[:, None] - np.arange(span)[None, :], 0, last))
    for part in np.split(reach, np.flatnonzero(np.diff(reach) > 1) + 1):
        for lo in range(0, len(part), 2048):
            starts = part[lo : lo + 2048]
            shingles = run_hashes(h[starts[0] : starts[-1] + n], run)
            total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(votes(shingles), axis=0, dtype=np.int32)])
            i, j, far = index.within(fingerprints(total[starts - starts[0] + span] - total[starts - starts[0]]))
            for y in np.unique(j).tolist():
                item, mine = int(index.items[y]), j == y
                at = places.get(item)
                if at is None:
                    continue
                begin = starts[i[mine]]
                shared = np.searchsorted(at, begin + span) - np.searchsorted(at, begin)
                able = (1 + THRESHOLD) * shared >= THRESHOLD * (span + block.weights[item])
                for x, d in zip(begin[able].tolist(), far[mine][able].tolist(), strict=True):
                    score = similarity(Counter(shingles[x - starts[0] : x - starts[0] + span].tolist()), block.bags[item])
                    if score >= THRESHOLD and (item not in best or (score, -x) > (best[item][0], -best[item][1])):
                        best[item] = (score, x, n, d)
    return best


def _hits(block: BenchmarkBlock, texts: pa.Array) -> list[tuple[int, int, tuple]]:
    """(row, number of the item, its best window) of all pairs that match."""
    found = []
    item_sizes = np.array(block.sizes)
    for i, _, data, offsets in w.slices(texts):
        ws = w.split_words(data, offsets, w.LETTERS_DIGITS)
        # places by word, for whole five-word runs and for the shorter items' own lengths
        got = []
        for size in [*block.short, SHINGLE]:
            hashes = run_hashes(ws.hashes, size)
            at, item = block.shared(hashes)
            doc = np.searchsorted(ws.first, at, "right") - 1
            ok = at + size <= ws.first[doc + 1]
            ok &= (item_sizes[item] == size) if size < SHINGLE else (item_sizes[item] >= SHINGLE)
            got.append((doc[ok], item[ok], at[ok]))
        doc, item, at = (np.concatenate(x) for x in zip(*got, strict=True))
        if not len(doc):
            continue
        order = np.lexsort((at, item, doc))
        doc, item, at = doc[order], item[order], at[order]
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
        near: dict[tuple[int, int], dict[int, np.ndarray]] = {}  # by document and size: each item's places
        for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(doc)).tolist(), strict=True):
            d, k = int(doc[lo]), int(item[lo])
            if hi - lo >= THRESHOLD * block.weights[k]:
                near.setdefault((d, block.sizes[k]), {})[k] = at[lo:hi] - ws.first[d]
        for (d, size), places in near.items():
            hits = windows_near(block, ws.hashes[ws.first[d] : ws.first[d + 1]], size, places)
            found += [(i + d, k, hit) for k, hit in sorted(hits.items())]
    return found


def _scan(shared_block):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: BenchmarkBlock = shared_block.value
        for batch in batches:
            found = [(batch.column(0)[row].as_py(), block.item_ids[k], *hit) for row, k, hit in _hits(block, batch.column(1))]
            columns = list(zip(*found, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return run


def _reject(shared_block, text: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            clean[[row for row, _, _ in _hits(shared_block.value, batch.column(text).fill_null(""))]] = False
            yield batch.filter(pa.array(clean))

    return run


def benchmark_blocks(benchmark: DataFrame) -> Iterator[BenchmarkBlock]:
    """The items in blocks of at most about BLOCK_ITEMS items and BLOCK_CHARS characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text")).where(F.length("text") > 0)
    n, chars = items.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    blocks = max(1, -(-n // (BLOCK_ITEMS // 2)), -(-(chars or 0) // (BLOCK_CHARS // 2)))
    for b in range(blocks if n else 0):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield BenchmarkBlock([r[0] for r in rows], [r[1] for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, window_words, hamming): the best window of each pair that matches.

    Words are runs of letters and digits after lower-casing A-Z. A document shorter than an item is one
    window. Items of fewer than five words match their exact sequence; items and texts without words, and
    nulls, match nothing. An empty benchmark or an empty table gives no rows; repeated rows repeat theirs.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = spark.createDataFrame([], _SCHEMA)
    for k, block in enumerate(benchmark_blocks(benchmark)):
        made = texts.mapInArrow(_scan(spark.sparkContext.broadcast(block)), _SCHEMA)
        found = made if k == 0 else found.unionByName(made)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage, row by row; columns stay as they are.

    Each row is judged by its own text, whether its doc_id is null, repeated or neither; null and empty texts
    stay, and an empty table or benchmark changes nothing.
    """
    kept = docs
    for block in benchmark_blocks(benchmark):
        kept = kept.mapInArrow(_reject(docs.sparkSession.sparkContext.broadcast(block), docs.columns.index("text")), docs.schema)
    return kept


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
