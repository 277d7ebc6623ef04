"""Token-ID output as wavelet matrices.

Documents are dealt to shards by ranges of doc_id, encoded with a byte-level BPE, closed with an end id, and
written as wavelet matrices: one bit-plane for each bit of an id, most significant first, each plane stably
parted by its bits. Rank directories let a reader get the id at a position, count an id in a range and find
an id's places from one file without decoding it. A shard is one Parquet file; its rows are segments of at
most ``SEGMENT_TOKENS`` ids (and so of bounded memory), each with its planes, rank directory and documents.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm.shared import shared_folder, table, whole_text

SEGMENT_TOKENS = 1 << 20
MOST_SHARDS = 100_000
RANK_BLOCK = 512  # bits between entries of a rank directory
END_ID = 0
CACHE_WORDS = 1_200_000  # pre-tokens that a Python worker remembers from task to task
_SCHEMA = "shard int, segment int, n_tokens long, width int, zeros array<long>, planes array<binary>, ranks array<binary>, doc_ids array<long>, lengths array<long>"

# Texts of these characters are cut into the vocabulary's pre-tokens here (its published pattern, with the
# letters and digits among these characters spelled out); the library encodes each distinct pre-token once.
_PLAIN = re.compile("[\\t\\n\\r -~¡-©«¬®-±´¶-¸»¿-ſ–—‘’“”•…€™]*")
_PLAIN_END = 0x2200  # past the last of them
_LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")


class Encoder:
    """Encodes texts with one tokenizers vocabulary; ids equal ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # how the vocabulary spells the bytes of each plain character
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spell = {c: spelled.pre_tokenize_str(chr(c))[0][0] for c in range(_PLAIN_END) if _PLAIN.fullmatch(chr(c))}

    def _learn(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.translate(self.spell))]
        made = self.cache[word] = struct.pack(f"<{len(ids)}I", *ids)
        return made

    def _plain(self, words: list[str]) -> bytes:
        """The ids of pre-tokens; what isn't remembered yet is encoded once."""
        parts = list(map(self.cache.get, words))
        if None in parts:
            for i in [i for i, p in enumerate(parts) if p is None]:
                parts[i] = self.cache.get(words[i]) or self._learn(words[i])
        return b"".join(parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for text in texts:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                out.append(self._plain(_PRETOKEN.findall(text)))
            else:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary: loaded once, with what earlier tasks of the worker have learnt."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass
class WaveletMatrix:
    """Bit-planes with rank directories over ``n`` ids of ``width`` bits."""

    n: int
    width: int
    zeros: list[int]
    planes: list[np.ndarray]  # packed bits, little-endian within a byte
    ranks: list[np.ndarray]  # ones before every RANK_BLOCK bits

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        zeros, planes, ranks = [], [], []
        ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
        for level in range(width - 1, -1, -1):
            bit = ((ids >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            planes.append(packed)
            padded = np.zeros(-(-len(packed) // (RANK_BLOCK // 8)) * (RANK_BLOCK // 8), np.uint8)
            padded[: len(packed)] = packed
            ones = np.bitwise_count(padded.reshape(-1, RANK_BLOCK // 8)).sum(axis=1, dtype=np.int64)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4"))
            ids = np.concatenate([np.compress(~bit, ids), np.compress(bit, ids)])
            zeros.append(int(len(bit) - np.count_nonzero(bit)))
        return cls(len(ids), width, zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        block = i // RANK_BLOCK
        part = self.planes[level][block * (RANK_BLOCK // 8) : (i + 7) // 8]
        inside = np.unpackbits(part, bitorder="little")[: i - block * RANK_BLOCK]
        return int(self.ranks[level][block]) + int(inside.sum())

    def access(self, i: int) -> int:
        """The id at a position."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.width):
            bit = int(self.planes[level][i >> 3] >> (i & 7)) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` in [lo, hi) stand below the last plane."""
        for level in range(self.width):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if value >> (self.width - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """How often an id occurs among positions [lo, hi)."""
        if value >> self.width:
            return 0
        a, b = self._range(value, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane: a search over the directory, then in its block."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * RANK_BLOCK - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        part = np.unpackbits(self.planes[level][block * (RANK_BLOCK // 8) : (block + 1) * (RANK_BLOCK // 8)], bitorder="little")
        return block * RANK_BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def occurrences(self, value: int, lo: int = 0, hi: int | None = None) -> list[int]:
        """All positions of an id in [lo, hi), in order."""
        if value >> self.width:
            return []
        a, b = self._range(value, lo, self.n if hi is None else hi)
        found = []
        for i in range(a, b):
            for level in range(self.width - 1, -1, -1):
                bit = value >> (self.width - 1 - level) & 1
                i = self._select(level, bit, i - self.zeros[level] if bit else i)
            found.append(i)
        return found

    def decode(self) -> np.ndarray:
        """All ids in order, undoing the planes' partings from the last to the first."""
        kind = np.uint16 if self.width <= 16 else np.uint32
        ids = np.zeros(self.n, dtype=kind)
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)
            back = np.empty_like(ids)
            back[np.flatnonzero(~bit)] = ids[: self.zeros[level]]
            back[np.flatnonzero(bit)] = ids[self.zeros[level] :] | kind(1 << (self.width - 1 - level))
            ids = back
        return ids.astype(np.uint32)


def _segment(shard: int, segment: int, parts: list[bytes], doc_ids: list, lengths: list[int], width: int) -> pa.RecordBatch:
    m = WaveletMatrix.build(np.frombuffer(b"".join(parts), "<u4"), width)
    blobs = lambda arrays: [a.tobytes() for a in arrays]
    values = [shard, segment, m.n, width, m.zeros, blobs(m.planes), blobs(m.ranks), doc_ids, lengths]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def _write(path: str, vocabulary: int):
    width = max(1, (vocabulary - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        shard, segment, size = TaskContext.get().partitionId(), 0, 0
        parts, ids, lengths = [], [], []
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                for doc, made in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist()), strict=True):
                    made += end
                    if size and size + len(made) // 4 > SEGMENT_TOKENS:
                        yield _segment(shard, segment, parts, ids, lengths, width)
                        segment, size, parts, ids, lengths = segment + 1, 0, [], [], []
                    parts.append(made)
                    ids.append(doc)
                    lengths.append(len(made) // 4)
                    size += len(made) // 4
        if ids:
            yield _segment(shard, segment, parts, ids, lengths, width)

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, vocabulary: int) -> None:
    """Write ``docs`` (doc_id, text; null texts count as empty) below ``path``, in ascending doc_id order.

    Null doc_ids come first; rows of one doc_id follow each other in the order of a hash of their texts. There are
    as many shards as splits of the input (or shuffle partitions, if that is more), so a shard is about a split;
    its rows are segments of bounded size. An empty table writes files without segments.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    shards = min(MOST_SHARDS, max(texts.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    order = (F.asc_nulls_first("doc_id"), F.xxhash64("text"))  # rows of one doc_id may go to several shards
    dealt = texts.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(_write(tokenizer_file, vocabulary), _SCHEMA).write.option("compression", "zstd").parquet(path)


def matrix_of(row) -> WaveletMatrix:
    """The matrix of one segment row of a token file."""
    return WaveletMatrix(row["n_tokens"], row["width"], list(row["zeros"]), [np.frombuffer(p, np.uint8) for p in row["planes"]], [np.frombuffer(r, "<u4") for r in row["ranks"]])


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def _documents(digest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                ids = matrix_of(row).decode().astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                cut = [ids[i:j] for i, j in zip(starts, ends, strict=True)]
                last = pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()) if digest_only else pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32()))
                n = len(cut)
                yield pa.record_batch([pa.array([row["shard"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), last], names=["shard", "segment", "doc_id", "inside", "n_tokens", "ids" if not digest_only else "ids_crc32"])

    return run


def _segment_starts(segments: DataFrame) -> DataFrame:
    """(shard, segment, before): ids before each segment; shards are summed first, so one task sees a row a shard."""
    sizes = segments.select("shard", "segment", "n_tokens")
    by_shard = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    whole = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    by_shard = by_shard.select("shard", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(by_shard, "shard").select("shard", "segment", (F.col("inner") + F.col("shard_start")).alias("before"))


def read_documents(spark: SparkSession, path: str, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids or ids_crc32) of every document in the files, decoded from the planes."""
    segments = read_segments(spark, path)
    last = "ids_crc32 long" if digest_only else "ids array<int>"
    rows = segments.mapInArrow(_documents(digest_only), f"shard int, segment int, doc_id long, inside long, n_tokens long, {last}")
    placed = rows.join(_segment_starts(segments), ["shard", "segment"])
    return placed.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", last.split()[0])


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as token ids in wavelet matrices on shared files, read back from them."""
    import public_tokenizers

    path = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 50_257)
    return read_documents(spark, path, digest_only=True)
