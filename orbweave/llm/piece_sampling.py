"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A text's lattice has an edge for every vocabulary piece that stands in it, and byte pieces for characters
without one. Forward filtering sums the weights of all paths to each node; backward sampling then walks from
the end, choosing edges by their posterior, which draws a segmentation with its exact probability (to
2**-SHARE_BITS an edge). The random numbers are a hash of the seed, the row's key, the place in the text and
the step.

No piece has a space mark after another character, so every path passes all starts of space-marked words:
the lattice splits there exactly. Filtering runs once for each distinct word that a task remembers, sampling
for all occurrences side by side. A word's shares are integers of its own, made by additions, products and
quotients in a fixed order from weights that the driver sends, so neither the words around it nor batch sizes
nor what a task remembers change a segmentation. Remembered words are found by hash and compared code point
by code point.

The vocabulary is a BPE model whose scores are merge ranks; a piece's weight here is Zipf's law over that
rank, ``(rank + 2) ** -sharpness``. Decoding is lossless: a leading space mark is added and taken off again,
and a literal space mark, like any character without a piece, is spelled in byte pieces.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from orbweave.llm import words as w
from orbweave.llm.memory import trimmed
from orbweave.llm.shared import fresh_name, table, whole_text

MARK, SPACE = "▁", 0x20
SHARPNESS, SEED = 1.0, 17
SLICE_CHARS = 1 << 18  # of texts that are sampled at once
FILTER_CHARS = 1 << 15  # of new words that are filtered at once
MOST_EDGES = 4 << 20  # of filtered words that a task remembers
SHARE_BITS = 36
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GOLD = np.uint64(0xD1B54A32D192ED03)


@dataclass
class Vocabulary:
    """Pieces over code points, with spaces in place of space marks."""

    size: int
    raw: list[bytes]  # what each id decodes to
    byte_ids: np.ndarray  # id of each byte piece
    ids: np.ndarray  # of the ordinary pieces
    pieces: list[str]
    weights: np.ndarray  # of the ordinary pieces

    @classmethod
    def load(cls, path: str, sharpness: float = SHARPNESS) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        raw, ids, pieces = [], [], []
        byte_ids = np.full(256, -1, dtype=np.int64)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                byte_ids[value] = i
                raw.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                text = piece.replace(MARK, " ")
                raw.append(text.encode())
                if " " not in text.lstrip(" "):  # a piece across words would be no edge of the split lattice
                    ids.append(i)
                    pieces.append(text)
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces, so decoding can't be lossless")
        score = np.array([sp.get_score(i) for i in ids])
        rank = np.empty(len(ids))
        rank[np.argsort(-score, kind="stable")] = np.arange(len(ids))
        return cls(sp.get_piece_size(), raw, byte_ids, np.array(ids, dtype=np.int64), pieces, (rank + 2) ** -sharpness)


def _hash_codes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` code points."""
    n = len(codes) - size + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(size):
        h = (h + codes[k : k + n].astype(np.uint64) + np.uint64(1)) * _BASE
        h ^= h >> np.uint64(29)
    return h


class Lattice:
    """The vocabulary's pieces by length and hash; finds all edges of many words at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(p) for p in vocabulary.pieces])
        self.longest = int(sizes.max())
        self.single = np.zeros(0x110000, dtype=bool)
        for size in sorted(set(sizes.tolist())):
            at = np.flatnonzero(sizes == size)
            codes = np.frombuffer("".join(vocabulary.pieces[i] for i in at).encode("utf-32-le"), "<u4")
            hashes = _hash_codes(codes, size)[::size]
            order = np.argsort(hashes)
            sieve = np.zeros(1 << 16, dtype=bool)
            sieve[(hashes >> np.uint64(48)).astype(np.int64)] = True
            self.by_size[size] = (hashes[order], at[order], sieve, codes.reshape(-1, size)[order].T.copy())
            if size == 1:
                self.single[codes] = True
        self.byte_weight = float(vocabulary.weights.min())

    def edges(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all edges; ``ends``: for each place, where its word stops. Negative pieces are bytes."""
        found = []
        h = np.zeros(len(codes) + 1, dtype=np.uint64)
        plus = codes.astype(np.uint64) + np.uint64(1)
        for size in range(1, min(self.longest, len(codes)) + 1):
            h = (h[:-1] + plus[size - 1 :]) * _BASE  # as _hash_codes, one code point further
            h ^= h >> np.uint64(29)
            if size not in self.by_size:
                continue
            hashes, at, sieve, spelled = self.by_size[size]
            start = np.flatnonzero(sieve[(h >> np.uint64(48)).astype(np.int64)])
            start = start[start + size <= ends[start]]
            k = np.searchsorted(hashes, h[start])
            k[k == len(hashes)] = 0
            same = hashes[k] == h[start]
            for i in range(size):
                same &= spelled[i][k] == codes[start + i]
            start, piece = start[same], at[k[same]]
            found.append((start, np.full(len(start), size), piece))
        bare = np.flatnonzero(~self.single[codes])
        found.append((bare, np.ones(len(bare), dtype=np.int64), -1 - codes[bare].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges ``begin[i]:begin[i] + size[i]``, one after the other."""
    first = np.cumsum(size) - size
    return np.repeat(begin - first, size) + np.arange(int(size.sum()))


class Sampler:
    """Encodes slices of texts; see the module's docstring."""

    def __init__(self, vocabulary: Vocabulary, seed: int = SEED):
        self.v, self.lattice = vocabulary, Lattice(vocabulary)
        self.seed = np.uint64(seed)
        self.forget()

    def forget(self, room: int = 0):
        """Drop all filtered words; there is room for MOST_EDGES edges, or for more where one slice needs it."""
        self.known = np.zeros(0, np.uint64)  # hashes of filtered words, in order
        self.low = self.size = np.zeros(0, np.int64)  # their first nodes and numbers of code points
        self.nodes = self.edges = 0
        room = max(room, MOST_EDGES)
        if not hasattr(self, "bound") or len(self.bound) != room:
            self.bound = np.empty(room, np.int64)  # of each edge: its last node and cumulative share, in order
            self.back, self.piece = np.empty(room, np.int32), np.empty(room, np.int32)  # its first node and its piece
            self.codes = np.empty(room, np.uint32)  # of each node: the code point after it (no more than edges)

    def learn(self, hashes: np.ndarray, codes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of the words ``codes[begin:begin + size]`` with distinct hashes in order; new ones are filtered."""
        while True:
            at = np.searchsorted(self.known, hashes)
            fresh = np.ones(len(hashes), dtype=bool)
            inside = at < len(self.known)
            fresh[inside] = self.known[at[inside]] != hashes[inside]
            new = np.flatnonzero(fresh)
            if not len(new):
                return at
            made, reach = [], np.cumsum(size[new])
            lo = 0
            while lo < len(new):
                hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + FILTER_CHARS, "right")))
                part = new[lo:hi]
                made.append((codes[_spread(begin[part], size[part])], *self.filter(codes[_spread(begin[part], size[part])], size[part])))
                lo = hi
            edges = sum(len(m[1]) for m in made)
            if self.edges + edges <= len(self.bound):
                break
            self.forget(0 if len(self.known) else edges)  # at first the older words make room
        low = self.nodes + reach - size[new]
        for word_codes, bound, back, piece in made:
            e, n = slice(self.edges, self.edges + len(bound)), slice(self.nodes, self.nodes + len(word_codes))
            self.bound[e], self.back[e], self.piece[e], self.codes[n] = bound + (self.nodes << SHARE_BITS), back + self.nodes, piece, word_codes
            self.edges, self.nodes = e.stop, n.stop
        self.low, self.size = np.insert(self.low, at[new], low), np.insert(self.size, at[new], size[new])
        self.known = np.insert(self.known, at[new], hashes[new])
        return np.searchsorted(self.known, hashes)

    def filter(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bound, back, piece) of the edges of words that stand one after the other in ``codes``.

        Node ``p`` is the place after ``p`` code points. An edge's bound is its last node and, in the low bits,
        the sum of shares of the node's edges up to it: integers, so equal for a word wherever it stands.
        """
        n, ends = len(codes), np.cumsum(sizes)
        begins = np.zeros(n + 1, dtype=bool)
        begins[ends - sizes] = True
        start, length, piece = self.lattice.edges(codes, np.repeat(ends, sizes))
        stop = start + length
        weight = np.where(piece >= 0, self.v.weights[np.maximum(piece, 0)], self.lattice.byte_weight)
        depth = stop - np.repeat(ends - sizes, sizes)[start]  # of the edge's last node in its word
        order = np.argsort((depth * (n + 1) + stop) * (self.lattice.longest + 1) + length)
        start, stop, piece, weight, depth = start[order], stop[order], piece[order], weight[order], depth[order]
        node = np.flatnonzero(np.concatenate([[True], stop[1:] != stop[:-1]]))  # all edges into one node stand together
        level = np.searchsorted(depth[node], np.arange(1, int(depth[-1]) + 2))
        bounds = np.append(node, len(stop))
        forward, power = np.ones(n + 1), np.zeros(n + 1, dtype=np.int64)  # a node's weight: forward * 2**power
        share = np.empty(len(stop), dtype=np.int64)
        for a, b in zip(level, level[1:], strict=False):
            lo, hi = bounds[a], bounds[b]
            at, cut = start[lo:hi], bounds[a:b] - lo
            fan = np.diff(np.append(cut, hi - lo))
            opens = begins[at]
            came, scale = np.where(opens, 1.0, forward[at]) * weight[lo:hi], np.where(opens, 0, power[at])
            most = np.maximum.reduceat(scale, cut)
            came = np.ldexp(came, scale - np.repeat(most, fan))
            total = np.add.reduceat(came, cut)
            share[lo:hi] = came / np.repeat(total, fan) * 2.0**SHARE_BITS
            to = stop[lo + cut]
            forward[to], raised = np.frexp(total)
            power[to] = most + raised
        order = np.argsort(stop, kind="stable")
        start, stop, piece, share = start[order], stop[order], piece[order], share[order]
        run = np.cumsum(share)
        head = np.flatnonzero(np.concatenate([[True], stop[1:] != stop[:-1]]))
        fan = np.diff(np.append(head, len(stop)))
        upto = run - np.repeat(run[head] - share[head], fan)
        upto[head + fan - 1] = 1 << SHARE_BITS
        return (stop << SHARE_BITS) + upto, start, piece

    @staticmethod
    def walk(key: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray, back: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, word) of words' sampled segmentations, words and pieces in order."""
        live, node, steps = np.arange(len(key)), high, []
        count = np.zeros(len(key), dtype=np.int64)
        while len(live):
            u = w.mix(key[live] + np.uint64((len(steps) + 1) * int(_BASE) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - SHARE_BITS)
            edge = np.searchsorted(bound, (node << SHARE_BITS) + u.astype(np.int64), "right")
            count[live] += 1
            steps.append((live, piece[edge]))
            node = back[edge].astype(np.int64)
            more = node > low[live]
            live, node = live[more], node[more]
        last = np.cumsum(count) - 1  # the walk goes from the end
        out = np.empty(int(count.sum()), dtype=np.int64)
        for k, (word, got) in enumerate(steps):
            out[last[word] - k] = got
        return out, np.repeat(np.arange(len(key)), count)

    def sample(self, keys: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): sampled ids of the texts, and where each text's begin. ``keys``: unsigned row keys."""
        codes = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le"), "<u4")
        text_first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        # words: a space after another character begins one, and so does each text
        opens = np.zeros(len(codes), dtype=bool)
        opens[1:] = (codes[1:] == SPACE) & (codes[:-1] != SPACE)
        opens[text_first[:-1]] = True
        begin = np.flatnonzero(opens)
        size = np.diff(np.append(begin, len(codes)))
        owner = np.searchsorted(text_first, begin, "right") - 1
        key = w.mix(keys[owner] * _GOLD + self.seed + (begin - text_first[owner]).astype(np.uint64))
        reach, lo, parts = np.cumsum(size), 0, []
        while lo < len(begin):
            hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + SLICE_CHARS, "right")))
            piece, word = self._segment(codes, begin[lo:hi], size[lo:hi], key[lo:hi])
            parts.append(self._spell(piece, owner[lo + word]))
            lo = hi
        ids, owners = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        return ids, np.searchsorted(owners, np.arange(len(texts) + 1))

    def _segment(self, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, word) of the words ``codes[begin:begin + size]``."""
        hashes = w.hash_ranges(codes.view(np.uint8), 4 * begin, 4 * size)
        distinct, chosen, which = np.unique(hashes, return_index=True, return_inverse=True)
        number = self.learn(distinct, codes, begin[chosen], size[chosen])[which]
        low = self.low[number]
        same = self.size[number] == size
        at = np.flatnonzero(same)
        differs = codes[_spread(begin[at], size[at])] != self.codes[_spread(low[at], size[at])]
        if differs.any():
            same[at[np.repeat(np.arange(len(at)), size[at])[differs]]] = False
        if same.all():
            return self.walk(key, low, low + size, self.bound[: self.edges], self.back, self.piece)
        # words whose hash another word has are filtered for themselves
        ours = np.flatnonzero(same)
        piece, word = self.walk(key[ours], low[ours], low[ours] + size[ours], self.bound[: self.edges], self.back, self.piece)
        found = [(piece, ours[word])]
        for i in np.flatnonzero(~same).tolist():
            lone, _ = self.walk(key[i : i + 1], np.zeros(1, np.int64), size[i : i + 1], *self.filter(codes[begin[i] : begin[i] + size[i]], size[i : i + 1]))
            found.append((lone, np.full(len(lone), i)))
        piece, word = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(word, kind="stable")
        return piece[order], word[order]

    def _spell(self, piece: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, owner) with the byte pieces of characters that have none of their own."""
        ids = np.where(piece >= 0, self.v.ids[np.maximum(piece, 0)], -1)
        bare = np.flatnonzero(piece < 0)
        if len(bare):
            spelled = [np.frombuffer(chr(-1 - c).encode(), np.uint8) for c in piece[bare].tolist()]
            size = np.ones(len(piece), dtype=np.int64)
            size[bare] = [len(s) for s in spelled]
            ids, owner = np.repeat(ids, size), np.repeat(owner, size)
            ids[_spread((np.cumsum(size) - size)[bare], size[bare])] = self.v.byte_ids[np.concatenate(spelled)]
        return ids.astype("<u4"), owner


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The text of sampled ids: their bytes without the leading space mark."""
    return b"".join(map(vocabulary.raw.__getitem__, ids.tolist()))[1:].decode()


def text_slices(lengths: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters; a longer text is a range of its own."""
    i = 0
    while i < len(lengths):
        j, size = i, 0
        while j < len(lengths) and (j == i or size + lengths[j] <= most):
            size += lengths[j]
            j += 1
        yield i, j
        i = j


def _sampled(sampler: Sampler, keys: pa.Array, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str]]]:
    """(first row, past last row, ids, where each row's begin, texts) of a batch, slice by slice."""
    keys = keys.to_numpy(zero_copy_only=False).view(np.uint64)
    for i, j in text_slices(pc.utf8_length(texts).to_pylist()):
        part = texts.slice(i, j - i).to_pylist()
        yield i, j, *sampler.sample(keys[i:j], part), part


def _encode(vocabulary, seed: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(vocabulary.value, seed)
        for batch in batches:
            last = batch.num_columns - 1
            for i, j, ids, first, _ in _sampled(sampler, batch.column(last), batch.column(last - 1)):
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(last - 1)), lists], names=[*batch.schema.names[: last - 1], "piece_ids"])

    return run


def encode(docs: DataFrame, path: str, seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """``docs`` with a column piece_ids: a sampled segmentation of each row's text.

    A row's key is its doc_id (a null counts as -1). Rows that repeat doc_id and text get the same ids. A
    null or empty text is a lone space mark. A column called piece_ids is replaced; the others stay. An empty
    table gives an empty one. Ids do not depend on partitions, batches or cluster, but on seed and sharpness.
    """
    kept = [c for c in docs.columns if c.lower() != "piece_ids"]
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    rows = plain.select("*", whole_text().alias(fresh_name(kept, "text")), key.alias(fresh_name(kept, "key")))
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path, sharpness))  # the size of one vocabulary file
    schema = StructType([*plain.schema.fields, StructField("piece_ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(_encode(vocabulary, seed), schema)


def _decode(vocabulary):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            for lo in range(0, batch.num_rows, 256):
                part = ids.slice(lo, 256)
                arrays = [np.asarray(part[k].values, dtype="<u4") for k in range(len(part))]
                made = [pa.array([decode(v, a) for a in arrays]), pa.array([len(a) for a in arrays], pa.int64()), pa.array([zlib.crc32(a.tobytes()) for a in arrays], pa.int64())]
                kept = [batch.column(k).slice(lo, 256) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[:-1], "decoded", "n_pieces", "ids_crc32"])

    return run


def decode_rows(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with piece_ids) as its other columns and decoded, n_pieces, ids_crc32 (unsigned, little-endian ids)."""
    kept = [c for c in encoded.columns if c.lower() not in ("piece_ids", "decoded", "n_pieces", "ids_crc32")]
    rows = encoded.select(*[F.col(f"`{c}`") for c in kept], "piece_ids")
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    added = [StructField("decoded", StringType()), StructField("n_pieces", LongType()), StructField("ids_crc32", LongType())]
    schema = StructType([*rows.schema.fields[:-1], *added])
    return rows.mapInArrow(_decode(vocabulary), schema)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _round_trip(vocabulary, seed: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        sampler = Sampler(v, seed)
        for batch in batches:
            for i, j, ids, first, part in _sampled(sampler, batch.column(1), batch.column(2)):
                arrays = [ids[a:b] for a, b in zip(first, first[1:], strict=False)]
                back = [decode(v, a) for a in arrays]
                columns = [
                    pa.array([len(a) for a in arrays], pa.int64()),
                    pa.array([zlib.crc32(a.tobytes()) for a in arrays], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    pa.array([a == b for a, b in zip(back, part, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])

    return run


def round_trip(docs: DataFrame, path: str, seed: int = SEED, sharpness: float = SHARPNESS) -> DataFrame:
    """Every text encoded as ``encode`` does, decoded again from its ids, and compared with itself, in one pass.

    One row for each row of ``docs``: doc_id, n_pieces, ids_crc32 (unsigned, of little-endian ids),
    decoded_sha256 and lossless. Nulls, repeated rows and empty tables are as in ``encode``.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(-1)).alias("key"), whole_text().alias("text"))
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path, sharpness))  # the size of one vocabulary file
    return rows.mapInArrow(_round_trip(vocabulary, seed), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by sampling, decoded again and compared with itself."""
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path())
