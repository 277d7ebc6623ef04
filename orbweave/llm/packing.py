"""Packing of token ids into sequences of one length, by order-preserving dynamic programming.

Documents follow each other by doc_id. Their ids are one stream, and windows of at most ``WINDOW`` ids are cut from it in
order. A window may end after a document, after a sentence at a penalty, or inside a stretch of ids without a
sentence's end at a higher one. With places p in order and f(p) the least cost of the stream up to p,

    f(p) = penalty(p) + min over places q in [p - WINDOW, p) of f(q) + WINDOW - (p - q),

where a window whose length is one of ``BARE`` (powers of two) needs no padding. As padding is linear in p, the minimum
is over f(q) + q in a sliding window, which a monotone queue keeps; the bare lengths are a few look-ups more.

The stream is dealt to tasks by ranges of doc_id. A task plans ``HORIZON`` ids at a time and carries what its plan leaves open
over to the next plan, so it pads nothing in between. What is left at a task's end, less than a window, goes to a
second round with the ends of ``TAILS`` neighbours, whose last window alone is padded at the end of the stream.

Every id lies in one piece; pieces of a document are in order. Null texts count as empty, and an empty text is its end id.
Rows with equal doc_id follow each other in the order of a hash of their texts; null doc_ids come first. Other columns
are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.shared import stage, table, whole_text

WINDOW = 4096
BARE = (256, 512, 1024, 2048)  # lengths of windows that need no padding, beside WINDOW itself
END_ID = 2
SENTENCE_CUT, STRETCH_CUT = 16, 32  # what a cut inside a document costs, in ids of padding
STRETCH, STRIDE = 256, 32  # a stretch of more ids without a sentence's end can be cut at every STRIDE-th
HORIZON = 1 << 18  # ids that are planned at a time
TAILS = 64  # tasks whose ends are packed together
CACHE_WORDS = 1_200_000  # pre-tokens that a Python worker remembers from task to task
_PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>, ids_crc32 long, part int, at int"

# Texts of these characters are cut into pre-tokens here as the vocabulary cuts them (normalisation leaves them alone but
# for case and white space); the library encodes each distinct pre-token once.
_PLAIN = re.compile("[\\t\\n\\r -~¡-©«¬®-±´¶-¸»¿-įı-ſ–—‘’“”•…€™]*")
_PLAIN_END = 0x2200  # past the last of them
_LETTER = "a-zß-öø-ſ"
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+")


class Encoder:
    """Encodes texts with a BPE of words; ids equal ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.cache: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spell = {c: spelled.pre_tokenize_str(chr(c))[0][0] for c in range(_PLAIN_END) if _PLAIN.fullmatch(chr(c))}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_sentence = np.zeros(max(vocabulary.values()) + 3, dtype=bool)
        for word, i in vocabulary.items():
            self.ends_sentence[i] = word.endswith((".</w>", "!</w>", "?</w>", '."</w>', '!"</w>', '?"</w>', ".)</w>"))

    def _learn(self, word: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(word.translate(self.spell))]
        made = self.cache[word] = struct.pack(f"<{len(ids)}I", *ids)
        return made

    def encode(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit integers."""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        words = _PRETOKEN.findall(text.lower())
        parts = list(map(self.cache.get, words))
        if None in parts:
            for i in [i for i, p in enumerate(parts) if p is None]:
                parts[i] = self.cache.get(words[i]) or self._learn(words[i])
        return b"".join(parts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary: loaded once, with what earlier tasks of the worker have learnt."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- the plan -----------------------------------------------------------------------------------------------


def places(ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, in order from 0, and what ending there costs. ``ends``: where documents end."""
    at = np.unique(np.concatenate([[0], np.flatnonzero(ends_sentence[np.minimum(ids, len(ends_sentence) - 1)]) + 1, ends]))
    long = np.flatnonzero(np.diff(at) > STRETCH)
    inside = [np.arange(at[k] + STRIDE, at[k + 1], STRIDE) for k in long]
    every = np.sort(np.concatenate([at, *inside]))
    cost = np.full(len(every), STRETCH_CUT)
    cost[np.searchsorted(every, at)] = SENTENCE_CUT
    cost[np.searchsorted(every, ends)] = 0
    cost[0] = 0
    return every, cost


def plan(at: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """f of every place, and the place before it on the cheapest way there."""
    bare: dict[int, list[int]] = {}
    for length in BARE:
        k = np.searchsorted(at, at - length)
        for j in np.flatnonzero((at >= length) & (at[k] == at - length)).tolist():
            bare.setdefault(j, []).append(int(k[j]))
    where, price = at.tolist(), cost.tolist()
    least, back = [0] * len(where), [0] * len(where)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (f(q) + q, q, its index), rising in both
    for j in range(1, len(where)):
        p = where[j]
        while queue[0][1] < p - WINDOW:
            queue.popleft()
        value, _, i = queue[0]
        best = value + WINDOW - p
        if j in bare:
            for k in bare[j]:
                if least[k] < best:
                    best, i = least[k], k
        best += price[j]
        least[j], back[j] = best, i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    return np.array(least), np.array(back)


def windows(at: np.ndarray, cost: np.ndarray, to_end: bool) -> np.ndarray:
    """The cuts of the cheapest plan, from 0; to the end, or up to where what follows can still change it."""
    least, back = plan(at, cost)
    j = len(at) - 1
    if not to_end:
        last = np.flatnonzero(at > at[-1] - WINDOW)
        j = int(last[len(last) - 1 - np.argmin(least[last][::-1])])  # the last of the cheapest
    cuts = [j]
    while j:
        j = int(back[j])
        cuts.append(j)
    return at[cuts[::-1]]


class Packer:
    """Collects stretches of documents in order and gives out their pieces, plan by plan."""

    def __init__(self, ends_sentence: np.ndarray, first_sequence: int, with_ids: bool):
        self.ends_sentence, self.sequence, self.with_ids = ends_sentence, first_sequence, with_ids
        self.docs: list[tuple[object, int, int]] = []  # doc_id, ids before the stretch, ids of the document
        self.parts: list[bytes] = []
        self.size = 0

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        self.docs.append((doc_id, start, doc_tokens))
        self.parts.append(ids)
        self.size += len(ids) // 4

    def _take(self, cuts: np.ndarray) -> list[dict]:
        """Pieces of the windows between the cuts; what lies behind the last cut stays."""
        sizes = np.array([len(p) // 4 for p in self.parts])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        edges = np.unique(np.concatenate([cuts, ends[ends < cuts[-1]]]))
        lows, highs = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, lows, "right")
        window = np.searchsorted(cuts, lows, "right") - 1
        raw, out = memoryview(b"".join(self.parts)), []
        for lo, hi, d, w in zip(lows.tolist(), highs.tolist(), doc.tolist(), window.tolist(), strict=True):
            doc_id, start, doc_tokens = self.docs[d]
            ids = raw[4 * lo : 4 * hi]
            out.append({
                "doc_id": doc_id, "start": start + lo - int(begins[d]), "length": hi - lo, "doc_tokens": doc_tokens, "sequence_id": self.sequence + w, "offset": lo - int(cuts[w]),
                "ids": np.frombuffer(ids, "<u4").astype(np.int32) if self.with_ids else None, "ids_crc32": zlib.crc32(ids), "part": None, "at": None,
            })
        self.sequence += len(cuts) - 1
        done = int(np.searchsorted(ends, cuts[-1], "right"))  # documents that are through
        kept, self.size = int(cuts[-1]), self.size - int(cuts[-1])
        docs, parts = self.docs[done:], self.parts[done:]
        if docs and begins[done] < kept:
            gone = kept - int(begins[done])
            docs[0], parts[0] = (docs[0][0], docs[0][1] + gone, docs[0][2]), parts[0][4 * gone :]
        self.docs, self.parts = docs, parts
        return out

    def pieces(self, to_end: bool) -> list[dict]:
        ids = np.frombuffer(b"".join(self.parts), "<u4")
        ends = np.cumsum([len(p) // 4 for p in self.parts])
        return self._take(windows(*places(ids, ends, self.ends_sentence), to_end))

    def tail(self, part: int) -> list[dict]:
        """What is left, as rows for the second round."""
        rest = [dict(doc_id=d, start=s, length=len(ids) // 4, doc_tokens=n, ids=np.frombuffer(ids, "<u4").astype(np.int32), part=part, at=k) for k, ((d, s, n), ids) in enumerate(zip(self.docs, self.parts, strict=True))]
        return [r | dict.fromkeys(("sequence_id", "offset", "ids_crc32")) for r in rest]


_FIELDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("at", pa.int32())])


def _rows(made: list[dict]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(made), 4096):
        part = made[i : i + 4096]
        yield pa.record_batch([pa.array([r[f.name] for r in part], f.type) for f in _FIELDS], schema=_FIELDS)


def _pack(path: str, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, part = encoder(path), TaskContext.get().partitionId()
    packer, end = Packer(own.ends_sentence, part << 40, with_ids), struct.pack("<I", END_ID)
    for batch in batches:
        for begin in range(0, batch.num_rows, 64):
            few = batch.slice(begin, 64)
            for doc_id, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                ids = own.encode(text) + end
                packer.add(doc_id, 0, ids, len(ids) // 4)
                if packer.size >= HORIZON:
                    yield from _rows(packer.pieces(to_end=False))
    if packer.size:
        yield from _rows(packer.pieces(to_end=False))
        yield from _rows(packer.tail(part))


def _pack_tails(path: str, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, group, packer = encoder(path), None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] // TAILS != group:
                if packer is not None:
                    yield from _rows(packer.pieces(to_end=True))
                group = row["part"] // TAILS
                packer = Packer(own.ends_sentence, (1 << 62) + (group << 24), with_ids)
            packer.add(row["doc_id"], row["start"], np.array(row["ids"], "<u4").tobytes(), row["doc_tokens"])
    if packer is not None:
        yield from _rows(packer.pieces(to_end=True))


def pack(docs: DataFrame, tokenizer_file: str, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids or ids_crc32): the pieces of all documents.

    ``start``: ids of the document before the piece; ``offset``: ids of the sequence before it. Sequence ids rise along the
    stream within a task's range of it; sequences of ends have ids of their own.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.monotonically_increasing_id().alias("place"))
    parts = max(texts.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = (F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.asc("place"))  # equal rows may go to several tasks
    dealt = texts.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = stage(dealt.mapInArrow(partial(_pack, tokenizer_file, not digest_only), _PIECE), "packed")
    groups = made.where("part is not null").withColumn("group", F.expr(f"part div {TAILS}"))
    tails = groups.repartition("group").sortWithinPartitions("group", "part", "at").drop("group")
    both = made.where("part is null").unionAll(tails.mapInArrow(partial(_pack_tails, tokenizer_file, not digest_only), _PIECE))
    return both.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32" if digest_only else "ids")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 4096, as pieces."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest_only=True)
