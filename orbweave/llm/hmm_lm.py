"""Hidden Markov language model over whole corpora.

A hidden chain of states emits word classes, a class emits its words: p(word | state) = p(class | state) *
p(word | class). The most frequent words are classes of their own; the others share a class by the hash of
their last bytes. Word counts are over the whole corpus: every task sends its distinct words with counts to
owner tasks, which merge them as they come, and a second pass answers what each asks for, so a word costs one entry a chunk however often it
stands there, and no vocabulary passes the driver or a broadcast.

Baum-Welch runs over all training documents: tasks add up expected starts, transitions and emissions of their
documents (tables of fixed size), Spark sums them, and the driver re-estimates. Likelihoods are exact, by the
scaled forward recursion. Long documents are cut into blocks whose transfer matrices are multiplied, which
gives each block its exact incoming distribution; so all blocks of a batch advance side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import words as w
from orbweave.llm.shared import stage, table, whole_text

STATES, ITERATIONS, SEED = 8, 4, 5
TOP = 159  # words that are classes of their own
TAILS = 96  # classes of the other words
END = TOP + TAILS  # the class of the end token
CLASSES = END + 1
CHUNK_BYTES = 2 << 20
TAIL_BYTES = 3
BLOCK = 512  # tokens that advance one after the other
RESCALE = 8  # steps that products go without a new scale
BATCH_TOKENS = 1 << 18
MERGE_WORDS = 1 << 21  # words that wait to be merged in a bucket's task
_CHUNK = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<long>, words binary, counts binary, tails binary, tokens binary"


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


# --- chunks of documents ------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in chunks: distinct word hashes in order, their training counts and tail classes, and the tokens."""
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, held = batch.column(0), batch.column(1)
        for i, j, data, offsets in w.slices(batch.column(2), CHUNK_BYTES):
            ws = w.split_words(data, offsets, w.BLANK_SEPARATED)
            known, at, tokens = np.unique(ws.hashes, return_index=True, return_inverse=True)
            size = np.minimum(ws.ends[at] - ws.starts[at], TAIL_BYTES)
            tail = w.mix(w.range_hashes(ws, ws.ends[at] - TAIL_BYTES, TAIL_BYTES)) if not len(at) or size.min() == TAIL_BYTES else _tail_hashes(ws, at, size)
            lengths = np.diff(ws.first)
            trains = ~np.asarray(held.slice(i, j - i).to_pylist(), dtype=bool)
            counts = np.bincount(tokens[np.repeat(trains, lengths)], minlength=len(known))
            kind = "<u2" if len(known) <= 1 << 16 else "<u4"
            values = [(part << 33) + seen, ids.slice(i, j - i).to_pylist(), (~trains).tolist(), lengths.tolist(), known.astype("<u8").tobytes(), _pack(counts.astype("<u4")), (tail % np.uint64(TAILS)).astype("u1").tobytes(), _pack(tokens.astype(kind))]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _CHUNK.split(", ")])
            seen += 1


def _tail_hashes(ws: w.Words, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for n in range(1, TAIL_BYTES + 1):
        k = np.flatnonzero(size == n)
        out[k] = w.mix(w.range_hashes(ws, ws.ends[at[k]] - n, n))
    return out


def _tokens(blob: bytes, distinct: int) -> np.ndarray:
    return _unpack(blob, "<u2" if distinct <= 1 << 16 else "<u4")


# --- corpus counts ------------------------------------------------------------------------------------------


def _ask(buckets: int):
    """A chunk's distinct words by bucket; buckets are ranges of the hash, so replies can be joined in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, known, counts, tails = (batch.column(c)[k].as_py() for c in range(4))
                known, tails = np.frombuffer(known, "<u8"), np.frombuffer(tails, "u1")
                counts = _unpack(counts, "<u4")
                cut = np.concatenate([[0], np.searchsorted(known, edges), [len(known)]])
                b = np.flatnonzero(np.diff(cut))
                blobs = lambda a: pa.array([a[cut[x] : cut[x + 1]].tobytes() for x in b], pa.binary())  # noqa: E731, B023
                yield pa.record_batch([pa.array(b, pa.int32()), pa.array([chunk] * len(b), pa.int64()), blobs(known), blobs(counts), blobs(tails)], names=["bucket", "chunk", "words", "counts", "tails"])

    return run


_OWNED = "kind int, bucket int, words binary, totals binary, number long, a long, b long"
_OWNED_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, their counts, their tail classes) of several tables."""
    words, counts, tails = (np.concatenate(x) for x in zip(*parts, strict=True))
    known, first, which = np.unique(words, return_index=True, return_inverse=True)
    return known, np.bincount(which, weights=counts, minlength=len(known)).astype(np.int64), tails[first]


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in bucket order, merged as they come, so that a task holds distinct words and not a row for each chunk.

    The bucket's words with their counts (kind 0), its tail classes (1) and its most frequent words (2).
    """
    held, parts, waiting, least = None, [], 0, 0

    def rows(kind, words, totals, number, a, b):
        n = len(kind)
        return pa.record_batch([pa.array(v, k) for v, k in zip((kind, [held] * n, words, totals, number, a, b), _OWNED_KINDS, strict=True)], names=[c.split()[0] for c in _OWNED.split(", ")])

    def close():
        known, total, tail = _merged(parts)
        tail = tail.astype(np.int64)
        yield rows([0], [known.astype("<u8").tobytes()], [_pack(total.astype("<u8"))], [None], [None], [None])
        live = total > 0
        mass, kinds = np.bincount(tail, weights=total, minlength=TAILS).astype(np.int64), np.bincount(tail[live], minlength=TAILS)
        at = np.flatnonzero(kinds)
        yield rows([1] * len(at), [None] * len(at), [None] * len(at), at, mass[at], kinds[at])
        best = np.lexsort((known, -total))[: TOP + 1]
        best = best[total[best] > 0]
        yield rows([2] * len(best), [None] * len(best), [None] * len(best), known[best].view(np.int64), total[best], tail[best])

    for batch in batches:
        for bucket, words, counts, tails in zip(*(batch.column(n).to_pylist() for n in ("bucket", "words", "counts", "tails")), strict=True):
            if bucket != held:
                if parts:
                    yield from close()
                held, parts, waiting, least = bucket, [], 0, 0
            parts.append((np.frombuffer(words, "<u8"), np.frombuffer(counts, "<u4").astype(np.int64), np.frombuffer(tails, "u1")))
            waiting += len(parts[-1][0])
            if waiting > max(MERGE_WORDS, least):
                parts = [_merged(parts)]
                waiting, least = 0, len(parts[0][0])
    if parts:
        yield from close()


def _reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in bucket order, the bucket's words (kind 0) before the chunks' questions (1): the counts that each asks for."""
    known, total = np.zeros(0, "<u8"), np.zeros(0, "<u8")
    for batch in batches:
        chunks, buckets, answers = [], [], []
        for bucket, kind, chunk, words, totals in zip(*(batch.column(n).to_pylist() for n in ("bucket", "kind", "chunk", "words", "totals")), strict=True):
            words = np.frombuffer(words, "<u8")
            if kind == 0:
                known, total = words, _unpack(totals, "<u8")
            else:
                chunks.append(chunk)
                buckets.append(bucket)
                answers.append(_pack(total[np.searchsorted(known, words)]))
        yield pa.record_batch([pa.array(chunks, pa.int64()), pa.array(buckets, pa.int32()), pa.array(answers, pa.binary())], names=["chunk", "bucket", "totals"])


@dataclass(frozen=True)
class Counts:
    """What the whole corpus says about classes: fixed size."""

    tokens: int  # N, with one end for each training document
    types: int  # V
    ends: int
    above: int  # words with a larger count are classes of their own
    top_words: np.ndarray  # their hashes, in order
    top_class: np.ndarray
    top_counts: np.ndarray  # by class
    tail_tokens: np.ndarray
    tail_types: np.ndarray

    def classes(self, known: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """The class of each distinct word."""
        out = TOP + tails.astype(np.int64)
        if len(self.top_words):
            at = np.searchsorted(self.top_words, known)
            at[at == len(self.top_words)] = 0
            same = self.top_words[at] == known
            out[same] = self.top_class[at[same]]
        return out

    def class_totals(self) -> np.ndarray:
        out = np.zeros(CLASSES)
        out[: len(self.top_counts)] = self.top_counts
        out[TOP:END] = self.tail_tokens
        out[END] = self.ends
        return out


def corpus_counts(owned: DataFrame, ends: int) -> Counts:
    tails = owned.where("kind = 1").groupBy("number").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()  # TAILS rows
    top = owned.where("kind = 2").orderBy(F.desc("a"), "number").limit(TOP + 1).select("number", "a", "b").collect()
    # a strict cut, so that a count alone tells whether a word is one of them
    above = top[TOP]["a"] if len(top) > TOP else 0
    top = [r for r in top[:TOP] if r["a"] > above]
    mass, kinds = np.zeros(TAILS, dtype=np.int64), np.zeros(TAILS, dtype=np.int64)
    for r in tails:
        mass[r["number"]], kinds[r["number"]] = r["a"], r["b"]
    tokens, types = int(mass.sum()) + ends, int(kinds.sum()) + (ends > 0)
    for r in top:
        mass[r["b"]] -= r["a"]
        kinds[r["b"]] -= 1
    hashes = np.array([r["number"] for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Counts(tokens, types, ends, int(above), hashes[order], order.astype(np.int64), np.array([r["a"] for r in top], dtype=np.float64), mass, kinds)


# --- the hidden chain ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Chain:
    start: np.ndarray
    move: np.ndarray  # STATES x STATES
    emit: np.ndarray  # STATES x CLASSES

    @classmethod
    def guess(cls, totals: np.ndarray, states: int = STATES, seed: int = SEED) -> Chain:
        """Sticky states with seeded preferences around the corpus's class frequencies."""
        r = np.random.default_rng(seed)
        emit = (totals + 1) * np.exp(r.normal(0, 1, (states, len(totals))))
        return cls(np.full(states, 1 / states), np.full((states, states), 0.2 / states) + 0.8 * np.eye(states), emit / emit.sum(axis=1, keepdims=True))

    @classmethod
    def estimate(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, totals: np.ndarray) -> Chain:
        """From expected counts; emissions lean on the corpus's class frequencies."""
        prior = (totals + 1) / (totals + 1).sum()
        emit = emit + len(totals) * prior
        move, start = move + 1, start + 1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


class Lanes:
    """Blocks of documents that advance side by side, longest first.

    Tables over tokens are kept by step: the first tokens of all blocks, then their second ones, and so on.
    """

    def __init__(self, classes: np.ndarray, first: np.ndarray):
        length = np.diff(first)
        self.pieces = -(-length // BLOCK)
        doc = np.repeat(np.arange(len(length)), self.pieces)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(self.pieces) - self.pieces, self.pieces)
        begin = first[:-1][doc] + within * BLOCK
        size = np.minimum(BLOCK, first[1:][doc] - begin)
        order = np.argsort(-size, kind="stable")
        self.docs, self.doc, self.size = len(length), doc[order], size[order]
        # blocks that others follow or precede, in the order of their documents
        self.lane = np.empty(len(order), dtype=np.int64)
        self.lane[order] = np.arange(len(order))
        self.later = np.flatnonzero(within > 0)
        live = np.searchsorted(-self.size, -np.arange(1, BLOCK + 1), "right")
        self.live = live[live > 0]  # how many blocks have a t-th token
        self.at = np.concatenate([[0], np.cumsum(self.live)])  # where each step's tokens begin
        step = np.repeat(np.arange(len(self.live)), self.live)
        self.classes = classes[begin[order][np.arange(len(step)) - self.at[step]] + step]
        self.last = self.at[self.size - 1] + np.arange(len(order))  # each block's last token

    def transfer(self, chain: Chain, emit: np.ndarray) -> np.ndarray:
        """For blocks that another follows: the matrix from a distribution before the block to its end, to a scale."""
        k = len(chain.start)
        out = np.zeros((len(self.doc), k, k))
        lanes = self.lane[self.later - 1]
        if not len(lanes):
            return out
        # such blocks are full, so they advance together
        m = np.eye(k) * emit[self.at[0] + lanes][:, None, :]
        for t in range(1, BLOCK):
            m = (m.reshape(-1, k) @ chain.move).reshape(-1, k, k)
            m *= emit[self.at[t] + lanes][:, None, :]
            if t % RESCALE == 0:
                m /= m.sum(axis=(1, 2))[:, None, None]
        out[lanes] = m / m.sum(axis=(1, 2))[:, None, None]
        return out

    def forward(self, chain: Chain, emit: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distributions after each token, the factor that each token's step was divided by)."""
        q = np.tile(chain.start, (len(self.doc), 1))
        for i in self.later:
            a = q[self.lane[i - 1]] @ matrix[self.lane[i - 1]]
            q[self.lane[i]] = (a / a.sum()) @ chain.move
        a, scale, ones = np.empty_like(emit), np.empty(len(emit)), np.ones(len(chain.start))
        before = q
        for lo, hi, n in zip(self.at, self.at[1:], self.live, strict=False):
            x = a[lo:hi]
            np.multiply(before[:n] if lo == 0 else before[:n] @ chain.move, emit[lo:hi], out=x)
            s = x @ ones
            scale[lo:hi] = s
            x /= s[:, None]
            before = x
        return a, scale

    def score(self, chain: Chain) -> np.ndarray:
        """Natural log likelihood of each document, by the scaled forward recursion."""
        emit = chain.emit.T[self.classes]
        _, scale = self.forward(chain, emit, self.transfer(chain, emit))
        lane = np.arange(len(scale)) - np.repeat(self.at[:-1], self.live)
        return np.bincount(self.doc[lane], weights=np.log(scale), minlength=self.docs)

    def expect(self, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, transitions and emissions, by forward and backward passes with common factors."""
        k, emit = len(chain.start), chain.emit.T[self.classes]
        matrix = self.transfer(chain, emit)
        a, scale = self.forward(chain, emit, matrix)
        emit /= scale[:, None]
        # likelihood of all that follows a block, by state at its end
        after = np.ones((len(self.doc), k))
        heads = np.zeros((len(self.doc), k))  # and of a block with all after it, by state at its first token
        last = np.sort(self.lane[np.setdiff1d(self.later, self.later - 1)])  # their last blocks, longest first
        heads[last] = self._heads(chain, emit, last)
        for i in self.later[::-1]:
            lane, before = self.lane[i], self.lane[i - 1]
            after[before] = chain.move @ heads[lane]
            x = matrix[before] @ after[before]
            heads[before] = x / x.sum()
        after /= (a[self.last] * after).sum(axis=1, keepdims=True)
        # from here on ``emit`` turns into the likelihood of each token and all after it, by its state
        back, b = chain.move.T.copy(), after.copy()
        post = np.empty_like(a)
        for t in range(len(self.live) - 1, -1, -1):
            lo, hi, n = self.at[t], self.at[t + 1], self.live[t]
            np.multiply(a[lo:hi], b[:n], out=post[lo:hi])
            y = emit[lo:hi]
            y *= b[:n]
            if t:
                b[:n] = y @ back
        moves = np.zeros((k, k))
        for t in range(1, len(self.live)):
            lo, hi, n = self.at[t], self.at[t + 1], self.live[t]
            moves += a[self.at[t - 1] : self.at[t - 1] + n].T @ emit[lo:hi]
        moves *= chain.move
        for i in self.later:  # transitions between blocks
            x = a[self.last[self.lane[i - 1]]][:, None] * chain.move * emit[self.lane[i]][None, :]
            moves += x / x.sum()
        emits = np.stack([np.bincount(self.classes, weights=post[:, s], minlength=CLASSES) for s in range(k)])
        starts = post[np.setdiff1d(np.arange(len(self.doc)), self.lane[self.later])].sum(axis=0)
        return starts, moves, emits

    def _heads(self, chain: Chain, emit: np.ndarray, lanes: np.ndarray) -> np.ndarray:
        """The likelihood of documents' last blocks by state at their first token, to a scale: a backward vector pass."""
        b, back = np.ones((len(lanes), len(chain.start))), chain.move.T.copy()
        size = self.size[lanes]
        for t in range(int(size.max(initial=0)) - 1, -1, -1):
            n = int(np.searchsorted(-size, -t, "left"))  # blocks longer than t
            y = emit[self.at[t] + lanes[:n]] * b[:n]
            b[:n] = y @ back if t else y
            if t % RESCALE == 0:
                b[:n] /= b[:n].sum(axis=1, keepdims=True)
        return b


def with_ends(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class sequences of documents with an end token each, and where they begin."""
    first = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(int(first[-1]), END, dtype=np.int64)
    inside = np.ones(len(out), dtype=bool)
    inside[first[1:] - 1] = False
    out[inside] = classes
    return out, first


def _expect(chain: Chain, counts: Counts):
    """One row (cell, value) for each cell of the three tables, summed over the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = np.zeros(STATES * (1 + STATES + CLASSES)), [], 0

        def flush():
            classes = np.concatenate([c for c, _ in waiting])
            lengths = np.concatenate([n for _, n in waiting])
            total[:] += np.concatenate([x.ravel() for x in Lanes(*with_ends(classes, lengths)).expect(chain)])
            waiting.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                held, lengths, known, tails, tokens = (batch.column(c)[i].as_py() for c in range(5))
                known, lengths = np.frombuffer(known, "<u8"), np.array(lengths, dtype=np.int64)
                trains = ~np.array(held, dtype=bool)
                if not trains.any():
                    continue
                classes = counts.classes(known, np.frombuffer(tails, "u1"))[_tokens(tokens, len(known))]
                waiting.append((classes[np.repeat(trains, lengths)], lengths[trains]))
                size += len(waiting[-1][0])
                if size > BATCH_TOKENS:
                    flush()
                    size = 0
        if waiting:
            flush()
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "value"])

    return run


def baum_welch(chunks: DataFrame, counts: Counts, iterations: int = ITERATIONS) -> Chain:
    """``iterations`` rounds over all training documents; without any, the first guess."""
    totals = counts.class_totals()
    chain = Chain.guess(totals)
    rows = chunks.select("held", "lengths", "words", "tails", "tokens")
    for _ in range(iterations if counts.ends else 0):
        found = rows.mapInArrow(_expect(chain, counts), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # a fixed number of cells
        cells = np.zeros(STATES * (1 + STATES + CLASSES))
        for r in found:
            cells[r["cell"]] = r["value"]
        start, move, emit = np.split(cells, [STATES, STATES * (1 + STATES)])
        chain = Chain.estimate(start, move.reshape(STATES, STATES), emit.reshape(STATES, CLASSES), totals)
    return chain


# --- scores -------------------------------------------------------------------------------------------------

_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(chain: Chain, counts: Counts):
    """Rows by chunk, the chunk before its replies, those in bucket order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, totals = None, []
        base = math.log10(counts.tokens + counts.types + 1)
        room = np.log10(counts.tail_tokens + counts.tail_types + 1.0)
        end_base = math.log10(counts.ends + 1) - base

        def close():
            known = np.frombuffer(chunk["words"], "<u8")
            c = np.concatenate([_unpack(t, "<u8") for t in totals]).astype(np.int64) if totals else np.zeros(0, np.int64)
            if len(c) != len(known):
                raise ValueError("a chunk's replies don't match its words")
            tails = np.frombuffer(chunk["tails"], "u1")
            own = np.log10(c + 1.0)
            inner = np.where(c > counts.above, 0.0, own - room[tails])
            lengths = np.array(chunk["lengths"], dtype=np.int64)
            tokens = _tokens(chunk["tokens"], len(known))
            doc = np.repeat(np.arange(len(lengths)), lengths)
            add = lambda x: np.bincount(doc, weights=x[tokens], minlength=len(lengths))
            n = lengths + 1
            hidden = np.zeros(len(lengths))
            classes = counts.classes(known, tails)[tokens]
            first = np.concatenate([[0], np.cumsum(lengths)])
            for i, j in batches_of(n):
                hidden[i:j] = Lanes(*with_ends(classes[first[i] : first[j]], lengths[i:j])).score(chain)
            values = [chunk["doc_ids"], chunk["held"], n, (add((c > 0).astype(float)) + (counts.ends > 0)).astype(np.int64), np.full(len(n), counts.tokens), add(own) - lengths * base + end_base, hidden / math.log(10) + add(inner)]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _SCORES.split(", ")])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}
                if row["bucket"] < 0:
                    if chunk is not None:
                        yield close()
                    chunk, totals = row, []
                else:
                    totals.append(row["totals"])
        if chunk is not None:
            yield close()

    return run


def batches_of(sizes: np.ndarray, most: int = BATCH_TOKENS) -> Iterator[tuple[int, int]]:
    i, ends = 0, np.cumsum(sizes)
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


@dataclass(frozen=True)
class Trained:
    """A trained model with what its corpus was made into: chunks of documents, and the replies to their words."""

    chunks: DataFrame
    replies: DataFrame
    counts: Counts
    chain: Chain


def train(docs: DataFrame, trains_on=None) -> Trained:
    """Counts over all training rows of ``docs``, and a chain fitted to them; see ``score_documents``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trains = ~held_out() if trains_on is None else trains_on
    held = F.coalesce(~trains, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), whole_text().alias("text"))
    chunks = stage(texts.mapInArrow(_chunks, _CHUNK), "hmm-chunks")
    ends, words = chunks.select(F.sum(F.size(F.filter("held", lambda x: ~x))), F.sum(F.octet_length("words"))).first()
    buckets = max(parts, -(-(words or 0) // (32 << 20)))
    asked = chunks.select("chunk", "words", "counts", "tails").mapInArrow(_ask(buckets), "bucket int, chunk long, words binary, counts binary, tails binary")
    owned = stage(asked.drop("chunk").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_own, _OWNED), "hmm-counts")
    counts = corpus_counts(owned, int(ends or 0))
    return Trained(chunks, replies_of(owned, asked, parts), counts, baum_welch(chunks, counts))


def replies_of(owned: DataFrame, asked: DataFrame, parts: int) -> DataFrame:
    """(chunk, bucket, totals): the corpus counts of each chunk's words, bucket by bucket."""
    none = F.lit(None)
    known = owned.where("kind = 0").select("bucket", "kind", none.cast("long").alias("chunk"), "words", "totals")
    both = known.unionAll(asked.select("bucket", F.lit(1), "chunk", "words", none.cast("binary")))
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_reply, "chunk long, bucket int, totals binary")


def score_documents(docs: DataFrame, trains_on=None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``trains_on``: a column telling which rows the model learns from (by default those outside the held-out
    fold). Null texts count as empty: the end token alone. A null doc_id counts as not held out. Repeated rows
    count, and are scored, as often as they stand there. An empty table gives an empty result, and one without
    training rows works with counts of nothing.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = train(docs, trains_on)
    rows = made.chunks.drop("counts").withColumn("bucket", F.lit(-1)).unionByName(made.replies, allowMissingColumns=True)
    return rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(_finish(made.chain, made.counts), _SCORES)


def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text under the model trained outside the held-out fold, beside its smoothed unigram score."""
    return score_documents(table(spark, sf_dir, "documents"))
