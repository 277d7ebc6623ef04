"""Phrase collocations by hierarchical pair naming.

Texts are cut into pieces and words, and documents of a language are gathered in chunks. Words that are frequent in their
language get an id; then, length by length, every place where two frequent phrases of k - 1 words overlap is a pair of
ids, pairs are counted over the whole corpus, and frequent ones get an id of their own by which the place is
replaced. So a text is only ever an array of ids, a phrase of k words costs as much as one of two, and an id's pair
names its parents: what is left of it without the last and without the first word. Frequencies of all first parts
and rests of a phrase are read along the parents, and a phrase is subsumed by a longer one if it is by one that
has it for a parent (longer ones hold that one, and are no more frequent).

Counting and naming is a shuffle of blocks: a chunk sends its distinct pairs with their counts, sorted and packed, to the
pair's bucket. A bucket's task merges as rows arrive and holds distinct pairs, never a row for each chunk. Names
go back only for pairs that a chunk asks for, in one pass over bucket and questions side by side. Pairs are compared as
pairs and words as words, so nothing collides.

Only A-Z are lower-cased. Null texts count as empty, a null lang as ``und``; doc_id and other columns are ignored, and
repeated rows count as often as they stand there. An empty table, and languages without a phrase, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.llm import words as w
from orbweave.llm.shared import stage, table, whole_text

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words
SUBSUMED = 80  # per cent of a phrase's occurrences that a longer one must have to stand for it
TOP = 2000  # phrases of each language
TOP_PARTS = 16  # parts of a language whose first ones meet in its last window
CHUNK_BYTES = 4 << 20
MERGE_ENTRIES = 1 << 21  # pairs that wait to be merged in a bucket's task
_ID_BITS = np.uint64(32)

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


def _pack(a: np.ndarray) -> bytes:
    """Integers, byte by byte: high bytes that hardly change are next to each other."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, "<u8"), dtype=np.uint64)


# --- words --------------------------------------------------------------------------------------------------


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, and all words in order as indices from 1, with a 0 before each piece."""
    low = w.LOWER[data]
    inside = ~_GAP[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    breaks = np.cumsum(_BREAK[low] | edge[:-1], dtype=np.int64)[starts]  # a document's first byte breaks as well
    fresh = np.diff(breaks, prepend=-1) != 0
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(low[inside])]).dictionary_encode()
    tokens = np.zeros(len(starts) + int(fresh.sum()), dtype="<u4")
    tokens[np.arange(len(starts)) + np.cumsum(fresh)] = words.indices.to_numpy(zero_copy_only=False) + 1
    return words.dictionary, tokens


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in chunks of one language: distinct words with their counts, and the tokens."""
    chunk, held, size = TaskContext.get().partitionId() << 33, {}, 0

    def flush():
        nonlocal chunk
        for lang, texts in held.items():
            for _, _, data, offsets in w.slices(pa.chunked_array(texts), CHUNK_BYTES):
                words, tokens = _split(data, offsets)
                if not len(words):
                    continue
                counts = np.bincount(tokens, minlength=len(words) + 1)[1:]
                columns = [[chunk], [lang], pa.array([words.cast(pa.large_string()).to_pylist()], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), [int(counts.sum())], pa.array([_pack(tokens)], pa.binary())]
                yield pa.record_batch(columns, names=["chunk", "lang", "words", "counts", "n", "tokens"])
                chunk += 1
        held.clear()

    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).filter(pa.compute.equal(langs.indices, code))
            held.setdefault(lang, []).append(texts)
            size += texts.nbytes
        if size > 2 * CHUNK_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def _word_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens as ids of frequent words, 0 for others."""
    for batch in batches:
        out = []
        for tokens, at, ids in zip(*(batch.column(n).to_pylist() for n in ("tokens", "at", "ids")), strict=True):
            tokens = _unpack(tokens, "<u4")
            names = np.zeros(int(tokens.max()) + 1, dtype="<u4")
            names[np.array(at, dtype=np.int64) + 1] = ids
            out.append(_pack(names[tokens]))
        yield pa.record_batch([batch.column("chunk"), pa.array(out, pa.binary())], names=["chunk", "ids"])


# --- pairs --------------------------------------------------------------------------------------------------


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where two named phrases overlap, and their pairs."""
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    return at, ids[at].astype(np.uint64) << _ID_BITS | ids[at + 1].astype(np.uint64)


def _ask(buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct pairs with their counts, a row for each bucket."""
    for batch in batches:
        for chunk, ids in zip(batch.column("chunk").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            keys, counts = np.unique(_pairs(_unpack(ids, "<u4"))[1], return_counts=True)
            bucket = (w.mix(keys) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, counts, bucket = keys[order], counts[order].astype("<u4"), bucket[order]
            cut = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(keys)]])
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            columns = [pa.array(bucket[cut[:-1]], pa.int32()), pa.array([chunk] * len(spans), pa.int64()), pa.array([_pack_sorted(keys[a:b]) for a, b in spans], pa.binary()), pa.array([_pack(counts[a:b]) for a, b in spans], pa.binary())]
            yield pa.record_batch(columns, names=["bucket", "chunk", "keys", "counts"])


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    known, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(known), dtype=np.int64)
    np.add.at(total, which, np.concatenate(counts))
    return known, total


def _count(least: int, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in bucket order: each bucket's frequent pairs, with the ids they get and their counts."""
    held, keys, counts, waiting, merged = None, [], [], 0, 0

    def close():
        known, total = _merged(keys, counts)
        live = total >= least
        known, total = known[live], total[live]
        names = np.arange(len(known), dtype=np.int64) * buckets + held + 1
        if len(names) and names[-1] >> 32:
            raise ValueError("over 2^32 frequent phrases of one length: raise the least count or the number of shuffle partitions")
        if len(known):
            yield pa.record_batch([pa.array([held], pa.int32()), *(pa.array([_pack(a.astype("<u8"))], pa.binary()) for a in (known, names, total))], names=["bucket", "keys", "names", "counts"])

    for batch in batches:
        for bucket, k, c in zip(*(batch.column(n).to_pylist() for n in ("bucket", "keys", "counts")), strict=True):
            if bucket != held:
                if held is not None:
                    yield from close()
                held, keys, counts, waiting, merged = bucket, [], [], 0, 0
            keys.append(_unpack_sorted(k))
            counts.append(_unpack(c, "<u4").astype(np.int64))
            waiting += len(keys[-1])
            if waiting > max(MERGE_ENTRIES, merged):
                known, total = _merged(keys, counts)
                keys, counts, waiting, merged = [known], [total], 0, len(known)
    if held is not None:
        yield from close()


def _reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in bucket order, names (kind 0) before questions (kind 1): what is named of each question."""
    held = None
    for batch in batches:
        chunks, found, named = [], [], []
        for bucket, kind, chunk, k, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "chunk", "keys", "names")), strict=True):
            if kind == 0:
                held, known, names = bucket, _unpack(k, "<u8"), _unpack(n, "<u8")
                continue
            if bucket != held:
                continue  # nothing in this bucket is frequent
            asked = _unpack_sorted(k)
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            hit = known[at] == asked
            if hit.any():
                chunks.append(chunk)
                found.append(_pack_sorted(asked[hit]))
                named.append(_pack(names[at[hit]].astype("<u4")))
        yield pa.record_batch([pa.array(chunks, pa.int64()), pa.array(found, pa.binary()), pa.array(named, pa.binary())], names=["chunk", "keys", "names"])


def _rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in chunk order, the chunk (kind 0) before its names (kind 1): the chunk with pairs replaced."""
    held, ids, keys, names = None, None, [], []

    def close():
        at, pairs = _pairs(ids)
        known, named = np.concatenate(keys), np.concatenate(names)
        order = np.argsort(known)
        known, named = known[order], named[order]
        k = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
        hit = known[k] == pairs
        made = np.zeros(len(ids) - 1, dtype="<u4")
        made[at[hit]] = named[k[hit]]
        return pa.record_batch([pa.array([held], pa.int64()), pa.array([_pack(made)], pa.binary())], names=["chunk", "ids"])

    for batch in batches:
        for chunk, kind, blob, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "blob", "names")), strict=True):
            if kind == 0:
                if keys:
                    yield close()
                held, ids, keys, names = chunk, _unpack(blob, "<u4"), [], []
            else:
                keys.append(_unpack_sorted(blob))
                names.append(_unpack(n, "<u4"))
    if keys:
        yield close()


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Named pairs, a row each."""
    for batch in batches:
        for k, n, c in zip(*(batch.column(x).to_pylist() for x in ("keys", "names", "counts")), strict=True):
            keys, names, counts = (_unpack(x, "<u8") for x in (k, n, c))
            for i in range(0, len(keys), 10_000):
                part = slice(i, i + 10_000)
                yield pa.record_batch([pa.array(a[part].astype(np.int64), pa.int64()) for a in (keys >> _ID_BITS, keys & np.uint64(0xFFFFFFFF), names, counts)], names=["left", "right", "id", "a"])


def _name_pairs(chunks: DataFrame, least: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(named pairs, chunks in which they are replaced)."""
    asked = chunks.mapInArrow(partial(_ask, buckets), "bucket int, chunk long, keys binary, counts binary")
    dealt = asked.select("bucket", "keys", "counts").repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    named = stage(dealt.mapInArrow(partial(_count, least, buckets), "bucket int, keys binary, names binary, counts binary"), "named-pairs")
    nothing = F.lit(None)
    known = named.select("bucket", F.lit(0).alias("kind"), nothing.cast("long").alias("chunk"), "keys", "names")
    both = known.unionAll(asked.select("bucket", F.lit(1), "chunk", "keys", nothing.cast("binary")))
    replies = both.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_reply, "chunk long, keys binary, names binary")
    side = chunks.select("chunk", F.lit(0).alias("kind"), F.col("ids").alias("blob"), nothing.cast("binary").alias("names"))
    side = side.unionAll(replies.select("chunk", F.lit(1), "keys", "names"))
    renamed = side.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_rename, "chunk long, ids binary")
    return named.mapInArrow(_listed, "left long, right long, id long, a long"), stage(renamed, "renamed-chunks")


def named_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by length, and the words of each lang.

    Phrases of k words are at k - 1: (id, lang, phrase, last, a, firsts, rests, left, right), with the last word, and how often the
    first and the last 1, 2, ... words occur; left and right are the parents' ids. Words: (lang, n).
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    chunks = stage(texts.mapInArrow(_chunks, "chunk long, lang string, words array<string>, counts array<long>, n long, tokens binary"), "word-chunks")
    entries = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "entry")).select("chunk", "lang", "at", F.col("entry.words").alias("word"), F.col("entry.counts").alias("n"))
    counted = entries.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    place = F.monotonically_increasing_id()  # of the staged rows: (partition << 33) + row, made dense
    words = stage(counted.withColumn("id", (place.bitwiseAND((1 << 33) - 1)) * buckets + F.shiftright(place, 33) + 1), "frequent-words")
    ids = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("named"))
    first = chunks.select("chunk", "tokens").join(ids, "chunk").select("chunk", "tokens", F.col("named.at").alias("at"), F.col("named.id").alias("ids"))
    told = stage(first.mapInArrow(_word_ids, "chunk long, ids binary"), "named-chunks")
    none = F.lit(None).cast("long")
    levels = [words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", F.array("a").alias("firsts"), F.array("a").alias("rests"), none.alias("left"), none.alias("right"))]
    for _ in range(longest - 1):
        named, told = _name_pairs(told, least, buckets)
        left = levels[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("_before"), F.col("firsts").alias("_firsts"))
        right = levels[-1].select(F.col("id").alias("right"), "last", F.col("rests").alias("_rests"))
        grown = named.join(left, "left").join(right, "right")
        own = F.array("a")
        levels.append(stage(grown.select("id", "lang", F.concat_ws(" ", "_before", "last").alias("phrase"), "last", "a", F.concat("_firsts", own).alias("firsts"), F.concat("_rests", own).alias("rests"), "left", "right"), "phrases"))
    return levels, chunks.groupBy("lang").agg(F.sum("n").alias("n"))


def _scored(phrases: DataFrame, size: int) -> DataFrame:
    """Candidates with the lowest-scoring cut: (lang, phrase, a, l, r, score)."""
    cuts = []
    for k in range(1, size):
        l, r = F.col("firsts")[k - 1], F.col("rests")[size - k - 1]  # noqa: E741
        exact = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast("decimal(19,0)"), l.cast("decimal(19,0)") + r.cast("decimal(19,0)"))
        cuts.append(F.struct(exact.cast("long").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    least = F.array_min(F.array(*cuts)).alias("cut")
    return phrases.select("lang", "phrase", "a", least).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases."""
    levels, words = named_phrases(docs, least, longest)
    found = []
    for k in range(2, longest + 1):
        own = levels[k - 1]
        if k < longest:
            longer = levels[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("most")).groupBy("id").agg(F.max("most").alias("most"))
            big = lambda c: F.col(c).cast("decimal(19,0)")
            own = own.join(longer, "id", "left").where(F.col("most").isNull() | (big("most") * 100 < big("a") * subsumed))
        found.append(_scored(own, k))
    every = reduce(DataFrame.unionAll, found)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = every
    for parts in (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), TOP_PARTS):  # a language's first ones are among the first ones of its parts
        some = Window.partitionBy("lang", "part").orderBy(*order)
        best = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two to four words of every language."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws
  FROM documents
),
places AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, range(1, 5) AS s(k)),
counts AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f FROM counts WHERE k >= 2 AND f >= 30),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, j, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
  FROM candidates c, range(1, 4) AS x(j)
  JOIN counts l ON l.lang = c.lang AND l.k = j AND l.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN counts r ON r.lang = c.lang AND r.k = c.k - j AND r.phrase = array_to_string(c.ws[j + 1:], ' ')
  WHERE j < c.k
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM candidates, range(2, 4) AS x(j) WHERE j < k) GROUP BY ALL
),
kept AS (
  SELECT o.* FROM lowest o LEFT JOIN inside i ON i.lang = o.lang AND i.phrase = o.phrase WHERE i.f IS NULL OR 100 * i.f < 80 * o.a
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
