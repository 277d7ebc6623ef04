import math
from collections import Counter

import numpy as np

from orbweave.llm import hmm_lm as m
from tests.llm.helpers import SF, blank_words, crc, odd_documents


def plain_pass(chain, o):
    """Log likelihood and expected counts of one sequence, by unscaled forward and backward passes."""
    k, n = len(chain.start), len(o)
    a, b = np.zeros((n, k)), np.ones((n, k))
    a[0] = chain.start * chain.emit[:, o[0]]
    for t in range(1, n):
        a[t] = (a[t - 1] @ chain.move) * chain.emit[:, o[t]]
    for t in range(n - 2, -1, -1):
        b[t] = chain.move @ (chain.emit[:, o[t + 1]] * b[t + 1])
    z = a[-1].sum()
    moves = sum((a[t][:, None] * chain.move * (chain.emit[:, o[t + 1]] * b[t + 1])[None] / z for t in range(n - 1)), np.zeros((k, k)))
    emits = np.zeros_like(chain.emit)
    for t in range(n):
        emits[:, o[t]] += a[t] * b[t] / z
    return math.log(z), a[0] * b[0] / z, moves, emits


def test_blocks_are_exact(monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 7)
    r = np.random.default_rng(0)
    chain = m.Chain(r.dirichlet(np.ones(4)), r.dirichlet(np.ones(4), 4), r.dirichlet(np.ones(m.CLASSES), 4))
    lengths = np.array([0, 3, 30, 6, 7, 8, 90])
    seq, first = m.with_ends(r.integers(0, m.END, lengths.sum()), lengths)
    want = [plain_pass(chain, seq[i:j]) for i, j in zip(first, first[1:], strict=False)]
    lanes = m.Lanes(seq, first)
    assert np.allclose(lanes.score(chain), [x[0] for x in want])
    for got, k in zip(lanes.expect(chain), (1, 2, 3), strict=True):
        assert np.allclose(got, sum(x[k] for x in want), atol=1e-5)


def base_scores(rows, fold=7):
    train = Counter()
    for i, t in rows:
        if i is None or crc(i) % fold != 2:
            train.update([*blank_words(t), None])
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        tokens = [*blank_words(t), None]
        out.append((i, i is not None and crc(i) % fold == 2, len(tokens), sum(x in train for x in tokens), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in tokens), 6)))
    return sorted(out, key=str)


def test_small_and_odd_documents(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionAll(odd_documents(spark).select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = m.score_documents(docs).collect()
    assert sorted([(*tuple(r)[:5], round(r["base_score"], 6)) for r in got], key=str) == base_scores(rows)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)


def test_scores_against_a_plain_recursion(spark):
    """The query's score of every document is the plain forward recursion's, from counts of plain words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionAll(odd_documents(spark).select("doc_id", "text"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    made = m.train(docs)
    train = Counter()
    for i, t in rows:
        if i is None or crc(i) % 7 != 2:
            train.update(blank_words(t))
    tail = lambda x: m.w.split_words(np.frombuffer(x.encode()[-m.TAIL_BYTES :], np.uint8), np.array([0, len(x.encode()[-m.TAIL_BYTES :])]), np.ones(256, dtype=bool)).hashes
    classes, own = {}, {}
    for x in {x for _, t in rows for x in blank_words(t)}:
        raw = np.frombuffer(x.encode(), np.uint8)
        h = m.w.split_words(raw, np.array([0, len(raw)]), np.ones(256, dtype=bool)).hashes
        classes[x] = int(made.counts.classes(h, (m.w.mix(tail(x)) % np.uint64(m.TAILS)).astype(np.int64))[0])
    inside = Counter(classes[x] for x in train if classes[x] >= m.TOP)
    tokens = Counter()
    for x, n in train.items():
        tokens[classes[x]] += n
    for x, c in classes.items():
        own[x] = 0.0 if c < m.TOP else math.log((train[x] + 1) / (tokens[c] + inside[c] + 1))

    def plain(text):
        a, total = None, 0.0
        for c in [*(classes[x] for x in blank_words(text)), m.END]:
            a = (made.chain.start if a is None else a @ made.chain.move) * made.chain.emit[:, c]
            total += math.log(a.sum())
            a = a / a.sum()
        return (total + sum(own[x] for x in blank_words(text))) / math.log(10)

    want = sorted(((i or 0, round(plain(t), 5)) for i, t in rows))
    got = sorted(((r["doc_id"] or 0, round(r["score"], 5)) for r in m.score_documents(docs).collect()))
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=2e-5)


def test_likelihood_sums_to_one_over_next_words(spark):
    """Over all known words and the unknown one of each class, one-word documents' chances make up what one word may be."""
    words = [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    docs = spark.createDataFrame([(k, " ".join(words[k % 7 :: 3])) for k in range(60)], "doc_id long, text string")
    probe = spark.createDataFrame([(1000 + k, w) for k, w in enumerate(words)], "doc_id long, text string")
    got = m.score_documents(docs.unionAll(probe), trains_on=(m.F.col("doc_id") < 1000))
    chance = sum(10 ** r["score"] for r in got.where("doc_id >= 1000").collect())
    assert 0 < chance < 1


def test_training_raises_the_likelihood(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", m.F.lit(False).alias("held"))
    chunks = docs.select("doc_id", "held", "text").mapInArrow(m._chunks, m._CHUNK).cache()
    asked = chunks.select("chunk", "words", "counts", "tails").mapInArrow(m._ask(3), "bucket int, chunk long, words binary, counts binary, tails binary")
    owned = asked.repartition(2, "bucket").sortWithinPartitions("bucket").mapInArrow(m._own, m._OWNED)
    counts = m.corpus_counts(owned, docs.count())
    row = chunks.first()
    classes = counts.classes(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["tails"], "u1"))[m._tokens(row["tokens"], len(row["words"]) // 8)]
    lanes = m.Lanes(*m.with_ends(classes, np.array(row["lengths"])))
    scores = [lanes.score(m.baum_welch(chunks, counts, n)).sum() for n in (0, 1, 4)]
    assert scores[0] < scores[1] < scores[2]


def test_nothing_to_learn_from(spark):
    docs = odd_documents(spark)
    assert m.score_documents(docs.where("false")).collect() == []
    got = m.score_documents(docs, trains_on=m.F.lit(False)).collect()
    assert {r["train_tokens"] for r in got} == {0} and {r["n_known"] for r in got} == {0} and all(abs(r["base_score"]) < 1e-9 for r in got)


def test_buckets_merge_as_rows_come(monkeypatch):
    """A word of every chunk: however few words may wait, totals and replies are those of a plain count."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows, total, tail = [], {}, {}
    for chunk in range(50):
        words = np.unique(np.concatenate([[7], rng.integers(0, 400, 30)])).astype("<u8")
        counts = rng.integers(0, 9, len(words)).astype("<u4")
        tails = (words % m.TAILS).astype("u1")
        for b in (0, 1):
            mine = words % 2 == b
            rows.append((b, chunk, words[mine].tobytes(), counts[mine].tobytes(), tails[mine].tobytes()))
        for w, c in zip(words.tolist(), counts.tolist()):
            total[w] = total.get(w, 0) + c
    rows.sort(key=lambda r: r[0])
    batch = lambda some: pa.RecordBatch.from_pylist([dict(zip(("bucket", "chunk", "words", "counts", "tails"), r)) for r in some])
    for most in (10, 1 << 21):
        monkeypatch.setattr(m, "MERGE_WORDS", most)
        out = [r for made in m._own(batch(rows[i : i + 7]) for i in range(0, len(rows), 7)) for r in made.to_pylist()]
        known = [r for r in out if r["kind"] == 0]
        assert {w: c for r in known for w, c in zip(np.frombuffer(r["words"], "<u8").tolist(), m._unpack(r["totals"], "<u8").tolist())} == total
        assert sum(r["a"] for r in out if r["kind"] == 1) == sum(total.values()) and len([r for r in out if r["kind"] == 2]) == 2 * min(m.TOP + 1, 200)
        both = sorted([dict(bucket=r["bucket"], kind=0, chunk=None, words=r["words"], totals=r["totals"]) for r in known] + [dict(bucket=b, kind=1, chunk=c, words=w, totals=None) for b, c, w, *_ in rows], key=lambda r: (r["bucket"], r["kind"]))
        for made in m._reply([pa.RecordBatch.from_pylist(both)]):
            for r, q in zip(made.to_pylist(), [x for x in both if x["kind"]]):
                assert m._unpack(r["totals"], "<u8").tolist() == [total[w] for w in np.frombuffer(q["words"], "<u8").tolist()] and r["chunk"] == q["chunk"]
