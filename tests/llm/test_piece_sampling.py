from collections import Counter

import numpy as np
import sentencepiece

from orbweave.llm import piece_sampling as p
from tests.llm.helpers import SF, odd_documents, odd_rows

PATH = p.vocabulary_path()


def test_samples_follow_the_exact_distribution():
    v = p.Vocabulary.load(PATH)
    sampler, n, word = p.Sampler(v), 20_000, "there"
    ids, first = sampler.sample(np.arange(n, dtype=np.uint64), [word] * n)
    weight = dict(zip(v.pieces, np.log(v.weights).tolist(), strict=True))
    number = dict(zip(v.pieces, v.ids.tolist(), strict=True))

    def paths(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in weight:
                for rest, x in paths(s[k:]):
                    yield (number[s[:k]], *rest), x + weight[s[:k]]

    exact = dict(paths(" " + word))
    z = sum(np.exp(x) for x in exact.values())
    seen = Counter(tuple(ids[first[i] : first[i + 1]].tolist()) for i in range(n))
    assert set(seen) <= set(exact)
    assert max(abs(seen[k] / n - np.exp(x) / z) for k, x in exact.items()) < 0.015


def test_split_lattice_equals_the_whole_one():
    """The log weight of all segmentations of a sentence is the sum over its words."""
    v = p.Vocabulary.load(PATH)
    weight = dict(zip(v.pieces, np.log(v.weights).tolist(), strict=True))

    def total(s):
        f = [0.0] + [-np.inf] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - 20), j):
                if s[i:j] in weight:
                    f[j] = np.logaddexp(f[j], f[i] + weight[s[i:j]])
        return f[-1]

    assert abs(total(" the old  tree stands") - sum(map(total, (" the", " old", "  tree", " stands")))) < 1e-9


def test_lossless_and_reproducible(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for docs, rows in ((odd_documents(spark), [(r[0], r[1]) for r in odd_rows()]), (spark.read.parquet(f"{SF}/documents.parquet"), None)):
        encoded = p.encode(docs.repartition(3), PATH)
        assert encoded.columns == [c for c in docs.columns if c != "piece_ids"] + ["piece_ids"]
        back = p.decode_rows(encoded.select("doc_id", "text", "piece_ids"), PATH).collect()
        assert all(r["decoded"] == (r["text"] or "") for r in back)
        again = {(r["doc_id"], r["text"]): r["piece_ids"] for r in p.encode(docs, PATH).collect()}
        got = encoded.collect()
        assert all(again[r["doc_id"], r["text"]] == r["piece_ids"] for r in got)
        assert all(sp.decode(r["piece_ids"]) == r["text"] for r in got if r["text"] and "\x00" not in r["text"] and len(r["text"]) < 5000)
        other = {(r["doc_id"], r["text"]): r["piece_ids"] for r in p.encode(docs, PATH, seed=2).collect()}
        assert any(other[k] != again[k] for k in again)
    empty = odd_documents(spark).where("false")
    assert p.encode(empty, PATH).collect() == [] and p.decode_rows(p.encode(empty, PATH), PATH).collect() == []


def test_words_are_forgotten_within_the_bound(monkeypatch):
    monkeypatch.setattr(p, "MOST_EDGES", 100)
    v = p.Vocabulary.load(PATH)
    small, texts = p.Sampler(v), ["alpha beta gamma delta", "alpha epsilon zeta eta theta", "beta gamma iota kappa", "x" * 300]
    for k, text in enumerate(texts):
        ids, _ = small.sample(np.array([k], dtype=np.uint64), [text])
        fresh, _ = p.Sampler(v).sample(np.array([k], dtype=np.uint64), [text])
        assert ids.tolist() == fresh.tolist() and p.decode(v, ids) == text


def some_texts():
    rng = np.random.default_rng(3)
    letters = list("etaoinshrdlu  é漢🎉")
    return ["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 400, 120)] + ["", " ", "x" * 9000, "the end"]


def test_ids_do_not_depend_on_slices_or_memory(monkeypatch):
    v, texts = p.Vocabulary.load(PATH), some_texts()
    keys = np.arange(len(texts), dtype=np.uint64)

    def made(sampler, step):
        out = []
        for i in range(0, len(texts), step):
            ids, first = sampler.sample(keys[i : i + step], texts[i : i + step])
            out += [ids[a:b].tolist() for a, b in zip(first, first[1:])]
        return out

    warm = p.Sampler(v)
    want = made(warm, 1)
    assert [p.decode(v, np.array(x, dtype="<u4")) for x in want] == texts
    for step in (1, 100, 10_000):
        assert made(warm, step) == want and made(p.Sampler(v), step) == want
    for name, value in (("FILTER_CHARS", 7), ("SLICE_CHARS", 50), ("MOST_EDGES", 500)):
        monkeypatch.setattr(p, name, value)
        assert made(p.Sampler(v), 20) == want


def test_shares_of_a_word_are_its_own():
    """A word filtered alone and after many others has the same shares, bit by bit."""
    v = p.Vocabulary.load(PATH)
    s, word = p.Sampler(v), np.frombuffer(" understanding".encode("utf-32-le"), "<u4")
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 12, 5000)
    before = rng.integers(97, 123, int(sizes.sum())).astype("<u4")
    alone = s.filter(word, np.array([len(word)]))
    among = s.filter(np.concatenate([before, word]), np.append(sizes, len(word)))
    n, mask = len(alone[0]), (1 << p.SHARE_BITS) - 1
    assert (alone[0] & mask).tolist() == (among[0][-n:] & mask).tolist() and alone[2].tolist() == among[2][-n:].tolist()


def test_words_with_one_hash_keep_their_own_pieces(monkeypatch):
    """Hashes that tell few words apart (Thue-Morse words collide under polynomials modulo 2**64) lose nothing."""
    thue = [bin(i).count("1") & 1 for i in range(4096)]
    texts = ["".join("ab"[b] for b in thue), "".join("ba"[b] for b in thue), *some_texts()]
    v, keys = p.Vocabulary.load(PATH), np.arange(len(some_texts()) + 2, dtype=np.uint64)
    ids, first = p.Sampler(v).sample(keys, texts)
    assert [p.decode(v, ids[a:b]) for a, b in zip(first, first[1:])] == texts
    words = p.w.split_words(np.frombuffer(" ".join(texts[:2]).encode(), np.uint8), np.array([0, 8193]), p.w.BLANK_SEPARATED)
    assert len(set(words.hashes.tolist())) == 2
    plain = p.w.hash_ranges
    monkeypatch.setattr(p.w, "hash_ranges", lambda data, begin, size: plain(data, begin, size) % np.uint64(5))
    s = p.Sampler(v)
    for _ in range(2):
        again, at = s.sample(keys, texts)
        assert again.tolist() == ids.tolist() and at.tolist() == first.tolist()


def test_round_trip_is_encode_and_decode(spark):
    docs = odd_documents(spark)
    a = p.round_trip(docs.repartition(4), PATH).collect()
    b = p.decode_rows(p.encode(docs, PATH), PATH).select("doc_id", "n_pieces", "ids_crc32", p.F.sha2("decoded", 256), (p.F.col("decoded") == p.whole_text())).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str) and all(r["lossless"] for r in a)
    assert p.round_trip(docs.where("false"), PATH).collect() == []
    clash = docs.withColumnsRenamed({"source": "key", "keep_id": "_text"}).withColumn("_key", p.F.lit(1))
    assert p.encode(clash, PATH).columns == [*[c for c in clash.columns if c != "piece_ids"], "piece_ids"]
    assert p.encode(clash, PATH).count() == docs.count()
