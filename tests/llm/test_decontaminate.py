import random
from collections import Counter

import numpy as np
import pyarrow as pa

from orbweave.llm import decontaminate as d
from orbweave.llm import decontaminate as d_
from tests.llm.helpers import SF, odd_documents, odd_rows, plain_words, shingles


def similar(a, b):
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low)


def brute(docs, items):
    found = set()
    for item, text in items:
        words = plain_words(text)
        if not words:
            continue
        size, bag = len(words), Counter(shingles(words))
        run = min(5, size)
        for doc, t in docs:
            have = plain_words(t)
            at = [i for i, s in enumerate(shingles(have, run) if len(have) >= run else []) if s in bag]
            n = min(size, len(have))
            starts = {s for i in at for s in range(max(0, i - n + run), min(i, len(have) - n) + 1)}
            if any(similar(Counter(shingles(have[s : s + n], run)), bag) >= 0.75 for s in starts):
                found.add((doc, item))
    return found


def test_small_table_against_all_windows(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, bench).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in bench.collect()])
    assert got == want and got


def test_odd_cases(spark):
    items = [(1, "quick brown fox jumps over the lazy dog while the cat sleeps"), (2, None), (3, ""), (4, "one two"), (4, "one two"), (None, "a far id"), (5, "word1 word2 word3 word4 word5 word6 word7")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = odd_documents(spark)
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, bench).collect()}
    assert got == brute([(r[0], r[1]) for r in odd_rows()], [x for x in items if x[1]])
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {4, 5, 6, 12} <= {r["doc_id"] for r in kept.collect()}
    assert d.contaminated(docs, bench.where("false")).collect() == []
    assert d.contaminated(docs.where("false"), bench).collect() == []


def test_partly_changed_passage_is_found_and_other_text_is_not(spark):
    passage = [f"p{i}" for i in range(60)]
    changed = passage[:20] + ["x"] + passage[21:]
    far = [w if i % 4 else f"q{i}" for i, w in enumerate(passage)]
    docs = spark.createDataFrame([(1, " ".join(["lead"] * 30 + changed + ["tail"] * 9)), (2, " ".join(far))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(passage))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["start_word"]) for r in d.contaminated(docs, bench).collect()] == [(1, 7, 30)]


def test_one_index_names_all_items_of_a_size(spark):
    """Items of one size that share most words are all found, each by its own best window."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(40)]
    items = []
    for k in range(12):
        words = list(base)
        for i in rng.sample(range(40), k // 4):
            words[i] = f"x{k}_{i}"
        items.append((k, " ".join(words)))
    docs = []
    for d in range(20):
        words = [f"f{rng.randrange(50)}" for _ in range(rng.randrange(30))] + items[rng.randrange(12)][1].split() + [f"g{d}"] * rng.randrange(5) + base[: rng.randrange(40)]
        docs.append((d, " ".join(words)))
    got = {(r["doc_id"], r["item_id"]) for r in d_.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items) and len(got) > 40


def test_the_index_finds_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(2)
    mine = rng.integers(0, 1 << 63, 50).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 50).astype(np.uint64)
    asked = mine[rng.integers(0, 50, 4000)]
    radii = rng.integers(0, 50, 50)
    for _ in range(26):
        asked = asked ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64))
    i, j, far = d_.HammingIndex(np.arange(50), mine, radii).within(asked)
    plain = np.bitwise_count(asked[:, None] ^ mine[None, :])
    want = np.argwhere(plain <= radii[None, :])
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist())) and (plain[i, j] == far).all()


def test_periodic_items_and_heavy_changes():
    """Windows exactly at the threshold whose shingles repeat: of 3,000 pairs none is lost. So with runs of one new word."""
    rng, lost, farthest = random.Random(8), 0, 0
    for k in range(3000):
        if k % 3:
            base, reach = [f"x{k}", f"y{k}"] * 5, 1
            item, text = base + [f"a{k}"], base + [f"b{k}"]
        else:
            n = rng.choice([30, 60, 120])
            item = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            reach = (n - 4) // 7
            text = item[: n - reach] + ["z"] * reach if k % 2 else ["z"] * reach + item[reach:]
            if k % 9 == 0:  # a document shorter than the item
                n = rng.choice([8, 12, 20, 60])
                item, reach = item[:n], (n - 4) // 4
                text = item[: len(item) - (len(item) - 4) // 4]
        bag, mine = Counter(shingles(item)), Counter(shingles(text))
        assert similar(bag, mine) >= 0.75
        block = d_.BenchmarkBlock([1], [" ".join(item)])
        hits = d_._hits(block, pa.array([" ".join(text)]))
        lost += not hits
        farthest = max(farthest, max((h[2][3] for h in hits), default=0))
    assert lost == 0 and farthest > 26
