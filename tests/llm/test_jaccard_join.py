import os

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from orbweave.llm import jaccard_join as j
from orbweave.llm.components import connected_components
from tests.llm.helpers import SF, blank_words, odd_documents, odd_rows, shingles


def brute(rows):
    sets = [set(shingles(blank_words(t))) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        root = find(k)
        if i is not None:
            least[root] = min(i, least.get(root, i))
    return sorted([(i, len(sets[k]), least.get(find(k), i)) for k, (i, _) in enumerate(rows)], key=str)


def ran(docs):
    return sorted((tuple(r) for r in j.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_odd_documents(spark):
    assert ran(odd_documents(spark)) == brute([(r[0], r[1]) for r in odd_rows()])


def test_small_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert ran(docs) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_chain_of_near_copies_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(j, "TILE_SETS", 4)
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 60])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ran(docs) == brute(rows)


def variants(count):
    """Texts far from each other, and a near copy of each."""
    texts = [" ".join(f"v{k}x{i}" for i in range(40 + k)) for k in range(count)]
    return texts, [t + " end" for t in texts]


def test_one_id_over_several_texts_and_texts_without_id(spark):
    texts, copies = variants(6)
    ids = [5, 5, 5, None, None, None]
    rows = [*zip(ids, texts, strict=True), *((20 + k, t) for k, t in enumerate(copies)), (5, texts[0]), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ran(docs) == brute(rows)
    nameless = [(None, t) for t in (*texts, *copies)]
    rows = [*nameless, (3, texts[1] + " begin")]
    assert ran(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_keep_one_and_empty(spark):
    docs = odd_documents(spark)
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 8 not in ids and 5 in ids
    assert j.keep_one(docs.where("false")).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7)], "a long, b long")
    got = {tuple(r) for r in connected_components(edges).collect()}
    assert got == {(5, 1), (4, 1), (3, 1), (1, 1), (9, 8), (8, 8)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(1, 40), min_size=1, max_size=30), min_size=2, max_size=8))
def test_tile_links_connect_like_all_links(sets):
    arrays = [np.array(sorted(s), dtype=np.uint64) for s in sorted(sets, key=len)]
    n = len(arrays)
    links = j.link_tile(arrays, np.zeros(n, int), np.zeros(n, bool), False)

    def groups(pairs):
        label = list(range(n))
        for a, b in pairs:
            la, lb = label[a], label[b]
            label = [la if x == lb else x for x in label]
        return [[label[i] == label[k] for k in range(n)] for i in range(n)]

    every = [(a, b) for a in range(n) for b in range(a) if 100 * j.overlap(arrays[a], arrays[b]) >= 75 * len(set(arrays[a].tolist()) | set(arrays[b].tolist()))]
    assert groups(links) == groups(every)


def candidate_groups(monkeypatch, tasks, flush):
    """Component of each set after the postings of ``tasks`` (lists of (shingle, set, size)) met in one bucket."""
    monkeypatch.setattr(j, "BUCKET_POSTINGS", flush)
    edges, blobs = [], []
    for task in tasks:
        found, rest = j._shorten(np.array(task, dtype=j._POSTING))
        edges += found.tolist()
        blobs.append(rest.tobytes())
    sent = [pa.record_batch([pa.array([0], pa.int32()), pa.array([b], pa.binary())], names=["bucket", "postings"]) for b in blobs]
    for batch in j._meet(iter(sent)):
        edges += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
    label = {s: s for task in tasks for _, s, _ in task}
    for a, b in edges:
        was, now = label[a], label[b]
        label = {s: now if x == was else x for s, x in label.items()}
    return label


def test_a_size_inside_a_shortened_run_meets_it(monkeypatch):
    tasks = [[(7, k, n) for k, n in enumerate((100, 130, 170, 220, 290))], [(7, 9, 165)]]
    assert len(set(candidate_groups(monkeypatch, tasks, 1 << 20).values())) == 1


def test_shortened_runs_lose_no_compatible_pair(monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(40):
        sets = [(int(rng.integers(3)), k, int(2 ** rng.uniform(0, 12))) for k in range(60)]
        tasks = [sets[k::20] for k in range(20)]
        for flush in (1, 3, 1 << 20):
            label = candidate_groups(monkeypatch, tasks, flush)
            for x, a, n in sets:
                for y, b, m in sets:
                    assert x != y or 100 * n < 75 * m or n > m or label[a] == label[b]


def test_a_run_is_stood_for_by_few_sets():
    _, rest = j._shorten(np.array([(1, k, 1000 + k) for k in range(100_000)], dtype=j._POSTING))
    n = rest["n"].astype(int)
    assert n[0] == 1000 and n[-1] == 100_999 and len(n) < 40 and (100 * n[:-1] >= 75 * n[1:]).all()


def test_sets_that_candidates_join_by_chance_are_parted_before_tiles(spark, monkeypatch):
    """What counters that are all alike do: one component of everything."""
    texts, copies = variants(20)
    rows = list(enumerate([*texts, *copies]))
    ids = [int(s) for _, hashes, first in j.document_sets(pa.array([t for _, t in rows])) for s in j.set_ids(hashes, first)]
    found, real, sizes = [], j.stage, []

    def all_in_one(edges):
        found.append(edges)
        return connected_components(spark.createDataFrame([(s, ids[0]) for s in ids[1:]], "a long, b long") if len(found) == 1 else edges)

    def staged(df, what):
        made = real(df, what)
        if what == "jaccard-tiles":
            sizes.extend(r["n"] for r in made.groupBy("component").agg({"set_id": "count"}).toDF("component", "n").collect())
        return made

    monkeypatch.setattr(j, "TILE_SETS", 4)
    monkeypatch.setattr(j, "connected_components", all_in_one)
    monkeypatch.setattr(j, "stage", staged)
    assert ran(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert sizes == [2] * 20


class Shared:
    def __init__(self, value):
        self.value = value


def test_marks_part_sets_of_one_passage_where_counters_are_alike():
    passage = " ".join(f"p{i}" for i in range(40))
    texts = pa.array([f"{t} {passage}" for t in variants(16)[0]])
    batch = pa.record_batch([texts, pa.array([7] * 16, pa.int64())], names=["text", "component"])
    alike = Shared(np.zeros(1 << j.COUNTER_BITS, np.uint8))

    def pairs(*marks):
        sent = list(j._send(alike, 1, *marks)(iter([batch])))
        sent.sort(key=lambda b: b.column(0)[0].as_py())
        return sum(b.num_rows for b in j._meet(iter(sent)))

    size = (1 << j.BLOCK_BITS) // 8
    bitmap = np.zeros((1 << 20) // 8, np.uint8)
    placed = sorted((r["block"], r["places"]) for b in j._places(20)(iter([batch])) for r in b.to_pylist())
    placed = pa.record_batch([pa.array([b for b, _ in placed], pa.int32()), pa.array([p for _, p in placed], pa.binary())], names=["block", "places"])
    for b in j._repeated(iter([placed])):
        at = b.column(0)[0].as_py()
        bitmap[at * size : (at + 1) * size] = np.frombuffer(b.column(1)[0].as_py(), np.uint8)
    assert pairs() >= 8 and pairs(Shared(bitmap), 20) == 0


def test_counters_pass_what_a_byte_holds():
    counters = j._Counters()
    hashes = np.repeat(np.array([1, 2, 3], np.uint64) << np.uint64(64 - j.COUNTER_BITS), [1, 255, 70_000])
    counters.add(hashes)
    blocks = [pa.record_batch([pa.array([b]), pa.array([c]), pa.array([m])], names=["block", "counts", "beyond"]) for b, c, m in counters.blocks()]
    (made,) = j._sum_blocks(iter([*blocks, *blocks]))
    levels = np.frombuffer(made.column(1)[0].as_py(), np.uint8)
    assert levels[:5].tolist() == [0, *(int(np.ceil(8 * np.log2(1 + 2 * n))) for n in (1, 255, 70_000)), 0]


def test_only_texts_that_are_asked_for_are_fetched(spark):
    texts = spark.range(2000).selectExpr("id as doc_id", "xxhash64(id) as digest", "cast(id as string) as text")
    kept = {r["doc_id"] for r in j._asked_for(texts, texts.where("doc_id % 200 = 0")).collect()}
    assert kept >= set(range(0, 2000, 200)) and len(kept) < 100


def test_components_of_many_tiles_leave_no_texts_and_little_behind(spark, monkeypatch):
    rows = [(k, " ".join(f"w{i}" for i in range(3 * k, 3 * k + 60))) for k in range(40)]
    real, made = j.stage, []

    def staged(df, what):
        made.append((what, real(df, what)))
        return made[-1][1]

    monkeypatch.setattr(j, "TILE_SETS", 4)
    monkeypatch.setattr(j, "stage", staged)
    assert ran(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert "jaccard-wide" in [what for what, _ in made]
    assert all("text" not in df.columns for _, df in made)
    assert {what for what, df in made if os.path.exists(df.staged_at.removeprefix("file:"))} == {"jaccard-rows", "jaccard-sets"}
