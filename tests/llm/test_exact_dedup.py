import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from orbweave.llm import exact_dedup as e
from tests.llm.helpers import odd_documents, odd_rows


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_documents_and_colliding_keys(spark):
    docs = odd_documents(spark)
    want = brute([(r[0], r[1]) for r in odd_rows()])
    for bits in (64, 2):
        got = e.exact_duplicates(docs, key_bits=bits, capacity=2)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_chains_hold_colliding_texts(spark):
    index = e.build_index(odd_documents(spark), key_bits=1)
    assert index.agg({"chain": "max"}).first()[0] > 2


def test_deduplicate_keeps_columns(spark):
    docs = odd_documents(spark)
    kept = e.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {1, 10} & {r["doc_id"] for r in kept.collect()} == {10}
    empty = docs.where("false")
    assert e.deduplicate(empty).collect() == [] and e.exact_duplicates(empty).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=16, max_size=16), st.integers(1, 30))
def test_directory_covers_and_splits(counts, capacity):
    directory = e.grow_directory(np.array(counts), capacity)
    width = 16 // len(directory)
    assert (np.diff(directory) >= 0).all() and (np.diff(directory) <= 1).all()
    for b in set(directory.tolist()):
        at = np.flatnonzero(directory == b)
        inside = sum(sum(counts[i * width : (i + 1) * width]) for i in at)
        assert inside <= capacity or (width == 1 and len(at) == 1)


def test_look_ups_of_heavy_and_null_keys(spark):
    """Every row finds its key's entry once, whether its key is rare, heavy, null or not there."""
    from orbweave.llm.shared import look_up

    rows = [(i, "hot" if i % 2 else f"k{i}") for i in range(4000)] + [(None, "hot"), (None, None), (4001, None), (4002, "absent")]
    df = spark.createDataFrame(rows, "doc_id long, key string").repartition(5)
    sizes = df.where("key is not null and key != 'absent'").groupBy("key").count().withColumnRenamed("count", "size").selectExpr("key", "size", "concat(key, '!') as said")
    got = look_up(df, sizes, "key", "size", "doc_id")
    assert got.columns == ["doc_id", "key", "size", "said"]
    found = sorted(((r["doc_id"] or -1, r["key"] or "", r["said"]) for r in got.collect()), key=str)
    assert found == sorted(((i or -1, k or "", f"{k}!" if k and k != "absent" else None) for i, k in rows), key=str)
    assert look_up(df.where("false"), sizes.where("false"), "key", "size", "doc_id").collect() == []
