import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orbweave.llm import token_files as t
from orbweave.llm.shared import shared_folder
from tests.llm.helpers import SF, odd_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=1500))
def test_wavelet_matrix_against_the_list(values):
    m = t.WaveletMatrix.build(np.array(values, dtype=np.uint32), 6)
    assert m.decode().tolist() == values
    for i in range(0, len(values), 37):
        assert m.access(i) == values[i]
    for v in (0, 1, 17, 63, 64):
        lo, hi = len(values) // 4, len(values) - len(values) // 8
        assert m.count(v) == values.count(v) and m.count(v, lo, hi) == values[lo:hi].count(v)
        assert m.occurrences(v) == [i for i, x in enumerate(values) if x == v]


def check(spark, docs, monkeypatch=None):
    path = shared_folder(spark, "tokens")
    t.write_token_files(docs, path, PATH, 50_257)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids"]) for r in t.read_documents(spark, path).collect())
    tokenizer, at = Tokenizer.from_file(PATH), 0
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append([*tokenizer.encode(text, add_special_tokens=False).ids, 0])
    assert [g[1] for g in got] == sorted((i for i, _ in rows), key=lambda x: (x is not None, x or 0))
    for start, i, n, ids in got:
        assert start == at and n == len(ids) and ids in want[i]
        want[i].remove(ids)
        at += n
    digests = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in t.read_documents(spark, path, digest_only=True).collect()}
    assert digests == {(i, start): zlib.crc32(np.array(ids, "<u4").tobytes()) for start, i, _, ids in got}
    return path


def test_round_trip(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = check(spark, docs)
    row = t.read_segments(spark, path).first()
    m = t.matrix_of(row)
    ids = m.decode().tolist()
    assert m.occurrences(0) == [i for i, x in enumerate(ids) if x == 0] and m.access(5) == ids[5]


def test_odd_documents_and_empty(spark):
    docs = odd_documents(spark)
    check(spark, docs)
    path = shared_folder(spark, "tokens")
    t.write_token_files(docs.where("false"), path, PATH, 50_257)
    assert t.read_documents(spark, path).collect() == []
