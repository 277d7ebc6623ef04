"""Packing: exact pieces, whole sequences, little padding, and the plan against all plans."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from orbweave.llm import packing
from tests.llm.helpers import SF, odd_documents, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def document_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, wanted):
    """``rows``: pieces as dicts; ``wanted``: (doc_id, ids) of all rows. Gives the share of padding."""
    left = {}
    for doc_id, ids in wanted:
        left.setdefault(doc_id, []).append(ids)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for (doc_id, n), found in pieces.items():
        same = [ids for ids in left[doc_id] if len(ids) == n]
        assert sum(r["length"] for r in found) == n * len(same)
        for ids in same:
            raw = np.array(ids, "<u4")
            starts = sorted((r["start"], r["length"]) for r in found)
            if len(same) == 1:
                assert starts[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(starts, starts[1:], strict=False))
        crcs = {zlib.crc32(raw[a : a + b].tobytes()) for ids in same for raw in [np.array(ids, "<u4")] for a, b in {(r["start"], r["length"]) for r in found}}
        assert {r["ids_crc32"] for r in found} <= crcs
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in wanted)
    padding = 0
    for found in sequences.values():
        found.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in found] == np.cumsum([0, *(r["length"] for r in found)])[:-1].tolist()
        total = sum(r["length"] for r in found)
        assert 0 < total <= 4096
        padding += 0 if total & (total - 1) == 0 else 4096 - total
    return padding / sum(len(ids) for _, ids in wanted)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = [r.asDict() for r in packing.op13_packing(spark, SF).collect()]
    assert check(rows, [(d, document_ids(tokenizer, t)) for d, t in docs]) < 0.02


def test_odd_documents(spark, tokenizer):
    df = odd_documents(spark).repartition(3)
    rows = [r.asDict() for r in packing.pack(df, PATH, digest_only=True).collect()]
    check(rows, [(r[0], document_ids(tokenizer, r[1])) for r in odd_rows()])
    again = packing.pack(df, PATH).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) in {x["ids_crc32"] for x in rows if x["doc_id"] == r.doc_id} for r in again if r.doc_id != 2)
    empty = packing.pack(df.where("false"), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def test_rows_that_repeat_go_to_several_tasks(spark, tokenizer):
    text = "One sentence here. Another one, longer than that! " * 40
    df = spark.createDataFrame([(7, text)] * 400 + [(i, f"text {i}.") for i in range(20)], "doc_id long, text string").repartition(8)
    rows = [r.asDict() for r in packing.pack(df, PATH, digest_only=True).collect()]
    assert len({r["sequence_id"] >> 40 for r in rows if r["doc_id"] == 7}) > 2
    check(rows, [(7, document_ids(tokenizer, text))] * 400 + [(i, document_ids(tokenizer, f"text {i}.")) for i in range(20) if i != 7] + [(7, document_ids(tokenizer, "text 7."))])


def test_ids_equal_the_library(tokenizer):
    own = packing.Encoder(PATH)
    texts = [r[1] or "" for r in odd_rows()] + ["It's WE'LL 'TIS don't 1234 a1b2 ..!? (end.) \"so.\"", "ÀÉÎ Öß × ÷ ſ ŉ İ ı ĸ", "café ﬁ ½ ² ª º", "x<|endoftext|>y", "  z\u0085", "日本語。テスト！", "’s ‘t", "'S 'LL"]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_plan_against_all_plans(monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 16)
    monkeypatch.setattr(packing, "BARE", (4, 8))
    draw = np.random.default_rng(2)
    for _ in range(200):
        at = np.concatenate([[0], np.cumsum(draw.integers(1, 9, draw.integers(1, 14)))])
        cost = np.concatenate([[0], draw.choice([0, 2, 5], len(at) - 1)])
        best = {0: 0}
        for j in range(1, len(at)):  # every window that may end here, by its definition
            ways = [best[i] + (0 if at[j] - at[i] in (4, 8, 16) else 16 - (at[j] - at[i])) for i in range(j) if at[j] - at[i] <= 16]
            best[j] = min(ways) + cost[j]
        least, _ = packing.plan(at, cost)
        assert least.tolist() == [best[j] for j in range(len(at))]
        cuts = packing.windows(at, cost, to_end=True)
        paid = sum((0 if b - a in (4, 8, 16) else 16 - (b - a)) + cost[np.searchsorted(at, b)] for a, b in zip(cuts, cuts[1:], strict=False))
        assert paid == best[len(at) - 1] and cuts[-1] == at[-1]


def test_penalties_keep_sentences_and_documents_whole():
    """A window ends after the document that nearly fills it, not in the next one's sentence."""
    at, cost = packing.places(np.array([5] * 4090 + [9] * 4096), np.array([4090, 8186]), np.zeros(10, bool))
    assert packing.windows(at, cost, to_end=True).tolist() == [0, 4090, 8186]
    ends = np.zeros(10, bool)
    ends[7] = True
    ids = np.array(([5] * 15 + [7]) * 600)
    at, cost = packing.places(ids, np.array([len(ids)]), ends)
    assert set(at.tolist()) == {16 * i for i in range(601)}
    sizes = np.diff(packing.windows(at, cost, to_end=True)).tolist()
    assert sorted(sizes) == [512, 1024, 3968, 4096]  # 128 of padding and three cuts, where [4096, 4096, 1408] would pad 2,688
