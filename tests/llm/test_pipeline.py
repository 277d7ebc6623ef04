import pytest

import corpus_pipeline as c
from orbweave.llm import decontaminate, exact_dedup, jaccard_join, toxicity
from tests.llm.helpers import SF, odd_documents
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard_join import brute as components


def test_stages_against_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels", "benchmark"))
    model = toxicity.fit(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if model.score(r["text"]) < toxicity.THRESHOLD]
    last = {t: max(i for i, x in rows if x == t) for _, t in rows}
    rows = [r for r in rows if last[r[1]] == r[0]]
    alone = {i for i, _, least in components(rows) if i == least}
    rows = [r for r in rows if r[0] in alone]
    bad = {d for d, _ in leaks(rows, [(r["item_id"], r["text"]) for r in bench.collect()])}
    want = sorted(i for i, _ in rows if i not in bad)
    got = c.run(spark, SF)
    assert got.columns == [*docs.columns, "piece_ids"]
    assert sorted(r["doc_id"] for r in got.collect()) == want


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents_pass_every_stage(spark, empty):
    docs = odd_documents(spark).where("false") if empty else odd_documents(spark)
    for k, (_, step) in enumerate(c.STAGES):
        out = step(spark, docs, SF)
        if k < len(c.STAGES) - 1:
            assert out.columns == docs.columns
        assert (out.count() > 0) != empty
        docs = out


def texts(spark, rows):
    return spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long")


def kept(docs):
    return sorted(r["n"] for r in docs.collect())


def test_rows_with_one_id_or_none_are_filtered_by_their_own_text(spark):
    item = " ".join(f"item{i}" for i in range(30))
    docs = texts(spark, [(None, item), (None, "clean words"), (1, item), (1, "other clean words"), (1, None), (2, "a " + item)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert kept(decontaminate.decontaminate(docs, bench)) == [1, 3, 4]
    bad = "you are an " + toxicity.INSULTS[0]
    docs = texts(spark, [(None, bad), (None, "clean words"), (1, bad), (1, "other clean words"), (1, None)])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert kept(toxicity.reject_toxic(docs, labels, docs)) == [1, 3, 4]


def test_deduplicate_keeps_one_row_of_each_text(spark):
    docs = texts(spark, [(1, "a"), (2, "a"), (1, "b"), (None, "a"), (None, "c"), (3, "d"), (3, "d"), (None, "e"), (None, "e"), (3, None), (None, "")])
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == [(0, "c"), (0, "e"), (1, "b"), (2, "a"), (3, ""), (3, "d")]


def test_keep_one_keeps_one_row_of_each_component(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    docs = texts(spark, [(1, a), (2, a + " end"), (2, b), (None, a), (None, c), (None, c + " end"), (4, d), (4, d), (4, d + " end"), (None, None)])
    got = [r["text"] or "" for r in jaccard_join.keep_one(docs).collect()]
    assert sorted(t.removesuffix(" end") for t in got) == ["", a, b, c, d]
