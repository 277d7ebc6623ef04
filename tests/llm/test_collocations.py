"""Collocations against counts of all phrases as strings."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from orbweave.llm import collocations as co
from tests.llm.helpers import SF, lower, odd_rows

SCHEMA = "doc_id long, text string, lang string, rank string, a int, id int"


def plain(rows, least, longest=4, subsumed=80, top=2000):
    counts, out = defaultdict(Counter), set()
    for text, lang in rows:
        own = counts["und" if lang is None else lang]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            own.update(tuple(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        found = []
        for p, a in candidates.items():
            if 100 * longer[p] < subsumed * a:
                score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        n = sum(a for p, a in own.items() if len(p) == 1)
        out |= {(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}
    return out


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def rows_of(seed, n=300):
    draw = random.Random(seed)
    few = ["the", "The", "of", "a", "new", "york", "Ünï", "ß", "\x00", "x" * 300, "it's", "漢字"]
    rows = []
    for _ in range(n):
        ws = [draw.choice(few) if draw.random() < 0.8 else f"w{draw.randrange(500)}" for _ in range(draw.randrange(40))]
        if draw.random() < 0.4:
            ws[len(ws) // 2 : len(ws) // 2] = ["in", "the", "city", "of"]
        text = "".join(x + draw.choice([" "] * 8 + ["\t", ", ", ".", "\n", "\x0b", "  "]) for x in ws)
        rows.append((text, draw.choice(["en", "en", "en", None, "und", ""])))
    return rows + [(None, "en"), ("", None), (" , .", "xx")]


def test_against_plain_counts(spark):
    rows = rows_of(1)
    df = spark.createDataFrame([(i, t, lang, "clash", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(5)
    for least, subsumed, top in ((3, 80, 2000), (2, 50, 7), (30, 80, 2000)):
        assert found(co.collocations(df, least=least, subsumed=subsumed, top=top)) == plain(rows, least, subsumed=subsumed, top=top)
    assert found(co.collocations(df, least=4, longest=6)) == plain(rows, 4, longest=6)


def test_one_phrase_and_rows_that_repeat(spark):
    """A third of all rows is one text; overlapping occurrences count."""
    rows = [("a a a a a", "en")] * 50 + [("b c", "en")] * 100
    df = spark.createDataFrame([(1, t, lang, None, None, None) for t, lang in rows], SCHEMA).repartition(7)
    got = found(co.collocations(df))
    assert got == plain(rows, 30)
    assert ("en", 1, "b c", 100, 100, 100, 450, 1_000_000) in got
    assert {r[2]: r[3] for r in got} == {"b c": 100, "a a": 200, "a a a": 150, "a a a a": 100}


def test_odd_documents_and_table(spark):
    odd = [(r[0], r[1], r[2], "clash", 1, 1) for r in odd_rows()]
    df = spark.createDataFrame(odd, SCHEMA)
    assert found(co.collocations(df, least=2)) == plain([(r[1], r[2]) for r in odd], 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(co.op11_collocations(spark, SF)) == plain([(r.text, r.lang) for r in docs.select("text", "lang").collect()], 30)


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_keep_what_they_pack():
    import numpy as np

    keys = np.sort(np.array([3, 1 << 63, (1 << 64) - 1, 0, 77], dtype=np.uint64))
    assert co._unpack_sorted(co._pack_sorted(keys)).tolist() == keys.tolist()
    assert co._unpack(co._pack(np.zeros(0, "<u4")), "<u4").tolist() == []
