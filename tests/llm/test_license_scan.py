import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from orbweave.llm import license_scan as s
from tests.llm.helpers import SF, lower, odd_documents, plain_words


def brute_blocks(text, templates=s.TEMPLATES):
    """Template -> best containment over every run of its span's words, at every place of the whole text."""
    have, best = plain_words(text), {}
    for t, (_, template) in enumerate(templates):
        words = template.split()
        members, span = set(words), len(words) + max(len(words) // 2, 4)
        most = max((len(members.intersection(have[i : i + span])) for i in range(len(have))), default=0)
        if 10 * most >= 9 * len(members):
            best[t] = most / len(members)
    return best


def brute(text):
    words = plain_words(text)
    places, base = [], set()
    for phrase, label in s.PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        base |= {label} if at else set()
    labels = base | {s.TEMPLATES[t][0] for t in brute_blocks(text)}
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


def rows(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = s.op5_license_scan(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return sorted([tuple(r)[:7] for r in got.collect()], key=str), [r["score"] for r in got.collect()]


def test_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionAll(odd_documents(spark).select("doc_id", "text"))
    got, scores = rows(spark, docs, tmp_path)
    assert got == sorted([(r["doc_id"], *brute(r["text"])) for r in docs.collect()], key=str)
    assert all(0 <= x <= 1 for x in scores) and any(g[6] != g[5] for g in got)


def test_blocks(spark, tmp_path):
    filler = " ".join(f"w{i}" for i in range(500))
    texts = [
        f"{filler} permission is hereby granted free of charge to any person obtaining a copy of the software and associated documentation files {filler}",
        "permission is hereby granted free of charge to any animal obtaining a copy of any software and other documentation files",
        "the license version 2 is\nlicensed under\nthe apache thing", "All\nrights\nreserved", "all rights reserved\n" * 3, f"all {filler} rights {filler} reserved", None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, _ = rows(spark, docs, tmp_path)
    assert got == sorted([(i, *brute(t)) for i, t in enumerate(texts)], key=str)
    assert [g[6] for g in got] == ["mit", "", "", "all-rights-reserved", "all-rights-reserved", "", "", ""]


def test_rare_words_come_first():
    counts = Counter(range(5))
    index = s.Index({**counts, 0: 10})
    for t in index.templates:
        assert (sorted(t.members) == t.members).all() and t.need <= len(t.members)
    assert all(re.fullmatch(r"[a-z0-9 ]+", text) for _, text in s.TEMPLATES)


def test_empty_table(spark):
    assert s.scan_licenses(odd_documents(spark).where("false")).collect() == []


def found_blocks(texts, templates=s.TEMPLATES):
    out = [{} for _ in texts]
    index = s.Index({}, templates)
    for i, _, data, offsets in s.w.slices(pa.array(texts)):
        for d, m in s.block_matches(index, s.w.split_words(data, offsets, s.w.LETTERS_DIGITS)):
            out[i + d][m["template"]] = max(out[i + d].get(m["template"], 0), m["containment"])
    return out


WRAPPED = [
    ("mit", "Copyright (c) 2020\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"),
    ("bsd", "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"),
    ("apache-2", "   you may not use this file except in compliance with the License.\n   You may obtain a copy of the License at\n\n       http://www.apache.org/licenses/LICENSE-2.0"),
    ("all-rights-reserved", "All rights\nreserved"),
]


def test_wrapped_notices(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(WRAPPED)], "doc_id long, text string")
    got, _ = rows(spark, docs, tmp_path)
    assert [label in g[6].split(",") for (label, _), g in zip(WRAPPED, got, strict=True)] == [True] * 4


def test_every_passage_once():
    mit = s.TEMPLATES[1][1].split()
    text = " ".join(["x"] * 110 + mit + ["x"] * 3 + mit + ["x"] * 300 + mit[:-1])
    ((_, _, data, offsets),) = s.w.slices(pa.array([text]))
    got = [m for _, m in s.block_matches(s.Index({}), s.w.split_words(data, offsets, s.w.LETTERS_DIGITS)) if m["template"] == 1]
    assert [(m["first_word"], m["last_word"]) for m in got][::2] == [(110, 109 + len(mit)), (110 + 2 * len(mit) + 303, 110 + 3 * len(mit) + 301)]


def test_templates_of_any_length_at_any_place():
    """One-line notices, notices with a word a line, and such with other words between, at every offset."""
    draw = random.Random(5)
    for size in (1, 2, 3, 20, 82, 96, 128, 150, 400):
        template = [("t", " ".join(f"term{i}" for i in range(size)))]
        words = template[0][1].split()
        texts = []
        for offset in [*range(0, 300, 7), 100, 127, 128]:
            said = [x for x in words for x in ([x, "other"] if size > 3 and draw.random() < 0.3 else [x])]
            texts.append(draw.choice([" ", "\n"]).join(["x"] * offset + said + ["y"] * draw.randrange(200)))
        got = found_blocks(texts, template)
        assert got == [brute_blocks(t, template) for t in texts] and all(got)
        lost = [x for x in words if draw.random() < 0.8]
        assert found_blocks([" ".join(lost)], template) == [brute_blocks(" ".join(lost), template)]


def test_repeated_template_words():
    templates = [("a", "of the of the of the end"), ("b", "the the the"), ("c", "end of")]
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["of", "the", "end", "x"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    assert found_blocks(texts, templates) == [brute_blocks(t, templates) for t in texts]


def test_blocks_against_brute_force():
    rng, texts = random.Random(3), []
    for _ in range(150):
        words = []
        for _ in range(rng.randint(1, 6)):
            words += ["filler"] * rng.choice([0, 1, 5, 60, 130])
            words += [x for x in rng.choice(s.TEMPLATES)[1].split() if rng.random() < 0.97]
        wrap = rng.choice([0, 0.02, 0.1, 0.5, 0.9])
        texts.append("".join(x + ("\n" if rng.random() < wrap else " ") for x in words))
    got = found_blocks(["", *texts, "\n"])
    want = [brute_blocks(t) for t in ["", *texts, "\n"]]
    assert got == want and np.mean([bool(x) for x in want]) > 0.5


def test_templates_are_a_parameter(spark):
    docs = spark.createDataFrame([(1, "Free for all; even for Cats and dogs alike."), (2, "all rights reserved")], "doc_id long, text string")
    got = {r["doc_id"]: [m["label"] for m in r["matches"]] for r in s.scan_licenses(docs, [("pets", "EVEN for cats, and dogs!"), ("none", " - ")]).collect()}
    assert got == {1: ["pets"], 2: []}
    assert all(r["matches"] == [] for r in s.scan_licenses(docs, []).collect())
