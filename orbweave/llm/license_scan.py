"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is every run of a template's ``span`` consecutive words of a document, at every place and across all line
breaks; the span is the template's number of words and half as many again (four at least). The join finds every block that holds at least
``THRESHOLD`` of a template's distinct words. Words outside all templates never add to an overlap, so a block is
its set of template words, in one global order (rarest in the corpus first, counted over all documents). Filters
that lose nothing come before the exact overlap:

* prefix: a block that reaches the threshold holds one of a template's first n - need + 1 words;
* length: it holds at least ``need`` template words;
* position: at a shared word, the words that follow on both sides bound what the overlap can still become.

They are put to tiles first: templates with spans of up to 2^k words share tiles of 2^(k+1) words that overlap by half, so
that every block is whole in a tile, whatever a template's length. A tile that a template can reach is then gone
through word by word, with a sliding count of the template's distinct words, which gives every block's exact overlap.
"""

from __future__ import annotations

from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import words as w
from orbweave.llm.shared import table, whole_text

THRESHOLD = (9, 10)  # of a template's distinct words

# Phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# License notices, as words of the normalised text, with their labels.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "redistribute it and or modify it under the terms of the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("all-rights-reserved", "all rights reserved"),
)

_MATCHES = "array<struct<template:int,label:string,line:long,first_word:long,last_word:long,overlap:int,containment:double>>"
_SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, matches {_MATCHES}"


def text_words(texts: list[str]) -> w.Words:
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    return w.split_words(data, offsets, w.LETTERS_DIGITS)


def normalised(templates) -> tuple[tuple[str, str], ...]:
    """Templates (label, text) with their words in the documents' form; those without words go."""
    found = []
    for label, text in templates:
        ws = text_words([text])
        found.append((label, " ".join(ws.text(i) for i in range(len(ws.starts)))))
    return tuple(t for t in found if t[1])


class Vocabulary:
    """The templates' words by hash, each with a number."""

    def __init__(self, templates=TEMPLATES):
        self.names = sorted({x for _, t in templates for x in t.split()})
        ws = text_words([x + " " for x in self.names])
        order = np.argsort(ws.hashes) if self.names else np.zeros(0, dtype=np.int64)
        self.hashes, self.number = ws.hashes[order], order.astype(np.int64)
        self.table = np.zeros(1 << 16, dtype=bool)
        self.table[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, ws: w.Words) -> tuple[np.ndarray, np.ndarray]:
        """(word index, number) of all template words of a slice; equal hashes are checked as text."""
        at = np.flatnonzero(self.table[(ws.hashes >> np.uint64(48)).astype(np.int64)])
        if not len(at):
            return at, at
        k = np.searchsorted(self.hashes, ws.hashes[at])
        k[k == len(self.hashes)] = 0
        same = self.hashes[k] == ws.hashes[at]
        at, number = at[same], self.number[k[same]]
        size = np.array([len(x.encode()) for x in self.names])
        ok = (ws.ends - ws.starts)[at] == size[number]
        return at[ok], number[ok]


@dataclass
class Template:
    label: str
    members: np.ndarray  # ranks of its words, ascending: the rarest first
    need: int
    span: int  # words of a block


class Tiles:
    """Templates that share a length of tiles, with an inverted index over their prefixes."""

    def __init__(self, step: int, words: int):
        self.step, self.templates = step, {}
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.member, self.prefix = np.zeros(words, dtype=bool), np.zeros(words, dtype=bool)  # by rank

    def add(self, number: int, template: Template) -> None:
        self.templates[number] = template
        self.member[template.members] = True
        for i, r in enumerate(template.members[: len(template.members) - template.need + 1].tolist()):
            self.postings[r].append((number, i))
            self.prefix[r] = True

    def reachable(self, tile: np.ndarray) -> list[int]:
        """Templates that a tile (its ranks, ascending and distinct) reaches."""
        shared: dict[int, int] = defaultdict(int)
        dead = set()
        for j, r in enumerate(tile.tolist()):
            for t, i in self.postings.get(r, ()):
                template = self.templates[t]
                rest = min(len(template.members) - i, len(tile) - j)
                if len(tile) < template.need or shared[t] + rest < template.need:
                    dead.add(t)
                shared[t] += 1
        own = [(t, self.templates[t]) for t in sorted(set(shared) - dead)]
        return [t for t, x in own if int(np.isin(x.members, tile, assume_unique=True).sum()) >= x.need]


class Index:
    """Templates in the corpus-wide order of words, by the length of their tiles."""

    def __init__(self, counts: dict[int, int], templates=TEMPLATES):
        self.vocabulary = Vocabulary(templates)
        names = self.vocabulary.names
        order = sorted(range(len(names)), key=lambda i: (counts.get(i, 0), names[i]))
        self.rank = np.zeros(len(names), dtype=np.int64)
        self.rank[order] = np.arange(len(names))
        number = {x: i for i, x in enumerate(names)}
        self.templates, tiles = [], {}
        for t, (label, text) in enumerate(templates):
            words = text.split()
            members = np.unique(self.rank[[number[x] for x in words]])
            need, span = -(-len(members) * THRESHOLD[0] // THRESHOLD[1]), len(words) + max(len(words) // 2, 4)
            self.templates.append(Template(label, members, need, span))
            step = 1 << (span - 1).bit_length()
            tiles.setdefault(step, Tiles(step, len(names))).add(t, self.templates[-1])
        self.tiles = [tiles[k] for k in sorted(tiles)]


def _count(templates):
    """How often the partition has each template word: at most one row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(templates)
        total = np.zeros(len(vocabulary.names), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in w.slices(batch.column(0)):
                _, number = vocabulary.find(w.split_words(data, offsets, w.LETTERS_DIGITS))
                total += np.bincount(number, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["word", "n"])

    return run


def phrase_places(ws: w.Words, phrase: str) -> np.ndarray:
    """Indices of words where the phrase's words stand consecutively within one document."""
    names = phrase.split()
    wanted = text_words([x + " " for x in names]).hashes
    last = len(ws.hashes) - len(names) + 1
    if last <= 0:
        return np.zeros(0, np.int64)
    hit = ws.hashes[:last] == wanted[0]
    for k in range(1, len(names)):
        hit &= ws.hashes[k : last + k] == wanted[k]
    at = np.flatnonzero(hit)
    doc = np.searchsorted(ws.first, at, "right") - 1
    at = at[at + len(names) <= ws.first[doc + 1]]
    return np.array([i for i in at.tolist() if all(ws.text(i + k) == x for k, x in enumerate(names))], dtype=np.int64)


def _blocks(template: Template, at: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first and last template word, overlap) of the runs within ``span`` words that reach a template, for each of its words as the last.

    ``at``: places of template words in a tile, ascending.
    """
    own = np.isin(rank, template.members, assume_unique=False)
    places, counts, low, distinct = at[own].tolist(), defaultdict(int), 0, 0
    ranks = rank[own].tolist()
    for k, (place, r) in enumerate(zip(places, ranks, strict=True)):
        counts[r] += 1
        distinct += counts[r] == 1
        while places[low] <= place - template.span:
            counts[ranks[low]] -= 1
            distinct -= counts[ranks[low]] == 0
            low += 1
        while counts[ranks[low]] > 1:  # a later one stands for it
            counts[ranks[low]] -= 1
            low += 1
        if distinct >= template.need:
            yield places[low], places[k], distinct


def _candidates(tiles: Tiles, begins: np.ndarray, at: np.ndarray, rank: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(template, places, ranks) of the tiles that a template reaches. ``begins``: where documents begin."""
    own = np.flatnonzero(tiles.member[rank])
    at, rank = at[own], rank[own]
    doc = np.searchsorted(begins, at, "right") - 1
    cell = (at - begins[doc]) // tiles.step
    where = np.concatenate([np.arange(len(at)), np.flatnonzero(cell > 0)])
    tile = np.concatenate([cell, cell[cell > 0] - 1])
    order = np.lexsort((where, tile, doc[where]))
    where, tile = where[order], tile[order]
    head = doc[where]
    cut = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (tile[1:] != tile[:-1])]))
    if not len(where):
        return
    ends = np.append(cut[1:], len(where))
    able = (np.add.reduceat(tiles.prefix[rank[where]].astype(np.int64), cut) > 0) & (ends - cut >= min(t.need for t in tiles.templates.values()))
    for lo, hi in zip(cut[able].tolist(), ends[able].tolist(), strict=True):
        inside = where[lo:hi]
        for t in tiles.reachable(np.unique(rank[inside])):
            yield t, at[inside], rank[inside]


def block_matches(index: Index, ws: w.Words) -> list[tuple[int, dict]]:
    """(document, match) of all blocks of a slice; of blocks that share words the best is kept."""
    at, number = index.vocabulary.find(ws)
    if not len(at):
        return []
    rank, begins = index.rank[number], ws.first[:-1]
    blocks: dict[tuple[int, int], set[tuple[int, int, int]]] = defaultdict(set)
    for tiles in index.tiles:
        for t, places, ranks in _candidates(tiles, begins, at, rank):
            doc = int(np.searchsorted(begins, places[0], "right")) - 1
            blocks[doc, t].update(_blocks(index.templates[t], places, ranks))
    breaks = np.concatenate([[0], np.cumsum(ws.low == 0x0A)])
    out = []
    for (doc, t), found in blocks.items():
        template, kept = index.templates[t], []
        for overlap, size, first in sorted((-overlap, last - first, first) for first, last, overlap in found):
            k = bisect(kept, (first + size, len(ws.starts), 0))  # what is kept begins no later than this one ends
            if not k or kept[k - 1][1] < first:
                kept.insert(k, (first, first + size, -overlap))
        for first, last, overlap in kept:
            line = int(breaks[ws.starts[first]] - breaks[ws.starts[ws.first[doc]]])
            out.append((doc, first, {"template": t, "label": template.label, "line": line, "first_word": int(first - ws.first[doc]), "last_word": int(last - ws.first[doc]), "overlap": overlap, "containment": overlap / len(template.members)}))
    return [(doc, m) for doc, _, m in sorted(out, key=lambda x: (x[0], x[1], x[2]["template"]))]


def _scan(shared_index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared_index
        for batch in batches:
            for i, j, data, offsets in w.slices(batch.column(1)):
                ws = w.split_words(data, offsets, w.LETTERS_DIGITS)
                places: dict[int, list[int]] = defaultdict(list)
                labels: dict[int, set[str]] = defaultdict(set)
                for phrase, label in PHRASES.items():
                    at = phrase_places(ws, phrase)
                    for d, k in zip((np.searchsorted(ws.first, at, "right") - 1).tolist(), at.tolist(), strict=True):
                        places[d].append(k - int(ws.first[d]))
                        labels[d].add(label)
                matches: dict[int, list[dict]] = defaultdict(list)
                for d, m in block_matches(index, ws):
                    matches[d].append(m)
                n = j - i
                yield pa.record_batch(
                    [
                        batch.column(0).slice(i, n),
                        pa.array(np.diff(ws.first), pa.int64()),
                        pa.array([len(places[d]) if d in places else 0 for d in range(n)], pa.int64()),
                        pa.array([min(places[d]) if d in places else None for d in range(n)], pa.int64()),
                        pa.array([max(places[d]) if d in places else None for d in range(n)], pa.int64()),
                        pa.array([sorted(labels[d]) if d in labels else [] for d in range(n)], pa.list_(pa.string())),
                        pa.array([matches.get(d, []) for d in range(n)], pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("line", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("overlap", pa.int32()), ("containment", pa.float64())]))),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "matches"],
                )

    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, matches.

    ``templates``: (label, text) of the notices to join with, a list that fits the driver and every task.

    ``matches`` lists the blocks that hold at least THRESHOLD of a template's words: template, label, line (of the block's
    first template word; a document's first word is in line 0), first_word and last_word (its first and last template
    word), overlap and containment. Templates may have any length. Of blocks of one template that share words the best
    is kept (the shortest and first of equal ones), and none that shares a word with it. Null and empty texts have no words and no matches; null and
    repeated doc_ids keep their rows; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    templates = normalised(templates)
    counts = texts.select("text").mapInArrow(_count(templates), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    index = Index({r["word"]: r["n"] for r in counts.collect()}, templates)  # one row for each template word
    return texts.mapInArrow(_scan(index), _SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and template labels of every document."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base, own = F.col("base_labels"), F.transform("matches", lambda m: m["label"])
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"),
    )
