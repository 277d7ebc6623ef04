"""Toxicity scores from a weighted finite-state pattern grammar.

A text is cut into clauses and each word becomes a symbol by a lexicon; insults come in three grades. Five small
weighted transducers, written down as arcs, rewrite the sequence of symbols one after the other:

* negation: an insult or threat within reach after a negation is read as negated, or as not meant by it;
* report: if the clause holds a word of reporting, before or after, it is read as told, or not;
* target: if the clause holds somebody to aim at, before or after, it is read as aimed, or not;
* threat: keeps threats that are read as aimed and lets the others pass for plain words;
* insult: ends the chain: each insult and threat left is live, and written as a reading, or lapses.

They are composed by product construction into one machine. "Before or after" makes two of them guess, and only
the right guess ends in a final state; each choice of reading is an arc with a weight of its own: for a negation by its
distance, for reports and targets by their side, for a live reading by its grade and marks. So a clause has many
accepted paths, and with the weights as log odds each is a share of them all. A clause is toxic with the share of the paths that
hold a live reading, a document if one of its clauses is, or by a small chance of its own: 1 - (1 - leak) * product of
(1 - share). The best path gives a clause's readings. Weights are fitted to the labels by maximum likelihood, with the paths as
latent variables, and drawn to starting values (fixed, and used as they are where there are no labels).

The lexicon comes from small fixed lists and from the labels: words, word beginnings and word endings that set
toxic documents apart are taken greedily while each explains documents that the ones before do not.
"""

from __future__ import annotations

import heapq
import json
import re
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, cached_property
from math import exp, inf, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import words as w
from orbweave.llm.memory import trimmed
from orbweave.llm.shared import stage, table, whole_text

THRESHOLD = 0.3
FIT_ROWS = 8_000  # bound of the labelled sample that the model is fitted on
LEAST_SUPPORT, LEAST_PRECISION = 5, 0.9
STEM_BYTES = (3, 4, 5, 6, 7, 8, 9)
TWICE = "\x02"  # before a terminal that counts only where two different words of a document match it

# Starting lists of the grammar (English, French, German, Spanish).
INSULTS = "idiot moron imbecile scumbag dumbass asshole bastard crétin connard salaud trottel vollidiot arschloch imbécil pendejo cabrón".split()
THREATS = "kill murder strangle tuerai étrangler umbringen töten mataré".split()
TARGETS = "you your yours he she him her they them this these toi vous lui eux elle du dich dir ihr euch er sie tú ti usted ustedes él ella ellos".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't pas jamais nicht kein keine nie nunca tampoco".split()
REPORTS = "said says wrote claimed quoted called dit écrit affirme sagte sagt schrieb behauptete dijo dice escribió afirmó".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, WORD = "insult", "threat", "target", "negation", "report", "word"
GRADES = (0.0, 3.0, 4.5)  # least log odds of a term that sets toxic documents apart, for each grade of insult
INSULTING = tuple(f"{INSULT} {k + 1}" for k in range(len(GRADES)))
HOT = (*INSULTING, THREAT)
SYMBOLS = (*HOT, TARGET, NEGATION, REPORT, WORD)
NEGATED, TOLD, AIMED = "not", "told", "aimed"  # marks that follow a symbol
NEGATION_REACH = 3
_CLAUSE = re.compile(r"[.!?;:|\n]+")
_WORD = re.compile(r"[^\x00-\x26\x28-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_BYTES = w.LETTERS_DIGITS.copy()  # the same words over bytes; both lose apostrophes at their ends
WORD_BYTES[0x27] = True
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Starting values of the arcs' weights, by name, and of the leak (its log odds, nearly).
START_WEIGHTS = {
    "not:1": 4.0, "not:2": 3.5, "not:3": 2.0, "told:earlier": 2.5, "told:later": 2.0, "aimed:earlier": 1.0, "aimed:later": 0.5,
    "live insult 1": 0.0, "live insult 2": 1.0, "live insult 3": 2.0, "live threat": 1.0, "live not": -4.0, "live told": -3.0, "live aimed": 1.0, "leak": -3.0,
}
_MEMO, _TERM_MEMO = 50_000, 10_000  # words and clauses whose symbols and sums, and words whose terms, a task remembers


def _log_add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -inf else a + log1p(exp(b - a))


@dataclass(frozen=True)
class Transducer:
    """A weighted finite-state transducer: arcs (state, input) -> [(next state, output, weight)], final weights by state.

    A weight is a number, or a tuple of names of numbers, which ``weighed`` adds up.
    """

    starts: tuple
    arcs: dict
    final: dict

    def compose(self, other: Transducer) -> Transducer:
        """What reads as this one reads, and writes what ``other`` makes of this one's output: the product of both."""
        starts = tuple((p, q) for p in self.starts for q in other.starts)
        by_state: dict = defaultdict(list)
        for (p, x), out in self.arcs.items():
            by_state[p].append((x, out))
        arcs, todo, seen = {}, list(starts), set(starts)
        while todo:
            p, q = at = todo.pop()
            for x, out in by_state[p]:
                made = [((p2, q2), z, a + b) for p2, y, a in out for q2, z, b in other.arcs.get((q, y), ())]
                if made:
                    arcs[at, x] = made
                for to, _, _ in made:
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
        final = {(p, q): self.final[p] + other.final[q] for p, q in seen if p in self.final and q in other.final}
        return Transducer(starts, arcs, final)

    def trim(self) -> Transducer:
        """The same machine with numbered states, without those from which no final one can be reached."""
        back: dict = defaultdict(set)
        for (p, _), out in self.arcs.items():
            for to, _, _ in out:
                back[to].add(p)
        alive, todo = set(self.final), list(self.final)
        while todo:
            for p in back[todo.pop()] - alive:
                alive.add(p)
                todo.append(p)
        number = {p: i for i, p in enumerate(sorted(alive, key=repr))}
        arcs = {(number[p], x): [(number[to], y, a) for to, y, a in out if to in alive] for (p, x), out in self.arcs.items() if p in alive}
        return Transducer(tuple(number[p] for p in self.starts if p in alive), {k: v for k, v in arcs.items() if v}, {number[p]: v for p, v in self.final.items()})

    def weighed(self, values: dict[str, float]) -> Transducer:
        """The same machine with numbers for names."""
        number = lambda names: sum(values[n] for n in names)
        return Transducer(self.starts, {k: [(to, y, number(a)) for to, y, a in out] for k, out in self.arcs.items()}, {p: number(a) for p, a in self.final.items()})

    def sums(self, symbols: Iterable[str]) -> tuple[float, float]:
        """(log of the sum over all accepted paths of exp(weight), the same over those that write nothing)."""
        both = {p: (0.0, 0.0) for p in self.starts}
        for x in symbols:
            grown: dict = {}
            for p, (every, silent) in both.items():
                for to, y, a in self.arcs.get((p, x), ()):
                    u, v = grown.get(to, (-inf, -inf))
                    grown[to] = (_log_add(u, every + a), v if y else _log_add(v, silent + a))
            both = grown
        total = (-inf, -inf)
        for p, (every, silent) in both.items():
            if p in self.final:
                total = (_log_add(total[0], every + self.final[p]), _log_add(total[1], silent + self.final[p]))
        return total

    def best(self, symbols: Iterable[str]) -> tuple[float, list[str]] | None:
        """(weight, outputs) of the heaviest accepted path.

        Of equal paths the one through the least states stays. None if no path is accepted.
        """
        paths = {p: (0.0, None) for p in self.starts}
        for x in symbols:
            grown: dict = {}
            for p in sorted(paths):
                total, tail = paths[p]
                for to, y, a in self.arcs.get((p, x), ()):
                    if to not in grown or total + a > grown[to][0]:
                        grown[to] = (total + a, (tail, y) if y else tail)
            paths = grown
        ended = [(total + self.final[p], tail) for p, (total, tail) in sorted(paths.items(), key=lambda e: e[0]) if p in self.final]
        if not ended:
            return None
        total, tail = max(ended, key=lambda e: e[0])  # the first of equal ones
        out = []
        while tail is not None:
            tail, y = tail
            out.append(y)
        return total, out[::-1]

    def paths(self, symbols: tuple[str, ...]) -> list[tuple]:
        """(weight, outputs) of every accepted path. Their number grows with that of choices."""
        found = [(p, None, ()) for p in self.starts]
        for x in symbols:
            found = [(to, a if w is None else w + a, (*out, y) if y else out) for p, w, out in found for to, y, a in self.arcs.get((p, x), ())]
        return [(self.final[p] if w is None else w + self.final[p], out) for p, w, out in found if p in self.final]


def _marked(symbols: tuple, marks: tuple) -> list[str]:
    """The symbols with every combination of marks, in the order in which the machines add them."""
    out = list(symbols)
    for mark in marks:
        out += [f"{x} {mark}" for x in out]
    return out


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """State k: the next k words are within reach; a hot one is negated, at a weight by its distance, or not meant."""
    arcs = {}
    for k in range(reach + 1):
        for x in SYMBOLS:
            to = reach if x == NEGATION else max(k - 1, 0)
            arcs[k, x] = [(to, x, ())]
            if k and x in HOT:
                arcs[k, x].append((to, f"{x} {NEGATED}", (f"{NEGATED}:{reach - k + 1}",)))
    return Transducer((0,), arcs, dict.fromkeys(range(reach + 1), ()))


def _context(sign: str, mark: str, before: tuple) -> Transducer:
    """Lets hot symbols be marked if ``sign`` stands anywhere: a guess at the start that the sign must bear out."""
    hot = _marked(HOT, before)
    arcs = {}
    for x in [*hot, *(y for y in SYMBOLS if y not in HOT)]:
        ways = lambda to, side, x=x: [(to, x, ())] + ([(to, f"{x} {mark}", (f"{mark}:{side}",))] if x in hot else [])
        if x != sign:
            arcs["absent", x] = [("absent", x, ())]
        arcs["awaited", x] = ways("met" if x == sign else "awaited", "later")
        arcs["met", x] = ways("met", "earlier")
    return Transducer(("absent", "awaited"), arcs, {"absent": (), "met": ()})


def report() -> Transducer:
    return _context(REPORT, TOLD, (NEGATED,))


def target() -> Transducer:
    return _context(TARGET, AIMED, (NEGATED, TOLD))


def _relay(ways, before: tuple) -> Transducer:
    """One state that rewrites each symbol in some ``ways``: (output, weight) pairs."""
    symbols = [*_marked(HOT, before), *(y for y in SYMBOLS if y not in HOT)]
    return Transducer((0,), {(0, x): [(0, y, a) for y, a in ways(x)] for x in symbols}, {0: ()})


def threat() -> Transducer:
    """A threat at nobody ("kill the process") is a plain word."""
    return _relay(lambda x: [(WORD if x.startswith(THREAT) and not x.endswith(AIMED) else x, ())], (NEGATED, TOLD, AIMED))


def insult() -> Transducer:
    """The chain's end: an insult or threat is live, at a weight by its grade and marks, or lapses; all else falls silent."""

    def ways(x: str) -> list:
        if not x.startswith(HOT):
            return [("", ())]
        kind = next(h for h in HOT if x.startswith(h))
        marks = [m for m in (NEGATED, TOLD, AIMED) if m in x.split() and not (m == AIMED and kind == THREAT)]
        return [("", ()), (x, (f"live {kind}", *(f"live {m}" for m in marks)))]

    return _relay(ways, (NEGATED, TOLD, AIMED))


@cache
def machine() -> Transducer:
    """The five machines in one."""
    return negation().compose(report()).trim().compose(target()).trim().compose(threat()).compose(insult()).trim()


@dataclass(frozen=True)
class Grammar:
    """The machine with a lexicon: whole words, beginnings ('^ab') and endings ('ab$') of words, once or twice."""

    insults: dict[str, float]
    _memo: dict = field(default_factory=dict, compare=False, repr=False)

    def terms(self, word: str) -> list[str]:
        """The grammar's terms that a word matches, twice-terms by their plain name."""
        return [t for t in word_terms(word) if t in self.insults or TWICE + t in self.insults]

    def _known(self, word: str) -> tuple[str | None, tuple[str, ...]]:
        """(fixed symbol, terms) of a word, remembered within a bound."""
        found = self._memo.get(word)
        if found is None:
            if len(self._memo) >= _MEMO:
                self._memo.clear()
            found = self._memo[word] = (_FIXED.get(word), tuple(self.terms(word)))
        return found

    def twice(self, words) -> frozenset[str]:
        """Terms that at least two different ones of the words match."""
        seen = Counter(t for x in set(words) for t in self._known(x)[1])
        return frozenset(t for t, n in seen.items() if n > 1)

    def symbol(self, word: str, twice: frozenset[str] = frozenset()) -> str:
        """A word's symbol: by the fixed lists, or the grade of its weightiest term."""
        fixed, terms = self._known(word)
        if fixed:
            return fixed
        best = max((max(self.insults.get(t, 0.0), self.insults.get(TWICE + t, 0.0) if t in twice else 0.0) for t in terms), default=0.0)
        return INSULTING[bisect(GRADES, best) - 1] if best > 0 else WORD

    def clauses(self, text: str) -> Iterator[tuple[str, ...]]:
        """The symbols of the clauses that hold an insult or threat, without plain words that are out of any reach."""
        text = text.translate(_LOWER)
        clauses = [[y for x in _WORD.findall(c) if (y := x.strip("'"))] for c in _CLAUSE.split(text)]
        twice = self.twice(x for c in clauses for x in c)
        for words in clauses:
            symbols, plain = [], 0
            for x in (self.symbol(word, twice) for word in words):
                plain = plain + 1 if x == WORD else 0
                if plain <= NEGATION_REACH:
                    symbols.append(x)
            if any(x in HOT for x in symbols):
                yield tuple(symbols)


def views(clause: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
    """A clause as clauses of one hot symbol each, with what bears on it; the product of their sums is the clause's."""
    for i, x in enumerate(clause):
        if x in HOT:
            far = next((d for d in range(1, NEGATION_REACH + 1) if i >= d and clause[i - d] == NEGATION), None)
            near = (NEGATION, *[WORD] * (far - 1)) if far else ()
            yield (*(s for s in (REPORT, TARGET) if s in clause[:i]), *near, x, *(s for s in (REPORT, TARGET) if s in clause[i:]))


_FIXED = {x: k for k, xs in ((NEGATION, NEGATIONS), (REPORT, REPORTS), (TARGET, TARGETS), (THREAT, THREATS)) for x in xs}


def _whole(raw: bytes) -> bool:
    """Whether a prefix of a UTF-8 word ends between characters."""
    try:
        raw.decode()
        return True
    except UnicodeDecodeError:
        return False


def _whole_end(raw: bytes) -> bool:
    return not 0x80 <= raw[0] < 0xC0


def word_terms(word: str) -> Iterator[str]:
    """The terminals that a word could teach: itself, its beginnings and its endings."""
    yield word
    raw = word.encode()
    for n in STEM_BYTES:
        if len(raw) > n:
            if _whole(raw[:n]):
                yield "^" + raw[:n].decode()
            if _whole_end(raw[-n:]):
                yield raw[-n:].decode() + "$"


class Spotter:
    """Finds quickly which documents hold an insult or threat terminal at all, on hashes of a batch's words."""

    def __init__(self, grammar: Grammar):
        terms = {x.removeprefix(TWICE) for x in grammar.insults}
        self.words = self._hashes([x for x in terms if x[0] != "^" and x[-1] != "$"] + THREATS)
        self.heads = {n: self._hashes([x[1:] for x in terms if x[0] == "^" and len(x[1:].encode()) == n]) for n in STEM_BYTES}
        self.tails = {n: self._hashes([x[:-1] for x in terms if x[-1] == "$" and len(x[:-1].encode()) == n]) for n in STEM_BYTES}

    @staticmethod
    def _hashes(words: list[str]) -> np.ndarray:
        data = np.frombuffer("".join(words).encode(), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(x.encode()) for x in words])]).astype(np.int64)
        return np.sort(w.split_words(data, offsets, np.ones(256, dtype=bool)).hashes) if words else np.zeros(0, np.uint64)

    @staticmethod
    def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, hashes)
        at[at == len(known)] = 0
        return known[at] == hashes

    @staticmethod
    def words_of(data: np.ndarray, offsets: np.ndarray) -> w.Words:
        """The grammar's words of a slice."""
        return w.split_words(data, offsets, WORD_BYTES, strip=0x27)

    def documents(self, ws: w.Words) -> np.ndarray:
        """Numbers of the slice's documents to parse."""
        hit = self._among(ws.hashes, self.words)
        size = ws.ends - ws.starts
        for n in STEM_BYTES:
            if len(self.heads[n]) or len(self.tails[n]):
                long = np.flatnonzero(size >= n)
                if len(self.heads[n]):
                    hit[long] |= self._among(w.range_hashes(ws, ws.starts[long], n), self.heads[n])
                if len(self.tails[n]):
                    hit[long] |= self._among(w.range_hashes(ws, ws.ends[long] - n, n), self.tails[n])
        return np.unique(np.searchsorted(ws.first, np.flatnonzero(hit), "right") - 1)


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def text_terms(text: str, memo: dict | None = None) -> list[str]:
    """All terms that a text's words could teach; those of two different words also as twice-terms.

    ``memo`` keeps the terms of words from text to text, up to a bound.
    """
    memo = {} if memo is None else memo
    seen: Counter = Counter()
    for word in {x.strip("'") for x in _WORD.findall(text.translate(_LOWER))} - {""}:
        terms = memo.get(word)
        if terms is None:
            if len(memo) >= _TERM_MEMO:
                memo.clear()
            terms = memo[word] = tuple(word_terms(word))
        seen.update(terms)
    return [*seen, *(TWICE + t for t, n in seen.items() if n > 1)]


@trimmed
def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic documents, clean documents) of a partition of the bounded sample."""
    counts: dict[str, list[int]] = {}
    memo: dict = {}

    def out():
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["term", "toxic", "clean"])

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for term in text_terms(text, memo):
                counts.setdefault(term, [0, 0])[toxic] += 1
        if len(counts) > 200_000:
            yield out()
            counts.clear()
    yield out()


def _find_terms(candidates: list[str]):
    known = set(candidates)
    number = {t: i for i, t in enumerate(candidates)}

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            hits = []
            for text in batch.column(0).to_pylist():
                hits.append(sorted(number[t] for t in text_terms(text, memo) if t in known))
            yield pa.record_batch([batch.column(1).cast(pa.int64()), pa.array(hits, pa.list_(pa.int32()))], names=["toxic", "hits"])

    return run


def choose_terminals(candidates: list[str], rows: list[tuple[int, list[int]]]) -> dict[str, float]:
    """Greedy cover: the term that explains most toxic documents not yet explained, while it is precise there.

    Gains only fall while documents get covered, so a term is looked at again only when it leads.
    """
    by_term: dict[int, tuple[list[int], list[int]]] = {}
    for d, (toxic, hits) in enumerate(rows):
        for t in hits:
            by_term.setdefault(t, ([], []))[toxic].append(d)
    covered = np.zeros(len(rows), dtype=bool)

    def place(t: int) -> tuple:
        """Best first: by gain less three times the clean documents, then by kind of term."""
        clean, toxic = by_term[t]
        name = candidates[t]
        return (3 * len(clean) - int((~covered[toxic]).sum()), TWICE in name, "^" not in name, len(name), [-ord(c) for c in name], t)

    heap = [place(t) for t, (clean, toxic) in by_term.items() if len(toxic) >= LEAST_PRECISION * (len(clean) + len(toxic))]
    heapq.heapify(heap)
    chosen: dict[str, float] = {}
    while heap:
        *_, t = heap[0]
        now = place(t)
        clean, toxic = by_term[t]
        if 3 * len(clean) - now[0] < LEAST_SUPPORT:
            heapq.heappop(heap)
        elif now != heap[0]:
            heapq.heapreplace(heap, now)
        else:
            heapq.heappop(heap)
            chosen[candidates[t]] = float(np.log((len(toxic) + 0.5) / (len(clean) + 0.5)))
            covered[toxic] = True
    return chosen


def _log_sums(scores: np.ndarray) -> tuple[float, np.ndarray]:
    """(log of the sum of exponentials, each one's share)."""
    top = scores.max()
    shares = np.exp(scores - top)
    return top + float(np.log(shares.sum())), shares / shares.sum()


def fit_weights(seen: list[tuple[int, dict[tuple[str, ...], int]]], ridge: float = 1.0, rounds: int = 60) -> dict[str, float]:
    """Maximum-likelihood weights, with a ridge towards their starting values: Newton steps, halved until they gain.

    ``seen``: for each document its label and how often it has each view.
    """
    names = list(START_WEIGHTS)
    start = np.array(list(START_WEIGHTS.values()))
    known = sorted({v for _, counts in seen for v in counts})
    number = {v: i for i, v in enumerate(known)}
    found = []  # by view: how often each path takes each weight, and which paths write nothing
    for view in known:
        paths = machine().paths(view)
        found.append((np.array([[p.count(n) for n in names] for p, _ in paths], dtype=float), np.array([not out for _, out in paths])))
    row = np.array([d for d, (_, counts) in enumerate(seen) for _ in counts], dtype=np.int64)
    column = np.array([number[v] for _, counts in seen for v in counts], dtype=np.int64)
    times = np.array([n for _, counts in seen for n in counts.values()], dtype=float)
    y = np.array([label for label, _ in seen], dtype=float)
    penalty = np.full(len(names), ridge)
    penalty[names.index("leak")] = 1e-3

    def loss(b: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = np.zeros(len(known)), np.zeros((len(known), len(names)))
        for i, (uses, silent) in enumerate(found):
            scores = uses @ b
            (every, share), (nothing, rest) = _log_sums(scores), _log_sums(scores[silent])
            value[i], slope[i] = every - nothing, share @ uses - rest @ uses[silent]
        leak = np.logaddexp(0.0, b[-1])
        t = np.maximum(leak + np.bincount(row, weights=times * value[column], minlength=len(y)), 1e-12)
        by_t = (1 - y) - y / np.expm1(np.minimum(t, 500.0))
        gradient = np.bincount(column, weights=times * by_t[row], minlength=len(known)) @ slope
        gradient[-1] += by_t.sum() / (1 + np.exp(-b[-1]))
        total = ((1 - y) * t - y * np.log(-np.expm1(-t))).sum() + 0.5 * (penalty * (b - start) ** 2).sum()
        return float(total), gradient + penalty * (b - start)

    b = start.copy()
    now, gradient = loss(b)
    for _ in range(rounds):
        curve = np.stack([(loss(b + h)[1] - gradient) / 1e-5 for h in np.eye(len(b)) * 1e-5])
        size, axes = np.linalg.eigh((curve + curve.T) / 2)
        step = axes @ ((axes.T @ gradient) / np.maximum(np.abs(size), 1e-3))
        scale = 1.0
        while scale > 1e-6 and not loss(b - scale * step)[0] < now:
            scale /= 2
        if scale <= 1e-6:
            break
        b = b - scale * step
        was, (now, gradient) = now, loss(b)
        if was - now < 1e-9 * abs(was):
            break
    return dict(zip(names, b.tolist(), strict=True))


@dataclass(frozen=True)
class Model:
    grammar: Grammar
    weights: dict[str, float]
    _sums: dict = field(default_factory=dict, compare=False, repr=False)

    @cached_property
    def machine(self) -> Transducer:
        return machine().weighed(self.weights)

    def doubt(self, clause: tuple[str, ...]) -> float:
        """-log of the share of a clause's paths that hold no live reading."""
        found = self._sums.get(clause)
        if found is None:
            if len(self._sums) >= _MEMO:
                self._sums.clear()
            every, silent = self.machine.sums(clause)
            found = self._sums[clause] = every - silent
        return found

    def score(self, text: str | None) -> float:
        leak = float(np.logaddexp(0.0, self.weights["leak"]))
        return -float(np.expm1(-leak - sum(map(self.doubt, self.grammar.clauses(text or "")))))

    def readings(self, text: str | None) -> list[tuple[float, list[str]]]:
        """(share of paths with a live reading, readings on the best path) of each clause with an insult or threat."""
        return [(-float(np.expm1(-self.doubt(c))), self.machine.best(c)[1]) for c in self.grammar.clauses(text or "")]

    def to_json(self) -> str:
        return json.dumps({"insults": self.grammar.insults, "weights": self.weights})


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most FIT_ROWS labelled rows outside the held-out fold (those least by a hash of doc_id).

    Equal texts of the sample count once, repeated labels included; rows with null labels or ids are left out.
    Without labelled rows of both kinds, as in empty tables, the fixed lists score with the starting weights. The sample's
    texts are written to the shared folder once, so ``docs`` is read once.
    """
    sample = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("label_id"), "toxic").limit(FIT_ROWS)
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))  # FIT_ROWS rows of two numbers
    rows = rows.groupBy(F.xxhash64("text").alias("same")).agg(F.max_by("text", "doc_id").alias("text"), F.max_by("toxic", "doc_id").alias("toxic")).select("text", "toxic")
    rows = stage(rows, "toxicity-sample")
    terms = rows.mapInArrow(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    good = terms.where((F.col("toxic") >= LEAST_SUPPORT) & (F.col("toxic") >= LEAST_PRECISION * (F.col("toxic") + F.col("clean"))))
    candidates = [r["term"] for r in good.orderBy("term").select("term").collect()]  # terms of FIT_ROWS texts
    seen = [(int(r["toxic"]), list(r["hits"])) for r in rows.mapInArrow(_find_terms(candidates), "toxic long, hits array<int>").collect()]  # FIT_ROWS rows
    grammar = Grammar({x: 1.0 for x in INSULTS} | choose_terminals(candidates, seen))
    made = rows.mapInArrow(_views(grammar), "toxic long, views array<string>, times array<long>").collect()  # FIT_ROWS rows
    if len({r["toxic"] for r in made}) < 2:
        return Model(grammar, dict(START_WEIGHTS))
    return Model(grammar, fit_weights([(r["toxic"], {tuple(v.split("|")): n for v, n in zip(r["views"], r["times"], strict=True)}) for r in made]))


def _views(grammar: Grammar):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Counter("|".join(v) for c in grammar.clauses(t) for v in views(c)) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([batch.column(1).cast(pa.int64()), pa.array([list(c) for c in made], pa.list_(pa.string())), pa.array([list(c.values()) for c in made], pa.list_(pa.int64()))], names=["toxic", "views", "times"])

    return run


def _scorer(model: Model):
    """Scores of a batch's texts; the grammar reads only those in which a term is spotted."""
    spotter, base = Spotter(model.grammar), model.score("")

    def scores(texts: pa.Array) -> np.ndarray:
        found = np.full(len(texts), base)
        for i, _, data, offsets in w.slices(texts):
            for d in spotter.documents(spotter.words_of(data, offsets)):
                found[i + d] = model.score(texts[i + int(d)].as_py())
        return found

    return scores


def _score(model: Model):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(scores(batch.column(1)))], names=["doc_id", "score"])

    return run


def _reject(model: Model, text: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(text).fill_null("")) < THRESHOLD))

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts get the score of no clause.

    A null doc_id isn't held out. Repeated rows are scored each for itself; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    scored = rows.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, training_docs: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic, row by row; columns stay as they are.

    Each row is judged by its own text, whether its doc_id is null, repeated or neither; an empty table stays empty.
    """
    return docs.mapInArrow(_reject(fit(training_docs, labels), docs.columns.index("text")), docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, fitted on labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
