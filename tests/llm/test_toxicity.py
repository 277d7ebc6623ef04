import itertools
import math
import random

from orbweave.llm import toxicity as t
from tests.llm.helpers import SF, odd_documents

BIG = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{x}.parquet") for x in ("documents", "labels"))
    rows = t.score_documents(docs, t.fit(docs, labels)).join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    bad, good = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert sum(r["predicted"] for r in bad) >= 0.9 * len(bad) and sum(r["predicted"] for r in good) <= 0.02 * len(good)
    wins = sum((a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in bad for b in good)
    assert wins >= 0.95 * len(bad) * len(good)


def model(insults, **changed):
    return t.Model(t.Grammar(insults), t.START_WEIGHTS | {k.replace("_", " "): v for k, v in changed.items()})


def readings(m, text):
    return [found for _, found in m.readings(text)]


def test_clauses():
    m = model({"idiot": 5.0, "^dumm": 3.5, "wurst$": 1.5})
    assert readings(m, "You are an idiot.") == [["insult 3 aimed"]]
    assert readings(m, "You are not an idiot.") == [[]] and m.score("You are not an idiot.") < m.score("You are an idiot.")
    assert readings(m, "I will kill you! Nice day.") == [["threat aimed"]]
    assert readings(m, "Kill the process.") == [[]] and m.score("Kill the process.") == m.score("")
    assert readings(m, "idiot; fine. they said nothing") == [["insult 3"]]
    assert readings(m, "DUMMkopf") == [["insult 2"]] and m.grammar.symbol("hanswurst") == "insult 1"
    assert m.grammar.symbol("dummheit") == "insult 2" and m.grammar.symbol("you") == t.TARGET and m.grammar.symbol("tree") == t.WORD
    assert m.score("He said you are an idiot") < m.score("You are an idiot") and m.score("You are an idiot, she wrote") < m.score("You are an idiot")
    assert m.score("not an idiot") < m.score("not an utter idiot") < m.score("not an utter and proper idiot") == m.score("an utter and proper idiot")


def test_weights_decide_between_readings():
    """Each kind of arc: with another weight a clause has another best reading, and the document another score."""
    text = "He said you are not an idiot"
    m = model({"idiot": 5.0})
    clause = next(iter(m.grammar.clauses(text)))
    every = {out for _, out in t.machine().paths(clause)}
    marks = ("", " not", " told", " not told")
    assert every == {()} | {(f"insult 3{a}{b}",) for a in marks for b in ("", " aimed")}
    cases = {"not:2": (9.0, text), "told:earlier": (9.0, "he said idiot"), "told:later": (9.0, "idiot, he said"), "aimed:earlier": (-9.0, "you idiot"), "aimed:later": (-9.0, "idiot you"), "live insult 3": (-9.0, "idiot"), "live aimed": (-9.0, "you idiot"), "live threat": (-9.0, "kill you"), "live not": (9.0, "not idiot"), "live told": (9.0, "he said idiot")}
    for name, (value, said) in cases.items():
        other = t.Model(m.grammar, t.START_WEIGHTS | {name: value})
        assert abs(other.score(said) - m.score(said)) > 0.02, name
        assert readings(other, said) != readings(m, said) or name in ("not:2", "told:earlier", "told:later"), name
    assert t.Model(m.grammar, t.START_WEIGHTS | {"live not": 9.0}).readings("not an idiot")[0][1] == ["insult 3 not"]


def all_paths(m, symbols, state=None):
    """Every accepted path of a machine: (weight, outputs), by plain recursion."""
    if state is None:
        return [p for s in m.starts for p in all_paths(m, symbols, s)]
    if not symbols:
        return [(m.final[state], ())] if state in m.final else []
    return [(a + w, (y, *rest)) for to, y, a in m.arcs.get((state, symbols[0]), ()) for w, rest in all_paths(m, symbols[1:], to)]


def test_the_composed_machine_is_the_chain_of_its_parts():
    parts = [t.negation(), t.report(), t.target(), t.threat(), t.insult()]
    draw = random.Random(6)
    values = {n: draw.uniform(-1, 1) for n in t.START_WEIGHTS}
    weighed = t.machine().weighed(values)
    for n in range(4):
        for clause in itertools.product(t.SYMBOLS, repeat=n):
            if n == 3 and draw.random() < 0.8:
                continue
            found = [((), clause)]
            for m in parts:
                found = [(w + a, out) for w, x in found for a, out in all_paths(m, x)]
            plain = sorted((sorted(w), [y for y in out if y]) for w, out in found)
            assert sorted((sorted(w), list(out)) for w, out in t.machine().paths(clause)) == plain
            assert (len(plain) > 1) == any(x in t.HOT and (x != t.THREAT or t.TARGET in clause) or x in t.HOT and (t.REPORT in clause or t.NEGATION in clause[:i]) for i, x in enumerate(clause))
            total = {False: 0.0, True: 0.0}
            for w, out in plain:
                total[bool(out)] += math.exp(sum(values[x] for x in w))
            every, silent = weighed.sums(clause)
            assert abs(math.exp(every) - sum(total.values())) < 1e-9 * math.exp(every) and abs(math.exp(silent) - total[False]) < 1e-9 * math.exp(silent)
            assert abs(weighed.best(clause)[0] - max(sum(values[x] for x in w) for w, _ in plain)) < 1e-9


def test_a_clause_is_the_product_of_its_views():
    draw = random.Random(7)
    m = t.machine().weighed({n: draw.uniform(-2, 2) for n in t.START_WEIGHTS})
    for _ in range(500):
        clause = tuple(draw.choice(t.SYMBOLS) for _ in range(draw.randrange(12)))
        doubt = lambda c: m.sums(c)[0] - m.sums(c)[1]
        assert abs(doubt(clause) - sum(map(doubt, t.views(clause)))) < 1e-9
    every, silent = m.sums([t.INSULTING[2]] * 5000)
    assert every - silent > 1000 and math.isfinite(every)


def test_weights_are_learnt():
    """Labels drawn from a machine's own shares bring back its weights' effect: scores, and which kind of clause is toxic."""
    draw = random.Random(11)
    true = t.Model(t.Grammar({}), t.START_WEIGHTS | {"live not": 1.0, "live insult 1": -3.0, "live told": -6.0, "leak": -5.0})
    seen, kinds = [], []
    for _ in range(4000):
        clause = tuple(draw.choice([*t.HOT, t.NEGATION, t.REPORT, t.TARGET, t.WORD]) for _ in range(draw.randrange(1, 4)))
        counts = {}
        for v in t.views(clause):
            counts[v] = counts.get(v, 0) + 1
        share = 1 - (1 - math.log1p(math.exp(-5.0))) * math.exp(-true.doubt(clause))
        seen.append((int(draw.random() < share), counts))
        kinds.append(clause)
    got = t.Model(t.Grammar({}), t.fit_weights(seen, ridge=0.01))
    gaps = [abs(math.exp(-got.doubt(c)) - math.exp(-true.doubt(c))) for c in kinds]
    assert sum(gaps) / len(gaps) < 0.02
    assert got.weights["live insult 1"] < got.weights["live insult 3"] - 2
    again = t.fit_weights(seen[::-1], ridge=0.01)
    assert all(abs(again[k] - v) < 1e-3 for k, v in got.weights.items())


def test_best_path_is_the_heaviest_of_all():
    a = t.Transducer((0, 1), {(0, "a"): [(0, "x", 1.0), (1, "y", 2.0)], (1, "a"): [(0, "z", 0.5)], (1, "b"): [(1, "w", 3.0), (0, "", 0.0)], (0, "b"): [(0, "v", 1.0)]}, {0: 0.0, 1: -1.0})
    b = t.Transducer(("s",), {("s", y): [("s", y.upper(), k / 8)] for k, y in enumerate("vwxyz")} | {("s", ""): [("s", "", 0.0)]}, {"s": 0.25})
    both = a.compose(b).trim()
    for n in range(6):
        for clause in itertools.product("ab", repeat=n):
            plain = [(w + v, out) for w, x in all_paths(a, clause) for v, out in all_paths(b, x)]
            got = both.best(clause)
            assert (got is None) == (not plain)
            if plain:
                assert abs(got[0] - max(w for w, _ in plain)) < 1e-9
                assert abs(math.exp(both.sums(clause)[0]) - sum(math.exp(w) for w, _ in plain)) < 1e-6 * math.exp(both.sums(clause)[0])


def spotted(g, texts):
    import pyarrow as pa

    found = []
    for i, _, data, offsets in t.w.slices(pa.array(texts)):
        found += [i + int(d) for d in t.Spotter(g).documents(t.Spotter.words_of(data, offsets))]
    return found


def test_spotter_finds_what_the_grammar_finds():
    g = t.Grammar({"idiot": 1.0, "^dumm": 2.0, "wurst$": 1.5, "^été": 1.0, "^l'as": 1.0, "n't$": 1.0, "d'enf": 1.0})
    texts = ["an idiot", "a DUMMY", "hanswurst!", "nothing", "", None, "étéx", "they kill", "x" * 1000 + " idiot", "l'assassin", "'l'assaut'", "don''t isn't'", "d'enf", "''", "'idiot'", "d enf"]
    assert spotted(g, texts) == [0, 1, 2, 6, 7, 8, 9, 10, 11, 12, 14]


def test_every_score_is_the_model_s(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    extra = spark.createDataFrame([(10**9 + k, f"{a} d'enfoiré l'assommant {b} n'importe qu'idiot") for k, (a, b) in enumerate([("tu es", "!"), ("'tu", "'l'as"), ("", "il l'a dit")])], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionAll(extra)
    model = t.fit(docs, labels)
    model = t.Model(t.Grammar(model.grammar.insults | {"^d'enf": 1.0, "^l'as": 2.0}), model.weights)
    got = {r["doc_id"]: r["score"] for r in t.score_documents(rows, model).collect()}
    assert all(abs(got[r["doc_id"]] - model.score(r["text"])) < 1e-12 for r in rows.collect())
    assert len({got[10**9 + k] for k in range(3)} | {model.score("")}) > 1


def test_greedy_choice_without_bounds():
    rng = random.Random(1)
    candidates = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(400):
        toxic = d % 2
        rows.append((toxic, sorted({i for i in range(60) if rng.random() < (0.06 if toxic else 0.002)})))
    covered, chosen, left = set(), [], dict(enumerate(candidates))
    by = {i: ([d for d, (x, h) in enumerate(rows) if not x and i in h], [d for d, (x, h) in enumerate(rows) if x and i in h]) for i in left}
    while True:
        fit = {i: len(set(by[i][1]) - covered) for i in left}
        fit = {i: n for i, n in fit.items() if n >= t.LEAST_SUPPORT and len(by[i][1]) >= t.LEAST_PRECISION * (len(by[i][0]) + len(by[i][1]))}
        if not fit:
            break
        best = min(fit, key=lambda i: (3 * len(by[i][0]) - fit[i], len(candidates[i]), [-ord(c) for c in candidates[i]]))
        chosen.append(candidates[best])
        covered |= set(by[best][1])
        del left[best]
    assert list(t.choose_terminals(candidates, rows)) == chosen and len(chosen) > 3


def test_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (3, 0, 7), (9, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("false")):
        got = t.score_documents(docs, t.fit(docs, some)).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
        assert all(r["held_out"] in (True, False) for r in got)
    kept = t.reject_toxic(docs, labels, docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert t.reject_toxic(docs.where("false"), labels, docs.where("false")).collect() == []
