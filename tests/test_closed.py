"""Closed documents against a plain walk over the same descriptions, for documents with random faults."""

import copy
import json
import random
import re

from orbweave.operators import closed
from orbweave.operators.artifacts import ARTIFACTS
from orbweave.operators.closed import Fields, Flag, Items, Number, Text
from orbweave.plans.artifacts import GOOD


def typed(spec, x):
    number = isinstance(x, (int, float)) and not isinstance(x, bool)
    return {Text: isinstance(x, str), Flag: isinstance(x, bool), Fields: isinstance(x, dict), Items: isinstance(x, list), Number: number and not (isinstance(spec, Number) and spec.whole and not isinstance(x, int))}[type(spec)]


def allowed(spec, x):
    if isinstance(spec, Text):
        return (spec.pattern is None or re.search(spec.pattern.replace(r"\z", r"\Z"), x) is not None) and (spec.values is None or x in spec.values)
    if isinstance(spec, Number):
        return (spec.low is None or (x > spec.low if spec.above else x >= spec.low)) and (spec.high is None or x <= spec.high)
    if isinstance(spec, Flag):
        return spec.value is None or x == spec.value
    return not isinstance(spec, Items) or len(x) >= spec.least and (spec.most is None or len(x) <= spec.most)


def plain(spec, x, path="$"):
    if not isinstance(x, dict):
        return {(path, "not_an_object", "")} if path == "$" else set()
    out = {(path, "unknown_field", k) for k in x.keys() - spec.of.keys()} | {(path, "missing_field", k) for k in spec.of.keys() - x.keys()}
    for k, inner in spec.of.items():
        if k not in x or (x[k] is None and inner.null):
            continue
        v = x[k]
        if not typed(inner, v):
            out.add((path, "wrong_type", k))
        elif not allowed(inner, v):
            out.add((path, "value", k))
        if isinstance(inner, Fields):
            out |= plain(inner, v, f"{path}.{k}") if isinstance(v, dict) else set()
        if isinstance(inner, Items) and isinstance(v, list):
            if not all(typed(inner.of, i) and (isinstance(inner.of, Fields) or allowed(inner.of, i)) for i in v):
                out.add((path, "item", k))
            if inner.unique is not None:
                names = [json.dumps(i.get(inner.unique) if isinstance(i, dict) else None) if inner.unique else json.dumps(i) for i in v]
                if len(set(names)) < len(names):
                    out.add((path, "repeated", k))
            if isinstance(inner.of, Fields):
                for n, i in enumerate(v):
                    out |= plain(inner.of, i, f"{path}.{k}[{n}]")
    return out


def spoil(draw, x):
    """One random change somewhere inside."""
    places = []

    def walk(v):
        if isinstance(v, dict):
            places.extend((v, k) for k in v)
            for i in v.values():
                walk(i)
        elif isinstance(v, list):
            places.extend((v, k) for k in range(len(v)))
            for i in v:
                walk(i)

    walk(x)
    at, k = draw.choice(places)
    how = draw.randrange(5)
    if how == 0 and isinstance(at, dict):
        del at[k]
    elif how == 1 and isinstance(at, dict):
        at[draw.choice(["extra", "x_1"])] = draw.choice([1, None, "y"])
    elif how == 2 and isinstance(at, list):
        at.append(copy.deepcopy(at[k]))
    else:
        at[k] = draw.choice([None, -5, 2.5, 7, "bad value", "ok", True, False, [], {}, ["a", "a"], 1e13])


def test_documents_with_random_faults(spark):
    draw = random.Random(4)
    for name, good in GOOD.items():
        documents = [good]
        for _ in range(60):
            d = copy.deepcopy(good)
            for _ in range(draw.randrange(1, 4)):
                spoil(draw, d)
            documents.append(d)
        texts = [json.dumps(d) for d in documents] + ["", "{", "null", "[]", "3", None]
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        got = [tuple(r) for r in closed.closed_violations(df, "id", "text", ARTIFACTS[name]).collect()]
        want = {(i, *v) for i, d in enumerate(documents) for v in plain(ARTIFACTS[name], d)} | {(i, "$", "not_an_object", "") for i in range(len(documents), len(texts))}
        assert len(got) == len(set(got)) and set(got) == want, (name, set(got) ^ want)
        assert not [v for v in want if v[0] == 0] and len(want) > 60
