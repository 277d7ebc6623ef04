"""Catalogue queries against DuckDB, and folds and kernels against plain loops."""

import itertools
import math

import duckdb
import numpy as np
import pytest

from orbweave.operators import folds, intervals, rotation, validation
from orbweave.plans import artifacts, catalog, documents, events, frames, geometry, motion, rules, sequences, summaries, tracking  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("events", "lineitem", "orders", "embeddings", "documents"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def plain(rows):
    return sorted(tuple(None if x is None else round(float(x), 6) + 0.0 if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x) for x in row) for row in rows) if rows and not any(x is None for r in rows for x in r) else sorted((tuple(None if x is None else round(float(x), 6) + 0.0 if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x) for x in row) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, tables, name):
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = tables.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({catalog.SQL[name]})").fetchall()
    assert plain([tuple(r) for r in got.select(*names).collect()]) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs_and_repeats(spark, name):
    """Its parts are tested elsewhere; here the whole runs, and gives the same rows however the input is cut."""
    got = [sorted(map(str, catalog.QUERIES[name](spark, SF).collect()))]
    assert got[0]
    if name in ("st06_association", "st07_tracklets", "agg23_group_shots"):
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        try:
            got.append(sorted(map(str, catalog.QUERIES[name](spark, SF).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got[0] == got[1]


def test_merge_touching_and_support(spark):
    rows = [(1, 0.0, 3.0), (1, 1.5, 4.5), (1, 6.0, 9.0), (1, 7.5, 10.5), (1, 10.5, 11.0), (2, 5.0, 6.0)]
    df = spark.createDataFrame(rows, "s int, start double, end double")
    got = intervals.merge_intervals(df, ["s"], "start", "end", {"n": catalog.F.count(catalog.F.lit(1))})
    assert sorted(map(tuple, got.collect())) == [(1, 0.0, 4.5, 2), (1, 6.0, 11.0, 3), (2, 5.0, 6.0, 1)]


def test_nms(spark):
    df = spark.createDataFrame([(1, 10.0, 0.5, 1), (1, 11.0, 0.8, 2), (1, 21.0, 0.3, 3), (1, 20.5, 0.3, 4)], "s int, t double, score double, id int")
    assert {r["id"] for r in folds.temporal_nms(df, "s", "t", "score", "id", 10.0).collect()} == {2, 3}


def test_lifecycle(spark):
    kinds = ["observed", "not_observed", "not_observed", "outside_viewport", "not_observed", "outside_viewport", "outside_viewport", "observed"]
    df = spark.createDataFrame([(1, i, k, 0.8) for i, k in enumerate(kinds)], "s int, i long, k string, c double")
    got = sorted((r["i"], r["phase"], r["missing"], r["outside"], round(r["confidence"], 6)) for r in folds.lifecycle(df, "s", "i", "k", "c").collect())
    assert got == [(0, "active", 0, 0, 0.8), (1, "grace", 1, 0, 0.6), (2, "grace", 2, 0, 0.45), (3, "viewport_exit", 0, 1, 0.3375), (4, "grace", 1, 0, 0.253125), (5, "viewport_exit", 0, 1, 0.189844), (6, "terminated", 0, 2, 0.142383)]


def test_event_plan_is_the_best_of_all(spark):
    r = np.random.default_rng(3)
    names = ("start", "end", "current_id", "proposed_id", "current_total", "proposed_total", "observed", "angle")
    rows = [(s, i, 0.0, float(r.integers(1, 4)), "m", "ab"[r.integers(0, 2)], float(r.integers(0, 5)) / 4, float(r.integers(0, 9)) / 4, bool(r.integers(0, 4)), float(r.integers(0, 3)) / 4) for s in range(12) for i in range(6)]
    df = spark.createDataFrame(rows, "s int, i long, " + ", ".join(f"{n} {'string' if n.endswith('id') else 'boolean' if n == 'observed' else 'double'}" for n in names))
    got = {}
    for x in folds.choose_events(df, "s", "i", switch=0.25, angular=0.25, repeat=0.5, least_dwell=2.0, least_advantage=0.25).collect():
        got.setdefault(x["s"], []).append((x["i"], x["selected"], x["objective"], x["eligible"]))
    for s in range(12):
        mine = [dict(zip(names, x[2:])) for x in rows if x[0] == s]
        able = [x["observed"] and x["end"] >= 2 and x["proposed_total"] >= x["current_total"] + 0.25 for x in mine]
        totals = {}
        for path in itertools.product((0, 1), repeat=6):
            if all(not p or ok for p, ok in zip(path, able)):
                cost = sum(0.5 + 0.5 * x["angle"] for p, x in zip(path, mine) if p) + sum(0.5 for k in range(1, 6) if path[k] and path[k - 1] and mine[k]["proposed_id"] == mine[k - 1]["proposed_id"])
                totals[tuple(x["proposed_id"] if p else "m" for p, x in zip(path, mine))] = sum(x["proposed_total"] if p else x["current_total"] for p, x in zip(path, mine)) - cost
        best = max(totals.values())
        chosen = tuple(c for _, c, _, _ in sorted(got[s]))
        assert math.isclose(got[s][0][2], best) and chosen == min(p for p, v in totals.items() if math.isclose(v, best))
        assert [e for _, _, _, e in sorted(got[s])] == able
    assert folds.choose_events(df.limit(0), "s", "i", switch=0.25, angular=0.0, repeat=0.5, least_dwell=2.0, least_advantage=0.25).count() == 0


def test_rotation_fit_ignores_outliers():
    r = np.random.default_rng(1)
    rays = r.normal(size=(40, 3))
    rays /= np.linalg.norm(rays, axis=1, keepdims=True)
    q = np.array([0.0, math.sin(0.05), 0.0, math.cos(0.05)])
    target = rotation.turn(q, rays)
    target[:4] = -target[:4]
    x, y, z, w, share, count, matches, _, residual, confidence, failure = rotation.fit_rotation(rays, target)
    assert abs(np.array([x, y, z, w]) @ q) > 1 - 1e-9 and math.isclose(share, 0.9) and (count, matches) == (36, 40) and residual < 1e-6 and confidence > 0.8 and failure is None


def test_rotation_fit_keeps_rays_up_to_the_inlier_bound():
    """Rays just within the bound keep a weight, however small the others' errors are."""
    rays = np.random.default_rng(2).normal(size=(30, 3))
    rays /= np.linalg.norm(rays, axis=1, keepdims=True)
    off = np.array([0.0, 0.0, math.sin(math.radians(2.9) / 2), math.cos(math.radians(2.9) / 2)])
    target = rays.copy()
    target[:3] = rotation.turn(off, rays[:3])
    fit = rotation.fit_rotation(rays, target)
    assert fit[5] == 30 and 2 * math.degrees(math.acos(min(1.0, fit[3]))) > 0.01  # they pull


def test_rotation_fit_needs_enough_and_different_rays():
    one = np.array([[0.0, 0.0, 1.0]])
    assert rotation.fit_rotation(one, one)[-1] == "insufficient_correspondences"
    same = np.repeat(one, 5, axis=0)
    assert rotation.fit_rotation(same, same)[-1] == "insufficient_angular_diversity" and rotation.fit_rotation(same, same)[0] is None
    assert rotation.fit_rotation(np.concatenate([one, -one]), np.concatenate([one, -one]))[-1] == "insufficient_angular_diversity"
    rays = np.eye(3)
    assert rotation.spread(rays)[1] == pytest.approx(math.pi / 2) and rotation.spread(rays, block=2) == pytest.approx(rotation.spread(rays))


def test_rotation_fits_by_group(spark):
    r = np.random.default_rng(5)
    rows = []
    for g in range(4):
        q = np.array([0.0, math.sin(0.02 * g), 0.0, math.cos(0.02 * g)])
        rays = r.normal(size=(20, 3))
        rays /= np.linalg.norm(rays, axis=1, keepdims=True)
        rows += [(g, "all", *map(float, s), *map(float, t)) for s, t in zip(rays, rotation.turn(q, rays))]
    rows.append((9, "all", 0.0, 0.0, 1.0, 0.0, 0.0, 1.0))
    df = spark.createDataFrame(rows, "g long, v string, sx double, sy double, sz double, tx double, ty double, tz double")
    got = {x["g"]: x for x in rotation.fit_rotations(df, "g", "v").collect()}
    assert all(abs(got[g]["y"] - math.sin(0.02 * g)) < 1e-9 and got[g]["inlier_count"] == 20 for g in range(4))
    assert got[9]["w"] is None and got[9]["fit_failure"] == "insufficient_correspondences"


def test_relative_segments(spark):
    a = math.radians(10)
    rows = [(1, i, float(i), i + 1.0, s, 0.0, math.sin(a / 2), 0.0, math.cos(a / 2)) for i, s in enumerate(["measured", "interpolated", "invalid", "measured"])]
    df = spark.createDataFrame(rows, "s int, i int, start double, end double, state string, x double, y double, z double, w double")
    got = sorted((r["segment"], r["t"], round(2 * math.degrees(math.atan2(r["y"], r["w"])), 6), r["state"]) for r in rotation.relative_segments(df, "s", "i").collect())
    assert got == [(1, 0.0, 0.0, "segment_anchor"), (1, 1.0, 10.0, "measured"), (1, 2.0, 20.0, "interpolated"), (2, 3.0, 0.0, "segment_anchor"), (2, 4.0, 10.0, "measured")]


def test_validation(spark):
    df = spark.createDataFrame([("ok", 1.0, 2.0), ("bad id\n", 0.0, 1.0), ("ok", 1.5, None)], "id string, start double, end double")
    rules = {"safe_id": catalog.F.col("id").rlike(validation.SAFE_ID), "ends": catalog.F.col("end") > catalog.F.col("start")}
    assert sorted(r["rule_id"] for r in validation.violations(df, "id", rules).collect()) == ["ends", "safe_id"]
    assert [r["id"] for r in validation.repeated_keys(df, "id").collect()] == ["ok"]
    assert validation.out_of_order(df, "id", "start", "start", "end").count() == 1
    assert validation.difference(df, df).count() == 0 and validation.difference(df, df.limit(2)).count() == 1


def test_greedy_hysteresis_by_hand(spark):
    """One case for each reason: dwell 2 s, margin 0.1, hold 0.5 s."""
    frames = [
        (0.0, {"a": 0.5, "b": 0.5}, "a", "initial_best", False),  # equal ones: the lesser name
        (0.5, {"a": 0.6, "b": 0.5}, "a", "incumbent_best", False),
        (1.0, {"a": 0.1, "b": 0.9}, "a", "minimum_dwell", False),
        (2.0, {"a": 0.5, "b": 0.59}, "a", "switch_margin", False),
        (2.2, {"a": 0.5, "b": 0.7}, "a", "challenger_hysteresis", False),
        (2.4, {"a": 0.5, "c": 0.8, "b": 0.7}, "a", "challenger_hysteresis", False),  # another challenger waits anew
        (2.8, {"a": 0.5, "c": 0.8}, "a", "challenger_hysteresis", False),
        (2.9, {"a": 0.5, "c": 0.8}, "c", "sustained_challenger", True),
        (3.0, {"a": 0.9, "b": 0.2}, "a", "incumbent_missing_fallback", True),
        (5.5, {"a": 0.2, "b": 0.9}, "a", "challenger_hysteresis", False),
        (5.7, {"a": 0.9, "b": 0.2}, "a", "incumbent_best", False),  # the challenger's lead is over
        (6.1, {"a": 0.2, "b": 0.9}, "a", "challenger_hysteresis", False),
    ]
    rows = [(s, t, k, u) for s in (1, 2) for t, c, *_ in frames for k, u in c.items()]
    df = spark.createDataFrame(rows, "s int, t double, k string, u double").repartition(3)
    got = sorted(tuple(r) for r in folds.greedy_hysteresis(df, "s", "t", "k", "u").collect())
    assert got == [(s, t, *want) for s in (1, 2) for t, _, *want in frames]
    assert {w[1] for _, _, *w in frames} == set(folds.REASONS)
    assert folds.greedy_hysteresis(df.limit(0), "s", "t", "k", "u").count() == 0


def test_causal_reliability_by_hand(spark):
    rows = [(1, p, v, d) for p, ds in enumerate([(0.1, 0.5, 0.3), (0.5, 0.0, 0.3), (0.0, 0.0, 0.0)]) for v, d in zip("abc", ds)]
    got = sorted(tuple(r) for r in folds.causal_reliability(spark.createDataFrame(rows, "s int, p long, v string, d double"), "s", "p", "v", "d", 2, alpha=0.5).collect())
    assert [r[2:] for r in got[:3]] == [("a", None, 1, True), ("b", None, 2, True), ("c", None, 3, True)]  # nothing is known yet
    assert [(r[2], r[3], r[5]) for r in got[3:6]] == [("a", 0.1, True), ("b", 0.5, False), ("c", 0.3, True)]
    assert [(r[2], round(r[3], 6), r[5]) for r in got[6:]] == [("a", 0.3, True), ("b", 0.25, True), ("c", 0.3, False)]


def test_keyframes_by_hand(spark):
    d = math.radians
    rows = [(0.0, "a", 0.0), (1.0, "a", d(3)), (2.0, "a", d(6)), (3.0, "b", d(6)), (4.0, "b", d(8)), (5.0, "b", d(9))]
    df = spark.createDataFrame([(1, t, s, y, 0.0, 1.0) for t, s, y in rows], "k int, t double, s string, y double, p double, f double")
    got = sorted((r["t"], r["s"]) for r in folds.sparse_keyframes(df, "k", "t", "s", "y", "p", "f", d(5)).collect())
    assert got == [(0.0, "a"), (2.0, "a"), (3.0, "b"), (5.0, "b")]  # far enough, another selection, and the end


def test_acquisition_by_hand(spark):
    c, m, a = "compatible", "missing", "ambiguous"
    rows = [(0.0, c), (0.2, c), (0.4, m), (0.6, c), (1.7, c), (1.9, c), (2.0, c), (2.1, a), (2.2, c)]
    got = sorted(tuple(r)[1:] for r in folds.acquisitions(spark.createDataFrame([(1, *x) for x in rows], "s int, t double, o string"), "s", "t", "o").collect())
    assert [(x[2], round(x[3], 6), x[4]) for x in got] == [(1, 0.0, False), (2, 0.2, False), (0, 0.0, False), (1, 0.0, False), (1, 0.0, False), (2, 0.2, False), (3, 0.3, True), (0, 0.0, False), (1, 0.0, False)]


def test_box_nms_follows_a_plain_loop(spark):
    rng = np.random.default_rng(9)
    rows = [(f, "ab"[int(rng.integers(2))], i, *(float(x) / 8 for x in rng.integers(0, 6, 2)), *(float(x) / 8 for x in rng.integers(0, 6, 2)), float(rng.integers(1, 5)) / 4) for f in range(10) for i in range(25)]
    df = spark.createDataFrame(rows, "f int, c string, i int, x double, y double, w double, h double, s double")
    want = []
    for f, c in itertools.product(range(10), "ab"):
        kept = []
        for r in sorted((r for r in rows if r[:2] == (f, c)), key=lambda r: (-r[7], r[2])):
            def iou(k, r=r):
                wide, high = (max(0.0, min(k[n] + k[n + 2], r[n] + r[n + 2]) - max(k[n], r[n])) for n in (3, 4))
                union = k[5] * k[6] + r[5] * r[6] - wide * high
                return wide * high / union if union > 0 else 0.0

            if all(iou(k) <= 0.25 for k in kept):
                kept.append(r)
        want += [(f, c, r[2], r[7]) for r in kept]
    got = folds.box_nms(df, ["f", "c"], ["x", "y", "w", "h"], "s", ["i"], 0.25)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert folds.box_nms(df.limit(0), ["f", "c"], ["x", "y", "w", "h"], "s", ["i"], 0.25).count() == 0
