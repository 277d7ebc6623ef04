"""Range joins by slots and neighbours on the sphere, against all pairs."""

import math

import numpy as np
import pytest

from orbweave.operators import intervals, spatial

INF = float("inf")


def pairs_of(spark, left, right):
    kind = "k string, start double, end double, id long"
    a, b = (spark.createDataFrame(rows, kind).repartition(3) for rows in (left, right))
    found = intervals.overlaps(a, b, ["k"])
    assert found.columns == ["k", "start", "end", "id", "start_right", "end_right", "id_right", "clip_start", "clip_end"]
    got = sorted((r["id"], r["id_right"], r["clip_start"], r["clip_end"]) for r in found.collect())
    want = sorted((i, j, max(s, t), min(e, f)) for k, s, e, i in left for x, t, f, j in right if k == x and None not in (k, s, e, t, f) and s < f and t < e)
    assert got == want
    return len(got)


@pytest.mark.parametrize("seed", range(4))
def test_overlaps_equal_all_pairs(spark, seed):
    """Short, long, unbounded, empty, reversed and null intervals, and bounds on the edges of slots."""
    r = np.random.default_rng(seed)

    def side(n):
        rows = []
        for i in range(n):
            start = float(r.choice([r.uniform(-1000, 1000), r.integers(-16, 16) * 64.0, 1.7e9 + r.uniform(0, 9)]))
            length = float(r.choice([0.0, r.uniform(0, 1), 64.0, r.uniform(0, 3000), 2.0 ** r.integers(-9, 12), -1.0]))
            rows.append((["a", "b", None][int(r.choice(3, p=[0.6, 0.3, 0.1]))], start, start + length, i))
        return [*rows, ("a", -INF, INF, n), ("a", -INF, 0.0, n + 1), ("b", 5.0, INF, n + 2), ("a", None, 3.0, n + 3), ("a", 1.0, 1.0, n + 4)]

    assert pairs_of(spark, side(120), side(90)) > 500


def test_overlaps_of_points_and_of_nothing(spark):
    points = [("a", float(i), float(i), i) for i in range(50)]
    assert pairs_of(spark, points, [("a", 10.0, 20.0, 1)]) == 9  # 10 itself: an empty interval doesn't begin before the span does
    assert pairs_of(spark, points, points) == 0 and pairs_of(spark, [], points) == 0 and pairs_of(spark, points, []) == 0
    assert pairs_of(spark, [("a", 3.0, 3.5, 1)], [("a", 3.0, 3.5, 1)]) == 1
    assert pairs_of(spark, [("a", -INF, INF, 1)], [("a", -INF, INF, 2)]) == 1


def test_one_source_is_dealt_to_many_tasks(spark):
    """Half a million short intervals of one source on each side: slots of few rows, each pair once."""
    n = 500_000
    rows = spark.range(n).selectExpr("'s' as k", "cast(id as double) as start", "id + 1.5 as end", "id")
    found = intervals.overlaps(rows, rows, ["k"])
    assert found.count() == n + 2 * (n - 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_slot" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def plain_pairs(rows, most, least, scale):
    def ray(y, p):
        return np.array([math.cos(p) * math.sin(y), math.sin(p), math.cos(p) * math.cos(y)])

    found = set()
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a[3] == b[3] and a[2] < b[2]:
                u, v = ray(*a[4:6]), ray(*b[4:6])
                far = math.atan2(np.linalg.norm(np.cross(u, v)), float(u @ v))
                if far <= min(most, max(least, scale * (a[6] + b[6]) / 2)):
                    found.add((a[0], a[1], a[2], b[2]))
    return found


FRAME = "source string, frame long, id long, kind string, yaw double, pitch double, h_fov double"


@pytest.mark.parametrize("most", [1, 12, 50, 120])
def test_neighbours_on_the_whole_sphere(spark, most):
    """Dense spots at the seam, at both poles and at bands' edges; two sources share each moment."""
    r = np.random.default_rng(most)
    rows = []
    for i in range(360):
        yaw, pitch = r.uniform(-math.pi, math.pi), math.asin(r.uniform(-1, 1))
        spot = i % 6
        if spot == 1:
            yaw = math.copysign(math.pi - abs(r.normal(0, math.radians(most) / 2)) % 1, r.normal())
        elif spot in (2, 3):
            pitch = (math.pi / 2 - abs(r.normal(0, math.radians(most) / 2)) % 0.5) * (1 if spot == 2 else -1)
        elif spot == 4:
            pitch = math.radians(most) * int(r.integers(-2, 3)) - math.pi / 2 % math.radians(most)
            pitch = max(-math.pi / 2, min(math.pi / 2, pitch + r.choice([0, 1e-9, -1e-9])))
        elif spot == 5:
            yaw, pitch = r.choice([-math.pi, math.pi, 0.0]), r.choice([-math.pi / 2, math.pi / 2, 0.0])
        rows.append(("ab"[i % 2], 7, i, "pq"[i // 2 % 2], float(yaw), float(pitch), float(r.uniform(0, 1))))
    df = spark.createDataFrame(rows, FRAME)
    limits = (math.radians(most) + 1e-6, math.radians(most) / 4, 2.0)  # no two of these lie at the limit itself
    pairs = spatial.close_pairs(df, *limits, keys=("source", "frame"))
    got = [tuple(x)[:4] for x in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs(rows, *limits)
    parents = {x[2]: x[2] for x in rows}
    for _ in rows:
        for *_, a, b in got:
            parents[a] = parents[b] = min(parents[a], parents[b])
    clustered = spatial.frame_clusters(df, pairs, ("source", "frame"))
    assert {x["id"]: x["cluster"] for x in clustered.collect()} == parents
    merged = spatial.merge_clusters(clustered, ("source", "frame")).collect()
    assert sum(x["members"] for x in merged) == len(rows) and len({(x["source"], x["cluster"]) for x in merged}) == len(merged)


def test_sources_at_one_time_never_merge(spark):
    rows = [("a", 1, 1, "p", math.radians(179), 0.0, 0.2), ("a", 1, 2, "p", math.radians(-179), 0.0, 0.2), ("b", 1, 3, "p", math.radians(180), 0.0, 0.2), ("b", 2, 4, "p", math.radians(180), 0.0, 0.2)]
    df, keys = spark.createDataFrame(rows, FRAME), ("source", "frame")
    pairs = spatial.close_pairs(df, math.radians(12), math.radians(5), 0.6, keys)
    merged = spatial.merge_clusters(spatial.frame_clusters(df, pairs, keys), keys)
    assert sorted((x["source"], x["frame"], x["ids"]) for x in merged.collect()) == [("a", 1, "1+2"), ("b", 1, "3"), ("b", 2, "4")]
    assert [tuple(x)[:4] for x in spatial.mutual_unique(pairs, keys).collect()] == [("a", 1, 1, 2)]


def test_pairs_looked_at_grow_with_neighbours(spark):
    """A frame of 20,000 spread candidates: cells keep the join to some neighbours each, where all pairs would be 200 million."""
    df = spark.range(20_000).selectExpr("1L as frame", "id", "'p' as kind", "(id * 2.399963) % 6.283185 - 3.141592 as yaw", "asin(2 * (id + 0.5) / 20000 - 1) as pitch", "0.01 as h_fov")
    placed, looking = spatial._cells(math.radians(2))
    assert placed(df).select("_cell").join(looking(df).select("_cell"), "_cell").count() < 20_000 * 60
    assert spatial.close_pairs(df, math.radians(2), math.radians(2), 1.0).count() > 0
