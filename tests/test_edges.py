"""Distances that lie on a limit of the same grid of degrees: the last bit decides, as the C library (and SQL) has it."""

import math
import random
from collections import defaultdict

import duckdb

from orbweave.operators import folds, paths, spatial
from orbweave.plans import catalog, geometry, motion

TURN = 2 * math.pi


def _rows():
    """Directions that share yaws, on a grid of whole degrees of pitch and extent."""
    for i in range(400):
        x = (i % 8) * 91.37 * 7.3
        yield i, x + math.pi - TURN * math.floor((x + math.pi) / TURN) - math.pi, math.radians(float(i * 7 % 121 - 60)), math.radians(float(10 + i % 40))


def _far(a, b):
    (ax, ay, az), (bx, by, bz) = ((math.cos(p) * math.sin(y), math.sin(p), math.cos(p) * math.cos(y)) for _, y, p, _ in (a, b))
    x, y, z = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
    return math.atan2(math.sqrt(x * x + y * y + z * z), ax * bx + ay * by + az * bz)


def test_close_pairs_at_the_very_limit(spark):
    rows = list(_rows())
    df = spark.createDataFrame([(0, "a", *r) for r in rows], "frame long, kind string, id long, yaw double, pitch double, h_fov double")
    made = {(r.a, r.b) for r in spatial.close_pairs(df, math.radians(12), math.radians(2), 0.6).collect()}
    gate = lambda a, b: min(math.radians(12), max(math.radians(2), 0.6 * (a[3] + b[3]) / 2))
    assert made == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and _far(a, b) <= gate(a, b)}


def test_refresh_matches_at_the_very_limit(spark):
    rows = list(_rows())
    df = spark.createDataFrame([(0, *r) for r in rows], "frame long, id long, yaw double, pitch double, h_fov double")
    want = defaultdict(list)
    for a in rows:
        want[a[0]] = [b[0] for b in rows if _far(a, b) <= math.radians(40)]
    for r in paths.refresh_matches(df, df, ["frame"], math.radians(40)).collect():
        assert r.compatible == ",".join(map(str, want[r.id]))


def test_angle_has_the_arithmetic_of_sql():
    rows = list(_rows())
    assert all(folds._angle(a[1], a[2], b[1], b[2]) == _far(a, b) for a in rows for b in rows)


def test_command_lines_keep_the_sign_of_what_rounds_to_zero(spark, tmp_path):
    """A source's path leaves pitch 0 downwards just before a frame."""
    rows = [(60, 0), (181, 43_199), (59, 86_399)]  # ids give pitches of 0, 0 and -1 degree
    df = spark.createDataFrame([(i, 3, "view", 0.0, s) for i, s in rows], "event_id long, user_id long, event_type string, value double, s long")
    df.selectExpr("event_id", "timestamp_seconds(s) as ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(catalog.SQL["snk04_command_lines"]).fetchall())
    assert sorted(map(tuple, geometry.snk04_command_lines(spark, str(tmp_path)).collect())) == want
    assert any("pitch -0.000000000" in line for *_, line in want)


def test_medoids_of_two_tiles(spark, tmp_path):
    """Two tiles have one distance, so what rounding leaves of a tile's distance from itself names the medoid."""
    rng = random.Random(5)
    rows = [(24 * k + i, [rng.gauss(0, 0.2) for _ in range(8)], 0) for k in range(60) for i in (0, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(f"select pair, medoid, n_selected, covered from ({catalog.SQL['agg19_global_consensus']})").fetchall())
    made = motion.agg19_global_consensus(spark, str(tmp_path)).select("pair", "medoid", "n_selected", "covered")
    assert sorted(map(tuple, made.collect())) == want
