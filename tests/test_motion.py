"""Motion chains and stabilisation by hand; registrations of known rotations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.functions import matrix, sphere
from orbweave.functions import quaternion as quat
from orbweave.operators import motion, rotation


def test_source_motion_disconnects_for_good(spark):
    a = math.radians(5)
    turn = (0.0, math.sin(a / 2), 0.0, math.cos(a / 2))
    none = (None,) * 4
    rows = [(1, 0, 0.0, 1.0, *turn, 0.8, 0.9, 0.01, 6, None), (1, 1, 1.0, 2.0, *turn, 0.8, 0.9, 0.01, 3, None), (1, 2, 2.0, 3.0, *none, 0.0, 0.0, None, 0, "rotation_fit_failed"), (1, 3, 3.0, 4.0, *turn, 0.8, 0.7, 0.02, 3, None), (2, 0, 0.5, 1.0, *turn, 0.5, 0.9, 0.01, 6, None), (2, 1, 1.5, 2.0, *turn, 0.5, 0.9, 0.01, 6, None)]
    df = spark.createDataFrame(rows, "s int, p int, a double, b double, x double, y double, z double, w double, confidence double, inlier_ratio double, residual double, contributing int, failure_reason string")
    made = motion.source_motion(df, "s", "p", "a", "b", 6)
    got = sorted((r["s"], r["sample"], r["t"], r["state"], r["reason"] or "", round(2 * math.degrees(math.atan2(r["y"], r["w"])), 6), round(r["confidence"], 6), r["inlier_ratio"], r["coverage"], round(r["residual"], 6)) for r in made.collect())
    assert got == [
        (1, 0, 0.0, "measured", "", 0.0, 1.0, 1.0, 1.0, 0.0), (1, 1, 1.0, "measured", "", 5.0, 0.8, 0.9, 1.0, 0.01), (1, 2, 2.0, "measured", "", 10.0, round(0.8 * math.sqrt(0.5), 6), 0.9, 0.5, 0.01), (1, 3, 3.0, "invalid", "rotation_fit_failed", 10.0, 0.0, 0.0, 0.0, round(math.pi, 6)),
        (1, 4, 4.0, "invalid", "disconnected_absolute_path", 10.0, 0.0, 0.7, 0.5, 0.02), (2, 0, 0.5, "measured", "", 0.0, 1.0, 1.0, 1.0, 0.0), (2, 1, 1.0, "measured", "", 5.0, 0.5, 0.9, 1.0, 0.01), (2, 2, 2.0, "invalid", "pairs_not_contiguous", 5.0, 0.0, 0.0, 0.0, round(math.pi, 6)),
    ]
    gaps = sorted(tuple(r) for r in motion.motion_gaps(made, "s").collect())
    assert gaps == [(1, 2.0, 3.0, "rotation_fit_failed"), (1, 3.0, 4.0, "disconnected_absolute_path"), (2, 1.5, 2.0, "pairs_not_contiguous")]


def test_segments_of_one_source_in_several_tasks(spark):
    """The block scan gives the rows of a plain loop, however the source is cut: inside segments, at their ends, and where all fails."""
    r = np.random.default_rng(6)
    rows = []
    for s, n in ((1, 300), (2, 40), (3, 1), (4, 30)):
        for i in range(n):
            state = "invalid" if s == 4 else r.choice(["measured", "interpolated", "invalid"], p=[0.8, 0.15, 0.05] if s == 1 else [0.3, 0.2, 0.5])
            q = r.normal(size=4) * (1 if i % 2 else 0.2) + np.array([0, 0, 0, 2.0])
            rows.append((s, i, float(i), i + 1.0, str(state), *((None,) * 4 if state == "invalid" else map(float, q))))
    want = []
    for s in (1, 2, 3, 4):
        number, at = 0, None
        for _, i, a, b, state, *q in [x for x in rows if x[0] == s]:
            if state == "invalid":
                at = None
                continue
            if at is None:
                number, at = number + 1, np.array([0, 0, 0, 1.0])
                want.append((s, number, i, a, "segment_anchor", at))
            new = rotation.multiply(at, np.array(q) / np.linalg.norm(q))
            new /= np.linalg.norm(new)
            at = new if new @ at >= 0 else -new
            want.append((s, number, i, b, state, at))
    df = spark.createDataFrame(rows, "s int, i int, start double, end double, state string, x double, y double, z double, w double").repartition(5)
    for parts in ("1", "4", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = sorted(((x["s"], x["segment"], x["i"], x["t"], x["state"], np.array([x[c] for c in "xyzw"])) for x in rotation.relative_segments(df, "s", "i").collect()), key=lambda x: x[:4])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert [x[:5] for x in got] == [x[:5] for x in sorted(want, key=lambda x: x[:4])]
        assert all(np.allclose(a[5], b[5], atol=1e-9) for a, b in zip(got, sorted(want, key=lambda x: x[:4]), strict=True))


def test_registration_of_a_pure_rotation_is_fitted_back(spark):
    """The homography of a camera that turns about its own axis gives its rotation back."""
    w, h, fov, angle = 640, 360, math.radians(90), math.radians(2)
    f = w / 2 / math.tan(fov / 2)
    k = np.array([[f, 0, w / 2 - 0.5], [0, f, h / 2 - 0.5], [0, 0, 1]])
    roll = np.array([[math.cos(angle), -math.sin(angle), 0], [math.sin(angle), math.cos(angle), 0], [0, 0, 1]])
    m = (k @ roll @ np.linalg.inv(k)).ravel().tolist()
    df = spark.createDataFrame([(1, m, 640.0, 360.0, 0.3, 0.2, fov, 0.0)], "pair long, homography array<double>, width double, height double, yaw double, pitch double, h_fov double, roll double")
    fit = rotation.fit_rotations(motion.registration_samples(df, "homography", 9, 7), "pair").first()
    assert 2 * math.acos(min(1.0, fit["w"])) == pytest.approx(angle, abs=1e-6) and fit["inlier_ratio"] == 1.0
    axis = np.array([fit["x"], fit["y"], fit["z"]])
    ahead = np.array([math.cos(0.2) * math.sin(0.3), math.sin(0.2), math.cos(0.2) * math.cos(0.3)])
    assert abs(abs(axis @ ahead) / np.linalg.norm(axis) - 1) < 1e-6


def test_points_out_of_view_are_left_out(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 400.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], 640.0, 360.0, 0.0, 0.0, 1.5, 0.0), (2, [0.0] * 9, 640.0, 360.0, 0.0, 0.0, 1.5, 0.0)], "pair long, homography array<double>, width double, height double, yaw double, pitch double, h_fov double, roll double")
    got = motion.registration_samples(df, "homography").collect()
    assert sorted({round(r["column_fraction"], 3) for r in got}) == [0.1, 0.3] and {r["pair"] for r in got} == {1}


def test_fit_variants_leave_out_each_view(spark):
    df = spark.createDataFrame([(1, v, 0.1 * v) for v in (1, 2, 3)], "pair long, view long, row_fraction double")
    got = motion.fit_variants(df, ["pair"], "view", {"best": spark.createDataFrame([(1, 2)], "pair long, view long")}).collect()
    found = {}
    for r in got:
        found.setdefault(r["variant"], set()).add(r["view"])
    assert found == {"all": {1, 2, 3}, "without:1": {2, 3}, "without:2": {1, 3}, "without:3": {1, 2}, "best": {2}}
    assert {r["view"] for r in motion.without_bottom(df, "view", [3], 0.8).collect()} == {1, 2}


def test_first_reason_names_a_rejected_fit(spark):
    df = spark.createDataFrame([(1, 1.0, 0.9, 0.9, 0.001), (2, 0.5, 0.0, 0.0, 9.0), (3, 1.0, 0.0, 0.0, 9.0), (4, 1.0, 0.9, 0.0, 9.0), (5, 1.0, 0.9, 0.9, 9.0), (6, None, 0.0, 0.0, 9.0)], "i int, w double, confidence double, inlier_ratio double, residual double")
    got = [r["failure_reason"] for r in motion.judge_fits(df, 0.1, 0.5, 0.5, 1.0).orderBy("i").collect()]
    assert got == [None, *motion.FIT_REASONS, "rotation_fit_failed"]


def test_a_steady_source_needs_no_crop(spark):
    still = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    shaken = [1.0, 0.0, 8.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    back = [1.0, 0.0, -8.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(1, 0.1 * i, still, "measured") for i in range(10)] + [(2, 0.1 * i, shaken if i % 2 else back, "measured") for i in range(10)]
    df = spark.createDataFrame(rows, "s int, t double, h array<double>, state string")
    path = motion.similarity_path(df, "s", "t", "h", "state")
    frames, sources = motion.stabilize(motion.smooth_similarities(path, "s", "t", 0.3), "s", "t", 640, 360)
    got = {r["s"]: r for r in sources.collect()}
    assert got[1]["margin"] == 0 and got[1]["crop_width"] == 640 and 1 <= got[2]["margin"] <= 8
    assert all(r["displacement"] < 1e-9 for r in frames.where("s = 1").collect())
    ends = motion.similarity_path(spark.createDataFrame([(1, 0.0, still, "measured"), (1, 1.0, shaken, "measured"), (1, 2.0, shaken, "failed")], "s int, t double, h array<double>, state string"), "s", "t", "h", "state", backwards=True)
    assert [r["x"] for r in ends.orderBy("t").collect()] == [0.0, -8.0, -8.0]


def test_angles_unwrap_to_the_nearest_turn(spark):
    pi = math.pi
    df = spark.createDataFrame([(3.0, 0.0), (3.5, 0.0), (-3.5, 0.0), (pi, 0.0), (-pi, 0.0), (20.0, 1.0), (-20.0, 1.0)], "v double, r double")
    got = [round(x[0], 6) for x in df.select(matrix.unwrap(F.col("v"), F.col("r"))).collect()]
    assert got == [round(x, 6) for x in (3.0, 3.5 - 2 * pi, 2 * pi - 3.5, pi, -pi, 20 - 6 * pi, -20 + 6 * pi)]


def test_rotations_without_length_and_poles(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (math.sin(-math.pi / 4), 0.0, 0.0, math.cos(math.pi / 4)), (0.0, 0.0, 0.0, 2.0)], "x double, y double, z double, w double")
    q = [F.col(c) for c in "xyzw"]
    got = [tuple(r) for r in df.select(quat.unit(q)[3].alias("u"), *[a.alias(n) for a, n in zip(quat.yaw_pitch_roll(q), "ypr")]).collect()]
    assert got[0] == (None, None, None, None) and got[1][1:] == (None, None, None) and got[2] == (1.0, 0.0, 0.0, 0.0)


def test_seed_boxes_are_cut_by_a_pixel_at_most(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5, 0.5), (0.9, 0.5, 0.1015, 0.2), (0.9, 0.5, 0.11, 0.2), (-0.01, 0.5, 0.1, 0.2), (0.1, 0.9, 0.1, 0.101), (0.1, 0.1, 0.0, 0.1)], "x double, top double, w double, h double")
    made = sphere.seed_box(*[F.col(c) for c in ("x", "top", "w", "h")], 640, 360, 1.0)
    got = [tuple(None if v is None else round(v, 6) for v in r) for r in df.select(*[c.alias(n) for n, c in made.items()]).collect()]
    assert got == [(0.5, 0.0, 0.5, 0.5), (0.9, 0.3, 0.1, 0.2), (None,) * 4, (None,) * 4, (0.1, 0.0, 0.1, 0.1), (None,) * 4]


def test_global_motion_of_native_tiles(spark):
    """Tiles of a camera that turns by two degrees, given as a native library gives them, and two that saw something else: the motion is the turn back."""
    w, h, fov, angle = 640, 360, math.radians(90), math.radians(2)
    f = w / 2 / math.tan(fov / 2)
    k = np.array([[f, 0, w / 2 - 0.5], [0, f, h / 2 - 0.5], [0, 0, 1]])
    flip = np.array([[1, 0, 0], [0, -1, h - 1.0], [0, 0, 1]])
    axis = np.array([0.3, 0.9, -0.2]) / np.linalg.norm([0.3, 0.9, -0.2])  # of the world's turn

    def rotation_of(q):
        x, y, z, s = q
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * s), 2 * (x * z + y * s)], [2 * (x * y + z * s), 1 - 2 * (x * x + z * z), 2 * (y * z - x * s)], [2 * (x * z - y * s), 2 * (y * z + x * s), 1 - 2 * (x * x + y * y)]])

    world = np.array([*(axis * math.sin(angle / 2)), math.cos(angle / 2)])
    other = np.array([math.sin(0.4), 0.0, 0.0, math.cos(0.4)])
    rows = []
    for tile in range(8):
        yaw = math.radians(60 * tile)
        frame = np.array([[math.cos(yaw), 0, math.sin(yaw)], [0, 1, 0], [-math.sin(yaw), 0, math.cos(yaw)]])  # camera to world, x right, y up, z ahead
        image = np.diag([1.0, -1.0, 1.0])  # an image's y goes down
        turn = rotation_of(other if tile > 5 else world)
        m = k @ image @ frame.T @ turn @ frame @ image @ np.linalg.inv(k)  # source to target pixels, from the top left
        native = flip @ np.linalg.inv(m) @ flip
        rows.append((1, tile, tile % 4, (native / native[2, 2]).ravel().tolist(), float(w), float(h), yaw, 0.0, fov, 0.0))
    df = spark.createDataFrame(rows, "pair long, tile long, view long, homography array<double>, width double, height double, yaw double, pitch double, h_fov double, roll double")
    samples = motion.native_samples(df, "homography", 7, 5)
    fits, members, motions = motion.global_motion(samples, ["pair"], "tile", "view", math.radians(3), 4, 3)
    assert {x["tile"] for x in members.where("selected").collect()} == set(range(6))
    for x in fits.collect():
        want = other if x["tile"] > 5 else world
        assert abs(abs(np.dot([x[c] for c in "xyzw"], want)) - 1) < 1e-9
    got = motions.first()
    back = np.array([*-world[:3], world[3]])
    assert got["state"] == "selected" and abs(abs(np.dot([got[c] for c in "xyzw"], back)) - 1) < 1e-9 and got["n_selected"] == 6 and got["covered"] == 4
    few = motion.global_motion(samples.where("tile in (0, 4, 1, 5)"), ["pair"], "tile", "view", math.radians(3), 4, 3)[2].first()
    assert few["failure_reason"] == "insufficient_global_viewport_coverage" and few["w"] is None


def test_gaps_read_no_frame_to_the_end_for_each_row(spark):
    steps = spark.createDataFrame([("a", i, "measured" if i % 5 < 3 else "invalid", 0.0, 0.0, math.sin(i / 40), math.cos(i / 40)) for i in range(20)], "s string, i int, state string, x double, y double, z double, w double")
    made = motion.bridge_gaps(steps, "s", "i")
    assert "unboundedfollowing" not in made._jdf.queryExecution().executedPlan().toString().lower()  # Spark reads such a frame again for every row
    rows = made.where("gap_class = 'bridge_candidate'").collect()
    assert len(rows) == 6 and all(r.z == pytest.approx(math.sin(r.i / 40)) for r in rows)
