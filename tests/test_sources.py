"""Readers against small files."""

import hashlib
import json
import math

import pytest

from orbweave.sinks import documents
from orbweave.sources import events, files


def test_candidates_of_one_frame_from_two_views(spark, tmp_path):
    seen = lambda i, view: {"id": i, "kind": "human", "confidence": 0.5, "yawRadians": 0.1, "pitchRadians": 0.0, "horizontalFovRadians": 0.2, "viewportId": view, "boundingBox": {"x": 0.1, "y": 0.1, "width": 0.2, "height": 0.3}}
    frame = lambda *c: {"sourceId": "s", "frameIndex": 3, "timestampSeconds": 1.0, "candidates": list(c)}
    doc = {"provenance": {"adapterId": "a", "adapterVersion": "1"}, "frames": [frame(seen("x", "front")), frame(seen("y", "right")), {**frame(), "frameIndex": 4}]}
    (tmp_path / "doc.json").write_text(json.dumps(doc, indent=2))
    rows = files.read_candidates(spark, str(tmp_path)).orderBy("candidate_id").collect()
    assert [(r.candidate_id, r.viewport_id, r.viewport_count, r.frame_index, r.box.height) for r in rows] == [("x", "front", 2, 3, 0.3), ("y", "right", 2, 3, 0.3)]


def test_sound_labels_become_columns(spark, tmp_path):
    rows = [{"source_id": "s", "start": 1.5, "duration": 3.0, "classifications": [{"label": "applause", "confidence": 0.7}, {"label": "music", "confidence": 0.1}]}, {"source_id": "s", "start": 3.0, "duration": 3.0, "classifications": []}]
    (tmp_path / "w.json").write_text("\n".join(map(json.dumps, rows)))
    got = [tuple(r) for r in files.read_sound_windows(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == [("s", 1.5, 3.0, 0.1, 0.7, None, None), ("s", 3.0, 3.0, None, None, None, None)]


def test_scene_scores_follow_their_frames(spark, tmp_path):
    text = "lavfi.scene_score=0.9\nframe:0 pts:0 pts_time:0\nlavfi.scene_score=0.5\nlavfi.scene_score=0.6\nframe:1 pts:9 pts_time:1.5\nnoise\nframe:2 pts:10 pts_time:2e0\n  lavfi.scene_score=0.25  \nframe:3 pts:x pts_time:3\nlavfi.scene_score=1.5\n"
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("lavfi.scene_score=0.1\n")
    got = [(r.timestamp_seconds, r.scene_score, r.valid) for r in files.read_scene_metadata(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [(0.0, 0.5, True), (2.0, 0.25, True), (3.0, 1.5, False)]
    bad = events.scene_violations(files.read_scene_metadata(spark, str(tmp_path)), 0.4)
    assert sorted((r["rule_id"], r["line"]) for r in bad.collect()) == [("below_threshold", 7), ("out_of_range", 9)]


def test_one_scene_file_in_several_tasks(spark, tmp_path):
    """Wherever a file is cut, between a frame and its score too, it reads as a plain loop reads it."""
    said = []
    for k in range(400):
        said += [f"frame:{k} pts:{k * 40} pts_time:{k / 25}"] * (k % 3 > 0) + ["", "other"] * (k % 5 == 0) + [f"lavfi.scene_score={k % 11 / 10}"] * (1 + (k % 4 == 0))
    for name, end in (("a", "\n"), ("b", "\r\n")):
        (tmp_path / f"{name}.txt").write_bytes((end.join(said) + end).encode())
    want, frame = [], None
    for n, line in enumerate(said):
        if line.startswith("frame:"):
            frame = float(line.rsplit(":", 1)[1])
        elif line.startswith("lavfi"):
            if frame is not None:
                want.append((n, frame, float(line.split("=")[1])))
            frame = None
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("97", "1000", "1g"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            got = files.read_scene_metadata(spark, str(tmp_path))
            rows = sorted((r.path[-5:], r.line, r.timestamp_seconds, r.scene_score) for r in got.collect())
            assert rows == [(f"{x}.txt", *w) for x in "ab" for w in want]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])


def test_timestamp_lists(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# seconds\n1.5\n\n 20 \n#3\n")
    assert sorted(r.ts for r in files.read_timestamps(spark, str(tmp_path)).collect()) == [1.5, 20.0]


def detector_document():
    box = lambda i, kind, score, b: {"class_name": kind, "score": score, "source_index": i, "box_top_left_normalized": b}
    view = lambda name, yaw: {"viewport_id": name, "yaw_radians": yaw, "pitch_radians": 0.0, "horizontal_fov_radians": math.pi / 2, "width_pixels": 640, "height_pixels": 360}
    return {
        "source_id": "s", "model_id": "m", "viewports": [view("front", 0.0), view("right", math.pi / 2)],
        "events": [
            {"timestamp_seconds": 1.0, "viewport_id": "front", "detections": [box(0, "person", 0.5, [0.4, 0.4, 0.2, 0.2]), box(1, "bicycle", 0.4, [0.1, 0.1, 0.2, 0.2]), box(2, "person", 0.9, [0.0, 0.0, 0.5, 1.0])]},
            {"timestamp_seconds": 1.0, "viewport_id": "right", "detections": [box(0, "dog", 0.5, [0.4, 0.4, 0.2, 0.2]), box(1, "person", 1.5, [0.9, 0.4, 0.2, 0.2])]},
            {"timestamp_seconds": 2.0, "viewport_id": "left", "detections": []},
        ],
    }


def test_detector_events(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(detector_document(), indent=1))
    rows, bad = events.read_detector_events(spark, str(tmp_path))
    front = sorted((r["place"], r["class_name"], r["source_index"]) for r in rows.collect() if r["viewport_id"] == "front")
    assert front == [(1, "bicycle", 1), (2, "person", 2), (3, "person", 0)]
    assert sorted((r["rule_id"], r["viewport_id"]) for r in bad.collect()) == [("box_leaves_image", "right"), ("class", "right"), ("score_range", "right"), ("unknown_viewport", "left")]
    sphere = {r["id"]: r for r in events.spherical_rows(rows.where("viewport_id = 'front'")).collect()}
    middle = sphere["front:person:0"]
    assert abs(middle["yaw"]) < 1e-9 and abs(middle["pitch"]) < 1e-9 and middle["h_fov"] == pytest.approx(2 * math.atan(0.2))
    assert middle["pitch_min"] == pytest.approx(-middle["pitch_max"])
    assert json.loads(middle["provenance"]) == {"box_top_left_normalized": [0.4, 0.4, 0.2, 0.2], "class_name": "person", "model_id": "m", "source_index": 0, "viewport_id": "front"}


def test_seeds_take_the_smallest_box(spark):
    told = lambda i, view, b, kind="person": json.dumps({"box_top_left_normalized": b, "class_name": kind, "source_index": i, "viewport_id": view})
    seen = [told(3, "b", [0.1, 0.1, 0.2, 0.3]), told(2, "a", [0.5, 0.5, 0.3, 0.1]), told(1, "b", [0.5, 0.5, 0.3, 0.1]), told(0, "a", [0.9, 0.5, 0.2, 0.1]), told(0, "a", [0.1, 0.1, 0.1, 0.1], "bicycle"), "duplicate-source:x"]
    views = spark.createDataFrame([(v, 0.0, 0.0, math.pi / 2, 640, 360) for v in "ab"], "viewport_id string, yaw double, pitch double, h_fov double, width int, height int")
    got = events.seeds(spark.createDataFrame([("t", "person", seen), ("u", "person", ["duplicate-source:x"])], "track_id string, kind string, provenance array<string>"), views).collect()
    assert [(r["track_id"], r["viewport_id"], r["source_index"], r["eligible"], round(r["y"], 6)) for r in got] == [("t", "a", 2, 3, 0.4)]


def test_tile_evidence(spark, tmp_path):
    frame = lambda i, t, state="measured", h=9: {"frameIndex": i, "timestampSeconds": t, "state": state, "homographyRowMajor": [1.0] * h if state == "measured" else None}
    tile = lambda name, x: {"id": name, "x": x, "y": 0, "width": 320, "height": 180, "evidenceFile": f"{name}.json"}
    (tmp_path / "e").mkdir()
    (tmp_path / "m.json").write_text(json.dumps({"sourceId": "s", "viewportId": "v", "parentWidth": 640, "parentHeight": 360, "tiles": [tile("a", 0), tile("b", 320), tile("c", 400), tile("d", 0)]}))
    for name, frames, width in (("a", [frame(0, 0.0, "reference"), frame(1, 0.5)], 320), ("b", [frame(0, 0.0, "reference"), frame(1, 0.6, h=8)], 320), ("c", [frame(0, 0.0, "reference"), frame(1, 0.5)], 300)):
        (tmp_path / "e" / f"{name}.json").write_text(json.dumps({"frameWidth": width, "frameHeight": 180, "observations": frames}))
    rows, bad = events.read_tile_evidence(spark, str(tmp_path / "m.json"), str(tmp_path / "e"))
    assert sorted((r["tile_id"], r["frame_index"], r["homography"] is None) for r in rows.where("tile_id = 'a'").collect()) == [("a", 0, True), ("a", 1, False)]
    found = sorted((r["tile_id"], r["rule_id"]) for r in bad.collect())
    assert found == [("b", "homography"), ("b", "timing"), ("c", "dimensions"), ("c", "outside_parent"), ("d", "dimensions"), ("d", "homography"), ("d", "timing"), ("d", "too_few_frames")]


POLICY = """
schema_version = "v1"
[weights]
presence = 0.4
persistence = 0.25
composition = 0.22
forward_prior = 0.13
[hysteresis]
minimum_dwell_seconds = 3.0
switch_margin = 0.17
challenger_hold_seconds = 0.8
[camera]
min_angular_change_degrees = 4.0
minimum_horizontal_fov_degrees = 95.0
candidate_extent_padding_degrees = 7.0
maximum_zoom_in_change_degrees = 21.0
"""


def test_greedy_policy():
    p = events.greedy_policy(POLICY)
    assert p.weights["presence"] == 0.4 and (p.dwell, p.margin, p.hold) == (3.0, 0.17, 0.8) and p.keyframe_angle == pytest.approx(math.radians(4))
    for old, new, said in (("presence = 0.4", "", "missing weight presence"), ("presence = 0.4", "presence = -1", "weights.presence"), ("[camera]", "[camera]\nodd = 1", "unknown field camera.odd"), ("= 95.0", "= 180.0", "least_fov"), ("= 3.0\nswitch", "= true\nswitch", "minimum_dwell_seconds")):
        with pytest.raises(ValueError, match=said):
            events.greedy_policy(POLICY.replace(old, new))


def test_manifest(spark, tmp_path):
    (tmp_path / "m.toml").write_text('version = 1\n[[asset]]\nid = "a"\nseconds = [30, 60]\n[[asset]]\nid = "b"\nwidth = 640\n')
    got = [(r["place"], r["id"], r["fields"]) for r in events.read_manifest(spark, str(tmp_path / "m.toml")).orderBy("place").collect()]
    assert got == [(0, "a", {"seconds": "[30, 60]"}), (1, "b", {"width": "640"})]


def test_canonical_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", [1.5, 2.0], None), (2, "a", [], 3)], "id int, name string, list array<double>, n int")
    for row in documents.documents(df, ["id"]).collect():
        assert row["document"].endswith("\n") and list(json.loads(row["document"])) == ["list", "n", "name"] and row["sha256"] == hashlib.sha256(row["document"].encode()).hexdigest()
    with pytest.raises(Exception, match="NaN"):
        documents.documents(spark.createDataFrame([(1, float("nan"))], "id int, x double"), ["id"]).collect()
    motion = documents.known_motion(spark.createDataFrame([(1, 1.0), (2, 0.1)], "k int, seconds double"), "k", 4.0, 8.0, 1.0, 0.5)
    documents.write_motion(motion, str(tmp_path / "m"), "time_seconds")
    got = spark.read.option("header", True).csv(str(tmp_path / "m")).orderBy("time_seconds").collect()
    assert [float(r["raw_yaw_degrees"]) for r in got] == [1.0, 1.0, 5.0, 5.0]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        documents.write_motion(motion, str(tmp_path / "m"), "time_seconds")
    documents.write_lines(spark.createDataFrame([(2, "b"), (1, "a")], "i int, line string"), str(tmp_path / "t"), ["i"])
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a", "b"]
