"""Record files, whole-or-nothing sinks, motion from frame to frame and detector heads, against plain loops."""

import json
import math
import os

import numpy as np
import pytest

from orbweave.operators import frames
from orbweave.sinks import atomic
from orbweave.sources import records


def write(path, frame_list):
    path.write_bytes(b"".join(f.tobytes() for f in frame_list))
    return str(path)


def test_records_are_read_by_several_tasks(spark, tmp_path):
    r = np.random.default_rng(1)
    bodies = [r.integers(0, 256, 10, dtype=np.uint8) for _ in range(103)]
    write(tmp_path / "a.raw", bodies)
    write(tmp_path / "b.raw", bodies[:1])
    (tmp_path / "c.raw").touch()
    (tmp_path / "_left.raw").write_bytes(b"x")
    for each in (1, 7, 1000):
        got = records.read_records(spark, f"file://{tmp_path}", 10, records_per_task=each)
        assert got.rdd.getNumPartitions() == {1: 104, 7: 16, 1000: 2}[each]
        rows = sorted((os.path.basename(x["path"]), x["record"], bytes(x["body"]), x["previous"] and bytes(x["previous"])) for x in got.collect())
        assert rows == [("a.raw", i, b.tobytes(), bodies[i - 1].tobytes() if i else None) for i, b in enumerate(bodies)] + [("b.raw", 0, bodies[0].tobytes(), None)]
    assert records.read_records(spark, str(tmp_path / "c.raw"), 10).collect() == []


def test_truncated_and_missing_files_are_errors(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(b"123456789")
    with pytest.raises(Exception, match="ends within a record"):
        records.read_records(spark, str(tmp_path / "a.raw"), 10).collect()
    with pytest.raises(Exception, match="FileNotFound"):
        records.read_records(spark, str(tmp_path / "none"), 10).collect()


def plain_motion(now, before, radius, stride):
    """By its definition, pixel by pixel."""
    height, width = now.shape
    ways = {}
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            at = [(y, x) for y in range(radius, height - radius, stride) for x in range(radius, width - radius, stride)]
            ways[dx, dy] = sum(abs(int(before[y, x]) - int(now[y + dy, x + dx])) for y, x in at) / len(at)
    dx, dy = min(ways, key=lambda s: (ways[s], s[0] ** 2 + s[1] ** 2, abs(s[1]), abs(s[0]), s))
    return dx, dy, ways[dx, dy], ways[0, 0]


def test_motion_and_differences_equal_plain_loops(spark, tmp_path):
    r = np.random.default_rng(2)
    scene = r.integers(0, 256, (40, 50), dtype=np.uint8)
    shots, at = [], (10, 10)
    for k in range(25):
        at = (at[0] + int(r.integers(-3, 4)), at[1] + int(r.integers(-3, 4))) if k % 5 else at
        y, x = (min(max(v, 0), m) for v, m in zip(at, (20, 25)))
        shots.append(np.ascontiguousarray(scene[y : y + 16, x : x + 20]) if k != 20 else np.zeros((16, 20), np.uint8))
    got = records.read_records(spark, write(tmp_path / "v.raw", shots), 320, records_per_task=4)
    diff = {x["record"]: x["difference"] for x in frames.frame_differences(got, 20, 16).collect()}
    assert diff == {i: sum(abs(int(a) - int(b)) for a, b in zip(shots[i].ravel(), shots[i - 1].ravel())) / 320 for i in range(1, 25)}
    for radius, stride in ((3, 1), (4, 2)):
        made = {x["record"]: x for x in frames.motion_series(got, 20, 16, 5.0, radius, stride).collect()}
        for i in range(1, 25):
            want = plain_motion(shots[i], shots[i - 1], radius, stride)
            assert (made[i]["dx"], made[i]["dy"], made[i]["best"], made[i]["zero"]) == want
            assert made[i]["time_seconds"] == i / 5 and made[i]["magnitude"] == pytest.approx(math.hypot(*want[:2]))
    s = frames.difference_summary(frames.frame_differences(got, 20, 16)).first()
    assert s["frame_pair_count"] == 24 and s["maximum"] == max(diff.values()) and s["mean"] == pytest.approx(sum(diff.values()) / 24)
    with pytest.raises(ValueError):
        frames.motion_series(got, 20, 16, 5.0, 8)


def plain_boxes(head, size, classes, threshold, strides):
    grid = [(x, y, s) for s in strides for y in range(size // s) for x in range(size // s)]
    out = []
    for i, (row, (gx, gy, s)) in enumerate(zip(head, grid, strict=True)):
        best = max(row[5:])
        if row[4] * best >= threshold:
            w, h = math.exp(row[2]) * s / size, math.exp(row[3]) * s / size
            out.append((i, row[5:].index(best), row[4] * best, (row[0] + gx) * s / size - w / 2, (row[1] + gy) * s / size - h / 2, w, h))
    return out


@pytest.mark.parametrize(("size", "classes", "strides"), [(416, 80, (8, 16, 32)), (64, 2, (16, 32))])
def test_heads_equal_plain_loops(spark, size, classes, strides):
    r = np.random.default_rng(3)
    n = frames.head_rows(size, strides)
    heads = [np.round(r.normal(0, 0.6, (n, 5 + classes)), 2).tolist() for _ in range(2)]
    bad = [heads[0][:-1], [[float("nan"), *heads[0][0][1:]], *heads[0][1:]], [heads[0][0][:-1], *heads[0][1:]], []]
    df = spark.createDataFrame(list(enumerate([*heads, *bad, None])), "k long, head array<array<double>>")
    got = frames.decode_head(df, "k", "head", size, classes, 0.5, strides).collect()
    for k, head in enumerate(heads):
        mine = sorted(tuple(x)[1:] for x in got if x["k"] == k)
        want = plain_boxes(head, size, classes, 0.5, strides)
        assert [m[:2] for m in mine] == [w[:2] for w in want] and np.allclose([m[2:] for m in mine], [w[2:] for w in want]) and want
    assert {x["k"] for x in got} == {0, 1}
    rules = sorted(map(tuple, frames.head_violations(df, "k", "head", size, classes, strides).collect()))
    assert rules == [("row_count", 2), ("row_count", 5), ("row_count", 6), ("row_values", 3), ("row_values", 4), ("row_values", 6)]
    assert (size, n) != (416, 0) and (size != 416 or n == 3549)


def nothing_left(folder):
    return [x for x in os.listdir(folder) if x.startswith(".")] == []


def test_one_file_of_all_rows_in_order(spark, tmp_path):
    rows = spark.range(1000).selectExpr("cast(id as string) as line", "id").repartition(7).orderBy("id").select("line")
    target = tmp_path / "all.txt"
    atomic.write_file(rows, f"file://{target}")
    assert target.read_text() == "".join(f"{i}\n" for i in range(1000)) and nothing_left(tmp_path)
    with pytest.raises(Exception, match="FileExists"):
        atomic.write_file(rows, str(target))
    assert target.read_text().startswith("0\n1\n") and nothing_left(tmp_path)
    atomic.write_file(rows.where("false"), str(tmp_path / "empty.txt"))
    assert (tmp_path / "empty.txt").read_bytes() == b""
    with pytest.raises(Exception, match="never overwrite"):
        spark.range(1).selectExpr("'x' as line").write.format("atomic_file").mode("overwrite").save(str(tmp_path / "z"))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = spark.range(100).repartition(4).selectExpr("if(id = 77, null, cast(id as string)) as line")
    with pytest.raises(Exception, match="a null is no line"):
        atomic.write_file(bad, str(tmp_path / "x.txt"))
    files = spark.range(9).selectExpr("if(id = 5, '../up', concat('f', id)) as name", "'c' as content").repartition(3)
    with pytest.raises(Exception, match="no file of a bundle"):
        atomic.write_bundle(files, str(tmp_path / "b"))
    with pytest.raises(Exception, match="holds a name once"):
        atomic.write_bundle(spark.range(4).selectExpr("concat('f', id % 3) as name", "'c' as content").repartition(4), str(tmp_path / "b"))
    assert os.listdir(tmp_path) == []


def test_a_bundle_appears_at_once(spark, tmp_path):
    target = tmp_path / "run"
    atomic.write_bundle(spark.range(5).selectExpr("concat('f', id, '.json') as name", "repeat('ä', cast(id as int)) as content").repartition(3), str(target))
    assert sorted(os.listdir(target)) == ["artifacts.json", *(f"f{i}.json" for i in range(5))] and nothing_left(tmp_path)
    said = json.loads((target / "artifacts.json").read_text())
    assert {k: v["bytes"] for k, v in said.items()} == {f"f{i}.json": 2 * i for i in range(5)} and (target / "f3.json").read_text() == "äää"
    with pytest.raises(Exception, match="FileExists"):
        atomic.write_bundle(spark.range(1).selectExpr("'a' as name", "'c' as content"), str(target))
    assert len(os.listdir(target)) == 6


def test_a_lost_race_keeps_the_winner(tmp_path):
    """The target appears between the job's start and its commit."""
    from pyspark.sql.types import BinaryType, StringType, StructType

    for kind, schema, name in ((atomic._FileWriter, StructType().add("value", BinaryType()), "f"), (atomic._BundleWriter, StructType().add("name", StringType()).add("content", BinaryType()), "b")):
        target = tmp_path / name
        late = kind({"path": str(target)}, schema, False)
        parts = atomic.Parts(0, [late.put("part", iter([b"late"]))])
        target.mkdir() if name == "b" else target.write_bytes(b"first")
        if name == "b":
            (target / "x").write_bytes(b"first")
        with pytest.raises(OSError):
            late.commit([parts])
        assert (target / "x" if name == "b" else target).read_bytes() == b"first" and nothing_left(tmp_path)
        late = kind({"path": str(tmp_path / f"{name}2")}, schema, False)
        late.put("part", iter([b"x"]))
        late.abort([])
        assert not (tmp_path / f"{name}2").exists() and nothing_left(tmp_path)
