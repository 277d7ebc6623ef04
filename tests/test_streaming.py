"""Streams over Parquet files that arrive one after the other, against the batch operators."""

import datetime as dt

import numpy as np

from orbweave.operators import folds
from orbweave.streaming import observations

KINDS = ("observed", "not_observed", "outside_viewport")


def drain(spark, stream, folder, name):
    run = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{folder}/ck-{name}").trigger(availableNow=True).start()
    run.awaitTermination(120)
    return sorted(map(tuple, spark.table(name).collect()))


def test_track_states_equal_the_batch_fold(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(t, i, KINDS[int(rng.choice(3, p=[0.6, 0.25, 0.15]))], float(rng.integers(1, 9)) / 8) for t in range(8) for i in range(30)]
    schema = "track long, i long, kind string, c double"
    for n in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 10 == n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(spark, observations.lifecycle_stream(stream, "track", "i", "kind", "c"), tmp_path, "states")
    want = sorted(map(tuple, folds.lifecycle(spark.createDataFrame(rows, schema), "track", "i", "kind", "c").select("track", "i", "phase", "confidence", "missing", "outside").collect()))
    assert got == want and any(r[2] == "terminated" for r in got)


def test_late_rows_are_marked(spark, tmp_path):
    schema = "track long, i long, kind string, c double"
    for r in ((1, 5, "observed", 0.5), (1, 3, "not_observed", 0.1)):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert drain(spark, observations.lifecycle_stream(stream, "track", "i", "kind", "c"), tmp_path, "late") == [(1, 3, "late", 0.5, 0, 0), (1, 5, "active", 0.5, 0, 0)]


def test_sessions_close_behind_the_watermark(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    for part in ([("a", at(0)), ("a", at(8)), ("b", at(3))], [("a", at(15)), ("a", at(60)), ("a", at(65))], [("z", at(900))]):
        spark.createDataFrame(part, "k string, t timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(spark, observations.sessions_stream(stream, "k", "t", "10 seconds", "30 seconds", 2), tmp_path, "sessions")
    assert got == [("a", at(0), at(25), 3), ("a", at(60), at(75), 2)]


def test_selections_equal_the_batch_planner(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(s, float(t), k, float(rng.integers(0, 12)) / 4) for s in range(4) for t in range(45) for k in "abc" if k == "a" or rng.random() < 0.8]
    schema = "s long, t double, k string, u double"
    for n in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 15 == n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(spark, observations.selections_stream(stream, "s", "t", "k", "u", 3.0, 0.5, 2.0), tmp_path, "selections")
    want = sorted(map(tuple, folds.greedy_hysteresis(spark.createDataFrame(rows, schema), "s", "t", "k", "u", 3.0, 0.5, 2.0).collect()))
    assert got == want and {r[3] for r in got} == set(folds.REASONS)
