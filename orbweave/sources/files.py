"""Readers for observation files: nested JSON, scene-score text and timestamp lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The labels of sound windows, in their declared order.
SOUND_LABELS = ("music", "applause", "clapping", "cheering")
_CANDIDATE = "id string, kind string, confidence double, yawRadians double, pitchRadians double, horizontalFovRadians double, viewportId string, boundingBox struct<x:double,y:double,width:double,height:double>"
_FRAMES = f"provenance struct<adapterId:string,adapterVersion:string,backendId:string,projectionStrategy:string,weightsSha256:string>, frames array<struct<sourceId:string,frameIndex:int,timestampSeconds:double,candidates:array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _CANDIDATE.split(', '))}>>>>"
_SOUND = "source_id string, start double, duration double, classifications array<struct<label:string,confidence:double>>"


def _frame_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_FRAMES).option("multiLine", True).json(path).select("provenance", F.explode("frames").alias("f"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, frame_index, ts, candidates): every frame of frame documents once, with the number of its candidates, 0 included.

    What follows candidates through a sequence takes this beside ``read_candidates``, as a frame in which nothing is seen counts.
    """
    rows = _frame_documents(spark, path).select(F.col("f.sourceId").alias("source_id"), F.col("f.frameIndex").alias("frame_index"), F.col("f.timestampSeconds").alias("ts"), F.coalesce(F.size("f.candidates"), F.lit(0)).alias("n"))
    return rows.groupBy("source_id", "frame_index", "ts").agg(F.sum(F.greatest("n", F.lit(0))).alias("candidates"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row a candidate of a frame document; frames that share source, index and time are one frame.

    A frame without candidates gives no row here; ``read_frames`` lists it. ``viewport_count`` counts the viewports its
    rows come from.
    """
    frames = _frame_documents(spark, path)
    rows = frames.select(F.col("f.sourceId").alias("source_id"), F.col("f.frameIndex").alias("frame_index"), F.col("f.timestampSeconds").alias("ts"), F.col("provenance.adapterId").alias("adapter_id"), F.explode("f.candidates").alias("c"))
    flat = rows.select(
        "source_id", "frame_index", "ts", "adapter_id", F.col("c.id").alias("candidate_id"), F.col("c.kind").alias("kind"), F.col("c.confidence").alias("confidence"), F.col("c.yawRadians").alias("yaw"),
        F.col("c.pitchRadians").alias("pitch"), F.col("c.horizontalFovRadians").alias("h_fov"), F.col("c.viewportId").alias("viewport_id"), F.col("c.boundingBox").alias("box"),
    )
    return flat.withColumn("viewport_count", F.size(F.collect_set("viewport_id").over(Window.partitionBy("source_id", "frame_index", "ts"))))


def read_sound_windows(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, start, duration, one confidence for each label); a label that isn't reported is null."""
    windows = spark.read.schema(_SOUND).json(path)
    said = F.map_from_entries("classifications")
    return windows.select("source_id", "start", "duration", *[F.try_element_at(said, F.lit(label)).alias(label) for label in SOUND_LABELS])


def read_scene_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, timestamp_seconds, scene_score, valid) from text of frame lines and score lines (lines from 0).

    A score belongs to the frame line before it and uses it up, so a score counts when the last line of either
    kind was a frame. Lines of other kinds don't matter. ``valid``: time at least 0, score from 0 to 1.

    A file is read in splits: lines are numbered within their split, and a table of one row for each split says how many
    lines stand before it and what the last known line before it was, so a score finds its frame across the border.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("said"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    number = lambda pattern: F.expr(f"try_cast(nullif(regexp_extract(said, '{pattern}', 1), '') as double)")
    # The two kinds of line.
    marked = lines.withColumn("at", number(r"^frame:\\d+\\s+pts:\\S+\\s+pts_time:([0-9.eE+-]+)$")).withColumn("score", number(r"^lavfi\\.scene_score=([0-9.eE+-]+)$"))
    known = F.when(F.col("at").isNotNull() | F.col("score").isNotNull(), F.struct("at"))
    inside = Window.partitionBy("path", "block").orderBy("place")
    rows = marked.withColumn("n", F.row_number().over(inside)).withColumn("ahead", F.last(known, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = marked.groupBy("path", "block").agg(F.count(F.lit(1)).alias("lines"), F.max_by(known, F.when(known.isNotNull(), F.col("place"))).alias("last"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("path", "block", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"), F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    found = rows.where("score is not null").join(blocks, ["path", "block"]).withColumn("frame_at", F.coalesce("ahead", "carried")["at"]).where("frame_at is not null")
    return found.select("path", (F.col("before") + F.col("n") - 1).cast("int").alias("line"), F.col("frame_at").alias("timestamp_seconds"), F.col("score").alias("scene_score"), ((F.col("frame_at") >= 0) & F.col("score").between(0, 1)).alias("valid"))


def read_timestamps(spark: SparkSession, path: str) -> DataFrame:
    """(ts) from a list of one number a line; blank lines and lines that begin with # are none."""
    said = F.trim("value")
    return spark.read.text(path).where((said != "") & ~said.startswith("#")).select(said.cast("double").alias("ts"))
