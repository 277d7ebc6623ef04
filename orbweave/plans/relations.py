"""The domain's relations over the test tables; each has a twin in SQL for the oracle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions import sphere


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), t.alias("t"), F.col("event_type").alias("kind"), (F.col("value") / 500).alias("score"), F.col("event_id").alias("id"))


def candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(
        F.floor(t / 3600).alias("frame"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), sphere.wrap_floor(F.col("value") * 7.3).alias("yaw"),
        F.radians((F.col("event_id") % 121 - 60).cast("double")).alias("pitch"), F.radians((10 + F.col("event_id") % 40).cast("double")).alias("h_fov"),
    )


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's numbered selections with their directions."""
    w = Window.partitionBy("source_id").orderBy("t", "id")
    c = candidate(spark, sf_dir).select("id", "yaw", "pitch", "h_fov")
    return signal(spark, sf_dir).select("source_id", "id", "t", "kind", "score", F.row_number().over(w).cast("long").alias("i")).join(c, "id")


def sighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of sixteen sources in frames of six hours; some kinds come with a tracker's id."""
    c = candidate(spark, sf_dir).select("id", "kind", "yaw", "pitch", "h_fov")
    s = signal(spark, sf_dir).select("id", (F.col("source_id") % 16).alias("source"), F.floor(F.col("t") / 21600).alias("frame"), "t")
    upstream = F.when(F.col("kind") == "purchase", F.concat(F.lit("up-"), (F.col("id") % 9).cast("string")))
    return s.join(c, "id").withColumn("upstream", upstream)


def registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image registrations near the identity: four sources, pairs of frames, six views a pair."""
    e = lambda i: F.element_at("embedding", i + 1).cast("double")
    m = F.array(1 + e(0) / 40, e(1) / 40, 6 * e(2), e(3) / 40, 1 + e(4) / 40, 4 * e(5), e(6) / 90000, e(7) / 90000, F.lit(1.0))
    v = table(spark, sf_dir, "embeddings")
    fixed = [F.lit(640.0).alias("width"), F.lit(360.0).alias("height"), F.radians(F.lit(90.0)).alias("h_fov")]
    view = (F.floor(F.col("vec_id") / 4) % 6).cast("long")
    return v.select("vec_id", (F.col("vec_id") % 4).alias("source"), F.floor(F.col("vec_id") / 24).alias("pair"), view.alias("view"), m.alias("homography"), *fixed, sphere.wrap_yaw(F.radians(60.0 * view)).alias("yaw"), F.radians((F.col("vec_id") % 31 - 15).cast("double")).alias("pitch"), F.radians((F.col("vec_id") % 5).cast("double")).alias("roll"))


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("frame"), c("l_linenumber").alias("line"), c("l_partkey").alias("part"), c("l_suppkey").alias("supp"), c("l_returnflag").alias("class"), ((c("l_quantity") - 1) / 100).alias("x"),
        ((c("l_linenumber") - 1) / 14).alias("top"), (0.1 + 5 * c("l_tax")).alias("w"), (0.1 + 4 * c("l_discount")).alias("h"), (1 - c("l_discount") - c("l_tax")).alias("score"),
    )


def quaternion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = [F.element_at("embedding", i + 1).cast("double") for i in range(4)]
    n = F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2] + e[3] * e[3])
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[(x / n).alias(k) for x, k in zip(e, "xyzw", strict=True)])


def sql_wrap(x: str) -> str:
    return f"(({x}) + pi() - 2 * pi() * floor((({x}) + pi()) / (2 * pi())) - pi())"


SIGNAL = "signal AS (SELECT user_id AS source_id, epoch(ts) AS t, event_type AS kind, value / 500 AS score, event_id AS id FROM events)"
CANDIDATE = f"""candidate AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame, event_id AS id, event_type AS kind, {sql_wrap("value * 7.3")} AS yaw,
 radians(CAST(event_id % 121 - 60 AS DOUBLE)) AS pitch, radians(CAST(10 + event_id % 40 AS DOUBLE)) AS h_fov FROM events)"""
POSE = "pose AS (SELECT s.*, c.yaw, c.pitch, c.h_fov, row_number() OVER (PARTITION BY s.source_id ORDER BY s.t, s.id) AS i FROM signal s JOIN candidate c USING (id))"
REGISTRATION = f"""registration AS (SELECT vec_id, vec_id % 4 AS source, vec_id // 24 AS pair, (vec_id // 4) % 6 AS view, {sql_wrap("radians(60.0::DOUBLE * ((vec_id // 4) % 6))")} AS yaw, radians((vec_id % 31 - 15)::DOUBLE) AS pitch, radians((vec_id % 5)::DOUBLE) AS roll,
 640.0::DOUBLE AS width, 360.0::DOUBLE AS height, radians(90.0::DOUBLE) AS h_fov, 1 + embedding[1]::DOUBLE / 40 AS m0, embedding[2]::DOUBLE / 40 AS m1, 6 * embedding[3]::DOUBLE AS m2, embedding[4]::DOUBLE / 40 AS m3, 1 + embedding[5]::DOUBLE / 40 AS m4, 4 * embedding[6]::DOUBLE AS m5,
 embedding[7]::DOUBLE / 90000 AS m6, embedding[8]::DOUBLE / 90000 AS m7, 1.0::DOUBLE AS m8 FROM embeddings)"""
DETECTION = """detection AS (SELECT l_orderkey AS frame, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, l_returnflag AS class, (l_quantity - 1) / 100 AS x,
 (l_linenumber - 1) / 14 AS top, 0.1::DOUBLE + 5 * l_tax AS w, 0.1::DOUBLE + 4 * l_discount AS h, 1 - l_discount - l_tax AS score FROM lineitem)"""
QUATERNION = """quaternion AS (SELECT vec_id, label, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM
 (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS w FROM embeddings)))"""


def sql_direction(a: str) -> list[str]:
    return [f"(cos({a}.pitch) * sin({a}.yaw))", f"sin({a}.pitch)", f"(cos({a}.pitch) * cos({a}.yaw))"]


def sql_distance(a: str, b: str) -> str:
    (ax, ay, az), (bx, by, bz) = sql_direction(a), sql_direction(b)
    cross = [f"({ay} * {bz} - {az} * {by})", f"({az} * {bx} - {ax} * {bz})", f"({ax} * {by} - {ay} * {bx})"]
    return f"atan2(sqrt({' + '.join(f'{c} * {c}' for c in cross)}), {ax} * {bx} + {ay} * {by} + {az} * {bz})"


DEGREE = math.pi / 180
