"""Registered queries over the test tables, each beside its SQL. Doubles are rounded to six places."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions import quaternion as quat
from orbweave.functions import sphere
from orbweave.operators import folds, intervals, spatial, validation
from orbweave.plans import relations as r

QUERIES: dict = {}
SQL: dict[str, str] = {}
HOUR, DAY = 3600.0, 86400.0


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(x):
    return F.round(x, 6) + 0.0


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


_SPAN = "span AS (SELECT source_id, t - 10800 AS start, t + 10800 AS \"end\", score, id FROM signal WHERE score >= 0.1)"
_MERGED = """flagged AS (SELECT *, max("end") OVER (PARTITION BY source_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM span),
 numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
 merged AS (SELECT source_id, min(start) AS start, max("end") AS "end", count(*) AS support, max(score) AS peak FROM numbered GROUP BY source_id, run)"""


def _spans(spark, sf):
    return r.signal(spark, sf).where("score >= 0.1").select("source_id", (F.col("t") - 10800).alias("start"), (F.col("t") + 10800).alias("end"), "score", "id")


def _merged(spark, sf):
    return intervals.merge_intervals(_spans(spark, sf), ["source_id"], "start", "end", {"support": F.count(F.lit(1)), "peak": F.max("score")})


@query(f"""WITH {r.SIGNAL}, {_SPAN}, {_MERGED} SELECT source_id, round(start, 6) AS start, round("end", 6) AS "end", support, round(peak, 6) AS peak FROM merged WHERE support >= 2""")
def win01_interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-01, FIL-02, FIL-03: events within three hours of each other become one interval; two at least support it."""
    return rounded(_merged(spark, sf).where("support >= 2"), "start", "end", "peak")


@query(f"""WITH {r.SIGNAL}, {_SPAN}, {_MERGED}, allowed AS (SELECT source_id, min(t) + 86400 AS start, min(t) + 864000 AS "end" FROM signal GROUP BY source_id)
 SELECT m.source_id, round(m.start, 6) AS start, m.support, round(greatest(m.start, a.start), 6) AS clip_start, round(least(m."end", a."end"), 6) AS clip_end,
 m.start >= a.start AND m.start < a."end" AS onset_available FROM merged m JOIN allowed a ON m.source_id = a.source_id AND m.start < a."end" AND a.start < m."end" """)
def join06_clipped_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-06, JOIN-07: intervals clipped to a source's available days; whether the unclipped onset is inside."""
    allowed = r.signal(spark, sf).groupBy("source_id").agg((F.min("t") + DAY).alias("start"), (F.min("t") + 10 * DAY).alias("end"))
    found = intervals.overlaps(_merged(spark, sf), allowed, ["source_id"])
    inside = (F.col("start") >= F.col("start_right")) & (F.col("start") < F.col("end_right"))
    return rounded(found.select("source_id", "start", "support", "clip_start", "clip_end", inside.alias("onset_available")), "start", "clip_start", "clip_end")


@query(f"""WITH {r.SIGNAL}, times AS (SELECT DISTINCT source_id, t FROM signal), flagged AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY source_id ORDER BY t) > 43200 THEN 1 ELSE 0 END AS n FROM times),
 runs AS (SELECT *, sum(n) OVER (PARTITION BY source_id ORDER BY t) AS run FROM flagged)
 SELECT source_id, round(min(t), 6) AS start, round(max(t) + 900, 6) AS "end", count(*) AS support FROM runs GROUP BY source_id, run HAVING count(*) >= 2""")
def win02_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-02: runs of times at most twelve hours apart."""
    return rounded(intervals.sessions(r.signal(spark, sf), ["source_id"], "t", 12 * HOUR, 900.0, 2), "start", "end")


@query(f"""WITH {r.SIGNAL}, pool AS (SELECT source_id, t - 3600 AS start, t + 3600 AS "end", 'purchase' AS signal FROM signal WHERE kind = 'purchase' UNION ALL SELECT source_id, t, t + 7200, 'error' FROM signal WHERE kind = 'error'),
 flagged AS (SELECT *, max("end") OVER (PARTITION BY source_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pool),
 numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 0 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM flagged)
 SELECT source_id, round(min(start), 6) AS start, round(max("end"), 6) AS "end", CASE WHEN min(signal) = max(signal) THEN min(signal) ELSE 'both' END AS scope, count(*) AS support FROM numbered GROUP BY source_id, run""")
def win03_multi_signal(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-03, SET-02: two kinds of signal fused into one timeline; touching intervals join."""
    s = r.signal(spark, sf)
    a = s.where("kind = 'purchase'").select("source_id", (F.col("t") - HOUR).alias("start"), (F.col("t") + HOUR).alias("end"), F.lit("purchase").alias("signal"))
    b = s.where("kind = 'error'").select("source_id", F.col("t").alias("start"), (F.col("t") + 2 * HOUR).alias("end"), F.lit("error").alias("signal"))
    scope = F.when(F.min("signal") == F.max("signal"), F.min("signal")).otherwise("both")
    return rounded(intervals.merge_intervals(a.unionByName(b), ["source_id"], "start", "end", {"scope": scope, "support": F.count(F.lit(1))}, slack=0.0), "start", "end")


@query(f"""WITH {r.SIGNAL}, s AS (SELECT source_id, id, t, kind = 'error' AS bad, row_number() OVER (PARTITION BY source_id ORDER BY t, id) AS i, count(*) OVER (PARTITION BY source_id) AS n FROM signal),
 g AS (SELECT *, i - row_number() OVER (PARTITION BY source_id ORDER BY i) AS run FROM s WHERE bad)
 SELECT source_id, min(i) AS first_index, max(i) AS last_index, count(*) AS length, CASE WHEN min(i) = 1 OR max(i) = max(n) THEN 'boundary' WHEN count(*) <= 3 THEN 'short_interior' ELSE 'long_interior' END AS class FROM g GROUP BY source_id, run""")
def win04_gap_runs(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-04: islands of invalid steps with their class."""
    w = Window.partitionBy("source_id").orderBy("t", "id")
    s = r.signal(spark, sf).select("source_id", (F.col("kind") == "error").alias("bad"), F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("source_id")).alias("n"))
    runs = intervals.runs_of(s, ["source_id"], ["i"], "bad").where("bad").groupBy("source_id", "run").agg(F.min("i").cast("long").alias("first_index"), F.max("i").cast("long").alias("last_index"), F.count(F.lit(1)).alias("length"), F.max("n").alias("n"))
    kind = F.when((F.col("first_index") == 1) | (F.col("last_index") == F.col("n")), "boundary").when(F.col("length") <= 3, "short_interior").otherwise("long_interior")
    return runs.select("source_id", "first_index", "last_index", "length", kind.alias("class"))


@query(f"""WITH {r.SIGNAL} SELECT id, round(greatest(score, max(score + 0.01 * n) OVER (PARTITION BY source_id ORDER BY n ROWS UNBOUNDED PRECEDING) - 0.01 * n), 6) AS fov FROM
 (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t, id) AS n FROM signal)""")
def win08_fov_guard(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-08: out = max(g, out before - step), in closed form as one running maximum."""
    s = r.signal(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy("t", "id")))
    best = F.max(F.col("score") + 0.01 * F.col("n")).over(Window.partitionBy("source_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - 0.01 * F.col("n")
    return s.select("id", r6(F.greatest("score", best)).alias("fov"))


@query(f"""WITH {r.SIGNAL}, a AS (SELECT id, source_id, t, {r.sql_wrap("score * 500 * 7.3")} AS yaw FROM signal), b AS (SELECT *, {r.sql_wrap("yaw - lag(yaw) OVER (PARTITION BY source_id ORDER BY t, id)")} AS d, first_value(yaw) OVER (PARTITION BY source_id ORDER BY t, id) AS y0 FROM a)
 SELECT id, round(y0 + coalesce(sum(d) OVER (PARTITION BY source_id ORDER BY t, id ROWS UNBOUNDED PRECEDING), 0), 6) AS unwrapped FROM b""")
def win09_unwrap_chain(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-09, FIL-12, GEO-02: a source's yaw as one continuous angle."""
    w = Window.partitionBy("source_id").orderBy("t", "id")
    a = r.signal(spark, sf).withColumn("yaw", sphere.wrap_yaw(F.col("score") * 500 * 7.3))
    b = a.withColumn("d", sphere.wrap_yaw(F.col("yaw") - F.lag("yaw").over(w))).withColumn("y0", F.first("yaw").over(w))
    return b.select("id", r6(F.col("y0") + F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).alias("unwrapped"))


@query(f"""WITH {r.SIGNAL}, a AS (SELECT *, t - lag(t) OVER w AS dt, score - lag(score) OVER w AS ds FROM signal WINDOW w AS (PARTITION BY source_id ORDER BY t, id)),
 b AS (SELECT *, ds / dt * 3600 AS speed FROM a), c AS (SELECT *, (speed - lag(speed) OVER (PARTITION BY source_id ORDER BY t, id)) / dt * 3600 AS accel FROM b)
 SELECT id, round(speed, 6) AS speed, round(accel, 6) AS accel, round((accel - lag(accel) OVER (PARTITION BY source_id ORDER BY t, id)) / dt * 3600, 6) AS jerk FROM c""")
def win12_dynamics(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-11, WIN-12, WIN-21: speed, acceleration and jerk by differences."""
    w = Window.partitionBy("source_id").orderBy("t", "id")
    a = r.signal(spark, sf).withColumn("dt", F.col("t") - F.lag("t").over(w)).withColumn("speed", (F.col("score") - F.lag("score").over(w)) / F.col("dt") * HOUR)
    b = a.withColumn("accel", (F.col("speed") - F.lag("speed").over(w)) / F.col("dt") * HOUR)
    return b.select("id", r6(F.col("speed")).alias("speed"), r6(F.col("accel")).alias("accel"), r6((F.col("accel") - F.lag("accel").over(w)) / F.col("dt") * HOUR).alias("jerk"))


_OUTCOME = "CASE kind WHEN 'error' THEN 'missing' WHEN 'view' THEN 'ambiguous' ELSE 'compatible' END"


def _outcomes(spark, sf):
    outcome = F.when(F.col("kind") == "error", "missing").when(F.col("kind") == "view", "ambiguous").otherwise("compatible")
    s = r.signal(spark, sf).withColumn("outcome", outcome)
    return s.groupBy("source_id", "t").agg(F.min_by("outcome", "id").alias("outcome"), F.min_by("score", "id").alias("score"))


_OUTCOMES = f"outcomes AS (SELECT source_id, t, arg_min({_OUTCOME}, id) AS outcome, arg_min(score, id) AS score FROM signal GROUP BY source_id, t), numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY t) AS i FROM outcomes)"


@query(f"""WITH RECURSIVE {r.SIGNAL}, {_OUTCOMES}, f AS (SELECT source_id, i, t, outcome, CASE WHEN outcome = 'compatible' THEN 1 ELSE 0 END AS consecutive, CASE WHEN outcome = 'compatible' THEN t END AS began, CASE WHEN outcome = 'compatible' THEN t END AS last FROM numbered WHERE i = 1
 UNION ALL SELECT n.source_id, n.i, n.t, n.outcome, CASE WHEN n.outcome <> 'compatible' THEN 0 WHEN f.last IS NULL OR n.t - f.last > 172800 THEN 1 ELSE f.consecutive + 1 END, CASE WHEN n.outcome <> 'compatible' THEN NULL WHEN f.last IS NULL OR n.t - f.last > 172800 THEN n.t ELSE f.began END, CASE WHEN n.outcome = 'compatible' THEN n.t END FROM f JOIN numbered n ON n.source_id = f.source_id AND n.i = f.i + 1),
 s AS (SELECT *, coalesce(t - began, 0) AS span FROM f), a AS (SELECT source_id, min(t) AS at FROM s WHERE consecutive >= 2 AND span >= 43200 GROUP BY source_id)
 SELECT s.source_id, round(s.t, 6) AS t, s.outcome, s.consecutive::INTEGER AS consecutive, round(s.span, 6) AS span, coalesce(s.t = a.at, false) AS acquired FROM s LEFT JOIN a USING (source_id)""")
def win19_acquisition(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-19, ST-09: streaks of compatible refreshes, cut by other outcomes and by gaps, and where the first long enough one acquires a track."""
    return rounded(folds.acquisitions(_outcomes(spark, sf), "source_id", "t", "outcome", 2, 12 * HOUR, 48 * HOUR), "t", "span")


@query(f"""WITH {r.SIGNAL}, {_SPAN}, {_MERGED}, whole AS (SELECT source_id, min(start) - 100 AS start, max("end") + 100 AS "end" FROM merged GROUP BY source_id),
 gaps AS (SELECT m.source_id, m."end" AS start, coalesce(lead(m.start) OVER (PARTITION BY m.source_id ORDER BY m.start), w."end") AS "end" FROM merged m JOIN whole w USING (source_id) UNION ALL SELECT source_id, start, start + 100 FROM whole)
 SELECT source_id, round(start, 6) AS start, round("end", 6) AS "end", 'wide' AS value FROM gaps UNION ALL SELECT source_id, round(start, 6), round("end", 6), 'close' FROM merged""")
def win24_segment_cover(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-24, WIN-25, JOIN-14, PLN-02: the whole time covered by a default view and its overlays."""
    m = _merged(spark, sf).withColumn("value", F.lit("close"))
    whole = _spans(spark, sf).groupBy("source_id").agg((F.min("start") - 100).alias("start"), (F.max("end") + 100).alias("end"))
    return rounded(intervals.elementary_cover(whole, m, "source_id", "value", "wide"), "start", "end")


@query(f"""WITH {r.SIGNAL}, k AS (SELECT DISTINCT source_id, t, score FROM signal WHERE kind = 'purchase'), q AS (SELECT id, source_id, t FROM signal WHERE kind = 'error')
 SELECT q.id, round(a.score + (b.score - a.score) * (q.t - a.t) / (b.t - a.t), 6) AS value FROM q ASOF JOIN k a ON q.source_id = a.source_id AND q.t >= a.t ASOF JOIN k b ON q.source_id = b.source_id AND q.t < b.t""")
def join12_asof_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-12, JOIN-13, WIN-10: values between the two knots around each asked time."""
    s = r.signal(spark, sf)
    asked = s.where("kind = 'error'")
    found = intervals.asof_bracket(asked.select("source_id", "t"), s.where("kind = 'purchase'").select("source_id", "t", "score"), "source_id", "score").where("t0 is not null and t1 is not null")
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return found.select("source_id", "t", r6(value).alias("value")).join(asked.select("source_id", "t", "id"), ["source_id", "t"]).select("id", "value")


_PAIRS = f"""pairs AS (SELECT a.frame, a.id AS a, b.id AS b, {r.sql_distance("a", "b")} AS distance, radians(12.0::DOUBLE) AS most, greatest(radians(2.0::DOUBLE), 0.6::DOUBLE * (a.h_fov + b.h_fov) / 2) AS gate FROM candidate a JOIN candidate b ON a.frame = b.frame AND a.kind = b.kind AND a.id < b.id),
 near AS (SELECT frame, a, b, distance FROM pairs WHERE distance <= least(most, gate))"""


def _pairs(spark, sf):
    return spatial.close_pairs(r.candidate(spark, sf), math.radians(12), math.radians(2), 0.6)


@query(f"WITH {r.CANDIDATE}, {_PAIRS} SELECT frame, a, b, round(distance, 6) AS distance FROM near")
def join01_close_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-01, GEO-06: candidates of one frame and kind that may be one subject."""
    return rounded(_pairs(spark, sf), "distance")


@query(f"WITH {r.CANDIDATE}, {_PAIRS} SELECT frame, a, b, round(distance, 6) AS distance FROM near n WHERE (SELECT count(*) FROM near x WHERE x.a = n.a) = 1 AND (SELECT count(*) FROM near x WHERE x.b = n.b) = 1")
def join04_mutual_unique(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-04: pairs that are unambiguous from both sides."""
    return rounded(spatial.mutual_unique(_pairs(spark, sf)), "distance")


_CLUSTERS = f"""pool AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), reach AS (SELECT id, id AS other FROM candidate UNION SELECT r.id, e.b FROM reach r JOIN pool e ON e.a = r.other),
 clustered AS (SELECT c.*, l.cluster FROM candidate c JOIN (SELECT id, min(other) AS cluster FROM reach GROUP BY id) l USING (id))"""


def _clusters(spark, sf):
    return spatial.frame_clusters(r.candidate(spark, sf), _pairs(spark, sf))


@query(f"WITH RECURSIVE {r.CANDIDATE}, {_PAIRS}, {_CLUSTERS} SELECT frame, cluster, kind, round(max(h_fov), 6) AS h_fov, count(*) AS members, string_agg(CAST(id AS VARCHAR), '+' ORDER BY id) AS ids, round(atan2(sum(cos(pitch) * sin(yaw)), sum(cos(pitch) * cos(yaw))), 6) AS yaw FROM clustered GROUP BY frame, cluster, kind")
def agg01_spherical_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-01: duplicates merge along chains into one candidate with the mean direction."""
    return rounded(spatial.merge_clusters(_clusters(spark, sf)).select("frame", "cluster", "kind", "h_fov", "members", "ids", "yaw"), "h_fov", "yaw")


_BOUNDED = "bounded AS (SELECT *, CASE WHEN id % 3 <> 0 THEN pitch - 0.125::DOUBLE END AS pitch_min, CASE WHEN id % 3 <> 0 THEN pitch + 0.25::DOUBLE END AS pitch_max, 'view:' || (id % 4) AS provenance FROM clustered)"


@query(f"""WITH RECURSIVE {r.CANDIDATE}, {_PAIRS}, {_CLUSTERS}, {_BOUNDED}, m AS (SELECT frame, cluster, kind, sum(cos(pitch) * sin(yaw)) AS x, sum(sin(pitch)) AS y, sum(cos(pitch) * cos(yaw)) AS z, count(*) AS members, CASE WHEN count(pitch_min) = count(*) THEN min(pitch_min) END AS low, CASE WHEN count(pitch_max) = count(*) THEN max(pitch_max) END AS high, string_agg(provenance, ';' ORDER BY id) AS provenance FROM bounded GROUP BY frame, cluster, kind)
 SELECT frame, cluster, kind, members, round(asin(y / sqrt(x * x + y * y + z * z)), 6) AS pitch, round(low, 6) AS pitch_min, round(high, 6) AS pitch_max, provenance FROM m""")
def agg02_merged_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-02: a cluster's mean direction, joined bounds where all members have them, and its provenance in order."""
    i = F.col("id")
    rows = _clusters(spark, sf).select("*", F.when(i % 3 != 0, F.col("pitch") - 0.125).alias("pitch_min"), F.when(i % 3 != 0, F.col("pitch") + 0.25).alias("pitch_max"), F.concat(F.lit("view:"), (i % 4).cast("string")).alias("provenance"))
    made = spatial.merge_clusters(rows)
    return rounded(made.select("frame", "cluster", "kind", "members", "pitch", "pitch_min", "pitch_max", "provenance"), "pitch", "pitch_min", "pitch_max")


@query(f"WITH RECURSIVE {r.CANDIDATE}, {_PAIRS}, {_CLUSTERS}, m AS (SELECT frame, cluster, kind, count(*) AS n FROM clustered GROUP BY frame, cluster, kind) SELECT kind, sum(n)::BIGINT AS raw_count, count(*) AS merged_count, count(*) FILTER (n > 1) AS duplicate_clusters, max(n) AS largest FROM m GROUP BY GROUPING SETS ((kind), ())")
def agg03_dedup_report(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-03, AGG-04: counts before and after, by kind and in total."""
    m = spatial.merge_clusters(_clusters(spark, sf))
    return m.rollup("kind").agg(F.sum("members").alias("raw_count"), F.count(F.lit(1)).alias("merged_count"), F.count_if(F.col("members") > 1).alias("duplicate_clusters"), F.max("members").alias("largest"))


@query(f"""WITH {r.CANDIDATE}, m AS (SELECT frame, count(*) AS members, sum(cos(pitch) * sin(yaw)) AS x, sum(sin(pitch)) AS y, sum(cos(pitch) * cos(yaw)) AS z FROM candidate GROUP BY frame HAVING count(*) > 1), c AS (SELECT frame, members, atan2(x, z) AS yaw, asin(y / sqrt(x * x + y * y + z * z)) AS pitch FROM m),
 s AS (SELECT c.frame, c.members, c.yaw, c.pitch, max({r.sql_distance("k", "c")} + k.h_fov / 2) AS radius FROM c JOIN candidate k USING (frame) GROUP BY ALL)
 SELECT frame, members, round(yaw, 6) AS yaw, round(pitch, 6) AS pitch, round(radius, 6) AS radius, round(greatest(radians(90.0::DOUBLE), least(radians(110.0::DOUBLE), 2 * (radius + radians(10.0::DOUBLE)))), 6) AS fov, 2 * (radius + radians(10.0::DOUBLE)) <= radians(110.0::DOUBLE) AS containable FROM s""")
def agg22_group_shots(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-22: one view that holds all of a frame."""
    return rounded(spatial.group_shots(r.candidate(spark, sf)), "yaw", "pitch", "radius", "fov")


def _quat(alias):
    return [F.col(f"{alias}.{c}") for c in "xyzw"]


@query(f"""WITH {r.CANDIDATE} SELECT id, round(yaw, 6) AS yaw, round(cos(pitch) * sin(yaw), 6) AS x, round(sin(pitch), 6) AS y, round(cos(pitch) * cos(yaw), 6) AS z, round((yaw + pi()) / (2 * pi()) * 1024 - 0.5, 6) AS px, round((pi() / 2 - pitch) / pi() * 512 - 0.5, 6) AS py,
 round(acos(greatest(least(cos(pitch) * cos(yaw), 1), -1)), 6) AS forward, round(abs((degrees(yaw) - 30 + 180) - 360 * floor((degrees(yaw) - 30 + 180) / 360) - 180), 6) AS from_30 FROM candidate""")
def geo_angles(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-01, 04, 05, 29, 31: wrapped angles, rays, pixels and distances from ahead."""
    c, yaw, pitch = r.candidate(spark, sf), F.col("yaw"), F.col("pitch")
    x, y, z = sphere.direction(yaw, pitch)
    px, py = sphere.angles_to_pixel(yaw, pitch, 1024, 512)
    return c.select("id", r6(yaw).alias("yaw"), r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"), r6(px).alias("px"), r6(py).alias("py"), r6(sphere.forward_distance(yaw, pitch)).alias("forward"), r6(sphere.circular_degrees(F.degrees(yaw), F.lit(30.0))).alias("from_30"))


@query(f"""WITH {r.CANDIDATE}, p AS (SELECT id, (id % 1024)::DOUBLE AS x, (id % 512)::DOUBLE AS y FROM candidate) SELECT id, round((x + 0.5) / 1024 * 2 * pi() - pi(), 6) AS yaw, round(pi() / 2 - (y + 0.5) / 512 * pi(), 6) AS pitch FROM p""")
def geo03_pixel_to_angles(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-03: a pixel's centre on the sphere."""
    yaw, pitch = sphere.pixel_to_angles((F.col("id") % 1024).cast("double"), (F.col("id") % 512).cast("double"), 1024, 512)
    return r.candidate(spark, sf).select("id", r6(yaw).alias("yaw"), r6(pitch).alias("pitch"))


@query(f"""WITH {r.QUATERNION}, p AS (SELECT a.vec_id, a.x AS ax, a.w AS aw, b.x AS bx, b.w AS bw, a.x * b.x + a.y * b.y + a.z * b.z + a.w * b.w AS d FROM quaternion a JOIN quaternion b ON b.vec_id = a.vec_id + 1), q AS (SELECT *, acos(abs(d)) AS th, CASE WHEN d < 0 THEN -1 ELSE 1 END AS s FROM p)
 SELECT vec_id, round(sin(0.7::DOUBLE * th) / sin(th) * ax + s * sin(0.3::DOUBLE * th) / sin(th) * bx, 6) AS x, round(sin(0.7::DOUBLE * th) / sin(th) * aw + s * sin(0.3::DOUBLE * th) / sin(th) * bw, 6) AS w FROM q""")
def geo24_slerp(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-24, WIN-05: a point on the shorter arc between two rotations."""
    q = r.quaternion(spark, sf)
    s = quat.slerp(_quat("a"), _quat("b"), F.lit(0.3))
    return q.alias("a").join(q.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id"), r6(s[0]).alias("x"), r6(s[3]).alias("w"))


_KEY = "frame, line, part, supp"


@query(f"""WITH {r.DETECTION} SELECT frame, line, part, supp, CASE WHEN w >= 0.399 AND h >= 0.399 THEN 'width,height' WHEN w >= 0.399 THEN 'width' WHEN h >= 0.399 THEN 'height' ELSE '' END AS reasons, w < 0.399 AND h < 0.399 AS accepted FROM detection""")
def fil01_framing_quality(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-01: boxes that fill too much of the view, with the reasons."""
    reasons = F.array_compact(F.array(*[F.when(F.col(c) >= 0.399, F.lit(n)) for c, n in (("w", "width"), ("h", "height"))]))
    return r.detection(spark, sf).select("frame", "line", "part", "supp", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("accepted"))


@query(f"""WITH {r.DETECTION} SELECT frame, line, part, supp, CASE WHEN w > 0.449 THEN 'width_exceeds_limit' WHEN score < 0.85 THEN 'low_score' WHEN h > 0.401 THEN 'height_exceeds_limit' ELSE 'accepted' END AS reason FROM detection""")
def fil05_first_reason(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-05: a cascade of tests in which the first failing one names the reason."""
    reason = F.when(F.col("w") > 0.449, "width_exceeds_limit").when(F.col("score") < 0.85, "low_score").when(F.col("h") > 0.401, "height_exceeds_limit").otherwise("accepted")
    return r.detection(spark, sf).select("frame", "line", "part", "supp", reason.alias("reason"))


@query(f"""WITH {r.DETECTION} SELECT a.frame, a.line, a.part, a.supp, b.line AS other_line, b.part AS other_part, b.supp AS other_supp, round(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.top + a.h, b.top + b.h) - greatest(a.top, b.top)) / (a.w * a.h + b.w * b.h - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.top + a.h, b.top + b.h) - greatest(a.top, b.top))), 6) AS iou
 FROM detection a JOIN detection b ON a.frame = b.frame AND a.class = b.class AND (a.line, a.part, a.supp) < (b.line, b.part, b.supp)""")
def geo28_box_iou(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-28: overlap of a frame's boxes of one class."""
    d = r.detection(spark, sf)
    a, b = d.alias("a"), d.alias("b")
    key = lambda k: F.struct(F.col(f"{k}.line"), F.col(f"{k}.part"), F.col(f"{k}.supp"))
    box = lambda k: [F.col(f"{k}.{c}") for c in ("x", "top", "w", "h")]
    pairs = a.join(b, [F.col("a.frame") == F.col("b.frame"), F.col("a.class") == F.col("b.class"), key("a") < key("b")])
    return pairs.select("a.frame", "a.line", "a.part", "a.supp", F.col("b.line").alias("other_line"), F.col("b.part").alias("other_part"), F.col("b.supp").alias("other_supp"), r6(sphere.box_iou(box("a"), box("b"), 0.0)).alias("iou"))


@query(f"""WITH {r.SIGNAL} SELECT source_id, round(median(score), 6) AS median, round(quantile_disc(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.95), 6) AS p95_linear, round(max(score), 6) AS largest, round(sqrt(avg(score * score)), 6) AS rms FROM signal GROUP BY source_id""")
def agg09_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-08..10: median, nearest-rank and linear percentiles, root mean square."""
    p = F.expr("percentile_disc(0.95) within group (order by score)")
    return r.signal(spark, sf).groupBy("source_id").agg(r6(F.median("score")).alias("median"), r6(p).alias("p95"), r6(F.percentile("score", 0.95)).alias("p95_linear"), r6(F.max("score")).alias("largest"), r6(F.sqrt(F.avg(F.col("score") * F.col("score")))).alias("rms"))


@query(f"""WITH {r.SIGNAL}, t AS (SELECT DISTINCT source_id, t FROM signal), d AS (SELECT source_id, t - lag(t) OVER (PARTITION BY source_id ORDER BY t) AS d FROM t) SELECT source_id, round(median(d), 6) AS cadence FROM d GROUP BY source_id""")
def agg33_cadence(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-33: the median step between distinct times."""
    t = r.signal(spark, sf).select("source_id", "t").distinct()
    return t.withColumn("d", F.col("t") - F.lag("t").over(Window.partitionBy("source_id").orderBy("t"))).groupBy("source_id").agg(r6(F.median("d")).alias("cadence"))


_INTEREST = """kinds AS (SELECT *, CASE id % 6 WHEN 0 THEN 'context' WHEN 1 THEN 'group_context' WHEN 2 THEN 'human' ELSE kind END AS candidate_type, id % 5 <> 0 AS observed, id % 9 AS observed_frames, CASE id % 4 WHEN 0 THEN 'tracker_identity' WHEN 1 THEN 'human_geometric' ELSE 'geometric_only' END AS provenance, id % 5 AS covered FROM candidate),
 i AS (SELECT *, CASE WHEN candidate_type <> 'context' AND observed THEN 1.0 ELSE 0.0 END::DOUBLE AS presence, CASE WHEN candidate_type <> 'context' AND provenance <> 'geometric_only' THEN least(1, observed_frames / 5) ELSE 0 END AS persistence, greatest(0, 1 - abs(pitch) / radians(45.0::DOUBLE)) AS composition,
 greatest(0, 1 - acos(greatest(least(cos(pitch) * cos(yaw), 1), -1)) / radians(90.0::DOUBLE)) AS forward_prior, CASE WHEN candidate_type = 'group_context' THEN least(1, covered / 3) ELSE 0 END AS group_coverage FROM kinds)"""
#: The editorial weights of the first slice.
INTEREST_WEIGHTS = {"presence": 0.35, "persistence": 0.3, "composition": 0.2, "forward_prior": 0.15}


def _interest(spark, sf):
    i = F.col("id")
    kind = F.when(i % 6 == 0, "context").when(i % 6 == 1, "group_context").when(i % 6 == 2, "human").otherwise(F.col("kind"))
    provenance = F.when(i % 4 == 0, "tracker_identity").when(i % 4 == 1, "human_geometric").otherwise("geometric_only")
    rows = r.candidate(spark, sf).select("*", kind.alias("candidate_type"), (i % 5 != 0).alias("observed"), (i % 9).alias("observed_frames"), provenance.alias("provenance"), (i % 5).alias("covered"))
    return spatial.interest_signals(rows)


@query(f"""WITH {r.CANDIDATE}, {_INTEREST}, u AS (SELECT *, 0.35::DOUBLE * presence + 0.3::DOUBLE * persistence + 0.2::DOUBLE * composition + 0.15::DOUBLE * forward_prior AS utility FROM i), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round(utility, 9) DESC, id) AS place FROM u)
 SELECT frame, id, place, presence, round(persistence, 6) AS persistence, round(composition, 6) AS composition, round(forward_prior, 6) AS forward_prior, round(group_coverage, 6) AS group_coverage, round(utility, 6) AS utility FROM k""")
def agg28_interest_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-27, AGG-28, TOP-01: five signals, their weighted sum and the rank in the frame."""
    i = _interest(spark, sf)
    utility = sum((F.col(n) * w for n, w in list(INTEREST_WEIGHTS.items())[1:]), F.col("presence") * INTEREST_WEIGHTS["presence"])
    i = i.withColumn("utility", utility)
    place = F.row_number().over(Window.partitionBy("frame").orderBy(F.round("utility", 9).desc(), "id")).cast("long")
    return rounded(i.select("frame", "id", place.alias("place"), *spatial.SIGNALS, "utility"), *spatial.SIGNALS[1:], "utility")


_REPORTED = f"""{r.CANDIDATE}, {_INTEREST}, said AS (SELECT frame, id, 'presence' AS name, presence AS v FROM i UNION ALL SELECT frame, id, 'persistence', persistence FROM i WHERE id % 8 <> 0 UNION ALL SELECT frame, id, 'composition', CASE WHEN id % 7 = 0 THEN NULL ELSE composition END FROM i UNION ALL SELECT frame, id, 'forward_prior', forward_prior FROM i UNION ALL SELECT frame, id, 'group_coverage', group_coverage FROM i),
 w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in INTEREST_WEIGHTS.items())}) w(name, weight)), both_sides AS (SELECT c.frame, c.id, w.name, w.weight, s.v, s.name IS NOT NULL AS said FROM candidate c CROSS JOIN w LEFT JOIN said s ON s.frame = c.frame AND s.id = c.id AND s.name = w.name)"""


def _reported(spark, sf):
    i = _interest(spark, sf)
    lost = F.col("id") % 7 == 0
    said = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.when(~lost, F.col(n)) if n == "composition" else F.col(n)).alias("normalized")) for n in spatial.SIGNALS]))
    rows = i.select("frame", "id", said.alias("s")).select("frame", "id", "s.*").where("name != 'persistence' or id % 8 != 0")
    reason = F.when(F.col("normalized").isNull(), "occluded")
    rows = rows.select("*", F.col("normalized").alias("raw"), F.lit("interest:v1").alias("provenance"), reason.alias("missing_reason"))
    weights = spark.createDataFrame(list(INTEREST_WEIGHTS.items()), "name string, weight double")
    return rows, weights


@query(f"""WITH {_REPORTED} SELECT frame, id, round(sum(v * weight), 6) AS utility FROM both_sides GROUP BY frame, id HAVING count(v) = 4""")
def pln12_strict_utilities(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-12, JOIN-15: weighted sums of candidates that report every declared signal."""
    rows, weights = _reported(spark, sf)
    return rounded(spatial.weighted(rows, ["frame", "id"], weights)[0], "utility")


@query(f"""WITH {_REPORTED} SELECT frame, id, name, CASE WHEN said THEN 'missing:occluded' ELSE 'missing:not_reported' END AS provenance FROM both_sides WHERE v IS NULL""")
def pln12_missing_signals(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-12, JOIN-16: declared signals that a candidate lacks, and why."""
    rows, weights = _reported(spark, sf)
    return spatial.weighted(rows, ["frame", "id"], weights)[1]


@query(f"""WITH {_REPORTED} SELECT frame, id, round(sum(coalesce(v, 0) * weight), 6) AS utility FROM both_sides GROUP BY frame, id""")
def pln12_default_utilities(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-12: weighted sums in which what is missing counts 0, and signals without a weight don't count."""
    rows, weights = _reported(spark, sf)
    return rounded(spatial.weighted(rows, ["frame", "id"], weights, strict=False)[0], "utility")


@query(f"""WITH RECURSIVE {r.SIGNAL}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, t, id) AS i FROM signal WHERE score >= 0.08),
 f AS (SELECT source_id, i, [t] AS kept, true AS stays FROM n WHERE i = 1 UNION ALL SELECT n.source_id, n.i, CASE WHEN len(list_filter(f.kept, lambda k: abs(k - n.t) < 86400)) = 0 THEN list_append(f.kept, n.t) ELSE f.kept END, len(list_filter(f.kept, lambda k: abs(k - n.t) < 86400)) = 0 FROM f JOIN n ON n.source_id = f.source_id AND n.i = f.i + 1)
 SELECT n.source_id, n.id, n.t, n.score FROM f JOIN n USING (source_id, i) WHERE f.stays""")
def top02_temporal_nms(spark: SparkSession, sf: str) -> DataFrame:
    """TOP-02: best events a day apart at least."""
    return folds.temporal_nms(r.signal(spark, sf).where("score >= 0.08"), "source_id", "t", "score", "id", DAY)


def _track(spark, sf):
    w = Window.partitionBy("source_id").orderBy("t", "id")
    kind = F.when(F.col("kind") == "error", "outside_viewport").when(F.col("kind") == "view", "not_observed").otherwise("observed")
    return r.signal(spark, sf).select("source_id", F.row_number().over(w).cast("long").alias("i"), kind.alias("k"), "score")


_TRACK = f"""{r.SIGNAL}, track AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY t, id) AS i, CASE kind WHEN 'error' THEN 'outside_viewport' WHEN 'view' THEN 'not_observed' ELSE 'observed' END AS k, score FROM signal),
 firsts AS (SELECT source_id, min(i) AS i FROM track WHERE k = 'observed' GROUP BY source_id)"""
_STATES = """states AS (SELECT t.source_id, t.i, 'active' AS phase, t.score AS confidence, 0 AS missing, 0 AS outside FROM track t JOIN firsts USING (source_id, i)
 UNION ALL SELECT source_id, i, CASE WHEN k = 'observed' THEN 'active' WHEN m > 2 OR o > 1 THEN 'terminated' WHEN k = 'not_observed' THEN 'grace' ELSE 'viewport_exit' END, c, m, o FROM
 (SELECT t.source_id, t.i, t.k, CASE t.k WHEN 'observed' THEN t.score ELSE s.confidence * 0.75::DOUBLE END AS c, CASE t.k WHEN 'not_observed' THEN s.missing + 1 ELSE 0 END AS m, CASE t.k WHEN 'outside_viewport' THEN s.outside + 1 ELSE 0 END AS o FROM states s JOIN track t ON t.source_id = s.source_id AND t.i = s.i + 1 WHERE s.phase <> 'terminated'))"""


@query(f"WITH RECURSIVE {_TRACK}, {_STATES} SELECT source_id, i, phase, confidence, missing, outside FROM states")
def st01_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """ST-01, ST-04: track states from the first observation to termination, two counters that set each other back."""
    return folds.lifecycle(_track(spark, sf), "source_id", "i", "k", "score")


_TRACE = f"""{r.SIGNAL}, {_OUTCOMES}, track AS (SELECT source_id, i, CASE outcome WHEN 'compatible' THEN 'observed' ELSE 'not_observed' END AS k, outcome, CASE WHEN i % 13 <> 0 THEN score END AS score FROM numbered), firsts AS (SELECT source_id, min(i) AS i FROM track WHERE k = 'observed' GROUP BY source_id)"""


@query(f"""WITH RECURSIVE {_TRACE}, {_STATES}, ended AS (SELECT source_id, i FROM states WHERE phase = 'terminated') SELECT 'starts_without_match' AS rule_id, source_id, i FROM track WHERE i = 1 AND outcome <> 'compatible'
 UNION ALL SELECT 'match_without_confidence', source_id, i FROM track WHERE outcome = 'compatible' AND score IS NULL UNION ALL SELECT 'after_termination', t.source_id, t.i FROM track t JOIN ended e ON e.source_id = t.source_id AND t.i > e.i""")
def st03_trace_rules(spark: SparkSession, sf: str) -> DataFrame:
    """ST-02, ST-03: refresh outcomes as track events, and the rules a lifecycle trace must keep."""
    w = Window.partitionBy("source_id").orderBy("t")
    rows = folds.refresh_kinds(_outcomes(spark, sf).withColumn("i", F.row_number().over(w).cast("long")), "outcome")
    rows = rows.withColumn("sure", F.when(F.col("i") % 13 != 0, F.col("score")))
    states = folds.lifecycle(rows, "source_id", "i", "kind", "sure")
    return folds.lifecycle_violations(rows, states, "source_id", "i", "outcome", "sure")


@query(f"""WITH RECURSIVE {r.SIGNAL}, {r.CANDIDATE}, {r.POSE}, f AS (SELECT source_id, i, kind AS k, yaw, pitch, true AS emitted FROM pose WHERE i = 1
 UNION ALL SELECT source_id, i, CASE WHEN e THEN kind ELSE k END, CASE WHEN e THEN ny ELSE yaw END, CASE WHEN e THEN np ELSE pitch END, e FROM (SELECT n.source_id, n.i, n.kind, f.k, n.yaw AS ny, n.pitch AS np, f.yaw, f.pitch, n.kind <> f.k OR {r.sql_distance("f", "n")} >= {math.radians(40)!r}::DOUBLE AS e FROM f JOIN pose n ON n.source_id = f.source_id AND n.i = f.i + 1)),
 ends AS (SELECT source_id, max(i) AS i FROM pose GROUP BY source_id)
 SELECT p.source_id, p.t, p.kind AS selected, round(p.yaw, 6) AS yaw, round(p.pitch, 6) AS pitch, round(p.h_fov, 6) AS h_fov FROM f JOIN pose p USING (source_id, i) LEFT JOIN ends e USING (source_id, i) WHERE f.emitted OR e.i IS NOT NULL""")
def win07_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-07: keyframes where the selection changes or has moved far enough from the last one, and at the end."""
    p = r.pose(spark, sf)
    made = folds.sparse_keyframes(p.groupBy("source_id", "t").agg(*[F.min_by(c, "id").alias(c) for c in ("kind", "yaw", "pitch", "h_fov")]), "source_id", "t", "kind", "yaw", "pitch", "h_fov", math.radians(40))
    return rounded(made.withColumnRenamed("kind", "selected"), "yaw", "pitch", "h_fov")


def _events(spark, sf):
    """Proposals to cut away: a source's signals as events, two of five candidates each."""
    w = Window.partitionBy("source_id").orderBy("t", "id")
    s = r.pose(spark, sf).withColumn("i", F.row_number().over(w).cast("long"))
    name = lambda n: F.concat(F.lit("view:"), n.cast("string"))
    return s.select(
        "source_id", "i", F.lit(0.0).alias("start"), (1.0 + F.col("id") % 4).cast("double").alias("end"), name(F.col("id") % 2).alias("current_id"), name(2 + F.col("id") % 3).alias("proposed_id"),
        ((F.col("id") % 5) / 8).alias("current_total"), ((F.col("id") % 13) / 8).alias("proposed_total"), (F.col("kind") != "error").alias("observed"), ((F.col("id") % 7) / 4).alias("angle"),
    )


_PLAN = f"""{r.SIGNAL}, e AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY t, id) AS i, 'view:' || (id % 2) AS cur, 'view:' || (2 + id % 3) AS pro, (id % 5) / 8 AS here, (id % 13) / 8 AS there, 0.25::DOUBLE * 2 + 2 * ((id % 7) / 4) * 0.125::DOUBLE AS cost,
 kind <> 'error' AND 1 + id % 4 >= 2 AND (id % 13) / 8 >= (id % 5) / 8 + 0.125::DOUBLE AS ok FROM signal)"""
_PLAN_STEPS = """f AS (SELECT source_id, i, here AS s0, [cur] AS p0, CASE WHEN ok THEN there - cost END AS s1, CASE WHEN ok THEN [pro] END AS p1, pro AS last FROM e WHERE i = 1
 UNION ALL SELECT source_id, i, CASE WHEN s1 IS NOT NULL AND (s1 + here > s0 + here OR (s1 + here = s0 + here AND p1 < p0)) THEN s1 + here ELSE s0 + here END, list_append(CASE WHEN s1 IS NOT NULL AND (s1 + here > s0 + here OR (s1 + here = s0 + here AND p1 < p0)) THEN p1 ELSE p0 END, cur),
 CASE WHEN ok THEN CASE WHEN s1 IS NOT NULL AND (again > fresh OR (again = fresh AND p1 < p0)) THEN again ELSE fresh END END, CASE WHEN ok THEN list_append(CASE WHEN s1 IS NOT NULL AND (again > fresh OR (again = fresh AND p1 < p0)) THEN p1 ELSE p0 END, pro) END, pro FROM
 (SELECT e.*, f.s0, f.p0, f.s1, f.p1, f.s0 + e.there - e.cost AS fresh, f.s1 + e.there - (e.cost + CASE WHEN f.last = e.pro THEN 0.5::DOUBLE ELSE 0 END) AS again FROM f JOIN e ON e.source_id = f.source_id AND e.i = f.i + 1)),
 done AS (SELECT f.source_id, CASE WHEN s1 IS NOT NULL AND (s1 > s0 OR (s1 = s0 AND p1 < p0)) THEN s1 ELSE s0 END AS objective, CASE WHEN s1 IS NOT NULL AND (s1 > s0 OR (s1 = s0 AND p1 < p0)) THEN p1 ELSE p0 END AS path FROM f JOIN (SELECT source_id, max(i) AS i FROM e GROUP BY source_id) USING (source_id, i))"""


@query(f"""WITH RECURSIVE {_PLAN}, {_PLAN_STEPS} SELECT e.source_id, e.i, d.path[e.i] AS selected, e.ok AS eligible, round(d.objective, 6) AS objective FROM done d JOIN e USING (source_id)""")
def pln01_event_plan(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-01: which events to cut away for, best in total: switches, turns and repetitions cost, short or weak proposals aren't eligible."""
    made = folds.choose_events(_events(spark, sf), "source_id", "i", switch=0.25, angular=0.125, repeat=0.5, least_dwell=2.0, least_advantage=0.125)
    return rounded(made.select("source_id", "i", "selected", "eligible", "objective"), "objective")
