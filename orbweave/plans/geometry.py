"""Registered queries: viewports, rays, rotations, boxes and similarities, each beside its SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions import matrix, sphere
from orbweave.functions import quaternion as quat
from orbweave.operators import motion
from orbweave.plans import relations as r
from orbweave.plans.catalog import _quat, query, r6, rounded


def sql_ray(x: str, y: str, aspect: str, table: str = "", roll: str | None = None) -> list[str]:
    """World ray of a normalised viewport point in SQL; the pose columns are those of ``table``."""
    c = lambda n: f"{table}{n}"
    u, v = f"((2 * ({x}) - 1) * tan({c('h_fov')} / 2))", f"((1 - 2 * ({y})) * tan({c('h_fov')} / 2) / ({aspect}))"
    n = f"sqrt({u} * {u} + {v} * {v} + 1)"
    dx, dy, dz = f"({u} / {n})", f"({v} / {n})", f"(1 / {n})"
    if roll:
        dx, dy = f"({dx} * cos({roll}) - {dy} * sin({roll}))", f"({dx} * sin({roll}) + {dy} * cos({roll}))"
    ry, rz = f"({dy} * cos({c('pitch')}) + {dz} * sin({c('pitch')}))", f"({dz} * cos({c('pitch')}) - {dy} * sin({c('pitch')}))"
    return [f"({dx} * cos({c('yaw')}) + {rz} * sin({c('yaw')}))", ry, f"({rz} * cos({c('yaw')}) - {dx} * sin({c('yaw')}))"]


_X, _Y, _Z = sql_ray("0.3::DOUBLE", "0.8::DOUBLE", "1.5::DOUBLE")
_BOX = "(0.05::DOUBLE + (id % 7) / 20)", "(0.1::DOUBLE + (id % 5) / 20)", "(0.1::DOUBLE + (id % 11) / 40)", "(0.1::DOUBLE + (id % 13) / 40)"


@query(f"""WITH {r.CANDIDATE} SELECT id, round({_X}, 6) AS x, round({_Y}, 6) AS y, round({_Z}, 6) AS z, round({r.sql_wrap(f"yaw + atan((2 * ({_BOX[0]} + {_BOX[2]} / 2) - 1) * tan(h_fov / 2))")}, 6) AS centre_yaw,
 round(greatest(-pi() / 2, least(pi() / 2, pitch + atan((2 * ({_BOX[1]} + {_BOX[3]} / 2) - 1) * tan(h_fov / 2) / 1.5::DOUBLE))), 6) AS centre_pitch, round(least(pi() - 0.001::DOUBLE, greatest(0.01::DOUBLE, 2 * atan({_BOX[2]} * (id % 3) * tan(h_fov / 2)))), 6) AS extent FROM candidate""")
def geo08_viewport_rays(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-08, GEO-14, GEO-15: a viewport point's world ray, and a box's approximate centre and extent."""
    i = F.col("id")
    box = [0.05 + i % 7 / 20, 0.1 + i % 5 / 20, 0.1 + i % 11 / 40, 0.1 + i % 13 / 40]
    pose = [F.col(c) for c in ("yaw", "pitch", "h_fov")]
    x, y, z = sphere.viewport_ray(F.lit(0.3), F.lit(0.8), *pose, 1.5)
    yaw, pitch = sphere.box_centre_angles(box, *pose, 1.5)
    return r.candidate(spark, sf).select("id", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"), r6(yaw).alias("centre_yaw"), r6(pitch).alias("centre_pitch"), r6(sphere.box_extent(box[2] * (i % 3), F.col("h_fov"))).alias("extent"))


_PX = sql_ray("((vec_id % 640) + 0.5) / width", "((vec_id % 360) + 0.5) / height", "width / height", roll="roll")


@query(f"""WITH {r.REGISTRATION} SELECT vec_id, {", ".join(f"round({k}, 6) AS {n}" for k, n in zip(_PX, "xyz", strict=True))} FROM registration""")
def geo09_rolled_pixel_rays(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-09: a pixel's world ray in a viewport that is rolled about its own axis."""
    pose = [F.col(c) for c in ("width", "height", "yaw", "pitch", "h_fov", "roll")]
    ray = sphere.pixel_ray((F.col("vec_id") % 640).cast("double"), (F.col("vec_id") % 360).cast("double"), *pose)
    return r.registration(spark, sf).select("vec_id", *[r6(k).alias(n) for k, n in zip(ray, "xyz", strict=True)])


_S, _T = sql_ray("(x + 0.5) / width", "(y + 0.5) / height", "width / height", roll="roll"), sql_ray("(tx + 0.5) / width", "(ty + 0.5) / height", "width / height", roll="roll")
_FRACTIONS = "round((y + 0.5) / height, 6) AS row_fraction, round((x + 0.5) / width, 6) AS column_fraction"
_RAYS = ", ".join(f"round({k}, 6) AS {n}" for k, n in zip((*_S, *_T), (*motion.SOURCE, *motion.TARGET), strict=True))
_GRID = "(m0 * x + m1 * y + m2) / (m6 * x + m7 * y + m8) AS tx, (m3 * x + m4 * y + m5) / (m6 * x + m7 * y + m8) AS ty"


@query(f"""WITH {r.REGISTRATION}, grid AS (SELECT registration.*, ((c % 5) + 0.5) * width / 5 - 0.5 AS x, ((c // 5) + 0.5) * height / 3 - 0.5 AS y FROM registration, range(15) g(c)), moved AS (SELECT *, {_GRID} FROM grid)
 SELECT vec_id, {_FRACTIONS}, {_RAYS} FROM moved WHERE tx BETWEEN -0.5 AND width - 0.5 AND ty BETWEEN -0.5 AND height - 0.5""")
def geo11_registration_rays(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-10..12: ray matches of a registration on a grid of five by three points that stay in view."""
    made = motion.registration_samples(r.registration(spark, sf), "homography")
    return rounded(made.select("vec_id", "row_fraction", "column_fraction", *motion.SOURCE, *motion.TARGET), "row_fraction", "column_fraction", *motion.SOURCE, *motion.TARGET)


@query(f"""WITH {r.REGISTRATION}, tiles AS (SELECT registration.*, 320.0::DOUBLE * (vec_id % 2) AS left_x, 180.0::DOUBLE * ((vec_id // 2) % 2) AS top_y, 320.0::DOUBLE AS wide, 180.0::DOUBLE AS high FROM registration),
 cells AS (SELECT tiles.*, ((c % 4) + 0.5) * wide / 4 - 0.5 AS lx, ((c // 4) + 0.5) * high / 3 - 0.5 AS ly FROM tiles, range(12) g(c)), moved AS (SELECT *, (m0 * lx + m1 * ly + m2) / (m6 * lx + m7 * ly + m8) AS mx, (m3 * lx + m4 * ly + m5) / (m6 * lx + m7 * ly + m8) AS my FROM cells),
 whole AS (SELECT *, left_x + lx AS x, top_y + ly AS y, left_x + mx AS tx, top_y + my AS ty FROM moved WHERE mx BETWEEN -0.5 AND wide - 0.5 AND my BETWEEN -0.5 AND high - 0.5) SELECT vec_id, {_FRACTIONS}, {_RAYS} FROM whole""")
def geo13_tile_rays(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-13: ray matches of a registration of one quarter of the image, in the whole viewport's geometry."""
    i = F.col("vec_id")
    tiles = r.registration(spark, sf).select("*", (320.0 * (i % 2)).alias("left_x"), (180.0 * (F.floor(i / 2) % 2)).alias("top_y"), F.lit(320.0).alias("wide"), F.lit(180.0).alias("high"))
    made = motion.registration_samples(tiles, "homography", 4, 3, ("left_x", "top_y", "wide", "high"))
    return rounded(made.select("vec_id", "row_fraction", "column_fraction", *motion.SOURCE, *motion.TARGET), "row_fraction", "column_fraction", *motion.SOURCE, *motion.TARGET)


def _sql_product(a: list[str], b: list[str]) -> list[str]:
    return [f"({a[3 * i]} * {b[j]} + {a[3 * i + 1]} * {b[3 + j]} + {a[3 * i + 2]} * {b[6 + j]})" for i in range(3) for j in range(3)]


_N = [f"m{i}" for i in range(9)]
_FLIP = ["1", "0", "0", "0", "-1", "(height - 1)", "0", "0", "1"]
_TURNED = ", ".join(f"{x} AS t{i}" for i, x in enumerate(_sql_product(_FLIP, _sql_product(_N, _FLIP))))
_COFACTORS = [f"(t{a} * t{d} - t{b} * t{c})" for a, b, c, d in ((4, 5, 7, 8), (2, 1, 8, 7), (1, 2, 4, 5), (5, 3, 8, 6), (0, 2, 6, 8), (2, 0, 5, 3), (3, 4, 6, 7), (1, 0, 7, 6), (0, 1, 3, 4))]


@query(f"""WITH {r.REGISTRATION}, turned AS (SELECT vec_id, {_TURNED} FROM registration), inv AS (SELECT vec_id, {", ".join(f"{x} AS c{i}" for i, x in enumerate(_COFACTORS))} FROM turned) SELECT vec_id, {", ".join(f"round(c{i} / c8, 6) AS h{i}" for i in range(9))} FROM inv""")
def geo16_native_registration(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-16: a bottom-left, target-to-source registration as a top-left, source-to-target one."""
    made = matrix.from_native_registration(matrix.of(F.col("homography")), F.col("height"))
    return r.registration(spark, sf).select("vec_id", *[r6(x).alias(f"h{i}") for i, x in enumerate(made)])


@query(f"""WITH {r.DETECTION}, b AS (SELECT frame, line, part, supp, x * 2 AS x, top * 2 AS top, w, h, x * 2 + w AS rgt, top * 2 + h AS low FROM detection), ok AS (SELECT *, w > 0 AND h > 0 AND x >= 0 AND top >= 0 AND rgt <= 1 + 1 / 384.0::DOUBLE AND low <= 1 + 1 / 216.0::DOUBLE AS fits FROM b)
 SELECT frame, line, part, supp, round(CASE WHEN fits THEN x END, 6) AS x, round(CASE WHEN fits THEN CASE WHEN low > 1 THEN 0 ELSE 1 - top - h END END, 6) AS y, round(CASE WHEN fits THEN CASE WHEN rgt > 1 THEN 1 - x ELSE w END END, 6) AS width, round(CASE WHEN fits THEN CASE WHEN low > 1 THEN 1 - top ELSE h END END, 6) AS height FROM ok""")
def geo17_seed_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-17, FIL-08: boxes turned to the bottom-left origin and cut at the edge by one pixel at most; null where they don't fit."""
    made = sphere.seed_box(F.col("x") * 2, F.col("top") * 2, F.col("w"), F.col("h"), 384, 216, 1.0)
    return r.detection(spark, sf).select("frame", "line", "part", "supp", *[r6(v).alias(k) for k, v in made.items()])


_Q2 = f"{r.QUATERNION}, p AS (SELECT a.vec_id, a.x AS ax, a.y AS ay, a.z AS az, a.w AS aw, b.x AS bx, b.y AS \"by\", b.z AS bz, b.w AS bw FROM quaternion a JOIN quaternion b ON b.vec_id = a.vec_id + 1)"


@query(f"""WITH {_Q2} SELECT vec_id, round(aw * bx - ax * bw - ay * bz + az * "by", 6) AS cx, round(aw * bw + ax * bx + ay * "by" + az * bz, 6) AS cw, round(2 * (ax * az + aw * ay), 6) AS fx, round(2 * (ay * az - aw * ax), 6) AS fy, round(1 - 2 * (ax * ax + ay * ay), 6) AS fz,
 round(atan2(2 * (ax * az + aw * ay), 1 - 2 * (ax * ax + ay * ay)), 6) AS yaw, round(asin(greatest(-1, least(1, 2 * (ay * az - aw * ax)))), 6) AS pitch, round(atan2(2 * (ax * ay + az * aw), 1 - 2 * (ax * ax + az * az)), 6) AS roll FROM p""")
def geo_quaternions(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-18, 20, 21, 22: corrections (of inputs of any length), turned rays, and yaw, pitch and roll."""
    q = r.quaternion(spark, sf)
    pairs = q.alias("a").join(q.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1)
    a, b = _quat("a"), _quat("b")
    c, f = quat.correction([2 * x for x in a], [3 * x for x in b]), quat.rotate(a, [F.lit(0.0), F.lit(0.0), F.lit(1.0)])
    angles = quat.yaw_pitch_roll(a)
    return pairs.select(F.col("a.vec_id"), r6(c[0]).alias("cx"), r6(c[3]).alias("cw"), r6(f[0]).alias("fx"), r6(f[1]).alias("fy"), r6(f[2]).alias("fz"), *[r6(x).alias(n) for x, n in zip(angles, ("yaw", "pitch", "roll"), strict=True)])


@query(f"""WITH {r.CANDIDATE}, h AS (SELECT id, sin(yaw / 2) AS sy, cos(yaw / 2) AS cy, sin(-pitch / 2) AS sp, cos(-pitch / 2) AS cp, sin(h_fov / 2) AS sr, cos(h_fov / 2) AS cr FROM candidate)
 SELECT id, round(cy * sp * cr + sy * cp * sr, 6) AS x, round(sy * cp * cr - cy * sp * sr, 6) AS y, round(cy * cp * sr - sy * sp * cr, 6) AS z, round(cy * cp * cr + sy * sp * sr, 6) AS w FROM h""")
def geo23_from_angles(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-23: the rotation of a yaw, pitch and roll."""
    q = quat.from_yaw_pitch_roll(F.col("yaw"), F.col("pitch"), F.col("h_fov"))
    return r.candidate(spark, sf).select("id", *[r6(k).alias(n) for k, n in zip(q, "xyzw", strict=True)])


@query(f"""WITH {r.SIGNAL}, n AS (SELECT id, source_id, t, score, lead(t) OVER w - t AS d, lead(score) OVER w - score AS c FROM signal WINDOW w AS (PARTITION BY source_id ORDER BY t, id)),
 k AS (SELECT *, greatest(least((id % 14 - 2) / 10, 1), 0) AS s FROM n WHERE d > 0)
 SELECT id, round(s * s * s * (s * (s * 6 - 15) + 10), 6) AS weight, round(abs(c) * (15 / 8) / (d / 86400), 6) AS speed, round(abs(c) * (10 * sqrt(3) / 3) / ((d / 86400) * (d / 86400)), 4) AS acceleration, round(abs(c) * 60 / ((d / 86400) * (d / 86400) * (d / 86400)), 3) AS jerk FROM k WHERE d > 3600""")
def geo25_quintic(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-25, GEO-26: the quintic weight, and the greatest speed, acceleration and jerk of a quintic move."""
    w = Window.partitionBy("source_id").orderBy("t", "id")
    s = r.signal(spark, sf).withColumn("d", F.lead("t").over(w) - F.col("t")).withColumn("c", F.lead("score").over(w) - F.col("score")).where("d > 3600")
    speed, acceleration, jerk = sphere.segment_limits(F.col("c"), F.col("d") / 86400)
    return s.select("id", r6(sphere.smoothstep((F.col("id") % 14 - 2) / 10)).alias("weight"), r6(speed).alias("speed"), F.round(acceleration, 4).alias("acceleration"), F.round(jerk, 3).alias("jerk"))


@query(f"""WITH {r.REGISTRATION}, p AS (SELECT vec_id, m2 AS tx, m5 AS ty, (m0 + m4) / 2 AS a, (m3 - m1) / 2 AS b FROM registration), s AS (SELECT *, atan2(b, a) AS angle, ln(sqrt(a * a + b * b)) AS log_scale FROM p)
 SELECT vec_id, round(tx, 6) AS tx, round(ty, 6) AS ty, round(angle, 6) AS angle, round(log_scale, 6) AS log_scale, round(-(a * tx + b * ty) / (a * a + b * b), 6) AS back_x, round((b * tx - a * ty) / (a * a + b * b), 6) AS back_y, round(a * 100 - b * 50 + tx, 6) AS to_x, round(b * 100 + a * 50 + ty, 6) AS to_y,
 round(angle * 7 + 9 - 2 * pi() * round((angle * 7 + 9 - 1) / (2 * pi())), 6) AS unwrapped FROM s""")
def geo27_similarities(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-27, GEO-30: a registration's nearest similarity, its inverse, where it sends a point, and an angle's nearest turn."""
    parts = matrix.similarity_parts(matrix.of(F.col("homography")))
    made = matrix.similarity(*parts)
    back = matrix.multiply(matrix.inverse_similarity(made), made)  # the identity, up to rounding
    inverse = matrix.inverse_similarity(made)
    to_x, to_y = matrix.transform(made, F.lit(100.0), F.lit(50.0), 1e-9)
    ok = F.abs(back[0] - 1) + F.abs(back[2]) + F.abs(back[5]) < 1e-6
    named = dict(zip(("tx", "ty", "angle", "log_scale"), parts, strict=True)) | {"back_x": inverse[2], "back_y": inverse[5], "to_x": F.when(ok, to_x), "to_y": to_y, "unwrapped": matrix.unwrap(parts[2] * 7 + 9, F.lit(1.0))}
    return r.registration(spark, sf).select("vec_id", *[r6(c).alias(n) for n, c in named.items()])


@query(f"""WITH {r.DETECTION} SELECT frame, line, part, supp, 1.0::DOUBLE AS same, CASE WHEN line % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS none FROM detection""")
def geo28_empty_unions(spark: SparkSession, sf: str) -> DataFrame:
    """GEO-28: a box with itself, whose overlap is 1 by one convention even without area and 0 by the other."""
    box = [F.col("x"), F.col("top"), F.col("w") * (F.col("line") % 2), F.col("h") * (F.col("line") % 2)]
    return r.detection(spark, sf).select("frame", "line", "part", "supp", r6(sphere.box_iou(box, box, 1.0)).alias("same"), r6(sphere.box_iou(box, box, 0.0)).alias("none"))


@query(f"""WITH {r.SIGNAL}, {r.CANDIDATE}, {r.POSE}, k AS (SELECT source_id, i, t, yaw, pitch, h_fov, lag(t) OVER w AS t0, lag(yaw) OVER w AS y0, lag(pitch) OVER w AS p0, lead(t) OVER w AS t1, lead(pitch) OVER w AS p1 FROM pose WINDOW w AS (PARTITION BY source_id ORDER BY i))
 SELECT source_id, i, round(60 * (pitch - p0) / pow((t - t0) / 3600, 3), 6) AS left_jerk, round(60 * (p1 - pitch) / pow((t1 - t) / 3600, 3), 6) AS right_jerk FROM k WHERE t - t0 > 1800 AND t1 - t > 1800""")
def win11_knot_jerks(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-11: the jerk on both sides of each inner knot of a quintic path (speed and acceleration are 0 there)."""
    w = Window.partitionBy("source_id").orderBy("i")
    hours = lambda c: c / 3600
    p = r.pose(spark, sf).select("source_id", "i", hours(F.col("t") - F.lag("t").over(w)).alias("before"), hours(F.lead("t").over(w) - F.col("t")).alias("after"), (F.col("pitch") - F.lag("pitch").over(w)).alias("rise"), (F.lead("pitch").over(w) - F.col("pitch")).alias("fall"))
    p = p.where("before > 0.5 and after > 0.5")
    return p.select("source_id", "i", r6(60 * F.col("rise") / F.pow("before", F.lit(3))).alias("left_jerk"), r6(60 * F.col("fall") / F.pow("after", F.lit(3))).alias("right_jerk"))


_SAMPLES = f"""{r.SIGNAL}, {r.CANDIDATE}, {r.POSE}, knots AS (SELECT source_id, t - min(t) OVER (PARTITION BY source_id) AS t, yaw, pitch, h_fov, i FROM pose WHERE source_id % 10 = 3),
 chain AS (SELECT source_id, t, pitch, h_fov, i, first_value(yaw) OVER w AS y0, {r.sql_wrap("yaw - lag(yaw) OVER w")} AS d FROM knots WINDOW w AS (PARTITION BY source_id ORDER BY i)), path AS (SELECT source_id, t, pitch, h_fov, y0 + coalesce(sum(d) OVER (PARTITION BY source_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS yaw FROM chain),
 ends AS (SELECT source_id, floor(max(t) / 43200 + 1e-12)::BIGINT AS last FROM path GROUP BY source_id), frames AS (SELECT source_id, unnest(range(last + 1)) AS frame FROM ends), f AS (SELECT source_id, frame, frame * 43200.0::DOUBLE AS t FROM frames),
 q AS (SELECT f.source_id, f.frame, f.t, a.yaw AS ya, a.pitch AS pa, a.h_fov AS fa, b.yaw AS yb, b.pitch AS pb, b.h_fov AS fb, CASE WHEN b.t > a.t THEN (f.t - a.t) / (b.t - a.t) ELSE 0 END AS s FROM f ASOF JOIN path a ON f.source_id = a.source_id AND f.t >= a.t ASOF LEFT JOIN path b ON f.source_id = b.source_id AND f.t < b.t),
 g AS (SELECT *, coalesce(s * s * s * (s * (s * 6 - 15) + 10), 0) AS w FROM q), v AS (SELECT source_id, frame, t, ya + (coalesce(yb, ya) - ya) * w AS yaw, pa + (coalesce(pb, pa) - pa) * w AS pitch, fa + (coalesce(fb, fa) - fa) * w AS h_fov FROM g)"""


def _camera_samples(spark, sf):
    """A camera path on a grid of twelve-hour frames: unwrapped knots, quintic in between."""
    p = r.pose(spark, sf).where("source_id % 10 = 3")
    w = Window.partitionBy("source_id").orderBy("i")
    flat = p.withColumn("d", sphere.wrap_yaw(F.col("yaw") - F.lag("yaw").over(w))).withColumn("y0", F.first("yaw").over(w))
    flat = flat.withColumn("yaw", F.col("y0") + F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).withColumn("t", F.col("t") - F.min("t").over(Window.partitionBy("source_id")))
    step = 43200.0
    last = flat.groupBy("source_id").agg(F.floor(F.max("t") / step + 1e-12).alias("last"))
    frames = last.select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("frame")).withColumn("t", F.col("frame") * step)
    return dense_path(frames, flat.select("source_id", "t", "yaw", "pitch", "h_fov"), "source_id")


def dense_path(frames: DataFrame, knots: DataFrame, key: str) -> DataFrame:
    """WIN-10, JOIN-12: the pose at each frame time, by the quintic weight between the knots around it."""
    names = ["yaw", "pitch", "h_fov"]
    ask = frames.select(key, "t", F.col("frame").alias("_frame"), *[F.lit(None).cast("double").alias(c) for c in names])
    both = ask.unionByName(knots.select(key, "t", F.lit(None).cast("long").alias("_frame"), *names))
    mark = F.when(F.col("_frame").isNull(), F.struct("t", *names))
    w = Window.partitionBy(key).orderBy("t", F.col("_frame").isNotNull())
    a, b = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(mark, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    found = both.select(key, "t", "_frame", a.alias("_a"), b.alias("_b")).where("_frame is not null")
    share = F.when(F.col("_b.t") > F.col("_a.t"), (F.col("t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))).otherwise(0.0)
    weight = sphere.smoothstep(share)
    pose = [(F.col(f"_a.{c}") + (F.coalesce(F.col(f"_b.{c}"), F.col(f"_a.{c}")) - F.col(f"_a.{c}")) * weight).alias(c) for c in names]
    return found.select(key, F.col("_frame").alias("frame"), "t", *pose)


@query(f"WITH {_SAMPLES} SELECT source_id, frame, round(t, 6) AS t, round(yaw, 5) AS yaw, round(pitch, 6) AS pitch, round(h_fov, 6) AS h_fov FROM v")
def win10_camera_samples(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-10, JOIN-12, FIL-12: a dense camera path on a frame grid."""
    return rounded(_camera_samples(spark, sf), "t", "pitch", "h_fov").withColumn("yaw", F.round("yaw", 5))


@query(f"""WITH {_SAMPLES}, l AS (SELECT source_id, frame, unnest([0, 1, 2]) AS place, t, round(degrees({r.sql_wrap("yaw")}), 4) AS yaw, round(degrees(pitch), 6) AS pitch, round(degrees(h_fov), 6) AS h_fov FROM v)
 SELECT source_id, frame, place::INTEGER AS place, CASE place WHEN 0 THEN printf('%.9f v360 yaw %.9f;', t, yaw) WHEN 1 THEN printf('%.9f v360 pitch %.9f;', t, pitch) ELSE printf('%.9f v360 h_fov %.9f;', t, h_fov) END AS line FROM l""")
def snk04_command_lines(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-04, SNK-05: three camera commands for each sample, as text."""
    kept = lambda c, n: F.when(F.round(c, n) == 0, c * 0.0).otherwise(F.round(c, n))  # noqa: E731  # a text tells -0 from 0, and Spark's round has no -0
    degrees = {"yaw": kept(F.degrees(sphere.wrap_yaw(F.col("yaw"))), 4), "pitch": kept(F.degrees("pitch"), 6), "h_fov": kept(F.degrees("h_fov"), 6)}
    lines = F.posexplode(F.array(*[F.format_string(f"%.9f v360 {n} %.9f;", "t", c) for n, c in degrees.items()]))
    return _camera_samples(spark, sf).select("source_id", "frame", lines.alias("place", "line"))


