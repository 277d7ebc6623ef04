"""Registered queries: rotation fits by variant, consensus, reliability, motion chains, smoothing and stabilisation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.operators import folds, motion, rotation
from orbweave.operators.staging import staged
from orbweave.plans import relations as r
from orbweave.plans.catalog import query, r6, rounded

PAIR = ["source", "pair"]


def _samples(spark, sf):
    return motion.registration_samples(r.registration(spark, sf), "homography")


def _rotations(spark, sf):
    """Rotations of views: four sources, pairs of frames, six views a pair."""
    v = F.col("vec_id")
    return r.quaternion(spark, sf).select((v % 4).alias("source"), F.floor(v / 24).alias("pair"), (F.floor(v / 4) % 6).cast("long").alias("view"), "vec_id", *"xyzw")


_ROTATIONS = f"{r.QUATERNION}, rotation AS (SELECT vec_id % 4 AS source, vec_id // 24 AS pair, (vec_id // 4) % 6 AS view, vec_id, x, y, z, w FROM quaternion)"
_FAR = "2 * acos(least(abs(a.x * b.x + a.y * b.y + a.z * b.z + a.w * b.w), 1))"
_MEDOID = f"""{_ROTATIONS}, pairs AS (SELECT a.source, a.pair, a.view, b.view AS other, {_FAR} AS d FROM rotation a JOIN rotation b USING (source, pair)), total AS (SELECT source, pair, view, round(sum(d), 9) AS total FROM pairs GROUP BY source, pair, view),
 medoid AS (SELECT source, pair, arg_min(view, struct_pack(a := total, b := view)) AS medoid FROM total GROUP BY source, pair), near AS (SELECT p.source, p.pair, p.other AS view, m.medoid, p.d AS distance FROM pairs p JOIN medoid m ON m.source = p.source AND m.pair = p.pair AND m.medoid = p.view)"""


@query(f"""WITH {_MEDOID}, n AS (SELECT source, pair, any_value(medoid) AS medoid, count(*) FILTER (distance <= 1.75) AS n_selected, count(*) FILTER (distance > 1.75) AS n_rejected FROM near GROUP BY source, pair)
 SELECT *, CASE WHEN n_selected >= 3 THEN 'selected' ELSE 'invalid' END AS state, CASE WHEN n_selected < 3 THEN 'insufficient_view_consensus' END AS failure_reason FROM n""")
def agg17_medoid_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-17, JOIN-21, GEO-19: a pair's view with the least summed rotation distance, and who agrees with it."""
    _, verdicts = motion.consensus(_rotations(spark, sf), PAIR, "view", 1.75, 3)
    return verdicts.drop("covered")


@query(f"""WITH {_MEDOID} SELECT source, pair, view, round(distance, 6) AS distance, distance <= 1.75 AS selected FROM near""")
def set05_consensus_members(spark: SparkSession, sf: str) -> DataFrame:
    """SET-05: each view's distance from its pair's medoid, selected or rejected."""
    members, _ = motion.consensus(_rotations(spark, sf), PAIR, "view", 1.75, 3)
    return rounded(members, "distance")


_CELL = "'r' || least(floor(((view * 37) % 100) / 100 * 2), 1)::INTEGER || 'c' || least(floor(((view * 61) % 100) / 100 * 3), 2)::INTEGER"


@query(f"""WITH {_MEDOID}, n AS (SELECT source, pair, any_value(medoid) AS medoid, count(*) FILTER (distance <= 2) AS n_selected, count(DISTINCT CASE WHEN distance <= 2 THEN {_CELL} END) AS covered FROM near GROUP BY source, pair)
 SELECT *, CASE WHEN n_selected < 3 THEN 'insufficient_tile_consensus' WHEN covered < 3 THEN 'insufficient_spatial_coverage' END AS failure_reason FROM n""")
def agg18_tile_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-18: a pair's tiles near their medoid, which must cover enough cells of the image."""
    v = F.col("view")
    tiles = _rotations(spark, sf).withColumn("cell", motion.image_cell((v * 61) % 100 / 100, (v * 37) % 100 / 100, 3, 2))
    _, verdicts = motion.consensus(tiles, PAIR, "view", 2.0, 3, "insufficient_tile_consensus", ("cell", 3, "insufficient_spatial_coverage"))
    return verdicts.drop("n_rejected", "state")


@query(f"""WITH {_ROTATIONS}, pairs AS (SELECT a.pair, a.vec_id AS id, b.vec_id AS other, b.view, {_FAR} AS d FROM rotation a JOIN rotation b USING (pair)), total AS (SELECT pair, id, round(sum(d), 9) AS total FROM pairs GROUP BY pair, id),
 medoid AS (SELECT pair, arg_min(id, struct_pack(a := total, b := id)) AS medoid FROM total GROUP BY pair), n AS (SELECT p.pair, m.medoid, count(*) FILTER (p.d <= 1.5) AS n_selected, count(DISTINCT CASE WHEN p.d <= 1.5 THEN p.view END) AS covered FROM pairs p JOIN medoid m ON m.pair = p.pair AND m.medoid = p.id GROUP BY p.pair, m.medoid)
 SELECT *, CASE WHEN n_selected < 4 THEN 'insufficient_global_tile_consensus' WHEN covered < 3 THEN 'insufficient_global_viewport_coverage' END AS failure_reason FROM n""")
def agg19_global_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-19: all tiles of a pair's views near one medoid, which must come from enough viewports."""
    _, verdicts = motion.consensus(_rotations(spark, sf), ["pair"], "vec_id", 1.5, 4, "insufficient_global_tile_consensus", ("view", 3, "insufficient_global_viewport_coverage"))
    return verdicts.drop("n_rejected", "state")


@query(f"""WITH RECURSIVE {_MEDOID}, lists AS (SELECT source, pair, list(distance ORDER BY view) AS d, list(view ORDER BY view) AS views, row_number() OVER (PARTITION BY source ORDER BY pair) AS n FROM near GROUP BY source, pair),
 f AS (SELECT source, n, pair, views, d, CAST(NULL AS DOUBLE[]) AS before, d AS scores FROM lists WHERE n = 1 UNION ALL SELECT l.source, l.n, l.pair, l.views, l.d, f.scores, list_transform(range(1, 7), lambda k: coalesce(0.8::DOUBLE * f.scores[k] + 0.2::DOUBLE * l.d[k], f.scores[k])) FROM f JOIN lists l ON l.source = f.source AND l.n = f.n + 1),
 v AS (SELECT source, pair, n, unnest(views) AS view, unnest(list_transform(views, lambda k: before[k + 1])) AS reliability FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY source, pair ORDER BY reliability, view) AS place FROM v)
 SELECT source, pair, view::VARCHAR AS view, round(reliability, 4) AS reliability, place::INTEGER AS place, n = 1 OR place <= 4 AS selected FROM k""")
def win17_causal_average(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-17, ST-12, TOP-07: views ranked by moving averages of their medoid distances on earlier pairs only."""
    members, _ = motion.consensus(_rotations(spark, sf), PAIR, "view", math.inf, 1)
    made = folds.causal_reliability(members, "source", "pair", "view", "distance", 4)
    return made.withColumn("reliability", F.round("reliability", 4))


@query()
def agg20_rotation_fit(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-20, PLN-19: a robust rotation for each view of a pair from its registration's ray matches (tested on known rotations)."""
    fits = rotation.fit_rotations(_samples(spark, sf), *PAIR, "view")
    return rounded(fits, "x", "y", "z", "w", "inlier_ratio", "residual", "confidence")


@query()
def agg21_tile_motion(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-21, PLN-15: each tile fitted by itself, tiles near their medoid chosen, and one fit over their pooled matches."""
    samples = _samples(spark, sf)
    fits = rotation.fit_rotations(samples, *PAIR, "view").where("w is not null")
    v = F.col("view")
    tiles = fits.withColumn("cell", motion.image_cell((v * 61) % 100 / 100, (v * 37) % 100 / 100, 3, 2))
    members, verdicts = motion.consensus(tiles, PAIR, "view", math.radians(20), 3, "insufficient_tile_consensus", ("cell", 2, "insufficient_spatial_coverage"))
    pooled = samples.join(members.where("selected").select(*PAIR, "view"), [*PAIR, "view"], "left_semi")
    whole = rotation.fit_rotations(pooled, *PAIR)
    return rounded(verdicts.select(*PAIR, "medoid", "n_selected", "covered", "failure_reason").join(whole, PAIR, "left"), "x", "y", "z", "w", "inlier_ratio", "residual", "confidence")


@query()
def pln15_global_motion(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-15, PLN-19, GEO-16, AGG-19, AGG-20: a moment's motion from the native registrations of all tiles of all viewports: converted, fitted one
    by one, chosen by their medoid over enough viewports, and fitted together the other way round (tested against a plain loop)."""
    samples = motion.native_samples(r.registration(spark, sf), "homography")
    _, _, motions = motion.global_motion(samples, ["pair"], "vec_id", "view", math.radians(20), 4, 3)
    judged = motion.judge_fits(motions.drop("failure_reason").withColumnRenamed("state", "consensus"), math.radians(12), 0.02, 0.15, math.radians(2.5))
    return rounded(judged.select("pair", "medoid", "n_selected", "covered", "consensus", "x", "y", "z", "w", "inlier_ratio", "residual", "confidence", "state", "failure_reason"), "x", "y", "z", "w", "inlier_ratio", "residual", "confidence")


_FITTED = "fitted AS (SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE 1 - abs(embedding[1]::DOUBLE) / 30 END AS w, abs(embedding[2]::DOUBLE) * 4 AS confidence, 1 - abs(embedding[3]::DOUBLE) * 4 AS inlier_ratio, abs(embedding[4]::DOUBLE) / 6 AS residual FROM embeddings)"


@query(f"""WITH {_FITTED}, s AS (SELECT *, 2 * acos(least(abs(w), 1)) AS step FROM fitted), j AS (SELECT vec_id, step, CASE WHEN w IS NULL THEN 'rotation_fit_failed' WHEN step > 0.1 THEN 'rotation_step_exceeds_configured_bound' WHEN confidence < 0.2 THEN 'rotation_fit_confidence_below_bound' WHEN inlier_ratio < 0.5 THEN 'rotation_fit_inlier_ratio_below_bound' WHEN residual > 0.03 THEN 'rotation_fit_residual_exceeds_bound' END AS failure_reason FROM s)
 SELECT vec_id, round(step, 6) AS step, failure_reason, CASE WHEN failure_reason IS NULL THEN 'measured' ELSE 'invalid' END AS state FROM j""")
def fil06_fit_gates(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-06: the first bound that a fit breaks, of its step, confidence, inliers and residual."""
    e = lambda i: F.abs(F.element_at("embedding", i).cast("double"))
    fits = r.table(spark, sf, "embeddings").select("vec_id", F.when(F.col("vec_id") % 13 != 0, 1 - e(1) / 30).alias("w"), (e(2) * 4).alias("confidence"), (1 - e(3) * 4).alias("inlier_ratio"), (e(4) / 6).alias("residual"))
    return rounded(motion.judge_fits(fits, 0.1, 0.2, 0.5, 0.03).select("vec_id", "step", "failure_reason", "state"), "step")


def _judged(spark, sf):
    samples = staged(_samples(spark, sf), "ray-samples")
    views = rotation.fit_rotations(samples, *PAIR, "view").where("w is not null")
    members = staged(motion.consensus(views, PAIR, "view", math.radians(20), 1)[0], "view-consensus")
    causal = folds.causal_reliability(members, "source", "pair", "view", "distance", 4).where("selected").select("source", "pair", F.col("view").cast("long").alias("view"))
    masked = motion.without_bottom(samples, "view", [1, 2], 0.3)
    kept = motion.fit_variants(samples, PAIR, "view", {"consensus": members.where("selected"), "causal": causal})
    kept = kept.unionByName(masked.join(causal, [*PAIR, "view"], "left_semi").withColumn("variant", F.lit("masked")))
    fits = rotation.fit_rotations(kept, *PAIR, "variant")
    used = kept.groupBy(*PAIR, "variant").agg(F.count_distinct("view").alias("contributing"))
    return motion.judge_fits(fits.join(used, [*PAIR, "variant"]), math.radians(12), 0.02, 0.15, math.radians(2.5)), samples


@query()
def pln14_motion_variants(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-14, PLN-16, FIL-05, FIL-06: a pair's motion from all views, without each of them, from the consensus, from the causally chosen, and masked."""
    judged, _ = _judged(spark, sf)
    return rounded(judged.select(*PAIR, "variant", "contributing", "x", "y", "z", "w", "confidence", "inlier_ratio", "residual", "step", "state", "failure_reason"), "x", "y", "z", "w", "confidence", "inlier_ratio", "residual", "step")


@query()
def agg16_band_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-16: residuals of the causal fit by view and vertical band."""
    judged, samples = _judged(spark, sf)
    fits = judged.where("variant = 'causal' and w is not null")
    return rounded(motion.band_residuals(samples, fits, PAIR, "view"), "rms")


def _source_motion(spark, sf):
    judged, _ = _judged(spark, sf)
    steps = judged.where("variant = 'causal' and pair % 17 != 11").withColumn("start", F.col("pair").cast("double")).withColumn("end", F.col("pair") + 1.0)
    return motion.source_motion(steps, "source", "pair", "start", "end", 6)


@query()
def win16_source_motion(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-16: a source's orientation along its pairs from its first moment, until the first pair that fails, with each fit's figures."""
    return rounded(_source_motion(spark, sf), "x", "y", "z", "w", "confidence", "inlier_ratio", "coverage", "residual")


@query()
def win16_motion_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-16: the pairs that a source's motion path has no measured sample of, and why."""
    return motion.motion_gaps(_source_motion(spark, sf), "source")


_VIEWED = f"""{r.REGISTRATION}, seen AS (SELECT source, pair, view, vec_id, pair * 0.04::DOUBLE + CASE WHEN vec_id % 23 = 0 THEN 0.01 ELSE 0 END AS previous, pair * 0.04::DOUBLE + 0.04::DOUBLE AS current FROM registration WHERE vec_id % 29 <> 0),
 declared AS (SELECT DISTINCT source, view FROM seen WHERE NOT (source = 1 AND view = 5)), asked AS (SELECT p.source, p.pair, d.view FROM (SELECT DISTINCT source, pair FROM seen) p JOIN declared d USING (source)),
 first AS (SELECT source, pair, arg_min(previous, view) AS p FROM seen s SEMI JOIN declared d USING (source, view) GROUP BY source, pair),
 broken AS (SELECT 'missing_view' AS rule_id, source, pair, view FROM asked a ANTI JOIN seen s USING (source, pair, view) UNION ALL SELECT 'undeclared_view', source, pair, view FROM seen s ANTI JOIN declared d USING (source, view) UNION ALL SELECT 'timestamps_disagree', source, pair, view FROM seen JOIN first USING (source, pair) WHERE abs(previous - p) > 1e-9)"""


def _aligned(spark, sf):
    v = r.registration(spark, sf).where("vec_id % 29 != 0")
    at = F.col("pair") * F.lit(0.04)
    seen = v.select("source", "pair", "view", "vec_id", (at + F.when(F.col("vec_id") % 23 == 0, 0.01).otherwise(0.0)).alias("previous"), (at + 0.04).alias("current"))
    declared = seen.select("source", "view").distinct().where("not (source = 1 and view = 5)")
    return motion.aligned_views(seen, declared, "source", "pair", "view")


@query(f"""WITH {_VIEWED} SELECT source, pair, view, vec_id, round(previous, 6) AS previous FROM seen ANTI JOIN broken USING (source, pair)""")
def join17_aligned_views(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-17: the pairs of frames that all declared views saw at the same moments."""
    return rounded(_aligned(spark, sf)[0].select("source", "pair", "view", "vec_id", "previous"), "previous")


@query(f"""WITH {_VIEWED} SELECT * FROM broken""")
def join17_view_rules(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-17: views that are missing, not declared, or of another moment."""
    return _aligned(spark, sf)[1]


_STEPS = f"{_ROTATIONS}, step AS (SELECT source, vec_id // 4 AS i, CASE WHEN (vec_id // 4) % 9 IN (4, 5) OR (vec_id // 4) % 31 BETWEEN 7 AND 11 THEN 'invalid' ELSE 'measured' END AS state, x, y, z, w FROM rotation)"


def _steps(spark, sf):
    i = F.floor(F.col("vec_id") / 4)
    bad = (i % 9).isin(4, 5) | (i % 31).between(7, 11)
    return _rotations(spark, sf).select("source", i.alias("i"), F.when(bad, "invalid").otherwise("measured").alias("state"), *[F.when(~bad, F.col(c)).alias(c) for c in "xyzw"])


@query(f"""WITH {_STEPS}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) AS k, last_value(CASE WHEN state = 'measured' THEN i END IGNORE NULLS) OVER (PARTITION BY source ORDER BY i) AS i0, first_value(CASE WHEN state = 'measured' THEN i END IGNORE NULLS) OVER (PARTITION BY source ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS i1 FROM step),
 g AS (SELECT n.source, n.i, n.state, n.k, a.k AS k0, b.k AS k1, a.x AS ax, a.y AS ay, a.z AS az, a.w AS aw, b.x AS bx, b.y AS "by", b.z AS bz, b.w AS bw FROM n LEFT JOIN n a ON a.source = n.source AND a.i = n.i0 LEFT JOIN n b ON b.source = n.source AND b.i = n.i1),
 c AS (SELECT *, CASE WHEN state = 'measured' THEN NULL WHEN k0 IS NULL OR k1 IS NULL THEN 'boundary_gap_has_no_two_sided_rotation_context' WHEN k1 - k0 - 1 > 3 THEN 'interior_gap_exceeds_configured_frame_bound' ELSE 'bridge_candidate' END AS gap_class, ax * bx + ay * "by" + az * bz + aw * bw AS d FROM g),
 s AS (SELECT *, (k - k0)::DOUBLE / (k1 - k0) AS fraction, acos(least(abs(d), 1)) AS th, CASE WHEN d < 0 THEN -1 ELSE 1 END AS side FROM c), u AS (SELECT *, sin((1 - fraction) * th) / sin(th) AS p, side * sin(fraction * th) / sin(th) AS q FROM s)
 SELECT source, i, CASE WHEN gap_class = 'bridge_candidate' THEN 'interpolated' ELSE state END AS state, gap_class, CASE WHEN state <> 'measured' THEN k1 - k0 - 1 END AS gap_frames, round(CASE WHEN state = 'measured' THEN ax WHEN gap_class = 'bridge_candidate' THEN p * ax + q * bx END, 6) AS x, round(CASE WHEN state = 'measured' THEN aw WHEN gap_class = 'bridge_candidate' THEN p * aw + q * bw END, 6) AS w FROM u""")
def win05_bridged_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-04, WIN-05, GEO-24: short inner gaps of a rotation series filled along the arc, others classified."""
    made = motion.bridge_gaps(_steps(spark, sf), "source", "i")
    return rounded(made.select("source", "i", "state", "gap_class", F.col("gap_frames").cast("long").alias("gap_frames"), "x", "w"), "x", "w")


@query(f"""WITH RECURSIVE {_STEPS}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) AS k FROM step), ok AS (SELECT *, k - row_number() OVER (PARTITION BY source ORDER BY k) AS island FROM n WHERE state = 'measured'), numbered AS (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY island) AS segment, row_number() OVER (PARTITION BY source, island ORDER BY k) AS j FROM ok),
 f AS (SELECT source, segment, j, i, CASE WHEN w < 0 THEN -x ELSE x END AS x, CASE WHEN w < 0 THEN -y ELSE y END AS y, CASE WHEN w < 0 THEN -z ELSE z END AS z, abs(w) AS w FROM numbered WHERE j = 1
 UNION ALL SELECT source, segment, j, i, s * px, s * py, s * pz, s * pw FROM (SELECT *, CASE WHEN px * fx + py * fy + pz * fz + pw * fw < 0 THEN -1 ELSE 1 END AS s FROM (SELECT n.source, n.segment, n.j, n.i, f.x AS fx, f.y AS fy, f.z AS fz, f.w AS fw, f.w * n.x + f.x * n.w + f.y * n.z - f.z * n.y AS px, f.w * n.y - f.x * n.z + f.y * n.w + f.z * n.x AS py, f.w * n.z + f.x * n.y - f.y * n.x + f.z * n.w AS pz, f.w * n.w - f.x * n.x - f.y * n.y - f.z * n.z AS pw FROM f JOIN numbered n ON n.source = f.source AND n.segment = f.segment AND n.j = f.j + 1)))
 SELECT source, segment::INTEGER AS segment, i::DOUBLE + 1 AS t, round(x, 5) AS x, round(w, 5) AS w, 'measured' AS state FROM f UNION ALL SELECT source, segment::INTEGER, i::DOUBLE, 0, 1, 'segment_anchor' FROM f WHERE j = 1""")
def win15_relative_segments(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-15: orientations relative to where each stretch of measured steps begins."""
    steps = _steps(spark, sf).withColumn("start", F.col("i").cast("double")).withColumn("end", F.col("i") + 1.0)
    made = rotation.relative_segments(steps, "source", "i")
    return made.select("source", "segment", "t", (F.round("x", 5) + 0.0).alias("x"), (F.round("w", 5) + 0.0).alias("w"), "state")


_PATH = f"{_ROTATIONS}, path AS (SELECT source, (vec_id // 4) * 0.1::DOUBLE AS t, x + 0.0 AS x, y, z, w + 3 AS w FROM rotation), unit AS (SELECT source, t, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM path))"


@query(f"""WITH {_PATH}, m AS (SELECT a.source, a.t, a.x AS cx, a.y AS cy, a.z AS cz, a.w AS cw, sum(g * b.x) AS x, sum(g * b.y) AS y, sum(g * b.z) AS z, sum(g * b.w) AS w FROM unit a JOIN unit b ON a.source = b.source AND abs(b.t - a.t) <= 0.35, LATERAL (SELECT exp(-0.5 * pow((b.t - a.t) / 0.175, 2)) AS g) GROUP BY ALL),
 u AS (SELECT source, t, cx, cy, cz, cw, x / n AS x, y / n AS y, z / n AS z, w / n AS w FROM (SELECT *, sqrt(x * x + y * y + z * z + w * w) AS n FROM m)), k AS (SELECT *, 2 * acos(least(abs(cx * x + cy * y + cz * z + cw * w), 1)) AS far FROM u), b AS (SELECT *, radians(8.0::DOUBLE) AS most, far / 2 AS th FROM k)
 SELECT source, round(t, 6) AS t, round(least(far, most), 6) AS correction, round(CASE WHEN far > most THEN sin((1 - most / far) * th) / sin(th) * cx + sin(most / far * th) / sin(th) * x ELSE x END, 6) AS x, round(CASE WHEN far > most THEN sin((1 - most / far) * th) / sin(th) * cw + sin(most / far * th) / sin(th) * w ELSE w END, 6) AS w FROM b""")
def win14_smooth_rotations(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-14: Gaussian means of rotations, held to a greatest correction."""
    path = _rotations(spark, sf).select("source", (F.floor(F.col("vec_id") / 4) * F.lit(0.1)).alias("t"), "x", "y", "z", (F.col("w") + 3).alias("w"))
    made = motion.smooth_rotations(path, "source", "t", 0.35, math.radians(8))
    return rounded(made.select("source", "t", "correction", "x", "w"), "t", "correction", "x", "w")


def _stabilized(spark, sf):
    steps = r.registration(spark, sf).select("source", (F.floor(F.col("vec_id") / 4) * 0.04).alias("t"), "homography", F.when(F.col("vec_id") % 17 == 0, "failed").otherwise("measured").alias("state"))
    return motion.smooth_similarities(motion.similarity_path(steps, "source", "t", "homography", "state"), "source", "t", 0.5)


_SIMILAR = f"""{r.REGISTRATION}, step AS (SELECT source, (vec_id // 4) * 0.04::DOUBLE AS t, row_number() OVER (PARTITION BY source ORDER BY vec_id) AS n, CASE WHEN vec_id % 17 = 0 THEN 1 ELSE (m0 + m4) / 2 END AS a, CASE WHEN vec_id % 17 = 0 THEN 0 ELSE (m3 - m1) / 2 END AS b, CASE WHEN vec_id % 17 = 0 THEN 0 ELSE m2 END AS sx, CASE WHEN vec_id % 17 = 0 THEN 0 ELSE m5 END AS sy FROM registration),
 p AS (SELECT source, n, t, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM step WHERE n = 1 UNION ALL SELECT s.source, s.n, s.t, s.a * p.a - s.b * p.b, s.a * p.b + s.b * p.a, s.a * p.x - s.b * p.y + s.sx, s.b * p.x + s.a * p.y + s.sy FROM p JOIN step s ON s.source = p.source AND s.n = p.n + 1),
 raw AS (SELECT source, n, t, x, y, atan2(b, a) AS angle, ln(sqrt(a * a + b * b)) AS log_scale FROM p), smooth AS (SELECT a.source, a.n, a.t, a.x, a.y, a.angle, a.log_scale, sum(g * b.x) / sum(g) AS smooth_x, sum(g * b.y) / sum(g) AS smooth_y, sum(g * b.angle) / sum(g) AS smooth_angle, sum(g * b.log_scale) / sum(g) AS smooth_log_scale FROM raw a JOIN raw b ON a.source = b.source AND abs(b.t - a.t) <= 0.5, LATERAL (SELECT exp(-0.5 * pow((b.t - a.t) / 0.25, 2)) AS g) GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_SIMILAR} SELECT source, round(t, 6) AS t, round(x, 4) AS x, round(angle, 6) AS angle, round(log_scale, 6) AS log_scale, round(smooth_x, 4) AS smooth_x, round(smooth_y, 4) AS smooth_y, round(smooth_angle, 6) AS smooth_angle, round(smooth_log_scale, 6) AS smooth_log_scale FROM smooth""")
def win13_similarity_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-13, WIN-18, JOIN-13: the path that registrations add up to, and its Gaussian means."""
    names = ("angle", "log_scale", "smooth_angle", "smooth_log_scale", "t")
    made = rounded(_stabilized(spark, sf).drop("y"), *names)
    return made.select(*[(F.round(c, 4) + 0.0).alias(c) if c in ("x", "smooth_x", "smooth_y") else F.col(c) for c in made.columns])


@query(f"""WITH RECURSIVE {_SIMILAR}, c AS (SELECT *, exp(smooth_log_scale - log_scale) * cos(smooth_angle - angle) AS p, exp(smooth_log_scale - log_scale) * sin(smooth_angle - angle) AS q FROM smooth), k AS (SELECT source, t, unnest([0.0, 640.0, 0.0, 640.0]) AS kx, unnest([0.0, 0.0, 360.0, 360.0]) AS ky, p, q, smooth_x - (p * x - q * y) AS ox, smooth_y - (q * x + p * y) AS oy FROM c),
 d AS (SELECT source, max(sqrt(pow(p * kx - q * ky + ox - kx, 2) + pow(q * kx + p * ky + oy - ky, 2))) AS displacement FROM k GROUP BY source) SELECT source, round(displacement, 4) AS displacement, least(ceil(displacement), 120)::BIGINT AS margin, (640 - 2 * least(ceil(displacement), 120))::BIGINT AS crop_width, (360 - 2 * least(ceil(displacement), 120))::BIGINT AS crop_height FROM d""")
def win18_overscan(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-18: how far a stabilised source's corners move, and the crop that hides it."""
    _, sources = motion.stabilize(_stabilized(spark, sf), "source", "t", 640, 360)
    long = [F.col(c).cast("long").alias(c) for c in ("margin", "crop_width", "crop_height")]
    return sources.select("source", F.round("displacement", 4).alias("displacement"), *long)


@query(f"""WITH {_ROTATIONS}, s AS (SELECT vec_id, source, vec_id // 4 AS i, x * 10 AS dx, y * 10 AS dy FROM rotation), v AS (SELECT *, dx - lag(dx) OVER w AS cx, dy - lag(dy) OVER w AS cy FROM s WINDOW w AS (PARTITION BY source ORDER BY i)) SELECT source, i, round(sqrt(cx * cx + cy * cy), 6) AS change FROM v""")
def win21_vector_changes(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-21: how much a motion vector differs from the one before."""
    w = Window.partitionBy("source").orderBy("i")
    s = _rotations(spark, sf).select("source", F.floor(F.col("vec_id") / 4).alias("i"), (F.col("x") * 10).alias("dx"), (F.col("y") * 10).alias("dy"))
    return s.select("source", "i", r6(F.hypot(F.col("dx") - F.lag("dx").over(w), F.col("dy") - F.lag("dy").over(w))).alias("change"))
