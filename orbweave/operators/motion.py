"""Source motion: ray matches from image registrations, fits by variant, consensus, chains and smoothing.

A pair is two neighbouring frames; its views, tiles and sampling grid are bounded, so what is grouped by pair
is small. Paths run over a source's pairs in order, as windows where the algebra allows it and else as folds.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import matrix, sphere
from orbweave.functions import quaternion as quat
from orbweave.operators import rotation
from orbweave.operators.intervals import near_in_time
from orbweave.operators.ordered import fold, kind_of
from orbweave.operators.rotation import multiply
from orbweave.operators.staging import staged

SOURCE, TARGET = ("sx", "sy", "sz"), ("tx", "ty", "tz")


def registration_samples(df: DataFrame, homography: str, columns: int = 5, rows: int = 3, tile: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Ray matches of registrations on a grid of sample points (GEO-10..13): ``df`` without the matrix, and
    row_fraction, column_fraction, sx, sy, sz, tx, ty, tz.

    ``df`` has the matrix (nine values, source to target pixels), the viewport's width, height, yaw, pitch,
    h_fov and roll. With ``tile`` (columns x, y, width, height) the matrix is local to a part of the viewport and the
    grid covers that part. Points that go to infinity, or leave the image or tile, are left out.
    """
    grid = F.sequence(F.lit(0), F.lit(columns * rows - 1))
    at = df.withColumn("_cell", F.explode(grid))
    left, top, wide, high = (F.col(c) for c in tile) if tile else (F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height"))
    x = ((F.col("_cell") % columns + 0.5) * wide / columns) - 0.5
    y = (F.floor(F.col("_cell") / columns) + 0.5) * high / rows - 0.5
    to_x, to_y = matrix.transform(matrix.of(F.col(homography)), F.col("_x"), F.col("_y"))
    moved = at.withColumn("_x", x).withColumn("_y", y).withColumn("_tx", to_x).withColumn("_ty", to_y)
    moved = moved.where(sphere.inside_viewport(F.col("_tx"), F.col("_ty"), wide, high))
    pose = [F.col(c) for c in ("width", "height", "yaw", "pitch", "h_fov", "roll")]
    s = sphere.pixel_ray(left + F.col("_x"), top + F.col("_y"), *pose)
    t = sphere.pixel_ray(left + F.col("_tx"), top + F.col("_ty"), *pose)
    place = [((top + F.col("_y") + 0.5) / F.col("height")).alias("row_fraction"), ((left + F.col("_x") + 0.5) / F.col("width")).alias("column_fraction")]
    return moved.select(*[c for c in df.columns if c != homography], *place, *[c.alias(n) for c, n in zip((*s, *t), (*SOURCE, *TARGET), strict=True)])


def native_samples(df: DataFrame, homography: str, columns: int = 5, rows: int = 3, tile: tuple[str, str, str, str] | None = None) -> DataFrame:
    """``registration_samples`` of registrations as a native library gives them (GEO-16): from target to source, with the origin
    at the bottom left."""
    height = F.col("height") if tile is None else F.col(tile[3])
    turned = F.array(*matrix.from_native_registration(matrix.of(F.col(homography)), height))
    return registration_samples(df.withColumn(homography, turned), homography, columns, rows, tile)


def global_motion(samples: DataFrame, keys: list[str], row_id: str, viewport: str, radius: float, least: int, viewports: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fits, members, motions) of a pair from the ray matches of all tiles of all its viewports (PLN-15, PLN-19).

    Each tile is fitted by itself (AGG-20); tiles near their medoid are chosen, ``least`` of them from as many ``viewports``
    (AGG-19); one fit over the matches of the chosen, from target to source, is the pair's motion. Motions have the verdict's
    columns, and the fit's where the verdict is ``selected``.
    """
    names = [*keys, viewport, row_id]
    samples = staged(samples.select(*names, *SOURCE, *TARGET), "tile-samples")
    fits = rotation.fit_rotations(samples, *names)
    members, verdicts = consensus(fits.where("w is not null"), keys, row_id, radius, least, "insufficient_global_tile_consensus", (viewport, viewports, "insufficient_global_viewport_coverage"))
    members = staged(members, "tile-members")
    chosen = samples.join(members.where("selected").select(*keys, row_id), [*keys, row_id], "left_semi")
    chosen = chosen.join(verdicts.where("state = 'selected'").select(*keys), keys, "left_semi")
    back = chosen.select(*keys, *[F.col(t).alias(s) for s, t in zip(SOURCE + TARGET, TARGET + SOURCE, strict=True)])
    return fits, members, verdicts.join(rotation.fit_rotations(back, *keys), keys, "left")


def fit_variants(samples: DataFrame, keys: list[str], view: str, chosen: dict[str, DataFrame]) -> DataFrame:
    """``samples`` once for each variant of a fit (PLN-14): all views, all but one of them, and each named choice.

    ``chosen``: by name, the views (keys, view) that a variant takes. The variant of all but view v is
    ``without:v``. One grouped kernel then fits them all (``rotation.fit_rotations`` by keys and variant).
    """
    every = samples.withColumn("variant", F.lit("all"))
    views = samples.select(*keys, F.col(view).alias("_left")).distinct()
    without = samples.join(views, keys).where(F.col(view) != F.col("_left")).withColumn("variant", F.concat(F.lit("without:"), F.col("_left").cast("string"))).drop("_left")
    made = every.unionByName(without)
    for name, some in chosen.items():
        made = made.unionByName(samples.join(some.select(*keys, view), [*keys, view], "left_semi").withColumn("variant", F.lit(name)))
    return made


def without_bottom(samples: DataFrame, view: str, views: list, fraction: float) -> DataFrame:
    """FIL-06: ``samples`` without the lowest part of the named views."""
    return samples.where(~(F.col(view).isin(views) & (F.col("row_fraction") > 1.0 - fraction)))


#: Why a fit is not accepted; the first reason that holds names it.
FIT_REASONS = ("rotation_step_exceeds_configured_bound", "rotation_fit_confidence_below_bound", "rotation_fit_inlier_ratio_below_bound", "rotation_fit_residual_exceeds_bound")


def judge_fits(fits: DataFrame, most_step: float, least_confidence: float, least_inliers: float, most_residual: float) -> DataFrame:
    """``fits`` with step (the rotation's angle), failure_reason and state (measured or invalid).

    A fit that failed has a null rotation and its own reason.
    """
    step = 2 * F.acos(F.least(F.abs(F.col("w")), F.lit(1.0)))
    tests = (F.col("step") > most_step, F.col("confidence") < least_confidence, F.col("inlier_ratio") < least_inliers, F.col("residual") > most_residual)
    reason = F.when(F.col("w").isNull(), "rotation_fit_failed")
    for broken, name in zip(tests, FIT_REASONS, strict=True):
        reason = reason.when(broken, name)
    judged = fits.withColumn("step", step).withColumn("failure_reason", reason)
    return judged.withColumn("state", F.when(F.col("failure_reason").isNull(), "measured").otherwise("invalid"))


def consensus(rotations: DataFrame, keys: list[str], row_id: str, radius: float, least: int, reason: str = "insufficient_view_consensus", cover: tuple[str, int, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rotations near their medoid (AGG-17..19): (members, verdicts).

    ``rotations``: keys, row_id, x, y, z, w. Members: keys, row_id, distance (from the medoid), selected.
    Verdicts: keys, medoid, n_selected, n_rejected, covered, state, failure_reason. The medoid has the least
    summed distance, then the least id. ``cover``: a column that the selected rows must have so many distinct
    values of, and the reason if they don't (cells of an image, or viewports).
    """
    extra = [cover[0]] if cover else []
    a, b = rotations.alias("a"), rotations.alias("b")
    q = lambda k: [F.col(f"{k}.{c}") for c in "xyzw"]
    far = quat.angle(quat.kept_unit(q("a")), quat.kept_unit(q("b")))
    pairs = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col(f"a.{row_id}").alias("_from"), F.col(f"b.{row_id}").alias(row_id), *[F.col(f"b.{c}").alias(c) for c in extra], far.alias("distance"))
    totals = pairs.groupBy(*keys, "_from").agg(F.round(F.sum("distance"), 9).alias("_total"))
    medoids = totals.groupBy(*keys).agg(F.min_by("_from", F.struct("_total", "_from")).alias("medoid"))
    members = pairs.join(medoids, keys).where("_from = medoid").select(*keys, row_id, *extra, "medoid", "distance", (F.col("distance") <= radius).alias("selected"))
    kept = F.col("selected")
    covered = F.count_distinct(F.when(kept, F.col(cover[0]))) if cover else F.count_if(kept)
    counted = members.groupBy(*keys).agg(F.first("medoid").alias("medoid"), F.count_if(kept).alias("n_selected"), F.count_if(~kept).alias("n_rejected"), covered.alias("covered"))
    why = F.when(F.col("n_selected") < least, reason)
    if cover:
        why = why.when(F.col("covered") < cover[1], cover[2])
    verdicts = counted.withColumn("failure_reason", why).withColumn("state", F.when(F.col("failure_reason").isNull(), "selected").otherwise("invalid"))
    return members.drop("medoid"), verdicts


def image_cell(x: Column, y: Column, columns: int, rows: int) -> Column:
    """The cell of a coverage grid that a normalised centre lies in."""
    part = lambda v, n: F.least(F.floor(v * n), F.lit(n - 1)).cast("string")
    return F.concat(F.lit("r"), part(y, rows), F.lit("c"), part(x, columns))


def band_of(row_fraction: Column) -> Column:
    """The third of an image, from the top, that a row lies in."""
    return F.when(row_fraction < 1 / 3, "top").when(row_fraction < 2 / 3, "middle").otherwise("bottom")


def band_residuals(samples: DataFrame, fits: DataFrame, keys: list[str], view: str) -> DataFrame:
    """AGG-16: root mean square angle between turned target rays and source rays by view and vertical band."""
    turned = quat.rotate(quat.unit([F.col(c) for c in "xyzw"]), [F.col(c) for c in TARGET])
    dot = sum((p * F.col(s) for p, s in zip(turned[1:], SOURCE[1:], strict=True)), turned[0] * F.col(SOURCE[0]))
    off = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    rows = samples.join(fits.select(*keys, *"xyzw"), keys).select(*keys, view, band_of(F.col("row_fraction")).alias("band"), off.alias("_off"))
    return rows.groupBy(*keys, view, "band").agg(F.count(F.lit(1)).alias("samples"), F.sqrt(F.avg(F.col("_off") * F.col("_off"))).alias("rms"))


class Chain:
    def __init__(self):
        self.at, self.connected, self.n, self.end = np.array([0.0, 0.0, 0.0, 1.0]), True, 0, None


def source_motion(fits: DataFrame, key: str, order: str, start: str, end: str, views: int) -> DataFrame:
    """Absolute orientation along a source's pairs (WIN-16): key, sample, order, start, t, x, y, z, w, confidence,
    inlier_ratio, coverage, residual, state, reason.

    ``fits``: key, order, start, end, rotation x..w (null if the pair failed), confidence, inlier_ratio, residual,
    contributing (views), failure_reason. Sample 0 is where the first pair begins: the identity, measured. A measured step
    turns the orientation on; the first pair that failed disconnects the path for good: what follows keeps the last
    orientation and is invalid, with the figures of its own fit. A failed pair's residual is half a turn. A pair that doesn't
    begin where the one before ended is such a failure here (``pairs_not_contiguous``), not an error of the whole.
    """
    rows = fits.select(key, order, start, end, "x", "y", "z", "w", "confidence", "inlier_ratio", "residual", "contributing", "failure_reason")

    def step(chain: Chain, row: tuple):
        of, at, begins, ends, x, y, z, w, confidence, inliers, residual, contributing, reason = row
        if not chain.n:
            yield of, 0, at, begins, begins, *map(float, chain.at), 1.0, 1.0, 1.0, 0.0, "measured", None
            chain.end = begins
        contiguous, chain.end, chain.n = abs(begins - chain.end) <= 1e-9 and ends > begins, ends, chain.n + 1
        failed = reason or ("rotation_fit_failed" if w is None else None if contiguous else "pairs_not_contiguous")
        why = failed or (None if chain.connected else "disconnected_absolute_path")
        chain.connected &= why is None
        if why is None:
            turned = multiply(chain.at, np.array([x, y, z, w]))
            turned /= np.linalg.norm(turned)
            chain.at = turned if turned @ chain.at >= 0 else -turned
        coverage = 0.0 if failed else (contributing or 0) / views
        sure = confidence * math.sqrt(coverage) if why is None else 0.0
        yield of, chain.n, at, begins, ends, *map(float, chain.at), sure, 0.0 if failed else inliers, coverage, math.pi if failed else residual, "invalid" if why else "measured", why

    kinds = f"{key} {kind_of(fits, key)}, sample long, {order} {kind_of(fits, order)}, start double, t double, x double, y double, z double, w double, confidence double, inlier_ratio double, coverage double, residual double, state string, reason string"
    return fold(rows, [key], [order], Chain, step, kinds)


def motion_gaps(samples: DataFrame, key: str) -> DataFrame:
    """(key, start, end, reason): the pairs of ``source_motion`` without a measured sample."""
    return samples.where("state = 'invalid'").select(key, "start", F.col("t").alias("end"), "reason")


def aligned_views(observations: DataFrame, declared: DataFrame, key: str, index: str, view: str, slack: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(aligned, violations): observations of many views, joined by index (JOIN-17).

    ``observations``: key, index, view, previous, current, and what else a view has; ``declared``: key, view. An index is
    aligned if every declared view has one observation of it, no other view has any, and all give the moments of the
    first view (by name) to within ``slack``; then its rows stay. Violations: (rule_id, key, index, view) with
    ``missing_view``, ``undeclared_view``, ``repeated_view`` or ``timestamps_disagree``.
    """
    names = [key, index, view]
    asked = observations.select(key, index).distinct().join(declared.select(key, view), key)
    seen = observations.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min("previous").alias("_p"), F.min("current").alias("_c"))
    both = asked.withColumn("_asked", F.lit(True)).join(seen, names, "full")
    first = F.min_by(F.struct("_p", "_c"), F.when(F.col("_asked") & F.col("_n").isNotNull(), F.col(view))).over(Window.partitionBy(key, index))
    judged = both.withColumn("_first", first)
    off = (F.abs(F.col("_p") - F.col("_first._p")) > slack) | (F.abs(F.col("_c") - F.col("_first._c")) > slack)
    rules = {"missing_view": F.col("_n").isNull(), "undeclared_view": F.col("_asked").isNull(), "repeated_view": F.col("_n") > 1, "timestamps_disagree": off}
    bad = judged.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule_id"), *names)
    return observations.join(bad.select(key, index).distinct(), [key, index], "left_anti"), bad


def continuous(path: DataFrame, key: str, order: str) -> DataFrame:
    """``path`` with each rotation in the hemisphere of the one before, as one running count of sign changes."""
    w = Window.partitionBy(key).orderBy(order)
    dot = quat.dot([F.lag(c).over(w) for c in "xyzw"], [F.col(c) for c in "xyzw"])
    turned = path.withColumn("_flip", F.sum(F.coalesce((F.col("_dot") < 0).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))) if "_dot" in path.columns else None
    if turned is None:
        return continuous(path.withColumn("_dot", dot), key, order)
    sign = F.when(F.col("_flip") % 2 == 1, -1.0).otherwise(1.0)
    return turned.select(*[(F.col(c) * sign).alias(c) if c in "xyzw" else F.col(c) for c in path.columns if c != "_dot"])


def _gauss(at: str, radius: float) -> Column:
    return F.exp(-0.5 * F.pow((F.col("near_at") - F.col(at)) / (radius / 2), F.lit(2)))


def smooth_rotations(path: DataFrame, key: str, at: str, radius: float = 0.35, most: float = math.radians(25)) -> DataFrame:
    """Gaussian mean of rotations within ``radius`` seconds (WIN-14): key, at, x, y, z, w, correction.

    Rotations are put in one hemisphere along the path and, in each mean, in the centre's. Where the mean lies
    further than ``most`` from the centre it is moved back to that angle along the arc.
    """
    names = list("xyzw")
    units = path.select(key, at, *[q.alias(c) for q, c in zip(quat.unit([F.col(c) for c in names]), names, strict=True)])
    flat = continuous(units, key, at)
    pairs = near_in_time(flat, key, at, radius, names)
    centre, near = [F.col(c) for c in names], [F.col(f"near_{c}") for c in names]
    weight = _gauss(at, radius) * F.when(quat.dot(centre, near) < 0, -1.0).otherwise(1.0)
    sums = pairs.groupBy(key, at, *names).agg(*[F.sum(weight * n).alias(f"_{c}") for n, c in zip(near, names, strict=True)])
    mean = sums.select(key, at, *names, *[q.alias(f"_{c}") for q, c in zip(quat.unit([F.col(f"_{c}") for c in names]), names, strict=True)])
    smooth = [F.col(f"_{c}") for c in names]
    far = quat.angle(centre, smooth)
    held = quat.slerp(centre, smooth, F.lit(most) / far)
    capped = mean.select(key, at, *[F.when(far > most, h).otherwise(s).alias(c) for h, s, c in zip(held, smooth, names, strict=True)], F.least(far, F.lit(most)).alias("correction"))
    return continuous(capped, key, at)


class Similarity:
    def __init__(self):
        self.turn, self.shift, self.angle = complex(1, 0), complex(0, 0), 0.0


def similarity_path(steps: DataFrame, key: str, at: str, homography: str, state: str, backwards: bool = False) -> DataFrame:
    """The path that a source's frame-to-frame registrations add up to (WIN-18): key, at, x, y, angle, log_scale.

    Each step is reduced to the nearest similarity; a step that isn't measured, or has none, stands still. The
    first row is where the path begins. ``backwards``: steps map the current frame to the one before. Angles go
    on without jumps.
    """
    parts = matrix.similarity_parts(matrix.of(F.col(homography)))
    ok = F.col(state) == "measured"
    rows = steps.select(key, F.col(at).cast("double").alias(at), *[F.when(ok, p).alias(n) for p, n in zip(parts, ("_x", "_y", "_a", "_s"), strict=True)])

    def step(path: Similarity, row: tuple):
        of, now, x, y, angle, log_scale = row
        if hasattr(path, "began") and x is not None:
            turn = math.exp(log_scale) * complex(math.cos(angle), math.sin(angle))
            shift = complex(x, y)
            if backwards:
                turn, shift = 1 / turn, -shift / turn
            path.turn, path.shift = turn * path.turn, turn * path.shift + shift
            angle = math.atan2(path.turn.imag, path.turn.real)
            d = angle - path.angle
            turns = -math.ceil((d - math.pi) / (2 * math.pi)) if d > math.pi else math.ceil((-d - math.pi) / (2 * math.pi)) if d < -math.pi else 0
            path.angle = angle + turns * 2 * math.pi
        path.began = True
        yield of, now, path.shift.real, path.shift.imag, path.angle, math.log(abs(path.turn))

    return fold(rows, [key], [at], Similarity, step, f"{key} {kind_of(steps, key)}, {at} double, x double, y double, angle double, log_scale double")


def smooth_similarities(path: DataFrame, key: str, at: str, radius: float) -> DataFrame:
    """WIN-13: ``path`` with smooth_x, smooth_y, smooth_angle and smooth_log_scale, Gaussian means within ``radius`` seconds."""
    names = ["x", "y", "angle", "log_scale"]
    pairs = near_in_time(path, key, at, radius, names)
    weight = _gauss(at, radius)
    value = {n: F.col(f"near_{n}") for n in names} | {"angle": matrix.unwrap(F.col("near_angle"), F.col("angle"))}
    return pairs.groupBy(key, at, *names).agg(*[(F.sum(weight * value[n]) / F.sum(weight)).alias(f"smooth_{n}") for n in names])


def stabilize(path: DataFrame, key: str, at: str, width: float, height: float) -> tuple[DataFrame, DataFrame]:
    """What turns each raw frame into the smooth one, and how much the frame needs to be cut for it (WIN-18).

    ``path`` as ``smooth_similarities`` gives it. Frames: key, at, correction (nine values), displacement (of the
    corner that moves furthest). Sources: key, displacement, margin, crop_width, crop_height; the margin is a third
    of the shorter side at most.
    """
    raw, smooth = (matrix.similarity(*[F.col(p + n) for n in ("x", "y", "angle", "log_scale")]) for p in ("", "smooth_"))
    correction = matrix.multiply(smooth, matrix.inverse_similarity(raw))
    frames = path.select(key, at, F.array(*correction).alias("correction"))
    held = matrix.of(F.col("correction"))
    corners = []
    for x, y in ((0.0, 0.0), (width, 0.0), (0.0, height), (width, height)):
        to_x, to_y = matrix.transform(held, F.lit(x), F.lit(y), 1e-9)
        corners.append(F.hypot(to_x - x, to_y - y))
    frames = frames.withColumn("displacement", F.greatest(*corners))
    margin = F.least(F.ceil(F.col("displacement")), F.lit(int(min(width, height) // 3)))
    sources = frames.groupBy(key).agg(F.max("displacement").alias("displacement")).withColumn("margin", margin)
    return frames, sources.withColumn("crop_width", F.lit(int(width)) - 2 * F.col("margin")).withColumn("crop_height", F.lit(int(height)) - 2 * F.col("margin"))


def bridge_gaps(steps: DataFrame, key: str, order: str, most: int = 3) -> DataFrame:
    """``steps`` with short inner gaps filled along the arc between their neighbours (WIN-04, WIN-05).

    ``steps``: key, order, state, x, y, z, w. Rows: key, order, state (measured, interpolated or invalid), x..w,
    gap_class (``bridge_candidate``, ``interior_gap_exceeds_configured_frame_bound`` or
    ``boundary_gap_has_no_two_sided_rotation_context``; null outside gaps), gap_frames and fraction.
    """
    names = list("xyzw")
    w = Window.partitionBy(key).orderBy(order)
    ok = F.col("state") == "measured"
    numbered = steps.withColumn("_i", F.row_number().over(w))
    known = F.when(ok, F.struct("_i", *names))
    back = Window.partitionBy(key).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)  # frames to the end would be read anew for each row
    around = numbered.withColumn("_a", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.last(known, ignorenulls=True).over(back))
    frames = F.col("_b._i") - F.col("_a._i") - 1
    fraction = (F.col("_i") - F.col("_a._i")) / (frames + 1)
    inner = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    kind = F.when(ok, None).when(~inner, "boundary_gap_has_no_two_sided_rotation_context").when(frames > most, "interior_gap_exceeds_configured_frame_bound").otherwise("bridge_candidate")
    filled = around.withColumn("gap_class", kind).withColumn("gap_frames", F.when(~ok & inner, frames)).withColumn("fraction", F.when(F.col("gap_class") == "bridge_candidate", fraction))
    bridge = F.col("gap_class") == "bridge_candidate"
    between = quat.slerp([F.col(f"_a.{c}") for c in names], [F.col(f"_b.{c}") for c in names], F.col("fraction"))
    state = F.when(bridge, "interpolated").otherwise(F.col("state"))
    return filled.select(key, order, state.alias("state"), *[F.when(ok, F.col(c)).when(bridge, b).alias(c) for c, b in zip(names, between, strict=True)], "gap_class", "gap_frames", "fraction")
