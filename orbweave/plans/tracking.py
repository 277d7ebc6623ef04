"""Registered queries: association, tracklets, lifecycles as candidates, group views and windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.operators import folds, groups, tracking
from orbweave.operators.staging import staged
from orbweave.plans import relations as r
from orbweave.plans.catalog import _STATES, _TRACK, _track, query, rounded

_KEPT = ("source", "frame", "candidate_id", "yaw", "pitch", "h_fov", "candidate_type", "observed", "observed_frames", "age_frames", "missing_frames", "source_candidate", "provenance")


@query()
def st06_association(spark: SparkSession, sf: str) -> DataFrame:
    """ST-06, JOIN-02, JOIN-03, SET-03: every frame's candidates with their tracks, group views and fallback (tested against plain rules)."""
    s = r.sighting(spark, sf)
    every = tracking.whole_range(s, "source")
    frames = staged(tracking.associate(s, "source", frames=every), "association")
    shown = frames.where("observed and candidate_type in ('click', 'view')")
    views = groups.group_shots(shown.select("source", "frame", F.col("candidate_id").alias("id"), "yaw", "pitch", F.col("h_fov").alias("extent"), F.lit(None).alias("pitch_min"), F.lit(None).alias("pitch_max")), ["source", "frame"])
    return rounded(tracking.with_context(frames, views, "source", every).select(*_KEPT), "yaw", "pitch", "h_fov")


_SIGHTED = f"""{r.SIGNAL}, {r.CANDIDATE}, sighting AS (SELECT s.id, s.source_id % 16 AS source, CAST(floor(s.t / 21600) AS BIGINT) AS frame, c.kind, c.yaw, c.pitch, c.h_fov, CASE WHEN s.kind = 'purchase' THEN 'up-' || (s.id % 9) END AS upstream FROM signal s JOIN candidate c USING (id)),
 every AS (SELECT source, unnest(range(min(frame), max(frame) + 1)) AS frame FROM sighting GROUP BY source),
 listed AS (SELECT source, frame, list(struct_pack(kind := kind, upstream := upstream, yaw := yaw, pitch := pitch, h_fov := h_fov, id := id) ORDER BY kind, round_even(yaw, 12), round_even(pitch, 12), round_even(h_fov, 12), id) AS seen FROM sighting GROUP BY source, frame),
 sampled AS (SELECT e.source, e.frame, row_number() OVER (PARTITION BY e.source ORDER BY e.frame) AS n, coalesce(l.seen, []) AS seen FROM every e LEFT JOIN listed l USING (source, frame))"""
_FIRST_TRACKS = "list_transform(seen, lambda o, k: struct_pack(name := k, kind := o.kind, upstream := o.upstream, yaw := o.yaw, pitch := o.pitch, h_fov := o.h_fov, begun := frame, times := 1::BIGINT, missing := 0::BIGINT, source_candidate := o.id))"
# pairs of open tracks and rows in order; each is taken unless one of its sides is
_TAKEN = f"""list_reduce([[struct_pack(far := -1.0::DOUBLE, name := -1::BIGINT, place := -1::BIGINT)]] || list_transform(list_sort(flatten(list_transform(f.tracks, lambda t: list_transform(list_filter(range(1, len(s.seen) + 1), lambda i: s.seen[i].kind = t.kind AND s.seen[i].upstream IS NOT DISTINCT FROM t.upstream AND (t.upstream IS NOT NULL OR {r.sql_distance("t", "s.seen[i]")} <= radians(25.0::DOUBLE))),
 lambda i: struct_pack(far := CASE WHEN t.upstream IS NULL THEN {r.sql_distance("t", "s.seen[i]")} ELSE 0 END::DOUBLE, name := t.name, place := i))))), lambda p: [p]), lambda acc, p: CASE WHEN len(list_filter(acc, lambda a: a.name = p[1].name OR a.place = p[1].place)) > 0 THEN acc ELSE acc || p END)"""


@query(f"""WITH RECURSIVE {_SIGHTED}, f AS (SELECT source, n, frame, len(seen)::BIGINT + 1 AS fresh, {_FIRST_TRACKS} AS tracks FROM sampled WHERE n = 1
 UNION ALL SELECT source, n, frame, fresh + len(rest), list_filter(list_transform(tracks, lambda t: CASE WHEN len(list_filter(taken, lambda a: a.name = t.name)) > 0 THEN list_transform(list_filter(taken, lambda a: a.name = t.name), lambda a: struct_pack(name := t.name, kind := t.kind, upstream := t.upstream, yaw := seen[a.place].yaw, pitch := seen[a.place].pitch, h_fov := seen[a.place].h_fov, begun := t.begun, times := t.times + 1, missing := 0::BIGINT, source_candidate := seen[a.place].id))[1]
  ELSE struct_pack(name := t.name, kind := t.kind, upstream := t.upstream, yaw := t.yaw, pitch := t.pitch, h_fov := t.h_fov, begun := t.begun, times := t.times, missing := t.missing + 1, source_candidate := NULL::BIGINT) END), lambda t: t.missing <= 2)
  || list_transform(rest, lambda i, k: struct_pack(name := fresh + k - 1, kind := seen[i].kind, upstream := seen[i].upstream, yaw := seen[i].yaw, pitch := seen[i].pitch, h_fov := seen[i].h_fov, begun := frame, times := 1::BIGINT, missing := 0::BIGINT, source_candidate := seen[i].id))
  FROM (SELECT *, list_filter(range(1, len(seen) + 1), lambda i: len(list_filter(taken, lambda a: a.place = i)) = 0) AS rest FROM (SELECT s.source, s.n, s.frame, s.seen, f.fresh, f.tracks, {_TAKEN} AS taken FROM f JOIN sampled s ON s.source = f.source AND s.n = f.n + 1)))
 SELECT source, frame, format('track:{{:06d}}', t.name) AS candidate_id, round(t.yaw, 6) AS yaw, t.kind AS candidate_type, t.source_candidate IS NOT NULL AS observed, t.times AS observed_frames, frame - t.begun + 1 AS age_frames, t.missing AS missing_frames, t.source_candidate AS source_candidate FROM (SELECT source, frame, unnest(tracks) AS t FROM f)
 UNION ALL SELECT source, frame, 'context:forward', 0, 'context', true, n, n, 0, NULL FROM sampled""")
def st06_grace_frames(spark: SparkSession, sf: str) -> DataFrame:
    """ST-06, JOIN-02, JOIN-03, SET-03: tracks over every frame of a source, seen in or not, with grace rows and the fallback."""
    s = r.sighting(spark, sf)
    every = tracking.whole_range(s, "source")
    made = tracking.with_context(tracking.associate(s, "source", frames=every), None, "source", every)
    return rounded(made.select("source", "frame", "candidate_id", "yaw", "candidate_type", "observed", "observed_frames", "age_frames", "missing_frames", "source_candidate"), "yaw")


_NEAR = f"h.kind = seen[i].kind AND {r.sql_distance('h', 'seen[i]')} <= radians(25.0::DOUBLE)"
_NO_HYPOTHESES = "[]::STRUCT(name BIGINT, kind VARCHAR, yaw DOUBLE, pitch DOUBLE, since DOUBLE, seen BIGINT, missing BIGINT, track BIGINT)[]"
_HELD = "struct_pack(name := h.name, kind := h.kind, yaw := {yaw}, pitch := {pitch}, since := h.since, seen := h.seen + {more}, missing := {missing}, track := {track})"
_MATCHED = _HELD.format(yaw="seen[own[k]].yaw", pitch="seen[own[k]].pitch", more="1", missing="0::BIGINT", track="CASE WHEN fits[k] THEN next_track + len(list_filter(fits[1:k], lambda x: x)) - 1 ELSE h.track END")
_MISSED = _HELD.format(yaw="h.yaw", pitch="h.pitch", more="0", missing="h.missing + 1", track="h.track")


@query(f"""WITH RECURSIVE {_SIGHTED}, ordered AS (SELECT source, frame, list(struct_pack(kind := kind, yaw := yaw, pitch := pitch, id := id) ORDER BY kind, yaw, pitch, id) AS seen FROM sighting GROUP BY source, frame),
 sample AS (SELECT e.source, (e.frame * 21600)::DOUBLE AS moment, row_number() OVER (PARTITION BY e.source ORDER BY e.frame) AS n, coalesce(o.seen, []) AS seen FROM every e LEFT JOIN ordered o USING (source, frame)),
 f AS (SELECT DISTINCT source, 0::BIGINT AS n, 0.0::DOUBLE AS moment, 1::BIGINT AS fresh, 1::BIGINT AS next_track, {_NO_HYPOTHESES} AS hyps, {_NO_HYPOTHESES} AS acquired, {_NO_HYPOTHESES} AS ended, 0::BIGINT AS observations, 0::BIGINT AS unsure_hyps, 0::BIGINT AS unsure_rows FROM sample
 UNION ALL SELECT source, n, moment, fresh + len(fresh_rows), next_track + len(list_filter(fits, lambda x: x)), list_filter(moved, lambda h: h.missing = 0 OR (h.track IS NOT NULL AND h.missing <= 2)) || list_transform(fresh_rows, lambda i, k: struct_pack(name := fresh + k - 1, kind := seen[i].kind, yaw := seen[i].yaw, pitch := seen[i].pitch, since := moment, seen := 1::BIGINT, missing := 0::BIGINT, track := NULL::BIGINT)),
  list_filter(moved, lambda h: h.track >= next_track), list_filter(moved, lambda h: h.track IS NOT NULL AND h.missing > 2), len(seen), len(list_filter(partners, lambda p: len(p) > 1)), len(list_filter(suitors, lambda x: x > 1))
 FROM (SELECT *, list_transform(hyps, lambda h, k: CASE WHEN own[k] IS NOT NULL THEN {_MATCHED} ELSE {_MISSED} END) AS moved, list_filter(range(1, len(seen) + 1), lambda i: suitors[i] = 0) AS fresh_rows
 FROM (SELECT *, list_transform(hyps, lambda h, k: own[k] IS NOT NULL AND h.track IS NULL AND h.seen + 1 >= 2 AND moment - h.since >= 21600) AS fits
 FROM (SELECT *, list_transform(partners, lambda p: CASE WHEN len(p) = 1 AND suitors[p[1]] = 1 THEN p[1] END) AS own
 FROM (SELECT *, list_transform(range(1, len(seen) + 1), lambda i: len(list_filter(partners, lambda p: list_contains(p, i)))) AS suitors
 FROM (SELECT s.source, s.n, s.moment, s.seen, f.fresh, f.next_track, f.hyps, list_transform(f.hyps, lambda h: list_filter(range(1, len(s.seen) + 1), lambda i: {_NEAR.replace("seen[i]", "s.seen[i]")})) AS partners FROM f JOIN sample s ON s.source = f.source AND s.n = f.n + 1))))))
 SELECT source, moment AS at, event, format('semantic-track:{{:06d}}', h.track) AS track_id, h.kind AS kind, round(h.yaw, 6) AS yaw, round(h.pitch, 6) AS pitch, h.seen AS seen, h.missing AS missing, NULL::BIGINT AS count FROM (SELECT source, moment, 'acquired' AS event, unnest(acquired) AS h FROM f UNION ALL SELECT source, moment, 'terminated', unnest(ended) FROM f UNION ALL SELECT source, moment, 'active', unnest(list_filter(hyps, lambda h: h.track IS NOT NULL)) FROM f)
 UNION ALL SELECT source, moment, event, NULL, NULL, NULL, NULL, NULL, NULL, count FROM (SELECT source, moment, unnest(['observations', 'ambiguous_hypotheses', 'ambiguous_observations']) AS event, unnest([observations, unsure_hyps, unsure_rows]) AS count FROM f WHERE n > 0)""")
def st07_tracklets(spark: SparkSession, sf: str) -> DataFrame:
    """ST-07: tracks acquired from unambiguous geometry, over every sample of a source."""
    s = r.sighting(spark, sf).withColumn("at", (F.col("frame") * 21600).cast("double"))
    samples = tracking.whole_range(s, "source").select("source", (F.col("frame") * 21600).cast("double").alias("at"))
    return rounded(tracking.tracklets(s, "source", "at", math.radians(25), 2, 21600.0, 2, samples), "yaw", "pitch")


@query(f"""WITH {r.CANDIDATE}, k AS (SELECT frame, id, row_number() OVER (PARTITION BY frame ORDER BY kind, round_even(yaw, 12), round_even(pitch, 12), round_even(h_fov, 12), id) AS place FROM candidate) SELECT frame, id, place FROM k""")
def top09_observation_order(spark: SparkSession, sf: str) -> DataFrame:
    """TOP-09, TOP-10: a frame's rows in an order that doesn't depend on how they came."""
    c = tracking.in_observation_order(r.candidate(spark, sf))
    return c.select("frame", "id", F.row_number().over(Window.partitionBy("frame").orderBy(*tracking.OBSERVATION_ORDER)).cast("long").alias("place"))


@query(f"""WITH {r.CANDIDATE}, f AS (SELECT kind AS source, frame, row_number() OVER (PARTITION BY kind ORDER BY frame) AS n FROM (SELECT kind, unnest(range(min(frame), max(frame) + 1)) AS frame FROM candidate GROUP BY kind)) SELECT source, frame, 'context:forward' AS candidate_id, n AS observed_frames, n AS age_frames, round({r.sql_wrap("4.0::DOUBLE")}, 6) AS yaw FROM f""")
def set03_fallback_rows(spark: SparkSession, sf: str) -> DataFrame:
    """SET-03: the view ahead as a candidate of every frame, those in which nothing was seen as well."""
    numbered = tracking.frames_in_order(tracking.whole_range(r.candidate(spark, sf).withColumnRenamed("kind", "source"), "source"), "source")
    return rounded(tracking.fallback_rows(numbered, "source", yaw=4.0).select("source", "frame", "candidate_id", "observed_frames", "age_frames", "yaw"), "yaw")


_ALIVE = f"""{_TRACK}, {_STATES}, seen AS (SELECT t.source_id, t.i, s.phase, s.missing, sum(CASE WHEN s.phase = 'active' THEN 1 ELSE 0 END) OVER (PARTITION BY t.source_id ORDER BY t.i) AS seen FROM track t JOIN states s USING (source_id, i)),
 own AS (SELECT source_id, i AS frame, 'lifecycle:' || source_id AS candidate_id, phase = 'active' AS observed, seen::BIGINT AS observed_frames, i AS age_frames, missing::BIGINT AS missing_frames FROM seen WHERE phase <> 'terminated')"""


def _lifecycles(spark, sf):
    rows = _track(spark, sf)
    states = folds.lifecycle(rows, "source_id", "i", "k", "score")
    tracked = rows.select("source_id", "i", F.col("score").alias("yaw"), (F.col("score") / 4).alias("pitch"))
    return tracking.lifecycle_frames(tracked, states, "source_id", "i", F.lit(math.radians(60)), "person")


_FRAME = ("source_id", "frame", "candidate_id", "observed", "observed_frames", "age_frames", "missing_frames")


@query(f"""WITH RECURSIVE {_ALIVE} SELECT * FROM own UNION ALL SELECT source_id, i, 'context:forward', true, i, i, 0 FROM track""")
def st10_lifecycle_frames(spark: SparkSession, sf: str) -> DataFrame:
    """ST-10, JOIN-10: a lifecycle's candidate while it lasts, and the fallback in every frame."""
    return _lifecycles(spark, sf).select(*_FRAME)


@query(f"""WITH RECURSIVE {_ALIVE}, times AS (SELECT DISTINCT source_id % 4 AS room, i AS frame FROM track), fallback AS (SELECT room, frame, row_number() OVER (PARTITION BY room ORDER BY frame) AS n FROM times)
 SELECT source_id % 4 AS room, frame, candidate_id, observed, observed_frames FROM own UNION ALL SELECT room, frame, 'context:forward', true, n FROM fallback""")
def set01_merged_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """SET-01: many lifecycles of a room as one sequence, with one fallback a time."""
    frames = _lifecycles(spark, sf).withColumn("room", F.col("source_id") % 4)
    merged, _ = tracking.merge_sequences(frames, "source_id", "room")
    return merged.select(F.col("source_id").alias("room"), "frame", "candidate_id", "observed", "observed_frames")


def _members(spark, sf):
    s = r.sighting(spark, sf).where("kind != 'error'")
    return s.select("source", "frame", "id", "yaw", "pitch", F.col("h_fov").alias("extent"), F.when(F.col("id") % 4 != 0, F.greatest(-F.pi() / 2, F.col("pitch") - 0.1)).alias("pitch_min"), F.when(F.col("id") % 4 != 0, F.least(F.pi() / 2, F.col("pitch") + 0.2)).alias("pitch_max"))


@query()
def agg23_group_shots(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-23, TOP-06: a frame's members merged into the best views that hold them (tested against all merges)."""
    made = groups.group_shots(_members(spark, sf), ["source", "frame"])
    return rounded(made, "yaw", "pitch", "h_fov", "required", "pitch_min", "pitch_max")


@query()
def pln09_window_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-09, AGG-24, JOIN-11: one held group view for each window of two days, moved to the faces seen in it (tested against plain rules)."""
    s = r.sighting(spark, sf)
    windows = s.select("source", F.floor(F.col("frame") / 8).alias("window")).distinct().select("source", "window", (F.col("window") * 8).alias("start"), (F.col("window") * 8 + 8).alias("end"))
    empty = s.select("source", "frame").distinct().select("source", "frame", *[F.lit(None).cast(k).alias(c) for c, k in (("id", "long"), ("yaw", "double"), ("pitch", "double"), ("extent", "double"), ("pitch_min", "double"), ("pitch_max", "double"))])
    faces = s.where("kind = 'view'").select("source", "frame", "yaw", "pitch")
    made = groups.window_proposals(_members(spark, sf).unionByName(empty), faces, windows, "source", "frame")
    return rounded(made, "yaw", "pitch", "h_fov", "required")


_SHOTS = """shots AS (SELECT day, count(*) AS n, 1 + count(*) % 4 AS fewest_members, min(yaw) AS yaw, max(pitch) AS pitch, radians(95.0::DOUBLE) AS required FROM (SELECT frame // 24 AS day, yaw, pitch FROM candidate) GROUP BY day),
 decisions AS (SELECT day, CASE day % 3 WHEN 0 THEN 'group' ELSE 'uncertain' END AS scope, CASE day % 3 WHEN 0 THEN 'group:window:1' WHEN 1 THEN NULL ELSE 'person-slot:1' END AS selected FROM shots)"""


def _shots(spark, sf):
    c = r.candidate(spark, sf).withColumn("day", F.floor(F.col("frame") / 24))
    shots = c.groupBy("day").agg((1 + F.count(F.lit(1)) % 4).alias("fewest_members"), F.min("yaw").alias("yaw"), F.max("pitch").alias("pitch"), F.lit(math.radians(95)).alias("required"))
    selected = F.when(F.col("day") % 3 == 0, "group:window:1").when(F.col("day") % 3 == 2, "person-slot:1")
    return c, shots, shots.select("day", F.when(F.col("day") % 3 == 0, "group").otherwise("uncertain").alias("scope"), selected.alias("selected"))


@query(f"""WITH {r.CANDIDATE}, {_SHOTS} SELECT day, 'person-slot:' || unnest(range(1, fewest_members + 1)) AS candidate_id, 'person' AS candidate_type, 0::BIGINT AS n_members FROM shots WHERE fewest_members >= 2
 UNION ALL SELECT day, 'group:window:1', 'group', fewest_members FROM shots WHERE fewest_members >= 2 UNION ALL SELECT day, 'context:forward', 'context', 0 FROM shots WHERE fewest_members >= 2""")
def st11_window_slots(spark: SparkSession, sf: str) -> DataFrame:
    """ST-11: the candidates that a held view declares."""
    _, shots, _ = _shots(spark, sf)
    return groups.window_slots(shots, ["day"])


@query(f"""WITH {r.CANDIDATE}, {_SHOTS}, samples AS (SELECT day, frame, row_number() OVER (PARTITION BY day ORDER BY frame) AS n FROM (SELECT DISTINCT frame // 24 AS day, frame FROM candidate))
 SELECT day, frame, coalesce(d.selected, 'context:forward') AS candidate_id, round(CASE WHEN d.scope = 'group' THEN s.yaw ELSE 0 END, 6) AS yaw, round(CASE WHEN d.scope = 'group' THEN s.required ELSE radians(110) END, 6) AS h_fov, samples.n AS observed_frames
 FROM samples JOIN shots s USING (day) JOIN decisions d USING (day) WHERE d.scope = 'group' OR d.selected IS NULL""")
def st11_window_frames(spark: SparkSession, sf: str) -> DataFrame:
    """ST-11: every sample of a decided window with the group's view, or the fallback after an abstention."""
    c, shots, decisions = _shots(spark, sf)
    made = groups.window_frames(c.select("day", "frame").distinct(), shots, decisions, ["day"], "frame")
    return rounded(made.select("day", "frame", "candidate_id", "yaw", "h_fov", "observed_frames"), "yaw", "h_fov")


@query(f"""WITH {r.CANDIDATE}, g AS (SELECT frame, frame / 7 AS t, min(yaw) AS yaw, min(pitch) AS pitch, radians(100.0::DOUBLE) AS h_fov, CASE WHEN frame % 2 = 0 THEN min(pitch) - 0.25::DOUBLE END AS pitch_min, CASE WHEN frame % 2 = 0 THEN max(pitch) + 0.125::DOUBLE END AS pitch_max FROM candidate GROUP BY frame),
 f AS (SELECT frame / 7 + 1e-11 AS t, yaw, pitch FROM candidate WHERE kind = 'view'), m AS (SELECT g.*, (SELECT median(f.pitch) FROM f WHERE round_even(f.t * 1e9, 0)::BIGINT = round_even(g.t * 1e9, 0)::BIGINT AND abs({r.sql_wrap("f.yaw - g.yaw")}) <= g.h_fov / 2) AS target FROM g)
 SELECT frame, round(CASE WHEN target IS NULL THEN pitch ELSE greatest(-pi() / 2, least(pi() / 2, pitch + greatest(-radians(5.0::DOUBLE), least(radians(5.0::DOUBLE), target - pitch)))) END, 6) AS guarded, round(CASE WHEN pitch_min IS NOT NULL THEN (pitch_min + pitch_max) / 2 WHEN target IS NULL THEN pitch ELSE greatest(-pi() / 2, least(pi() / 2, pitch + greatest(-radians(5.0::DOUBLE), least(radians(5.0::DOUBLE), target - pitch)))) END, 6) AS middle FROM m""")
def join11_face_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-11, AGG-26: group views moved to the faces of the same moment (to nine places), or to their bounds' middle."""
    c = r.candidate(spark, sf)
    even = F.col("frame") % 2 == 0
    g = c.groupBy("frame").agg(F.min("yaw").alias("yaw"), F.min("pitch").alias("pitch"), F.max("pitch").alias("top")).withColumn("t", F.col("frame") / 7).withColumn("h_fov", F.lit(math.radians(100)))
    g = g.withColumn("pitch_min", F.when(even, F.col("pitch") - 0.25)).withColumn("pitch_max", F.when(even, F.col("top") + 0.125)).withColumn("room", F.lit(1))
    faces = c.where("kind = 'view'").select(F.lit(1).alias("room"), (F.col("frame") / 7 + 1e-11).alias("t"), "yaw", "pitch")
    one = groups.anchored(g, faces, ["room"], "t").select("frame", F.col("pitch").alias("guarded"))
    two = groups.anchored(g, faces, ["room"], "t", midpoint=True).select("frame", F.col("pitch").alias("middle"))
    return rounded(one.join(two, "frame"), "guarded", "middle")
