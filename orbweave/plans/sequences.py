"""More registered queries: association, shots, smoothing, summaries and selection over time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions import sphere
from orbweave.operators import folds, intervals, paths
from orbweave.plans import relations as r
from orbweave.plans.catalog import _MERGED, _SPAN, DAY, HOUR, _merged, query, r6, rounded

#: Declared weights by kind of signal (one kind isn't declared).
WEIGHTS = {"click": 0.5, "view": 0.25, "purchase": 2.0, "error": -1.0}


@query(f"""WITH {r.CANDIDATE}, hit AS (SELECT a.id, b.id AS other FROM candidate a JOIN candidate b ON b.frame = a.frame + 1 AND a.kind = b.kind AND {r.sql_distance("a", "b")} <= {math.radians(40)!r}::DOUBLE)
 SELECT c.id, CASE count(h.other) WHEN 0 THEN 'missing' WHEN 1 THEN 'compatible' ELSE 'ambiguous' END AS outcome, CASE WHEN count(h.other) = 1 THEN min(h.other) END AS matched,
 coalesce(string_agg(CAST(h.other AS VARCHAR), ',' ORDER BY h.other), '') AS compatible FROM candidate c LEFT JOIN hit h ON h.id = c.id GROUP BY c.id""")
def join05_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-05, ST-05: a candidate's sightings of its kind in the next frame within 40 degrees."""
    c = r.candidate(spark, sf).select("frame", "kind", "id", "yaw", "pitch")
    return paths.refresh_matches(c.withColumn("frame", F.col("frame") + 1), c, ["frame", "kind"], math.radians(40))


@query(f"""WITH {r.SIGNAL}, {_SPAN}, {_MERGED}, verdict AS (SELECT source_id, t - 10800 AS start, max(CASE kind WHEN 'purchase' THEN 'promote' ELSE 'reject' END) AS decision FROM signal WHERE kind IN ('purchase', 'error') GROUP BY ALL)
 SELECT m.source_id, round(m.start, 6) AS start, m.support, coalesce(v.decision, 'abstain') AS decision FROM merged m LEFT JOIN verdict v ON v.source_id = m.source_id AND v.start = m.start""")
def join09_default_decision(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-09: intervals with the decision on their first event; without one they abstain."""
    said = r.signal(spark, sf).where("kind in ('purchase', 'error')").select("source_id", (F.col("t") - 10800).alias("start"), F.when(F.col("kind") == "purchase", "promote").otherwise("reject").alias("decision"))
    said = said.groupBy("source_id", "start").agg(F.max("decision").alias("decision"))
    found = _merged(spark, sf).select("source_id", "start", "support").join(said, ["source_id", "start"], "left")
    return rounded(found.withColumn("decision", F.coalesce("decision", F.lit("abstain"))), "start")


@query(f"""WITH {r.CANDIDATE}, seen AS (SELECT frame, kind, max(h_fov) AS raw FROM candidate GROUP BY frame, kind), want AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {w}::DOUBLE)" for k, w in WEIGHTS.items())}) w(kind, weight)),
 pool AS (SELECT DISTINCT frame, w.kind, w.weight FROM candidate, want w)
 SELECT p.frame, p.kind, round(coalesce(p.weight * s.raw, 0), 6) AS component, CASE WHEN s.raw IS NULL THEN 'not_reported' END AS missing_reason FROM pool p LEFT JOIN seen s ON s.frame = p.frame AND s.kind = p.kind""")
def join16_components(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-16: every frame's declared signals with their weighted value, or why there is none."""
    by_kind = r.candidate(spark, sf).groupBy("frame").pivot("kind", list(WEIGHTS)).agg(F.max("h_fov"))
    said = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col(k) * w).alias("value")) for k, w in WEIGHTS.items()]))
    rows = by_kind.select("frame", said.alias("s"))
    return rows.select("frame", "s.kind", r6(F.coalesce("s.value", F.lit(0.0))).alias("component"), F.when(F.col("s.value").isNull(), "not_reported").alias("missing_reason"))


@query(f"""WITH {r.SIGNAL} SELECT DISTINCT source_id FROM signal WHERE source_id NOT IN (SELECT source_id FROM signal WHERE kind = 'purchase' AND score > 0.9)""")
def join20_undeclared(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-20: sources without any row on the other side."""
    s = r.signal(spark, sf)
    return s.select("source_id").distinct().join(s.where("kind = 'purchase' and score > 0.9").select("source_id"), "source_id", "left_anti")


@query(f"""WITH {r.CANDIDATE}, a AS (SELECT frame, yaw, atan2(sum(sin(yaw)) OVER (PARTITION BY frame), sum(cos(yaw)) OVER (PARTITION BY frame)) AS anchor FROM candidate),
 m AS (SELECT frame, median(anchor + {r.sql_wrap("yaw - anchor")}) AS flat FROM a GROUP BY frame) SELECT frame, round(cos({r.sql_wrap("flat")}), 6) AS centre_cos, round(sin({r.sql_wrap("flat")}), 6) AS centre_sin FROM m""")
def agg25_circular_median(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-25: a frame's middle direction across the seam, as cosine and sine."""
    found = paths.circular_median(r.candidate(spark, sf), ["frame"], "yaw")
    return found.select("frame", r6(F.cos("centre")).alias("centre_cos"), r6(F.sin("centre")).alias("centre_sin"))


@query(f"""WITH {r.SIGNAL}, s AS (SELECT source_id, score, score - lag(score) OVER w AS step, row_number() OVER w AS i, count(*) OVER (PARTITION BY source_id) AS n FROM signal WINDOW w AS (PARTITION BY source_id ORDER BY t, id)),
 e AS (SELECT *, greatest(1, ceil(n * 0.2::DOUBLE)) AS edge FROM s), p AS (SELECT source_id, 'all' AS part, score, CASE WHEN i > 1 THEN abs(step) END AS change FROM e UNION ALL SELECT source_id, 'first', score, CASE WHEN i > 1 THEN abs(step) END FROM e WHERE i <= edge
 UNION ALL SELECT source_id, 'last', score, CASE WHEN i > n - edge + 1 THEN abs(step) END FROM e WHERE i > n - edge)
 SELECT source_id, part, count(*) AS pair_count, round(quantile_cont(score, 0.5), 6) AS median_step, round(quantile_cont(score, 0.95), 6) AS p95_step, round(coalesce(quantile_cont(change, 0.5), 0), 6) AS median_change, round(coalesce(quantile_cont(change, 0.95), 0), 6) AS p95_change FROM p GROUP BY source_id, part""")
def agg30_edge_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-30: steps and their changes over a source's whole series and its first and last fifth."""
    s = r.signal(spark, sf).withColumn("step", F.col("score") - F.lag("score").over(Window.partitionBy("source_id").orderBy("t", "id")))
    parts = paths.edge_windows(s, "source_id", ["t", "id"], 0.2).withColumn("change", F.when(~F.col("opens"), F.abs("step")))
    p = lambda c, q: r6(F.coalesce(F.percentile(c, q), F.lit(0.0)))
    return parts.groupBy("source_id", "part").agg(F.count(F.lit(1)).alias("pair_count"), p("score", 0.5).alias("median_step"), p("score", 0.95).alias("p95_step"), p("change", 0.5).alias("median_change"), p("change", 0.95).alias("p95_change"))


_DECIDED = f"""{r.SIGNAL}, {r.CANDIDATE}, {r.POSE}, d AS (SELECT source_id, t, arg_min(kind, id) AS kind, arg_min(yaw, id) AS yaw, arg_min(pitch, id) AS pitch, arg_min(h_fov, id) AS h_fov, arg_min(score, id) AS score FROM pose GROUP BY source_id, t)"""


def _decided(spark, sf):
    return r.pose(spark, sf).groupBy("source_id", "t").agg(*[F.min_by(c, "id").alias(c) for c in ("kind", "yaw", "pitch", "h_fov", "score")])


@query(f"""WITH {_DECIDED}, s AS (SELECT *, t - min(t) OVER (PARTITION BY source_id) AS rel, CASE WHEN kind = lag(kind) OVER (PARTITION BY source_id ORDER BY t) THEN 0 ELSE 1 END AS changed FROM d), n AS (SELECT *, sum(changed) OVER (PARTITION BY source_id ORDER BY t) AS run FROM s),
 y AS (SELECT *, atan2(sum(sin(yaw)) OVER (PARTITION BY source_id, run), sum(cos(yaw)) OVER (PARTITION BY source_id, run)) AS anchor FROM n), g AS (SELECT source_id, run, min(kind) AS selected, min(rel) AS start, median(pitch) AS pitch, median(h_fov) AS h_fov, count(*) AS samples, median(anchor + {r.sql_wrap("yaw - anchor")}) AS yaw FROM y GROUP BY source_id, run)
 SELECT source_id, selected, start, coalesce(lead(start) OVER (PARTITION BY source_id ORDER BY run), 2678400.0) AS "end", samples, round(cos(yaw), 6) AS yaw_cos, round(sin(yaw), 6) AS yaw_sin, round(pitch, 6) AS pitch, round(h_fov, 6) AS h_fov FROM g""")
def win06_static_shots(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-06, AGG-25: runs of one selection as shots with one robust pose; each lasts until the next begins."""
    made = paths.static_shots(_decided(spark, sf), "source_id", "t", "kind", 31 * DAY)
    return rounded(made.select("source_id", "selected", "start", "end", "samples", F.cos("yaw").alias("yaw_cos"), F.sin("yaw").alias("yaw_sin"), "pitch", "h_fov"), "yaw_cos", "yaw_sin", "pitch", "h_fov")


@query(f"""WITH {_DECIDED}, d0 AS (SELECT source_id, floor(t) AS t, arg_min(kind, d.t) AS kind, arg_min(yaw, d.t) AS yaw, arg_min(pitch, d.t) AS pitch, arg_min(score, d.t) AS score FROM d GROUP BY source_id, floor(t)), s AS (SELECT *, t - min(t) OVER (PARTITION BY source_id) AS rel FROM d0), e AS (SELECT *, coalesce(lead(rel) OVER (PARTITION BY source_id ORDER BY t), 2678400.0) AS until, row_number() OVER (PARTITION BY source_id ORDER BY t) AS place FROM s)
 SELECT source_id, place::INTEGER AS place, printf('%.9f' || chr(9) || '%.9f' || chr(9) || '%.6f' || chr(9) || '%.6f' || chr(9) || '%.9f' || chr(9) || '%s', rel, until, round(degrees(yaw), 3), round(degrees(pitch), 3), score, kind || ' by rule') AS line FROM e""")
def snk06_trace_lines(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-06: decisions with the ends of their intervals as tab-separated text."""
    second = F.floor("t").cast("double")
    d = _decided(spark, sf).groupBy("source_id", second.alias("second")).agg(*[F.min_by(c, "t").alias(c) for c in ("kind", "yaw", "pitch", "score")]).withColumnRenamed("second", "t")
    d = d.select("source_id", "t", *[F.radians(F.round(F.degrees(c), 3)).alias(c) for c in ("yaw", "pitch")], F.col("score").alias("utility"), F.concat("kind", F.lit("\tby\nrule")).alias("reason"))
    return paths.trace_lines(d, "source_id", "t", 31 * DAY)


@query(f"""WITH {r.SIGNAL} SELECT a.id, round(sum(exp(-0.5 * ((b.t - a.t) / 43200) ** 2) * b.score) / sum(exp(-0.5 * ((b.t - a.t) / 43200) ** 2)), 6) AS smooth FROM signal a JOIN signal b ON a.source_id = b.source_id AND b.t BETWEEN a.t - 86400 AND a.t + 86400 GROUP BY a.id""")
def win13_gaussian(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-13: values smoothed over a day to each side."""
    return rounded(paths.gaussian_smoothing(r.signal(spark, sf), "source_id", "t", "score", "id", DAY), "smooth")


@query("""SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS best_index, round(CAST(list_max(embedding) AS DOUBLE), 6) AS best_value FROM embeddings""")
def top04_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """TOP-04: the best class of a row of scores, the lowest index on ties."""
    best = F.array_max("embedding")
    return r.table(spark, sf, "embeddings").select("vec_id", (F.array_position("embedding", best) - 1).alias("best_index"), r6(best.cast("double")).alias("best_value"))


@query(f"""WITH {r.CANDIDATE}, k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY h_fov DESC, id) AS i, row_number() OVER (PARTITION BY frame ORDER BY yaw DESC, id) AS j FROM candidate)
 SELECT frame, count(*) AS size, count(*) FILTER (i <= 3 AND j <= 3) AS shared, count(*) FILTER (i > 3 AND j > 3) AS rejected, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (i <= 3 AND j <= 3), '') AS shared_ids FROM k GROUP BY frame""")
def top05_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """TOP-05, SET-05, SET-06: what the three best by two measures have in common, and what neither takes."""
    w = Window.partitionBy("frame")
    k = r.candidate(spark, sf).select("frame", "id", F.row_number().over(w.orderBy(F.desc("h_fov"), "id")).alias("i"), F.row_number().over(w.orderBy(F.desc("yaw"), "id")).alias("j"))
    both, none = (F.col("i") <= 3) & (F.col("j") <= 3), (F.col("i") > 3) & (F.col("j") > 3)
    shared = F.array_join(F.sort_array(F.collect_list(F.when(both, F.col("id")))).cast("array<string>"), ",")
    return k.groupBy("frame").agg(F.count(F.lit(1)).alias("size"), F.count_if(both).alias("shared"), F.count_if(none).alias("rejected"), shared.alias("shared_ids"))


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's kinds by six-hour slot, with their best score as utility."""
    slot = F.floor(F.col("t") / (6 * HOUR)) * (6 * HOUR)
    return r.signal(spark, sf).groupBy("source_id", slot.cast("double").alias("t"), "kind").agg(F.max("score").alias("utility"))


_SLOTS = f"""{r.SIGNAL}, slots AS (SELECT source_id, (floor(t / 21600) * 21600)::DOUBLE AS t, kind, max(score) AS u FROM signal GROUP BY ALL), lists AS (SELECT source_id, t, list(kind ORDER BY u DESC, kind) AS kinds, list(u ORDER BY u DESC, kind) AS us, row_number() OVER (PARTITION BY source_id ORDER BY t) AS n FROM slots GROUP BY source_id, t)"""
_WHY = """CASE WHEN own IS NULL THEN 'initial_best' WHEN mine IS NULL THEN 'incumbent_missing_fallback' WHEN best = own THEN 'incumbent_best' WHEN t - since < 86400 THEN 'minimum_dwell' WHEN top < mine + 0.05::DOUBLE THEN 'switch_margin' WHEN t - led < 43200 THEN 'challenger_hysteresis' ELSE 'sustained_challenger' END"""


@query(f"""WITH RECURSIVE {_SLOTS}, f AS (SELECT source_id, n, t, kinds[1] AS own, t AS since, CAST(NULL AS VARCHAR) AS rival, CAST(NULL AS DOUBLE) AS rival_since, 'initial_best' AS reason, false AS switched FROM lists WHERE n = 1
 UNION ALL SELECT source_id, n, t, CASE WHEN why IN ('incumbent_missing_fallback', 'sustained_challenger') THEN best ELSE own END, CASE WHEN why IN ('incumbent_missing_fallback', 'sustained_challenger') THEN t ELSE since END, CASE WHEN why = 'challenger_hysteresis' THEN best END, CASE WHEN why = 'challenger_hysteresis' THEN led END, why, why IN ('incumbent_missing_fallback', 'sustained_challenger') FROM
 (SELECT *, {_WHY} AS why FROM (SELECT l.source_id, l.n, l.t, l.kinds[1] AS best, l.us[1] AS top, f.own, f.since, l.us[list_position(l.kinds, f.own)] AS mine, CASE WHEN f.rival = l.kinds[1] THEN f.rival_since ELSE l.t END AS led FROM f JOIN lists l ON l.source_id = f.source_id AND l.n = f.n + 1)))
 SELECT source_id, t, own AS selected, reason, switched FROM f""")
def st08_greedy_planner(spark: SparkSession, sf: str) -> DataFrame:
    """ST-08: one selection a slot, with dwell, margin and hold."""
    return folds.greedy_hysteresis(observations(spark, sf), "source_id", "t", "kind", "utility", DAY, 0.05, 12 * HOUR)


@query(f"""WITH {r.CANDIDATE}, s AS (SELECT frame, yaw, pitch, radians(90) AS h_fov FROM candidate QUALIFY row_number() OVER (PARTITION BY frame ORDER BY id) = 1),
 g AS (SELECT s.frame, s.pitch, median(a.pitch) AS target, count(a.pitch) AS anchors FROM s LEFT JOIN candidate a ON a.frame = s.frame AND a.kind = 'view' AND abs({r.sql_wrap("a.yaw - s.yaw")}) <= s.h_fov / 2 GROUP BY s.frame, s.pitch)
 SELECT frame, anchors, round(greatest(-pi() / 2, least(pi() / 2, pitch + greatest(-radians(25), least(radians(25), coalesce(target - pitch, 0))))), 6) AS pitch FROM g""")
def agg26_vertical_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-26: a frame's first view, moved up or down to the middle of what it shows."""
    c = r.candidate(spark, sf)
    first = c.groupBy("frame").agg(F.min_by(F.struct("yaw", "pitch"), "id").alias("v")).select("frame", "v.*", F.lit(math.radians(90)).alias("h_fov"))
    return paths.vertical_anchors(first, c.where("kind = 'view'").select("frame", "yaw", "pitch"), "frame", math.radians(25)).select("frame", "anchors", r6(F.col("pitch")).alias("pitch"))


@query(f"""WITH {r.CANDIDATE}, d AS (SELECT frame, 5 + id % 7 AS seconds, greatest(acos(greatest(-1, least(1, cos(pitch) * cos(yaw)))), abs(h_fov - radians(30))) AS change FROM candidate),
 g AS (SELECT frame, max(change) AS m, sum(CASE WHEN change >= 0.5 THEN seconds ELSE 0 END)::DOUBLE AS distinct_seconds, greatest(2, sum(seconds) * 0.1::DOUBLE) AS required FROM d GROUP BY frame)
 SELECT frame, round(m, 6) AS maximum_change, distinct_seconds, round(required, 6) AS required_seconds, distinct_seconds >= required AS passed FROM g""")
def agg29_shot_difference(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-29: seconds in which a frame's shots differ from the view ahead by half a radian or more."""
    shots = r.candidate(spark, sf).select("frame", "yaw", "pitch", "h_fov", F.lit(0.0).alias("start"), (5 + F.col("id") % 7).cast("double").alias("end"))
    return rounded(paths.shot_difference(shots, "frame", 0.5, math.radians(30)), "maximum_change", "required_seconds")


_SHARED = "greatest(0, least(k.x + k.w, n.x + n.w) - greatest(k.x, n.x)) * greatest(0, least(k.top + k.h, n.top + n.h) - greatest(k.top, n.top))"
_COVERED = f"len(list_filter(f.kept, lambda k: {_SHARED} > 0.5::DOUBLE * (k.w * k.h + n.w * n.h - {_SHARED}))) > 0"


@query(f"""WITH RECURSIVE {r.DETECTION}, n AS (SELECT *, row_number() OVER (PARTITION BY frame, class ORDER BY score DESC, line, part, supp) AS i FROM detection),
 f AS (SELECT frame, class, i, [struct_pack(x := x, top := top, w := w, h := h)] AS kept, true AS stays FROM n WHERE i = 1 UNION ALL SELECT n.frame, n.class, n.i, CASE WHEN {_COVERED} THEN f.kept ELSE list_append(f.kept, struct_pack(x := n.x, top := n.top, w := n.w, h := n.h)) END, NOT ({_COVERED}) FROM f JOIN n ON n.frame = f.frame AND n.class = f.class AND n.i = f.i + 1)
 SELECT n.frame, n.class, n.line, n.part, n.supp, round(n.score, 6) AS score FROM f JOIN n USING (frame, class, i) WHERE f.stays""")
def top03_box_nms(spark: SparkSession, sf: str) -> DataFrame:
    """TOP-03: a frame's boxes of one class without those that overlap a better one by half."""
    kept = folds.box_nms(r.detection(spark, sf), ["frame", "class"], ["x", "top", "w", "h"], "score", ["line", "part", "supp"], 0.5)
    return rounded(kept, "score")


@query(f"""WITH {r.SIGNAL}, {_SPAN}, {_MERGED}, shown AS (SELECT source_id, t AS v_start, t + 172800 AS v_end FROM signal WHERE kind = 'view'), bought AS (SELECT DISTINCT source_id, t - 10800 AS start FROM signal WHERE kind = 'purchase')
 SELECT m.source_id, round(greatest(m.start, v.v_start), 6) AS start, round(least(m."end", v.v_end), 6) AS "end" FROM merged m JOIN bought b ON b.source_id = m.source_id AND b.start = m.start
 JOIN shown v ON v.source_id = m.source_id AND m.start >= v.v_start AND m.start < v.v_end WHERE least(m."end", v.v_end) > greatest(m.start, v.v_start)""")
def join08_onset_gated(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-08: promoted intervals cut to the visible ranges that hold their onset."""
    s = r.signal(spark, sf)
    shown = s.where("kind = 'view'").select("source_id", F.col("t").alias("start"), (F.col("t") + 2 * DAY).alias("end"))
    promoted = _merged(spark, sf).join(s.where("kind = 'purchase'").select("source_id", (F.col("t") - 10800).alias("start")), ["source_id", "start"], "left_semi")
    found = intervals.overlaps(promoted.select("source_id", "start", "end"), shown, ["source_id"]).where("start >= start_right and start < end_right and clip_end > clip_start")
    return rounded(found.select("source_id", F.col("clip_start").alias("start"), F.col("clip_end").alias("end")), "start", "end")
