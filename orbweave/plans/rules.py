"""Registered queries: what each artifact must keep, as tables of violations, and gates between two sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.operators import paths, validation
from orbweave.plans import relations as r
from orbweave.plans.catalog import _MERGED, _SPAN, _merged, query, rounded


def sql_rules(base: str, table: str, key: str, rules: dict[str, str]) -> str:
    """One SELECT for each rule (the condition that must hold; null counts as broken)."""
    return f"WITH {base} " + " UNION ALL ".join(f"SELECT '{name}' AS rule_id, CAST({key} AS VARCHAR) AS key FROM {table} WHERE NOT coalesce({ok}, false)" for name, ok in rules.items())


@query("""SELECT rule_id, CAST(key AS VARCHAR) AS key FROM (SELECT 'discount_range' AS rule_id, l_orderkey AS key FROM lineitem WHERE NOT l_discount < 0.1 UNION ALL SELECT 'quantity_low', l_orderkey FROM lineitem WHERE NOT l_quantity > 1)""")
def fil09_violations(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-09: broken rules as a table."""
    return validation.violations(r.table(spark, sf, "lineitem"), "l_orderkey", {"discount_range": F.col("l_discount") < 0.1, "quantity_low": F.col("l_quantity") > 1})


_SOUND = f"""{r.SIGNAL}, w AS (SELECT id, source_id, t AS start, (id % 5 - 0.5) * 3600 AS duration, score * 1.2 AS confidence, id AS place FROM signal), span AS (SELECT source_id, min(t) + 3600 AS a, max(t) - 3600 AS b FROM signal GROUP BY source_id),
 rows AS (SELECT w.*, s.a, s.b, lag(w.start) OVER (PARTITION BY w.source_id ORDER BY w.place) AS before FROM w JOIN span s USING (source_id))"""


@query(sql_rules(_SOUND, "rows", "id", {"window_begins_early": "start >= a", "window_ends_late": "start + duration <= b + 1e-3", "window_out_of_order": "start >= coalesce(before, -1)", "duration_not_positive": "duration > 0", "confidence_range": "confidence BETWEEN 0 AND 1"}))
def fil09_sound_windows(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-09, SRC-05: sound windows in order, inside the requested window, with confidences in range."""
    s = r.signal(spark, sf)
    span = s.groupBy("source_id").agg((F.min("t") + 3600).alias("a"), (F.max("t") - 3600).alias("b"))
    rows = s.select("id", "source_id", F.col("t").alias("start"), ((F.col("id") % 5 - 0.5) * 3600).alias("duration"), (F.col("score") * 1.2).alias("confidence")).join(span, "source_id")
    return validation.violations(rows.withColumn("before", F.lag("start").over(Window.partitionBy("source_id").orderBy("id"))), "id", validation.sound_window_rules())


_REACTIONS = f"""{r.SIGNAL}, {_SPAN}, {_MERGED}, rows AS (SELECT source_id || ':' || rn AS key, start, CASE WHEN rn % 11 = 0 THEN start ELSE "end" + CASE WHEN rn % 7 = 0 THEN 2e6 ELSE 0 END END AS "end", support, peak * 1.4 AS peak, lag(CASE WHEN rn % 11 = 0 THEN start ELSE "end" + CASE WHEN rn % 7 = 0 THEN 2e6 ELSE 0 END END) OVER (PARTITION BY source_id ORDER BY rn) AS before FROM
 (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start) AS rn FROM merged))"""


@query(sql_rules(_REACTIONS, "rows", "key", {"out_of_order": "start >= coalesce(before, -1)", "empty_interval": '"end" > start', "support": "support >= 2", "peak_range": "peak BETWEEN 0 AND 1"}))
def fil09_reaction_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-09: reaction intervals ordered, disjoint, supported and with peaks in range."""
    n, w = F.col("rn"), Window.partitionBy("source_id").orderBy("rn")
    rows = _merged(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("source_id").orderBy("start")))
    rows = rows.withColumn("end", F.when(n % 11 == 0, F.col("start")).otherwise(F.col("end") + F.when(n % 7 == 0, 2e6).otherwise(0))).withColumn("peak", F.col("peak") * 1.4)
    rows = rows.withColumn("before", F.lag("end").over(w)).withColumn("key", F.concat_ws(":", F.col("source_id").cast("string"), n.cast("string")))
    return validation.violations(rows, "key", validation.interval_rules(2) | {"peak_range": F.col("peak").between(0, 1)})


_EVIDENCE = f"""{r.CANDIDATE}, rows AS (SELECT id, yaw * 1.01::DOUBLE AS yaw, pitch * 1.6::DOUBLE AS pitch, h_fov * 4 AS h_fov, CASE WHEN id % 3 = 0 THEN NULL ELSE pitch * 1.6::DOUBLE - 0.1::DOUBLE END AS pitch_min, CASE WHEN id % 7 = 0 THEN NULL ELSE pitch * 1.6::DOUBLE + 0.1::DOUBLE * (id % 4 - 1) END AS pitch_max, kind, count(*) OVER (PARTITION BY frame, id % 50) AS same FROM candidate)"""


@query(sql_rules(_EVIDENCE, "rows", "id", {"yaw_range": "yaw BETWEEN -pi() AND pi()", "pitch_range": "pitch BETWEEN -pi() / 2 AND pi() / 2", "fov_range": "h_fov > 0 AND h_fov < pi()", "bounds_in_pairs": "(pitch_min IS NULL) = (pitch_max IS NULL)", "bounds_hold_centre": "pitch_min IS NULL OR pitch_max IS NULL OR (-pi() / 2 <= pitch_min AND pitch_min <= pitch AND pitch <= pitch_max AND pitch_max <= pi() / 2)", "unique_id": "same = 1"}))
def fil10_candidate_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-10: candidates' geometry in range, bounds in pairs around the centre, ids unique in a sample."""
    i = F.col("id")
    rows = r.candidate(spark, sf).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("frame", i % 50))).withColumn("yaw", F.col("yaw") * 1.01).withColumn("pitch", F.col("pitch") * 1.6).withColumn("h_fov", F.col("h_fov") * 4)
    rows = rows.withColumn("pitch_min", F.when(i % 3 != 0, F.col("pitch") - 0.1)).withColumn("pitch_max", F.when(i % 7 != 0, F.col("pitch") + 0.1 * (i % 4 - 1)))
    return validation.violations(rows, "id", validation.candidate_rules())


_SIGNALS = f"""{r.SIGNAL}, rows AS (SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE score * 1.3 END AS normalized, CASE WHEN id % 7 = 0 THEN NULL ELSE score END AS raw, CASE WHEN id % 11 < 2 THEN 'not_reported' END AS missing_reason FROM signal)"""


@query(sql_rules(_SIGNALS, "rows", "id", {"normalized_range": "normalized IS NULL OR normalized BETWEEN 0 AND 1", "missing_with_raw": "normalized IS NOT NULL OR raw IS NULL", "missing_without_reason": "normalized IS NOT NULL OR missing_reason IS NOT NULL", "present_with_reason": "normalized IS NULL OR missing_reason IS NULL"}))
def fil10_signal_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-10: a signal is either in range or missing for a reason."""
    i = F.col("id")
    rows = r.signal(spark, sf).select("id", F.when(i % 5 != 0, F.col("score") * 1.3).alias("normalized"), F.when(i % 7 != 0, F.col("score")).alias("raw"), F.when(i % 11 < 2, "not_reported").alias("missing_reason"))
    return validation.violations(rows, "id", validation.signal_rules())


@query(sql_rules(f"{r.SIGNAL}, rows AS (SELECT id, kind, CASE WHEN id % 4 <> 0 THEN score * 1.3 END AS confidence FROM signal)", "rows", "id", {"observed_confidence": "kind <> 'purchase' OR (confidence IS NOT NULL AND confidence BETWEEN 0 AND 1)", "unobserved_confidence": "kind = 'purchase' OR confidence IS NULL"}))
def fil10_track_events(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-10: observed track events have a confidence in range, others none."""
    rows = r.signal(spark, sf).select("id", F.when(F.col("kind") == "purchase", "observed").otherwise("not_observed").alias("kind"), F.when(F.col("id") % 4 != 0, F.col("score") * 1.3).alias("confidence"))
    return validation.violations(rows, "id", validation.track_event_rules())


_INPUTS = f"""{r.CANDIDATE}, rows AS (SELECT frame, id, kind, pitch * 1.6::DOUBLE AS pitch, h_fov * 4 AS h_fov, CASE WHEN id % 9 = 0 THEN NULL ELSE id % 12 / 10 END AS normalized, count(*) OVER (PARTITION BY frame, kind) AS same FROM candidate)"""


@query(sql_rules(_INPUTS, "rows", "id", {"unique_candidate": "same = 1", "pitch_range": "pitch BETWEEN -pi() / 2 AND pi() / 2", "fov_range": "h_fov > 0 AND h_fov < pi()", "component_range": "normalized BETWEEN 0 AND 1"}))
def fil11_planner_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-11: a planner's candidates are unique in their observation, with geometry and components in range."""
    i = F.col("id")
    rows = r.candidate(spark, sf).withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("frame", "kind"))).withColumn("pitch", F.col("pitch") * 1.6).withColumn("h_fov", F.col("h_fov") * 4).withColumn("normalized", F.when(i % 9 != 0, i % 12 / 10))
    return validation.violations(rows, "id", validation.planner_rules())


@query(f"""WITH {r.SIGNAL}, s AS (SELECT source_id, max(t) - min(t) AS available, [86400.0, 864000.0, 1728000.0, 2160000.0, 2592000.0] AS ladder FROM signal GROUP BY source_id), e AS (SELECT source_id, list_filter(ladder, lambda d: d <= available) AS expected, list_filter(ladder, lambda d: d <= 1e6 * (source_id % 3 + 1)) AS declared FROM s)
 SELECT source_id, len(expected) AS n_expected, expected = declared AS matches FROM e""")
def fil13_duration_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-13: the durations that a source declares are those of the ladder that it is long enough for."""
    ladder = F.array(*[F.lit(d) for d in (86400.0, 864000.0, 1728000.0, 2160000.0, 2592000.0)])
    s = r.signal(spark, sf).groupBy("source_id").agg((F.max("t") - F.min("t")).alias("available"))
    declared = F.filter(ladder, lambda d: d <= 1e6 * (F.col("source_id") % 3 + 1))
    made = validation.duration_ladder(s.withColumn("declared", declared), "available", "declared", ladder)
    return made.select("source_id", F.size("expected").cast("long").alias("n_expected"), "matches")


_PREVIEW = f"""{r.CANDIDATE}, a AS (SELECT frame, kind AS selected, min(yaw) AS yaw, min(pitch) AS pitch, min(h_fov) AS h_fov, count(*) AS seconds FROM candidate GROUP BY frame, kind), p AS (SELECT DISTINCT frame FROM a WHERE selected = 'click'), c AS (SELECT x.frame, x.yaw, x.pitch, x.h_fov FROM a x WHERE selected = 'click'),
 d AS (SELECT a.frame, a.seconds, greatest(abs(degrees(a.yaw) - degrees(c.yaw) + 180 - 360 * floor((degrees(a.yaw) - degrees(c.yaw) + 180) / 360) - 180), abs(degrees(a.pitch) - degrees(c.pitch)), abs(degrees(a.h_fov) - degrees(c.h_fov))) AS change FROM a JOIN c USING (frame) WHERE a.selected <> 'click'),
 g AS (SELECT frame, count(*) AS n, sum(seconds) AS seconds, max(change) AS change FROM d GROUP BY frame)"""


@query(f"""WITH {_PREVIEW} SELECT p.frame, CASE WHEN g.n IS NULL THEN 'abstain' ELSE 'promote' END AS mode, coalesce(g.n, 0)::BIGINT AS promoted, coalesce(g.seconds, 0)::BIGINT AS distinct_seconds, round(coalesce(g.change, 0), 6) AS maximum_change, g.n IS NULL OR (g.change >= 8 AND g.seconds >= 2) AS passed FROM p LEFT JOIN g USING (frame)""")
def fil16_pose_gate(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-16: whether a plan's other views differ from the primary one enough and long enough; a plan without any abstains."""
    a = r.candidate(spark, sf).groupBy("frame", F.col("kind").alias("selected")).agg(*[F.min(c).alias(c) for c in ("yaw", "pitch", "h_fov")], F.count(F.lit(1)).alias("seconds"))
    made = paths.pose_gate(a.where("selected != 'click'"), a.where("selected = 'click'"), "frame", 8.0, 2.0)
    return rounded(made, "maximum_change")


@query(f"""WITH {r.SIGNAL}, a AS (SELECT source_id, floor(t / 86400)::BIGINT AS day, kind, count(*) AS n FROM signal WHERE id % 2 = 0 GROUP BY ALL), b AS (SELECT source_id, floor(t / 86400)::BIGINT AS day, kind, count(*) AS n FROM signal WHERE id % 2 = 1 GROUP BY ALL), s AS (SELECT DISTINCT source_id FROM signal),
 x AS (SELECT source_id, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY source_id), y AS (SELECT source_id, count(*) AS n FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY source_id)
 SELECT s.source_id, coalesce(x.n, 0) AS left_only, coalesce(y.n, 0) AS right_only, x.n IS NULL AND y.n IS NULL AS equal FROM s LEFT JOIN x USING (source_id) LEFT JOIN y USING (source_id)""")
def fil16_trace_equality(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-16, SET-04: whether two traces of a source are equal, row by row, and how they differ."""
    s = r.signal(spark, sf).withColumn("day", F.floor(F.col("t") / 86400))
    side = lambda k: s.where(F.col("id") % 2 == k).groupBy("source_id", "day", "kind").agg(F.count(F.lit(1)).alias("n"))
    found = validation.difference(side(0), side(1)).groupBy("source_id").agg(F.count_if(F.col("side") == "left").alias("left_only"), F.count_if(F.col("side") == "right").alias("right_only"))
    all_sources = s.select("source_id").distinct().join(found, "source_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return all_sources.select("source_id", zero("left_only").alias("left_only"), zero("right_only").alias("right_only"), (zero("left_only") + zero("right_only") == 0).alias("equal"))


def _tensors(spark, sf):
    v = r.table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    other = F.transform("values", lambda x, i: x + F.when((F.col("vec_id") + i) % 9 == 0, 0.004).otherwise(0.0))
    return v.select("vec_id", "values", F.when(F.col("vec_id") % 5 == 0, F.transform(other, lambda x: -x)).otherwise(other).alias("candidate"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), w AS (SELECT vec_id, a, list_transform(a, lambda x, i: x + CASE WHEN (vec_id + i - 1) % 9 = 0 THEN 0.004::DOUBLE ELSE 0 END) AS b FROM v), u AS (SELECT vec_id, a, CASE WHEN vec_id % 5 = 0 THEN list_transform(b, lambda x: -x) ELSE b END AS b FROM w),
 e AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y, generate_subscripts(a, 1) AS i FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) <= 20 AND row_number() OVER (PARTITION BY vec_id ORDER BY y DESC, i) <= 20 AS both_top FROM e)
 SELECT vec_id, round(max(abs(x - y)), 6) AS maximum_error, round(avg(abs(x - y)), 6) AS mean_error, count(*) FILTER (both_top) AS agreement, max(abs(x - y)) <= 0.02 AND avg(abs(x - y)) <= 0.005 AND count(*) FILTER (both_top) >= 19 AS passed FROM k GROUP BY vec_id""")
def fil17_numeric_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-17, SET-06, TOP-05: whether two raw outputs agree in values and in their top twenty."""
    return rounded(validation.numeric_equivalence(_tensors(spark, sf), "vec_id", "values", "candidate"), "maximum_error", "mean_error")


@query(f"""WITH {r.DETECTION}, n AS (SELECT frame, class, x, top, w, h, score, row_number() OVER (PARTITION BY frame ORDER BY line, part, supp) AS i, count(*) OVER (PARTITION BY frame) AS n FROM detection), o AS (SELECT frame, i, n, CASE WHEN i % 13 = 0 THEN 'Z' ELSE class END AS class, x + 0.002::DOUBLE * (frame % 4) AS x, top, w, h, score - 0.02::DOUBLE * (frame % 3) AS score FROM n),
 j AS (SELECT a.frame, a.i, a.class = b.class AS same_class, abs(a.score - b.score) AS score_error, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * a.h AS shared, a.w * a.h + b.w * b.h AS total FROM n a JOIN o b ON a.frame = b.frame AND a.i = b.i), k AS (SELECT *, shared / (total - shared) AS iou FROM j)
 SELECT frame, count(*) AS n_rows, round(min(iou), 6) AS least_iou, round(max(score_error), 6) AS largest_score_error, bool_and(same_class AND score_error <= 0.03 AND iou >= 0.95) AS passed FROM k GROUP BY frame""")
def fil17_decoded_equivalence(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-17, GEO-28: whether two decoders' boxes agree one by one in class, score and overlap."""
    w = Window.partitionBy("frame").orderBy("line", "part", "supp")
    a = r.detection(spark, sf).select("frame", F.row_number().over(w).alias("i"), "class", "x", "top", "w", "h", "score")
    b = a.select("frame", "i", F.when(F.col("i") % 13 == 0, "Z").otherwise(F.col("class")).alias("class"), (F.col("x") + 0.002 * (F.col("frame") % 4)).alias("x"), "top", "w", "h", (F.col("score") - 0.02 * (F.col("frame") % 3)).alias("score"))
    return rounded(validation.decoded_equivalence(a, b, "frame", "i"), "least_iou", "largest_score_error")


@query("""WITH m AS (SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '.' ELSE text END) AS declared FROM documents WHERE doc_id % 7 <> 0) SELECT d.doc_id, CASE WHEN m.declared IS NULL THEN 'undeclared' WHEN m.declared <> sha256(d.text) THEN 'checksum' END AS rule_id FROM documents d LEFT JOIN m USING (doc_id) WHERE m.declared IS NULL OR m.declared <> sha256(d.text)""")
def fil18_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-18: contents whose checksum isn't the declared one, or that aren't declared."""
    d = r.table(spark, sf, "documents").select("doc_id", "text")
    manifest = d.where("doc_id % 7 != 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("declared"))
    return validation.checksum_mismatches(d, manifest, "doc_id", "text")




_KEYED = f"""{r.SIGNAL}, keyed AS (SELECT s.id, s.source_id, s.t, CASE WHEN s.id % 17 = 3 THEN -1.0::DOUBLE WHEN s.id % 19 = 4 THEN 'nan'::DOUBLE ELSE s.t - s.t % 20000 END AS time, CASE WHEN s.id % 23 = 5 THEN 'inf'::DOUBLE ELSE s.score END AS yaw, s.score * 3.2::DOUBLE - 1.6::DOUBLE AS pitch, s.score * 3.5::DOUBLE - 0.1::DOUBLE AS h_fov FROM signal s),
 led AS (SELECT *, lag(time) OVER (PARTITION BY source_id ORDER BY t, id) AS before FROM keyed)"""


def _keyed(spark, sf):
    i, t = F.col("id"), F.col("t")
    rows = r.signal(spark, sf).withColumn("time", F.when(i % 17 == 3, -1.0).when(i % 19 == 4, float("nan")).otherwise(t - t % 20000)).withColumn("yaw", F.when(i % 23 == 5, float("inf")).otherwise(F.col("score")))
    rows = rows.withColumn("pitch", F.col("score") * 3.2 - 1.6).withColumn("h_fov", F.col("score") * 3.5 - 0.1)
    return rows.withColumn("before", F.lag("time").over(Window.partitionBy("source_id").orderBy("t", "id")))


@query(f"""WITH {_KEYED} SELECT 'finite' AS rule_id, id::VARCHAR AS key FROM led WHERE isnan(time) OR isinf(yaw) UNION ALL SELECT 'time_order', id::VARCHAR FROM led WHERE NOT (time >= 0 AND (before IS NULL OR time > before))
 UNION ALL SELECT 'pitch_range', id::VARCHAR FROM led WHERE NOT pitch BETWEEN -pi() / 2 AND pi() / 2 UNION ALL SELECT 'fov_range', id::VARCHAR FROM led WHERE NOT (h_fov > 0 AND h_fov < pi())""")
def fil12_keyframe_rules(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-12: keyframes are finite and in order of time, with pitch and field of view in range."""
    return validation.violations(_keyed(spark, sf), "id", validation.keyframe_rules())


@query(f"""WITH {_KEYED}, named AS (SELECT *, CASE WHEN id % 13 = 0 THEN '' WHEN id % 29 = 1 THEN NULL ELSE 'track' END AS track_id FROM led) SELECT 'finite_timestamp' AS rule_id, id::VARCHAR AS key FROM named WHERE isnan(time) UNION ALL SELECT 'timestamp_order', id::VARCHAR FROM named WHERE NOT (before IS NULL OR time > before)
 UNION ALL SELECT 'track_id', id::VARCHAR FROM named WHERE track_id IS NULL OR track_id = ''""")
def st05_trace_rules(spark: SparkSession, sf: str) -> DataFrame:
    """ST-05: refreshes of a trace come in order, each of a named track."""
    i = F.col("id")
    rows = _keyed(spark, sf).withColumn("timestamp", F.col("time")).withColumn("track_id", F.when(i % 13 == 0, "").when(i % 29 != 1, "track"))
    return validation.violations(rows, "id", validation.refresh_rules())
