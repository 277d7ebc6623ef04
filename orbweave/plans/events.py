"""Registered queries: views, roles, availability, timelines, semantics, utilities and review samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.functions import sphere
from orbweave.operators import events, validation
from orbweave.plans import relations as r
from orbweave.plans.catalog import _MERGED, _SPAN, DAY, _merged, query, rounded

_YAWS = ", ".join(f"({i}, {y}::DOUBLE)" for i, y in enumerate(events.CARDINAL_YAWS))
_WINDOWS = 'windows AS (SELECT source_id, min(t) + 86400 AS "start", max(t) - 86400 AS "end" FROM signal GROUP BY source_id)'
_VIEWS = f"""views AS (SELECT source_id, 'context:cardinal:' || place AS candidate_id, place, yaw, 0.0::DOUBLE AS pitch, 110.0::DOUBLE AS h_fov FROM windows, (VALUES {_YAWS}) v(place, yaw))"""
_CHOICES = """choices AS (SELECT source_id, 'context:cardinal:' || (source_id % 4) AS primary_id, 'context:cardinal:' || ((source_id + CASE WHEN source_id % 7 = 0 THEN 0 ELSE 1 END) % 5) AS reaction_id FROM windows)"""
_ROLES = """roles AS (SELECT * FROM (SELECT v.source_id, v.candidate_id, v.place, CASE v.candidate_id WHEN c.primary_id THEN 'primary_performance' WHEN c.reaction_id THEN 'audience_reaction' ELSE 'neutral_context' END AS role FROM views v JOIN choices c USING (source_id) WHERE c.primary_id <> c.reaction_id) QUALIFY count(*) FILTER (role <> 'neutral_context') OVER (PARTITION BY source_id) = 2),
 both_views AS (SELECT source_id, min(candidate_id) FILTER (role = 'primary_performance') AS current_id, min(candidate_id) FILTER (role = 'audience_reaction') AS proposed_id FROM roles GROUP BY source_id)"""
_GRID = f"{r.SIGNAL}, {_WINDOWS}, {_VIEWS}, {_CHOICES}, {_ROLES}"


def _windows(spark, sf):
    return r.signal(spark, sf).groupBy("source_id").agg((F.min("t") + DAY).alias("start"), (F.max("t") - DAY).alias("end"))


def _views(spark, sf):
    return events.cardinal_views(_windows(spark, sf), "source_id")


def _roles(spark, sf):
    s = F.col("source_id")
    name = lambda n: F.concat(F.lit("context:cardinal:"), n.cast("string"))
    choices = _windows(spark, sf).select("source_id", name(s % 4).alias("primary_id"), name((s + F.when(s % 7 == 0, 0).otherwise(1)) % 5).alias("reaction_id"))
    return events.editorial_roles(_views(spark, sf), choices, "source_id")


@query(f"WITH {r.SIGNAL}, {_WINDOWS}, {_VIEWS} SELECT * FROM views")
def pln07_context_grid(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-07: the four cardinal views of every source's window."""
    return _views(spark, sf)


@query(f"""WITH {r.CANDIDATE}, v AS (SELECT frame, kind AS candidate_id, degrees(yaw) * 1.02::DOUBLE AS yaw, degrees(pitch) * 1.6::DOUBLE AS pitch, degrees(h_fov) * 4 AS h_fov FROM candidate), n AS (SELECT frame, count(*) AS n, count(DISTINCT candidate_id) AS ids FROM v GROUP BY frame)
 SELECT DISTINCT 'yaw_range' AS rule_id, frame FROM v WHERE NOT (yaw >= -180 AND yaw < 180) UNION SELECT 'pitch_range', frame FROM v WHERE pitch NOT BETWEEN -90 AND 90 UNION SELECT 'fov_range', frame FROM v WHERE NOT (h_fov > 0 AND h_fov < 180) UNION SELECT 'view_count', frame FROM n WHERE n NOT BETWEEN 2 AND 8 UNION SELECT 'unique_ids', frame FROM n WHERE ids < n""")
def pln07_declared_grid_rules(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-07, FIL-09: declared grids that break a rule."""
    v = r.candidate(spark, sf).select("frame", F.col("kind").alias("candidate_id"), (F.degrees("yaw") * 1.02).alias("yaw"), (F.degrees("pitch") * 1.6).alias("pitch"), (F.degrees("h_fov") * 4).alias("h_fov"))
    return events.declared_view_violations(v, "frame")


@query(f"WITH {_GRID} SELECT * FROM roles")
def pln07_editorial_roles(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-07, JOIN-15: each view's role, where two different declared views are chosen."""
    return _roles(spark, sf)


_SEEN = """asked AS (SELECT source_id, 'context:cardinal:' || (id % 6) AS candidate_id, t AS "start", t + 43200 * (id % 5) AS "end" FROM signal WHERE kind = 'view'),
 checked AS (SELECT a.*, v.place IS NULL AS unknown, a."end" <= a."start" AS empty, a."start" < coalesce(lag(a."end") OVER (PARTITION BY a.source_id, a.candidate_id ORDER BY a."start", a."end"), w."start") AS unordered, a."end" > w."end" AS beyond FROM asked a JOIN windows w USING (source_id) LEFT JOIN views v ON v.source_id = a.source_id AND v.candidate_id = a.candidate_id),
 broken AS (SELECT DISTINCT source_id, candidate_id FROM checked WHERE unknown OR empty OR unordered OR beyond), available AS (SELECT a.* FROM asked a ANTI JOIN broken b USING (source_id, candidate_id))"""


def _available(spark, sf):
    spans = r.signal(spark, sf).where("kind = 'view'").select("source_id", F.concat(F.lit("context:cardinal:"), (F.col("id") % 6).cast("string")).alias("candidate_id"), F.col("t").alias("start"), (F.col("t") + 43200 * (F.col("id") % 5)).alias("end"))
    return events.availability(spans, _views(spark, sf), _windows(spark, sf), "source_id")


@query(f"""WITH {_GRID}, {_SEEN} SELECT source_id, candidate_id, round("start", 6) AS "start", round("end", 6) AS "end" FROM available""")
def pln07_availability(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-07: intervals of candidates whose every interval is in order."""
    return rounded(_available(spark, sf)[0], "start", "end")


@query(f"""WITH {_GRID}, {_SEEN} SELECT DISTINCT 'undeclared_candidate' AS rule_id, source_id, candidate_id FROM checked WHERE unknown UNION SELECT 'empty_interval', source_id, candidate_id FROM checked WHERE empty UNION SELECT 'out_of_order', source_id, candidate_id FROM checked WHERE unordered UNION SELECT 'beyond_window', source_id, candidate_id FROM checked WHERE beyond""")
def pln07_availability_rules(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-07, FIL-09: candidates' intervals that break a rule."""
    return _available(spark, sf)[1]


_SHOWN = """shown AS (SELECT source_id, proposed_id AS candidate_id, "start" + 172800 * k AS "start", "start" + 172800 * k + 86400 AS "end" FROM windows JOIN both_views USING (source_id), range(40) g(k))"""
_TIMELINE = f"""{_GRID}, {_SPAN}, {_MERGED}, {_SHOWN}, cut AS (SELECT m.source_id, m.start AS source_start, m."end" AS source_end, m.support, greatest(m.start, w."start") AS "start", least(m."end", w."end") AS "end" FROM merged m JOIN windows w USING (source_id) WHERE least(m."end", w."end") > greatest(m.start, w."start")),
 eventful AS (SELECT *, 'event:reaction:' || lpad((row_number() OVER (PARTITION BY source_id ORDER BY "start", "end") - 1)::VARCHAR, 4, '0') AS event_id FROM cut), bound AS (SELECT n.*, b.current_id, b.proposed_id FROM eventful n JOIN both_views b USING (source_id)),
 timeline AS (SELECT b.*, coalesce((SELECT bool_or(s."start" <= b.source_start AND b.source_start < s."end") FROM shown s WHERE s.source_id = b.source_id AND s.candidate_id = b.proposed_id), false) AS onset_available FROM bound b),
 parts AS (SELECT b.source_id, b.event_id, greatest(b."start", s."start") AS s, least(b."end", s."end") AS e FROM bound b JOIN shown s ON s.source_id = b.source_id AND s.candidate_id = b.proposed_id AND least(b."end", s."end") > greatest(b."start", s."start"))"""


def _shown(spark, sf):
    pairs = events.role_pairs(_roles(spark, sf), "source_id")
    k = F.explode(F.sequence(F.lit(0), F.lit(39)))
    rows = _windows(spark, sf).join(pairs, "source_id").select("source_id", F.col("proposed_id").alias("candidate_id"), "start", k.alias("k"))
    return rows.select("source_id", "candidate_id", (F.col("start") + 2 * DAY * F.col("k")).alias("start"), (F.col("start") + 2 * DAY * F.col("k") + DAY).alias("end"))


def _timeline(spark, sf):
    return events.event_timeline(_merged(spark, sf).select("source_id", "start", "end", "support"), _roles(spark, sf), _shown(spark, sf), _windows(spark, sf), "source_id")


@query(f"""WITH {_TIMELINE}, p AS (SELECT source_id, event_id, count(*) AS n, sum(e - s) AS seconds FROM parts GROUP BY source_id, event_id) SELECT t.source_id, t.event_id, round(t."start", 6) AS "start", round(t."end", 6) AS "end", round(source_start, 6) AS source_start, support, current_id, proposed_id, onset_available,
 coalesce(p.n, 0)::BIGINT AS n_available, round(coalesce(p.seconds, 0), 5) AS available_seconds FROM timeline t LEFT JOIN p USING (source_id, event_id)""")
def pln05_event_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-05, JOIN-06, JOIN-07: reactions as events of a source's window, with when the proposed view can be seen."""
    total = F.aggregate("available", F.lit(0.0), lambda acc, a: acc + (a["end"] - a["start"]))
    made = _timeline(spark, sf).withColumn("n_available", F.size("available").cast("long")).withColumn("available_seconds", F.round(total, 5))
    return rounded(made.select("source_id", "event_id", "start", "end", "source_start", "support", "current_id", "proposed_id", "onset_available", "n_available", "available_seconds"), "start", "end", "source_start")


_SAID = """said AS (SELECT source_id, start, "end" + CASE WHEN rn % 9 = 0 THEN 1 ELSE 0 END AS "end", CASE rn % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'abstain' ELSE 'promote' END AS decision, rn FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY start) AS rn FROM merged)),
 twice AS (SELECT source_id, start, "end", decision FROM said UNION ALL SELECT source_id, start, "end", decision FROM said WHERE rn % 4 = 0), judged AS (SELECT t.*, m.source_id IS NULL AS unknown, count(*) OVER (PARTITION BY t.source_id, t.start, t."end") > 1 AS repeated FROM twice t LEFT JOIN merged m ON m.source_id = t.source_id AND m.start = t.start AND m."end" = t."end")"""


def _gain(spark, sf):
    m = _merged(spark, sf).select("source_id", "start", "end")
    n = F.col("rn")
    said = m.withColumn("rn", F.row_number().over(Window.partitionBy("source_id").orderBy("start")))
    said = said.select("source_id", "start", (F.col("end") + F.when(n % 9 == 0, 1).otherwise(0)).alias("end"), F.when(n % 5 == 0, "reject").when(n % 5 == 1, "abstain").otherwise("promote").alias("decision"), "rn")
    return events.view_gain(said.unionAll(said.where("rn % 4 = 0")).drop("rn"), m, _roles(spark, sf), "source_id")


@query(f"""WITH {_GRID}, {_SPAN}, {_MERGED}, {_SAID} SELECT source_id, round(start, 6) AS "start", round("end", 6) AS "end", current_id, proposed_id, decision FROM judged JOIN both_views USING (source_id) WHERE NOT unknown AND NOT repeated AND decision <> 'reject'""")
def pln06_view_gain(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-06: decisions that name one declared reaction, with the views they compare."""
    return rounded(_gain(spark, sf)[0], "start", "end")


@query(f"""WITH {_GRID}, {_SPAN}, {_MERGED}, {_SAID} SELECT DISTINCT 'undeclared_event' AS rule_id, source_id, round(start, 6) AS "start" FROM judged WHERE unknown UNION SELECT 'repeated_event', source_id, round(start, 6) FROM judged WHERE repeated UNION SELECT 'unknown_decision', source_id, round(start, 6) FROM judged WHERE decision = 'reject'""")
def pln06_view_gain_rules(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-06, FIL-09: decisions that break a rule."""
    return rounded(_gain(spark, sf)[1].select("rule_id", "source_id", "start"), "start").distinct()


_SAMPLE = """moments AS (SELECT t.source_id, t.event_id, t.current_id, t.proposed_id, m.place, m.role, CASE m.place WHEN 0 THEN CASE WHEN t."start" > w."start" THEN greatest(w."start", t."start" - 2) END WHEN 4 THEN CASE WHEN t."end" < w."end" THEN least(w."end", t."end" + 2) END ELSE t."start" + (t."end" - t."start") * m.place / 4 END AS t
 FROM timeline t JOIN windows w USING (source_id), (VALUES (0, 'before'), (1, 'event_early'), (2, 'event_mid'), (3, 'event_late'), (4, 'after')) m(place, role)),
 sampled AS (SELECT *, t IS NOT NULL AND EXISTS (SELECT 1 FROM parts p WHERE p.source_id = moments.source_id AND p.event_id = moments.event_id AND p.s <= moments.t AND moments.t < p.e) AS sees FROM moments)"""


def _samples(spark, sf):
    return events.review_samples(_timeline(spark, sf), _windows(spark, sf), "source_id")


@query(f"""WITH {_TIMELINE}, {_SAMPLE} SELECT source_id, event_id, place, role, t, CASE WHEN t IS NULL THEN '' WHEN sees THEN current_id || ',' || proposed_id ELSE current_id END AS candidates FROM sampled""")
def win22_review_samples(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-22: five moments around each event and the views to look at."""
    return _samples(spark, sf).select("source_id", "event_id", "place", "role", "t", F.array_join("candidates", ",").alias("candidates"))


@query(f"""WITH {_TIMELINE}, {_SAMPLE}, asked AS (SELECT source_id, event_id, place, role, t, current_id AS candidate_id FROM sampled WHERE t IS NOT NULL UNION ALL SELECT source_id, event_id, place, role, t, proposed_id FROM sampled WHERE sees)
 SELECT a.source_id, a.event_id, a.place, a.candidate_id, v.yaw, 'sample-0' || a.place || '-' || replace(a.candidate_id, ':', '-') || '.png' AS filename, count(*) OVER (PARTITION BY a.source_id, a.event_id) BETWEEN 1 AND 10 AS within_bound FROM asked a JOIN views v USING (source_id, candidate_id)""")
def pln08_render_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-08: one job for each review sample and view."""
    jobs = events.render_jobs(_samples(spark, sf), _views(spark, sf), "source_id")
    return jobs.select("source_id", "event_id", "place", "candidate_id", "yaw", "filename", "within_bound")


@query(f"""WITH {_TIMELINE}, e AS (SELECT *, support % 2 = 0 AS neutral FROM timeline), m AS (SELECT e.source_id, e.event_id, e.neutral, e.current_id, e.proposed_id, k AS place, CASE WHEN neutral THEN CASE k WHEN 0 THEN 'before_boundary' ELSE 'after_boundary' END ELSE ['before', 'early', 'mid', 'late', 'after'][k + 1] END AS role,
 "start" + ("end" - "start") * CASE WHEN neutral THEN k ELSE k / 4 END AS t FROM e, range(5) g(k) WHERE NOT neutral OR k < 2), c AS (SELECT *, CASE WHEN neutral THEN 4 WHEN EXISTS (SELECT 1 FROM parts p WHERE p.source_id = m.source_id AND p.event_id = m.event_id AND p.s <= m.t AND m.t < p.e) THEN 2 ELSE 1 END AS n FROM m)
 SELECT source_id, event_id, place::INTEGER AS place, role, t, n AS n_candidates, sum(n) OVER (PARTITION BY source_id, event_id) <= 10 AS within_bound FROM c""")
def win23_scoped_samples(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-23: two moments and all views for neutral events, five moments and two views for role-scoped ones."""
    e = _timeline(spark, sf).withColumn("mode", F.when(F.col("support") % 2 == 0, "all_declared_candidates").otherwise("current_and_available_proposed"))
    made = events.scoped_samples(e, _views(spark, sf), "source_id")
    return made.select("source_id", "event_id", "place", "role", "t", F.size("candidates").alias("n_candidates"), "within_bound")


_LABELLED = """answers AS (SELECT source_id, event_id, current_id, proposed_id, CASE k % 6 WHEN 0 THEN 'abstain' WHEN 5 THEN 'maybe' ELSE 'observed' END AS status, CASE WHEN k % 6 = 0 AND k % 4 <> 0 THEN 'unknown' ELSE 'audience_reaction' END AS event_class, CASE WHEN k % 6 = 0 THEN 'unknown' WHEN k % 7 = 0 THEN 'odd' ELSE 'complements_current' END AS relationship, k FROM
 (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY event_id) AS k FROM timeline)),
 named AS (SELECT source_id, event_id, candidate_id, row_number() OVER (PARTITION BY source_id, event_id ORDER BY min(o)) - 1 AS place FROM (SELECT source_id, event_id, current_id AS candidate_id, place * 2 AS o FROM sampled WHERE t IS NOT NULL UNION ALL SELECT source_id, event_id, proposed_id, place * 2 + 1 FROM sampled WHERE sees) GROUP BY source_id, event_id, candidate_id),
 claims AS (SELECT n.source_id, n.event_id, n.place, n.candidate_id, CASE WHEN a.k % 5 = 0 THEN 'blurred' ELSE 'clear' END AS visibility, CASE n.place WHEN 0 THEN 'primary' ELSE 'supporting' END AS relevance, 'stable' AS temporal FROM named n JOIN answers a USING (source_id, event_id) WHERE (a.k % 6 <> 0 OR a.k % 4 = 0) AND NOT (a.k % 8 = 3 AND n.place = 1))"""


def _semantics(spark, sf):
    """Answers on every event's samples: some abstain, some claim too much, too little or in unknown words."""
    t = _timeline(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("source_id").orderBy("event_id")))
    k = F.col("k")
    answers = t.select(
        "source_id", "event_id", "current_id", "proposed_id", F.when(k % 6 == 0, "abstain").when(k % 6 == 5, "maybe").otherwise("observed").alias("status"), F.when((k % 6 == 0) & (k % 4 != 0), "unknown").otherwise("audience_reaction").alias("event_class"),
        F.when(k % 6 == 0, "unknown").when(k % 7 == 0, "odd").otherwise("complements_current").alias("relationship"), "k",
    )
    samples = _samples(spark, sf)
    ids = ["source_id", "event_id"]
    named = samples.select(*ids, "place", F.posexplode("candidates").alias("i", "candidate_id")).groupBy(*ids, "candidate_id").agg(F.min(F.struct("place", "i")).alias("first"))
    named = named.select(*ids, "candidate_id", (F.row_number().over(Window.partitionBy(*ids).orderBy("first")) - 1).alias("place")).join(answers.select(*ids, "k"), ids)
    claims = named.where(((k % 6 != 0) | (k % 4 == 0)) & ~((k % 8 == 3) & (F.col("place") == 1)))
    claims = claims.select(*ids, "place", "candidate_id", F.when(k % 5 == 0, "blurred").otherwise("clear").alias("visibility"), F.when(F.col("place") == 0, "primary").otherwise("supporting").alias("relevance"), F.lit("stable").alias("temporal"))
    return answers, claims, samples


@query(f"""WITH {_TIMELINE}, {_SAMPLE}, {_LABELLED}, n AS (SELECT source_id, event_id, count(*) AS wanted FROM named GROUP BY source_id, event_id), s AS (SELECT source_id, event_id, count(*) AS said, bool_and(visibility = 'clear') AS sound FROM claims GROUP BY source_id, event_id),
 a AS (SELECT answers.*, n.wanted, s.said, s.sound FROM answers JOIN n USING (source_id, event_id) LEFT JOIN s USING (source_id, event_id))
 SELECT source_id, event_id, 'unknown_status' AS rule_id FROM a WHERE status = 'maybe' UNION ALL SELECT source_id, event_id, 'abstention_with_claims' FROM a WHERE status = 'abstain' AND (said > 0 OR event_class <> 'unknown') UNION ALL SELECT source_id, event_id, 'unknown_relationship' FROM a WHERE status = 'observed' AND relationship = 'odd'
 UNION ALL SELECT source_id, event_id, 'candidates_not_covered_in_order' FROM a WHERE status = 'observed' AND said IS DISTINCT FROM wanted UNION ALL SELECT source_id, event_id, 'unknown_label' FROM a WHERE status = 'observed' AND NOT sound""")
def pln04_semantic_rules(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-04: semantic answers that don't fit their packet."""
    answers, claims, samples = _semantics(spark, sf)
    return events.bind_semantics(answers.drop("current_id", "proposed_id", "k"), claims, samples, "source_id")


#: An invented weight policy, one row for each label.
UTILITY_WEIGHTS = (
    ("relevance", "primary", 0.5), ("relevance", "supporting", 0.25), ("relevance", "unrelated", -0.25), ("relevance", "unknown", 0.0), ("visibility", "clear", 0.25), ("visibility", "partial", 0.125), ("visibility", "obstructed", -0.25), ("visibility", "unknown", 0.0),
    ("temporal", "stable", 0.125), ("temporal", "changing", 0.0), ("temporal", "unknown", 0.0), ("relationship", "complements_current", 0.375), ("relationship", "duplicates_current", -0.5), ("relationship", "unrelated", 0.0), ("relationship", "unknown", 0.0),
)
_WEIGHTS = "weights AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{x}', {w}::DOUBLE)" for c, x, w in UTILITY_WEIGHTS) + ") w(component, label, weight))"


@query(f"""WITH {_TIMELINE}, {_SAMPLE}, {_LABELLED}, {_WEIGHTS}, two AS (SELECT source_id, event_id, 0 AS place, current_id AS candidate_id FROM answers UNION ALL SELECT source_id, event_id, 1, proposed_id FROM answers),
 j AS (SELECT t.*, a.status = 'observed' AS seen, a.relationship, c.visibility, c.relevance, c.temporal FROM two t JOIN answers a USING (source_id, event_id) LEFT JOIN claims c ON c.source_id = t.source_id AND c.event_id = t.event_id AND c.candidate_id = t.candidate_id),
 w AS (SELECT *, CASE WHEN seen THEN coalesce((SELECT weight FROM weights x WHERE x.component = 'relevance' AND x.label = j.relevance), 0) ELSE 0 END AS wr, CASE WHEN seen THEN coalesce((SELECT weight FROM weights x WHERE x.component = 'visibility' AND x.label = j.visibility), 0) ELSE 0 END AS wv,
 CASE WHEN seen THEN coalesce((SELECT weight FROM weights x WHERE x.component = 'temporal' AND x.label = j.temporal), 0) ELSE 0 END AS wt, CASE WHEN seen AND place = 1 THEN coalesce((SELECT weight FROM weights x WHERE x.component = 'relationship' AND x.label = j.relationship), 0) ELSE 0 END AS wl FROM j)
 SELECT source_id, event_id, candidate_id, place, seen OR place = 0 AS eligible, wr AS relevance, wv AS visibility, wt AS temporal, wl AS relationship, wr + wv + wt + wl AS total FROM w""")
def pln03_event_utilities(spark: SparkSession, sf: str) -> DataFrame:
    """PLN-03, AGG-27, JOIN-15: the explained worth of an event's two views from a table of weights."""
    answers, claims, _ = _semantics(spark, sf)
    weights = spark.createDataFrame(list(UTILITY_WEIGHTS), "component string, label string, weight double")
    return events.event_utilities(answers, claims, answers.select("source_id", "event_id", "current_id", "proposed_id"), weights, "source_id")


@query(f"""WITH {r.SIGNAL}, n AS (SELECT source_id, kind, id, row_number() OVER (PARTITION BY source_id, kind ORDER BY t, id) AS place FROM signal WHERE kind IN ('click', 'view')), u AS (SELECT source_id, place, 'event:' || (id % 3) AS e FROM n WHERE kind = 'click'), p AS (SELECT source_id, place, 'event:' || (id % 3) AS e FROM n WHERE kind = 'view')
 SELECT coalesce(u.source_id, p.source_id) AS source_id, coalesce(u.place, p.place) AS place, u.e AS utility_event, p.e AS packet_event, coalesce(u.e = p.e, false) AS bound FROM u FULL JOIN p ON u.source_id = p.source_id AND u.place = p.place""")
def join19_paired_zip(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-19: two sequences one by one in order, and whether each pair names one event."""
    w = Window.partitionBy("source_id", "kind").orderBy("t", "id")
    n = r.signal(spark, sf).where("kind in ('click', 'view')").select("source_id", "kind", F.row_number().over(w).cast("long").alias("place"), F.concat(F.lit("event:"), (F.col("id") % 3).cast("string")).alias("event_id"))
    return events.paired_by_position(n.where("kind = 'click'").drop("kind"), n.where("kind = 'view'").drop("kind"), "source_id")


@query(f"""WITH {r.SIGNAL}, w AS (SELECT source_id, floor(t / 10800) * 10800 AS t, max(score) FILTER (kind = 'click') AS a, max(score) FILTER (kind = 'view') AS b FROM signal GROUP BY ALL), span AS (SELECT source_id, t AS start, t + 21600 AS "end", 1.0 AS score, 0 AS id, a, b FROM w WHERE a >= 0.05 AND b >= 0.02),
 flagged AS (SELECT *, max("end") OVER (PARTITION BY source_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM span), numbered AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY start) AS run FROM flagged)
 SELECT source_id, min(start) AS start, max("end") AS "end", count(*) AS support, round(max(a), 6) AS first_peak, round(max(b), 6) AS second_peak FROM numbered GROUP BY source_id, run HAVING count(*) >= 1""")
def fil02_reaction_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-02, WIN-01, SRC-05: windows of one time pivoted by kind, both sure enough, merged."""
    s = r.signal(spark, sf).withColumn("t", (F.floor(F.col("t") / 10800) * 10800).cast("double"))
    return rounded(events.reaction_intervals(s, "source_id", ("click", "view"), (0.05, 0.02), 21600.0, 1), "first_peak", "second_peak")


@query(f"""WITH {r.SIGNAL} SELECT id, source_id, kind FROM signal WHERE kind IN ('click', 'purchase')""")
def fil04_allowed_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-04: rows of allowed classes."""
    return r.signal(spark, sf).where(F.col("kind").isin("click", "purchase")).select("id", "source_id", "kind")


@query(f"""WITH {r.SIGNAL}, {_WINDOWS} SELECT s.id, s.source_id FROM signal s JOIN windows w USING (source_id) WHERE s.t >= w."start" AND s.t < w."start" + 432000""")
def fil07_window_clip(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-07: rows of a half-open window of each source."""
    w = _windows(spark, sf).select("source_id", F.col("start").alias("from"))
    return r.signal(spark, sf).join(w, "source_id").where((F.col("t") >= F.col("from")) & (F.col("t") < F.col("from") + 5 * DAY)).select("id", "source_id")


@query(f"""WITH {r.DETECTION}, g AS (SELECT frame, x < 0 OR top < 0 OR x + w > 1 OR top + h > 1 AS bad FROM detection) SELECT frame, count(*) AS raw_count, count(*) FILTER (bad) AS rejected_count FROM g GROUP BY frame""")
def fil08_geometry_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-08: how many of a frame's boxes leave the image."""
    bad = (F.col("x") < 0) | (F.col("top") < 0) | (F.col("x") + F.col("w") > 1) | (F.col("top") + F.col("h") > 1)
    return r.detection(spark, sf).groupBy("frame").agg(F.count(F.lit(1)).alias("raw_count"), F.count_if(bad).alias("rejected_count"))


@query(f"""WITH {r.SIGNAL}, w AS (SELECT DISTINCT source_id FROM signal), o AS (SELECT source_id, kind, count(*) AS n FROM signal WHERE score > 0.3 GROUP BY ALL), k AS (SELECT * FROM (VALUES ('click'), ('view'), ('purchase'), ('error'), ('refund')) k(kind)) SELECT w.source_id, k.kind, coalesce(o.n, 0) AS n FROM w CROSS JOIN k LEFT JOIN o ON o.source_id = w.source_id AND o.kind = k.kind""")
def agg32_outcome_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-32: counts of every known outcome, those that never occur included."""
    s = r.signal(spark, sf)
    kinds = F.explode(F.array(*[F.lit(k) for k in ("click", "view", "purchase", "error", "refund")]))
    dim = s.select("source_id").distinct().select("source_id", kinds.alias("kind"))
    found = s.where("score > 0.3").groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(found, ["source_id", "kind"], "left").select("source_id", "kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"""WITH {r.SIGNAL}, e AS (SELECT DISTINCT source_id, kind FROM signal WHERE id % 3 = 0), o AS (SELECT DISTINCT source_id, kind FROM signal WHERE id % 3 = 1) SELECT coalesce(e.source_id, o.source_id) AS source_id, coalesce(e.kind, o.kind) AS kind, CASE WHEN o.source_id IS NULL THEN 'missing' ELSE 'undeclared' END AS rule_id FROM e FULL JOIN o ON e.source_id = o.source_id AND e.kind = o.kind WHERE e.source_id IS NULL OR o.source_id IS NULL""")
def join18_full_cover(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-18: keys that only the expected or only the observed side has."""
    s = r.signal(spark, sf)
    side = lambda k: s.where(F.col("id") % 3 == k).select("source_id", "kind").distinct()
    return validation.uncovered(side(0), side(1), ["source_id", "kind"])


@query(f"""WITH {r.SIGNAL}, a AS (SELECT source_id, kind FROM signal WHERE id % 2 = 0), b AS (SELECT source_id, kind FROM signal WHERE id % 2 = 1) SELECT 'left' AS side, source_id, kind FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', source_id, kind FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def set04_difference(spark: SparkSession, sf: str) -> DataFrame:
    """SET-04: rows that only one of two tables has, counting repeats."""
    s = r.signal(spark, sf)
    return validation.difference(s.where("id % 2 = 0").select("source_id", "kind"), s.where("id % 2 = 1").select("source_id", "kind"))


@query(f"""WITH {r.CANDIDATE}, p AS (SELECT id, yaw, pitch, h_fov, lag(yaw) OVER w AS y, lag(pitch) OVER w AS pp, 0 AS f FROM candidate WINDOW w AS (ORDER BY id)), k AS (SELECT id, yaw, pitch, h_fov, y, pp, f FROM p WHERE id % 2 = 1 AND y IS NOT NULL)
 SELECT id, {r.sql_distance("a", "b")} >= radians(30.0::DOUBLE) AS material FROM (SELECT id, yaw, pitch FROM k) a JOIN (SELECT id AS bid, y AS yaw, pp AS pitch FROM k) b ON a.id = b.bid""")
def fil15_material_change(spark: SparkSession, sf: str) -> DataFrame:
    """FIL-15: whether a view's direction differs materially from the one before."""
    c = r.candidate(spark, sf).select("id", "yaw", "pitch")
    b = c.select((F.col("id") + 1).alias("id"), F.col("yaw").alias("y"), F.col("pitch").alias("p"))
    return c.where("id % 2 = 1").join(b, "id").select("id", (sphere.distance(*[F.col(k) for k in ("yaw", "pitch", "y", "p")]) >= math.radians(30)).alias("material"))

