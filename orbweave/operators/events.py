"""Editorial events: views and roles, availability, timelines, semantics, utilities and review samples.

Every artifact is a table keyed by source (and event); what binds artifacts together are joins, and what may not
be is a table of violations (``validation``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators import intervals

# The yaws of the four cardinal views, in order.
CARDINAL_YAWS = (0.0, 90.0, -180.0, -90.0)


def cardinal_views(windows: DataFrame, key: str, pitch: float = 0.0, h_fov: float = 110.0) -> DataFrame:
    """Four context views for each source's window: (key, candidate_id, place, yaw, pitch, h_fov), in degrees (PLN-07)."""
    view = lambda i, yaw: F.struct(F.lit(f"context:cardinal:{i}").alias("candidate_id"), F.lit(i).alias("place"), F.lit(yaw).alias("yaw"))
    views = F.explode(F.array(*[view(i, yaw) for i, yaw in enumerate(CARDINAL_YAWS)]))
    return windows.select(key, views.alias("v")).select(key, "v.*", F.lit(pitch).alias("pitch"), F.lit(h_fov).alias("h_fov"))


def declared_view_violations(views: DataFrame, key: str) -> DataFrame:
    """(rule_id, key) of declared grids that break a rule: 2 to 8 views, unique ids, angles in range."""
    bad = {"yaw_range": ~((F.col("yaw") >= -180) & (F.col("yaw") < 180)), "pitch_range": ~F.col("pitch").between(-90, 90), "fov_range": ~((F.col("h_fov") > 0) & (F.col("h_fov") < 180))}
    own = views.select(key, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in bad.items()]))).alias("rule_id"))
    counts = views.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("candidate_id").alias("ids"))
    whole = counts.select(key, F.explode(F.array_compact(F.array(F.when(~F.col("n").between(2, 8), F.lit("view_count")), F.when(F.col("ids") < F.col("n"), F.lit("unique_ids"))))).alias("rule_id"))
    return own.unionAll(whole).select("rule_id", key).distinct()


def editorial_roles(views: DataFrame, choices: DataFrame, key: str) -> DataFrame:
    """(key, candidate_id, place, role) for sources whose two chosen views differ and are declared (PLN-07).

    ``choices``: key, primary_id, reaction_id.
    """
    both = views.join(choices, key)
    role = F.when(F.col("candidate_id") == F.col("primary_id"), "primary_performance").when(F.col("candidate_id") == F.col("reaction_id"), "audience_reaction").otherwise("neutral_context")
    declared = F.count_if(F.col("role") != "neutral_context").over(Window.partitionBy(key))
    return both.withColumn("role", role).withColumn("_n", declared).where((F.col("_n") == 2) & (F.col("primary_id") != F.col("reaction_id"))).select(key, "candidate_id", "place", "role")


def role_pairs(roles: DataFrame, key: str) -> DataFrame:
    """(key, current_id, proposed_id): the primary and the reaction view of each source (JOIN-15)."""
    pick = lambda role: F.min(F.when(F.col("role") == role, F.col("candidate_id")))
    return roles.groupBy(key).agg(pick("primary_performance").alias("current_id"), pick("audience_reaction").alias("proposed_id"))


def availability(spans: DataFrame, views: DataFrame, windows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, violations): when candidates can be seen, for candidates whose every interval is in order (PLN-07).

    ``spans``: key, candidate_id, start, end. Intervals of a candidate must be declared by the grid, end after
    they begin, not begin before the one ahead ends, and lie in the source's window (key, start, end).
    """
    w = Window.partitionBy(key, "candidate_id").orderBy("start", "end")
    s = spans.join(windows.select(key, F.col("start").alias("_from"), F.col("end").alias("_to")), key, "left").join(views.select(key, "candidate_id", F.lit(1).alias("_known")), [key, "candidate_id"], "left")
    s = s.withColumn("_before", F.coalesce(F.lag("end").over(w), F.col("_from")))
    rules = {"undeclared_candidate": F.col("_known").isNull(), "empty_interval": F.col("end") <= F.col("start"), "out_of_order": F.col("start") < F.col("_before"), "beyond_window": F.col("end") > F.col("_to")}
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    bad = s.select(F.explode(broken).alias("rule_id"), key, "candidate_id").distinct()
    return spans.join(bad.select(key, "candidate_id").distinct(), [key, "candidate_id"], "left_anti"), bad


def event_timeline(reactions: DataFrame, roles: DataFrame, available: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Reactions cut to the source's window, with the two views they are between (PLN-05).

    Rows: (key, event_id, start, end, source_start, source_end, support, current_id, proposed_id, onset_available,
    available): ``available`` are the parts of the event in which the proposed view can be seen, and
    ``onset_available`` tells whether the reaction's own begin lies in one of that view's intervals.
    """
    cut = reactions.join(windows.select(key, F.col("start").alias("_from"), F.col("end").alias("_to")), key)
    start, end = F.greatest("start", "_from"), F.least("end", "_to")
    cut = cut.select(key, F.col("start").alias("source_start"), F.col("end").alias("source_end"), "support", start.alias("start"), end.alias("end")).where("end > start")
    numbered = cut.withColumn("event_id", F.format_string("event:reaction:%04d", F.row_number().over(Window.partitionBy(key).orderBy("start", "end")) - 1))
    bound = numbered.join(role_pairs(roles, key), key)
    events = bound.select(key, "event_id", F.col("proposed_id").alias("candidate_id"), F.col("source_start").alias("start"), F.col("source_end").alias("end"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    seen = intervals.overlaps(events, available.select(key, "candidate_id", "start", "end"), [key, "candidate_id"])
    part = F.struct(F.greatest("_s", "start_right").alias("start"), F.least("_e", "end_right").alias("end"))
    inside = F.least("_e", "end_right") > F.greatest("_s", "start_right")
    onset = (F.col("start_right") <= F.col("start")) & (F.col("start") < F.col("end_right"))
    parts = seen.groupBy(key, "event_id").agg(F.bool_or(onset).alias("onset_available"), F.sort_array(F.collect_list(F.when(inside, part))).alias("available"))
    none = F.array().cast(parts.schema["available"].dataType)
    names = [key, "event_id", "start", "end", "source_start", "source_end", "support", "current_id", "proposed_id"]
    return bound.join(parts, [key, "event_id"], "left").select(*names, F.coalesce("onset_available", F.lit(False)).alias("onset_available"), F.coalesce("available", none).alias("available"))


def view_gain(decisions: DataFrame, reactions: DataFrame, roles: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(bound, violations): reviewers' decisions on reactions, with the two views they compare (PLN-06).

    A decision (key, start, end, decision) must name a declared reaction by its exact bounds, once, and
    promote or abstain.
    """
    declared = reactions.select(key, "start", "end").distinct().withColumn("_known", F.lit(1))
    d = decisions.join(declared, [key, "start", "end"], "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "start", "end")))
    rules = {"undeclared_event": F.col("_known").isNull(), "repeated_event": F.col("_n") > 1, "unknown_decision": ~F.coalesce(F.col("decision").isin("promote", "abstain"), F.lit(False))}
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    d = d.withColumn("_broken", broken)
    bad = d.select(F.explode("_broken").alias("rule_id"), key, "start", "end").distinct()
    return d.where(F.size("_broken") == 0).join(role_pairs(roles, key), key).select(key, "start", "end", "current_id", "proposed_id", "decision"), bad


def _candidates_at(t: Column) -> Column:
    """Current view always, the proposed one while it can be seen."""
    shown = F.exists("available", lambda a: (a["start"] <= t) & (t < a["end"]))
    return F.array_compact(F.array(F.col("current_id"), F.when(shown, F.col("proposed_id"))))


def review_samples(timeline: DataFrame, windows: DataFrame, key: str, offset: float = 2.0) -> DataFrame:
    """Five moments around each event, and which views to look at (WIN-22): key, event_id, place, role, t, candidates.

    The moments before and after lie ``offset`` seconds off, cut to the window; they are null, without candidates,
    where the event touches the window's end.
    """
    e = timeline.join(windows.select(key, F.col("start").alias("_from"), F.col("end").alias("_to")), key)
    length = F.col("end") - F.col("start")
    moments = {
        "before": F.when(F.col("start") > F.col("_from"), F.greatest(F.col("_from"), F.col("start") - offset)),
        "event_early": F.col("start") + length * 0.25, "event_mid": F.col("start") + length * 0.5, "event_late": F.col("start") + length * 0.75,
        "after": F.when(F.col("end") < F.col("_to"), F.least(F.col("_to"), F.col("end") + offset)),
    }
    rows = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(role).alias("role"), t.alias("t")) for i, (role, t) in enumerate(moments.items())])
    s = e.withColumn("s", F.explode(rows)).withColumn("t", F.col("s.t"))
    return s.select(key, "event_id", F.col("s.place").alias("place"), F.col("s.role").alias("role"), "t", F.when(F.col("t").isNull(), F.array().cast("array<string>")).otherwise(_candidates_at(F.col("t"))).alias("candidates"))


def scoped_samples(events: DataFrame, views: DataFrame, key: str, most_frames: int = 10) -> DataFrame:
    """Review moments of events of either scope (WIN-23): key, event_id, place, role, t, candidates, within_bound.

    ``events``: key, event_id, start, end, mode, current_id, proposed_id, available. All declared views are looked at
    at both bounds of a neutral event (``all_declared_candidates``), current and proposed ones at five moments of a role-scoped one
    (``current_and_available_proposed``). ``within_bound``: whether the event asks for ``most_frames`` frames at most.
    """
    grid = views.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "candidate_id"))), lambda v: v["candidate_id"]).alias("_grid"))
    neutral = F.col("mode") == "all_declared_candidates"
    moment = lambda i, role, share: F.struct(F.lit(i).alias("place"), F.lit(role).alias("role"), (F.col("start") + (F.col("end") - F.col("start")) * share).alias("t"))
    two = F.array(moment(0, "before_boundary", 0.0), moment(1, "after_boundary", 1.0))
    five = F.array(*[moment(i, role, i / 4) for i, role in enumerate(("before", "early", "mid", "late", "after"))])
    s = events.join(grid, key).withColumn("s", F.explode(F.when(neutral, two).otherwise(five))).withColumn("t", F.col("s.t"))
    s = s.select(key, "event_id", F.col("s.place").alias("place"), F.col("s.role").alias("role"), "t", F.when(neutral, F.col("_grid")).otherwise(_candidates_at(F.col("t"))).alias("candidates"))
    total = F.sum(F.size("candidates")).over(Window.partitionBy(key, "event_id"))
    return s.withColumn("within_bound", total <= most_frames)


def render_jobs(samples: DataFrame, views: DataFrame, key: str, width: int = 384, height: int = 216) -> DataFrame:
    """One job for each sample and view (PLN-08), with whether the event's number of jobs is within 1 to 10."""
    asked = samples.where("t is not null").select(key, "event_id", "place", "role", "t", F.explode("candidates").alias("candidate_id"))
    jobs = asked.join(views.drop("place"), [key, "candidate_id"])
    name = F.concat(F.format_string("sample-%02d-", "place"), F.regexp_replace("candidate_id", ":", "-"), F.lit(".png"))
    made = jobs.select(key, "event_id", "place", "role", "t", "candidate_id", "yaw", "pitch", "h_fov", F.lit(width).alias("width"), F.lit(height).alias("height"), name.alias("filename"))
    return made.withColumn("within_bound", F.count(F.lit(1)).over(Window.partitionBy(key, "event_id")).between(1, 10))


# What semantics may say.
LABELS = {"visibility": ("clear", "partial", "obstructed", "unknown"), "relevance": ("primary", "supporting", "unrelated", "unknown"), "temporal": ("stable", "changing", "unknown")}
EVENT_CLASSES = ("audience_reaction", "performance_continuation", "ambient_activity", "unknown")
RELATIONSHIPS = ("complements_current", "duplicates_current", "unrelated", "unknown")


def bind_semantics(answers: DataFrame, claims: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """(key, event_id, rule_id) for semantic answers that don't fit their packet (PLN-04); a sound answer has no rows.

    ``answers``: key, event_id, status (observed or abstain), event_class, relationship. ``claims``: key, event_id,
    place, candidate_id, visibility, relevance, temporal. An abstention claims nothing. An observation covers the
    packet's candidates in the order in which its samples first name them, with known labels.
    """
    ids = [key, "event_id"]
    named = samples.select(*ids, "place", F.posexplode("candidates").alias("i", "candidate_id")).groupBy(*ids, "candidate_id").agg(F.min(F.struct("place", "i")).alias("_first"))
    in_order = lambda by: F.transform(F.sort_array(F.collect_list(F.struct(by, "candidate_id"))), lambda v: v["candidate_id"])
    wanted = named.groupBy(*ids).agg(in_order("_first").alias("_wanted"))
    sound = F.lit(True)
    for column, labels in LABELS.items():
        sound &= F.coalesce(F.col(column).isin(*labels), F.lit(False))
    said = claims.groupBy(*ids).agg(in_order("place").alias("_said"), F.bool_and(sound).alias("_sound"))
    a = answers.join(wanted, ids, "left").join(said, ids, "left")
    abstains, observed = F.col("status") == "abstain", F.col("status") == "observed"
    claims_any = F.coalesce(F.size("_said") > 0, F.lit(False))
    rules = {
        "unknown_status": ~F.coalesce(F.col("status").isin("observed", "abstain"), F.lit(False)),
        "abstention_with_claims": abstains & (claims_any | (F.col("event_class") != "unknown") | (F.col("relationship") != "unknown")),
        "unknown_event_class": observed & ~F.coalesce(F.col("event_class").isin(*EVENT_CLASSES), F.lit(False)),
        "unknown_relationship": observed & ~F.coalesce(F.col("relationship").isin(*RELATIONSHIPS), F.lit(False)),
        "candidates_not_covered_in_order": observed & ~F.col("_said").eqNullSafe(F.col("_wanted")),
        "unknown_label": observed & ~F.coalesce(F.col("_sound"), F.lit(True)),
    }
    return a.select(*ids, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule_id"))


def event_utilities(answers: DataFrame, claims: DataFrame, pairs: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """The explained worth of an event's current and proposed view (PLN-03): key, event_id, candidate_id, place,
    eligible, relevance, visibility, temporal, relationship, total.

    ``weights``: component, label, weight (a small dimension). The current view is always eligible, the proposed
    one if the event was observed. Without an observation all components are 0; the relationship counts for
    the proposed view only.
    """
    ids = [key, "event_id"]
    two = F.explode(F.array(F.struct(F.lit(0).alias("place"), F.col("current_id").alias("candidate_id")), F.struct(F.lit(1).alias("place"), F.col("proposed_id").alias("candidate_id"))))
    rows = pairs.select(*ids, two.alias("c")).select(*ids, "c.*").join(answers.select(*ids, "status", F.col("relationship").alias("_relationship")), ids)
    rows = rows.join(claims.select(*ids, "candidate_id", *[F.col(c).alias(f"_{c}") for c in LABELS]), [*ids, "candidate_id"], "left")
    for part in (*LABELS, "relationship"):
        dim = F.broadcast(weights.where(F.col("component") == part).select(F.col("label").alias(f"_{part}"), F.col("weight").alias(part)))  # one row for each label
        rows = rows.join(dim, f"_{part}", "left")
    observed = F.col("status") == "observed"
    counted = {part: F.when(observed, F.coalesce(part, F.lit(0.0))).otherwise(0.0) for part in LABELS} | {"relationship": F.when(observed & (F.col("place") == 1), F.coalesce("relationship", F.lit(0.0))).otherwise(0.0)}
    made = rows.select(*ids, "candidate_id", "place", (observed | (F.col("place") == 0)).alias("eligible"), *[c.alias(n) for n, c in counted.items()])
    return made.withColumn("total", F.col("relevance") + F.col("visibility") + F.col("temporal") + F.col("relationship"))


def paired_by_position(utilities: DataFrame, packets: DataFrame, key: str) -> DataFrame:
    """JOIN-19: utilities and packets of a source, one by one in order; ``bound`` tells whether they name one event.

    Both have key, place and event_id; a place that only one side has comes with nulls and is not bound.
    """
    u, p = utilities.select(key, "place", F.col("event_id").alias("utility_event")), packets.select(key, "place", F.col("event_id").alias("packet_event"))
    return u.join(p, [key, "place"], "full").withColumn("bound", F.coalesce(F.col("utility_event") == F.col("packet_event"), F.lit(False)))


def reaction_intervals(signal: DataFrame, key: str, kinds: tuple[str, str], least: tuple[float, float], length: float, support: int = 2) -> DataFrame:
    """Merged windows in which both kinds of sound are sure enough (FIL-02, WIN-01): key, start, end, support, peaks.

    ``signal``: key, t, kind, score; windows of one time are pivoted into one row, and both scores must reach
    their bound.
    """
    wide = signal.groupBy(key, "t").pivot("kind", list(kinds)).agg(F.max("score"))
    a, b = (F.col(k) for k in kinds)
    both = wide.where((a >= least[0]) & (b >= least[1])).select(key, F.col("t").alias("start"), (F.col("t") + length).alias("end"), a.alias("first"), b.alias("second"))
    merged = intervals.merge_intervals(both, [key], "start", "end", {"support": F.count(F.lit(1)), "first_peak": F.max("first"), "second_peak": F.max("second")})
    return merged.where(F.col("support") >= support)
