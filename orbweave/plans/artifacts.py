"""Registered queries: closed documents, one for each artifact, made from events with some faults each."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import closed
from orbweave.operators.artifacts import ARTIFACTS, EVENT_LABELS, FLAGS, INPUTS, PRIVATE
from orbweave.plans import relations as r
from orbweave.plans.catalog import query

_SHA = "0123456789abcdef" * 4
_WINDOW = {"start_seconds": 0, "duration_seconds": 60.5}
_NOT = lambda *names: {f"contains_{n}": False for n in names}
_SPAN = {"start_seconds": 1.5, "end_seconds": 4}
_AUDIO = {"source_event_start_seconds": 1.5, "source_event_end_seconds": 4.25, "supporting_window_count": 3, "peak_applause_confidence": 0.5, "peak_clapping_confidence": 1}
_SCOPE = {"mode": "role_pair", "current_candidate_id": "view:0", "proposed_candidate_id": "view:1", "proposed_available_intervals": [_SPAN]}
_PACKET = {"source_id": "SOURCE", "event_id": "event:1", "inputs": {"event_timeline_sha256": _SHA, "context_view_grid_sha256": _SHA}, "samples": [{"sample_id": "sample:00", "temporal_role": "before", "timestamp_seconds": None, "candidate_ids": []}, {"sample_id": "sample:01", "temporal_role": "event_mid", "timestamp_seconds": 2.5, "candidate_ids": ["view:0", "view:1"]}], "temporary_media_policy": {"durable_pixels_allowed": False, "render_only_declared_candidates": True, "delete_after_adapter_completion": True}, "privacy": _NOT(*PRIVATE), "limitations": ["a note"]}
_BASE = {"source_id": "SOURCE", "window": _WINDOW, "limitations": ["a note"]}

#: A document of each artifact that keeps to its description.
GOOD = {
    "live_scene": {"schema_version": "x.live-scene-intervals.v1", "source_id": "SOURCE", "source_semantic_schema": "x.semantic.v2", "policy": {"maximum_gap_seconds": 2.0, "minimum_supporting_timestamps": 2, "status": "broad_person_presence_not_role_or_identity"}, "intervals": [_SPAN | {"supporting_timestamp_count": 3}], "privacy": _NOT("source_path", "pixels"), "limitations": []},
    "roles": _BASE | {"schema_version": "x.editorial-roles.v1", "context_view_grid": {"schema_version": "x.grid.v1", "sha256": _SHA}, "provenance": {"reviewer_kind": "human", "adapter_id": "a.1"}, "assignments": [{"candidate_id": "view:0", "role": "primary_performance"}, {"candidate_id": "view:1", "role": "audience_reaction"}], "privacy": _NOT("source_path", "pixels", "names", "identity")},
    "timeline_v1": _BASE | {"schema_version": "x.event-timeline.v1", "inputs": {f"{n}_sha256": _SHA for n in INPUTS}, "privacy": _NOT(*PRIVATE), "events": [_SPAN | {"event_id": "event:reaction:0000", "event_type": "reaction_candidate", "audio_evidence": _AUDIO, "view_context": {"current_candidate_id": "view:0", "proposed_candidate_id": "view:1", "proposed_available_at_event_onset": True, "proposed_available_intervals": [_SPAN]}}]},
    "timeline_v2": _BASE | {"schema_version": "x.event-timeline.v2", "inputs": {f"{n}_sha256": _SHA for n in (*INPUTS, "scene_change_candidates")}, "privacy": _NOT(*PRIVATE), "events": [_SPAN | {"event_id": "event:1", "signals": ["audio"], "review_scope": _SCOPE}]},
    "packet_v1": _PACKET | {"schema_version": "x.event-review-packet.v1", "event_evidence": _SPAN | {"event_type": "reaction_candidate", "audio_evidence": _AUDIO, "current_candidate_id": "view:0", "proposed_candidate_id": "view:1"}, "sampling_policy": {"policy_id": "bounded_before_quartiles_after_v1", "context_offset_seconds": 2.0, "missing_boundary_context": "null_timestamp_and_empty_candidates"}},
    "packet_v2": _PACKET | {"schema_version": "x.event-review-packet.v2", "event": _SPAN | {"signals": ["audio", "scene"], "review_scope": _SCOPE}, "sampling_policy": {"policy_id": "role_pair_quartiles_v1", "maximum_rendered_frames": 10}},
    "plan": _BASE | {"schema_version": "x.reaction-shot-plan.v4", "inputs": {f"{n}_sha256": _SHA for n in (*INPUTS, "reaction_view_gain")}, "transition_policy": "hard_cut_only_when_promoted_v4", "segments": [_SPAN | {"candidate_id": "view:0", "reason": "primary_performance_default"}]},
    "scene_context": {"schema_version": "x.scene-context.v2", "window": _WINDOW | {"source_id": "SOURCE", "window_id": "w1"}, "candidates": [{"candidate_id": "p1", "candidate_type": "person", "member_candidate_ids": []}], "provenance": {"reviewer_kind": "human", "adapter_id": "a.1", "model_id": None, "model_sha256": None}, "decision": {"context_class": "scene", "subject_scope": "single", "selected_candidate_id": "p1", "evidence_flags": dict.fromkeys(FLAGS, "unknown")}, "privacy": _NOT("source_path", "pixels", "names", "embeddings"), "limitations": ["a note"]},
    "review": {"schemaVersion": 2, "review": {"reviewerId": "SOURCE", "reviewerKind": "human", "reviewedDate": "2024-01-31", "protocolVersion": "p1", "interRaterStatus": "not_performed"}, "evidence": {"sourceId": "s", "evidenceSchemaVersion": 1, "projectionStrategy": "four_rectilinear_viewports", "viewportIds": ["a", "b", "c", "d"]}, "frames": [{"timestampSeconds": 1.5, "reviewable": True, "ordinaryViewerInterest": 2, "eventLabels": list(EVENT_LABELS[:2]), "candidateReviews": [{"id": "c1", "viewportId": "a", "kind": "human", "verdict": "hit"}], "duplicateGroups": [{"id": "g1", "candidateIds": ["c1", "c2"]}], "missedImportantRegions": [{"id": "r1", "kind": "object", "yawRadians": 3.0, "pitchRadians": -1.5, "horizontalFovRadians": 1}]}], "limitations": ["a note"]},
}


def _first(name: str, *fields: str) -> str:
    return next(f for f in fields if f in GOOD[name])


def _faults(name: str) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """(document, violations (path, rule_id, field)) of an artifact: the good one, and one for each kind of fault."""
    good = GOOD[name]
    version = _first(name, "schema_version", "schemaVersion")
    listed = _first(name, "intervals", "assignments", "events", "samples", "segments", "candidates", "frames")
    first = good[listed][0]
    inner = next(iter(first))
    rest = {k: v for k, v in good.items() if k != version}
    item = f"$.{listed}[0]"
    made = [
        (good, []),
        (rest | {"extra": [1], "vers": None}, [("$", "missing_field", version), ("$", "unknown_field", "extra"), ("$", "unknown_field", "vers")]),
        (good | {"limitations": {"a": 1}}, [("$", "wrong_type", "limitations")]),
        (good | {"limitations": ["", 3]}, [("$", "item", "limitations")]),
        (good | {version: 7 if name == "review" else "x.other.v1"}, [("$", "value", version)]),
        (good | {version: None}, [("$", "wrong_type", version)]),
        (good | {listed: [first | {"more": 1}, *good[listed][1:]]}, [(item, "unknown_field", "more")]),
        (good | {listed: [*good[listed], 5]}, [("$", "item", listed)]),
        (good | {listed: [first | {inner: [[]]}, *good[listed][1:]]}, [(item, "wrong_type", inner)]),
        (good | {listed: [{k: v for k, v in first.items() if k != inner}, *good[listed][1:]]}, [(item, "missing_field", inner)]),
        ([good], [("$", "not_an_object", "")]),
    ]
    return [(json.dumps(document), broken) for document, broken in made]


def _register(name: str) -> None:
    faults = _faults(name)
    values = ", ".join(f"({i}, '{path}', '{rule}', '{field}')" for i, (_, broken) in enumerate(faults) for path, rule, field in broken)
    sql = f"WITH {r.SIGNAL}, faults(k, path, rule_id, field) AS (VALUES {values}) SELECT id, path, rule_id, field FROM signal JOIN faults ON id % {len(faults)} = k"

    def made(spark: SparkSession, sf: str) -> DataFrame:
        documents = F.array(*[F.lit(text) for text, _ in faults])
        source = F.concat(F.lit("source:"), F.col("source_id").cast("string"))
        rows = r.signal(spark, sf).select("id", F.replace(documents[(F.col("id") % len(faults)).cast("int")], F.lit("SOURCE"), source).alias("document"))
        return closed.closed_violations(rows, "id", "document", ARTIFACTS[name])

    made.__name__ = f"fil09_{name}"
    made.__doc__ = f"FIL-09: what {name.replace('_', ' ')} documents may not hold, unknown fields included."
    query(sql)(made)


for _name in GOOD:
    _register(_name)
