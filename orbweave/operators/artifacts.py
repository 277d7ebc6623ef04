"""What the editorial artifacts hold, as closed descriptions (``closed``)."""

from __future__ import annotations

import math

from orbweave.operators.closed import Fields, Flag, Items, Number, Text
from orbweave.operators.validation import SAFE_ID

# The artifacts' field names, value sets and bounds.
SAFE, SHA = Text(SAFE_ID), Text(r"\A[0-9a-f]{64}\z")
SECONDS = Number(0)
NOTES = Items(Text(r"(?s)\A.+\z"))


def _schema(name: str) -> Text:
    return Text(rf"\A[a-z0-9]+\.{name}\z")


def _absent(*names: str) -> Fields:
    return Fields({f"contains_{n}": Flag(False) for n in names})


SPAN = {"start_seconds": SECONDS, "end_seconds": SECONDS}
WINDOW = Fields({"start_seconds": SECONDS, "duration_seconds": Number(0, above=True)})
PRIVATE = ("source_path", "pixels", "audio", "names", "identity", "editorial_decision")
MEDIA = Fields({"durable_pixels_allowed": Flag(False), "render_only_declared_candidates": Flag(True), "delete_after_adapter_completion": Flag(True)})
SHARE = Number(0, 1)
AUDIO = Fields({"source_event_start_seconds": Number(), "source_event_end_seconds": Number(), "supporting_window_count": Number(1, whole=True), "peak_applause_confidence": SHARE, "peak_clapping_confidence": SHARE})
AVAILABLE = Items(Fields(SPAN))
SAMPLES = Items(Fields({"sample_id": Text(r"\Asample:\d{2}\z"), "temporal_role": Text(r"\A[a-z_]+\z"), "timestamp_seconds": Number(0, null=True), "candidate_ids": Items(SAFE, unique="")}), 1, 10, unique="sample_id")
INPUTS = ("context_view_grid", "editorial_roles", "reaction_intervals", "candidate_availability")
FLAGS = ("multiple_people_visible", "face_visible", "mouth_motion_visible", "reciprocal_orientation", "speech_audio_present")

LIVE_SCENE = Fields({
    "schema_version": _schema(r"live-scene-intervals\.v1"), "source_id": SAFE, "source_semantic_schema": Text(), "privacy": _absent("source_path", "pixels"), "limitations": NOTES,
    "policy": Fields({"maximum_gap_seconds": Number(0, above=True), "minimum_supporting_timestamps": Number(1, whole=True), "status": Text(values=["broad_person_presence_not_role_or_identity"])}),
    "intervals": Items(Fields(SPAN | {"supporting_timestamp_count": Number(1, whole=True)})),
})
ROLES = Fields({
    "schema_version": _schema(r"editorial-roles\.v1"), "source_id": SAFE, "window": WINDOW, "context_view_grid": Fields({"schema_version": Text(), "sha256": SHA}), "provenance": Fields({"reviewer_kind": Text(values=["human"]), "adapter_id": SAFE}),
    "assignments": Items(Fields({"candidate_id": SAFE, "role": Text(values=["primary_performance", "audience_reaction", "neutral_context"])}), 2, unique="candidate_id"), "privacy": _absent("source_path", "pixels", "names", "identity"), "limitations": NOTES,
})
TIMELINE_V1 = Fields({
    "schema_version": _schema(r"event-timeline\.v1"), "source_id": SAFE, "window": WINDOW, "inputs": Fields({f"{n}_sha256": SHA for n in INPUTS}), "privacy": _absent(*PRIVATE), "limitations": NOTES,
    "events": Items(Fields(SPAN | {
        "event_id": Text(r"\Aevent:reaction:\d{4,}\z"), "event_type": Text(values=["reaction_candidate"]), "audio_evidence": AUDIO,
        "view_context": Fields({"current_candidate_id": SAFE, "proposed_candidate_id": SAFE, "proposed_available_at_event_onset": Flag(), "proposed_available_intervals": AVAILABLE}),
    }), unique="event_id"),
})
SIGNALS = Items(Text(), 1)
SCOPE = Fields({"mode": Text(values=["role_pair"]), "current_candidate_id": SAFE, "proposed_candidate_id": SAFE, "proposed_available_intervals": AVAILABLE})
TIMELINE_V2 = Fields({
    "schema_version": _schema(r"event-timeline\.v2"), "source_id": SAFE, "window": WINDOW, "inputs": Fields({f"{n}_sha256": SHA for n in (*INPUTS, "scene_change_candidates")}), "privacy": _absent(*PRIVATE), "limitations": NOTES,
    "events": Items(Fields(SPAN | {"event_id": SAFE, "signals": SIGNALS, "review_scope": SCOPE}), unique="event_id"),
})
_PACKET = {"source_id": SAFE, "event_id": SAFE, "inputs": Fields({"event_timeline_sha256": SHA, "context_view_grid_sha256": SHA}), "samples": SAMPLES, "temporary_media_policy": MEDIA, "privacy": _absent(*PRIVATE), "limitations": NOTES}
PACKET_V1 = Fields(_PACKET | {
    "schema_version": _schema(r"event-review-packet\.v1"), "event_evidence": Fields(SPAN | {"event_type": Text(values=["reaction_candidate"]), "audio_evidence": AUDIO, "current_candidate_id": SAFE, "proposed_candidate_id": SAFE}),
    "sampling_policy": Fields({"policy_id": Text(values=["bounded_before_quartiles_after_v1"]), "context_offset_seconds": Number(2, 2), "missing_boundary_context": Text(values=["null_timestamp_and_empty_candidates"])}),
})
PACKET_V2 = Fields(_PACKET | {
    "schema_version": _schema(r"event-review-packet\.v2"), "event": Fields(SPAN | {"signals": SIGNALS, "review_scope": SCOPE}),
    "sampling_policy": Fields({"policy_id": Text(values=["role_pair_quartiles_v1", "neutral_boundaries_v1"]), "maximum_rendered_frames": Number(10, 10, whole=True)}),
})
PLAN = Fields({
    "schema_version": _schema(r"reaction-shot-plan\.v4"), "source_id": SAFE, "window": WINDOW, "inputs": Fields({f"{n}_sha256": SHA for n in (*INPUTS, "reaction_view_gain")}), "transition_policy": Text(r"\Ahard_cut_only_[a-z_]+_v4\z"), "limitations": NOTES,
    "segments": Items(Fields(SPAN | {"candidate_id": SAFE, "reason": Text(values=["primary_performance_default", "reaction_event_candidate_available_and_gain_promoted"])}), 1),
})
SCENE_CONTEXT = Fields({
    "schema_version": _schema(r"scene-context\.v2"), "window": Fields({"source_id": SAFE, "window_id": SAFE, **WINDOW.of}), "privacy": _absent("source_path", "pixels", "names", "embeddings"), "limitations": NOTES,
    "candidates": Items(Fields({"candidate_id": SAFE, "candidate_type": Text(values=["person", "group", "context"]), "member_candidate_ids": Items(SAFE, unique="")}), 1, unique="candidate_id"),
    "provenance": Fields({"reviewer_kind": Text(values=["human", "local_vlm"]), "adapter_id": SAFE, "model_id": Text(SAFE_ID, null=True), "model_sha256": Text(r"\A[0-9a-f]{64}\z", null=True)}),
    "decision": Fields({"context_class": Text(), "subject_scope": Text(values=["single", "group", "context", "uncertain"]), "selected_candidate_id": Text(SAFE_ID, null=True), "evidence_flags": Fields({f: Text(values=["present", "absent", "unknown"]) for f in FLAGS})}),
})
EVENT_LABELS = ("action_change", "environment_context", "interaction", "obstacle_or_hazard", "person_or_group", "travel_progress", "other_visual_event")
REVIEW = Fields({
    "schemaVersion": Number(2, 2, whole=True), "limitations": NOTES,
    "review": Fields({"reviewerId": SAFE, "reviewerKind": Text(values=["human", "model_assisted"]), "reviewedDate": Text(r"\A\d{4}-\d{2}-\d{2}\z"), "protocolVersion": SAFE, "interRaterStatus": Text(values=["not_performed"])}),
    "evidence": Fields({"sourceId": SAFE, "evidenceSchemaVersion": Number(1, 1, whole=True), "projectionStrategy": Text(values=["four_rectilinear_viewports"]), "viewportIds": Items(SAFE, 4, 4, unique="")}),
    "frames": Items(Fields({
        "timestampSeconds": Number(0, 1e12), "reviewable": Flag(), "ordinaryViewerInterest": Number(0, 3, whole=True), "eventLabels": Items(Text(values=EVENT_LABELS), unique=""),
        "candidateReviews": Items(Fields({"id": SAFE, "viewportId": SAFE, "kind": SAFE, "verdict": Text(values=["hit", "false_positive", "uncertain"])}), unique="id"),
        "duplicateGroups": Items(Fields({"id": SAFE, "candidateIds": Items(SAFE, 2, unique="")}), unique="id"),
        "missedImportantRegions": Items(Fields({"id": SAFE, "kind": Text(values=["human", "object", "action", "interaction", "context", "other"]), "yawRadians": Number(-math.pi, math.pi), "pitchRadians": Number(-math.pi / 2, math.pi / 2), "horizontalFovRadians": Number(1e-9, math.pi)}), unique="id"),
    }), unique="timestampSeconds"),
})

ARTIFACTS = {"live_scene": LIVE_SCENE, "roles": ROLES, "timeline_v1": TIMELINE_V1, "timeline_v2": TIMELINE_V2, "packet_v1": PACKET_V1, "packet_v2": PACKET_V2, "plan": PLAN, "scene_context": SCENE_CONTEXT, "review": REVIEW}
