"""Closed-schema validation: rules give a table of violations, and rebuilt tables must be equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions import sphere

SAFE_ID = r"\A[A-Za-z0-9._:-]+\z"


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule_id, key) for every row that breaks a rule; a rule that is null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule_id"), F.col(key).cast("string").alias("key"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def out_of_order(df: DataFrame, key: str, order: str, start: str, end: str) -> DataFrame:
    """Intervals that begin before the one ahead of them has ended."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_end", F.lag(end).over(w)).where(F.col(start) < F.col("_end")).drop("_end")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, counting repeats; empty if and only if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))


def uncovered(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule_id) for keys that only one side has: ``missing`` or ``undeclared``; no rows if the sides match."""
    a, b = expected.select(*keys, F.lit(1).alias("_expected")), observed.select(*keys, F.lit(1).alias("_observed"))
    both = a.join(b, keys, "full").where("_expected is null or _observed is null")
    return both.select(*keys, F.when(F.col("_observed").isNull(), "missing").otherwise("undeclared").alias("rule_id"))


# --- what the domain's artifacts must keep -------------------------------------------------------------------


def sound_window_rules() -> dict[str, Column]:
    """Rows start, duration, confidence, before (the start of the window ahead), a and b (the requested window)."""
    start, length = F.col("start"), F.col("duration")
    return {"window_begins_early": start >= F.col("a"), "window_ends_late": start + length <= F.col("b") + 1e-3, "window_out_of_order": start >= F.coalesce("before", F.lit(-1.0)), "duration_not_positive": length > 0, "confidence_range": F.col("confidence").between(0, 1)}


def interval_rules(least_support: int) -> dict[str, Column]:
    """Rows start, end, support, before (the end of the interval ahead)."""
    return {"out_of_order": F.col("start") >= F.coalesce("before", F.lit(-1.0)), "empty_interval": F.col("end") > F.col("start"), "support": F.col("support") >= least_support}


def geometry_rules() -> dict[str, Column]:
    return {"pitch_range": F.col("pitch").between(-F.pi() / 2, F.pi() / 2), "fov_range": (F.col("h_fov") > 0) & (F.col("h_fov") < F.pi())}


def candidate_rules() -> dict[str, Column]:
    """Rows yaw, pitch, h_fov, pitch_min, pitch_max, same (rows of the sample with this id)."""
    low, high, pitch = F.col("pitch_min"), F.col("pitch_max"), F.col("pitch")
    holds = low.isNull() | high.isNull() | ((low >= -F.pi() / 2) & (low <= pitch) & (pitch <= high) & (high <= F.pi() / 2))
    return {"yaw_range": F.col("yaw").between(-F.pi(), F.pi()), **geometry_rules(), "bounds_in_pairs": low.isNull() == high.isNull(), "bounds_hold_centre": holds, "unique_id": F.col("same") == 1}


def signal_rules() -> dict[str, Column]:
    """Rows normalized, raw, missing_reason."""
    there, reason = F.col("normalized").isNotNull(), F.col("missing_reason").isNotNull()
    return {"normalized_range": ~there | F.col("normalized").between(0, 1), "missing_with_raw": there | F.col("raw").isNull(), "missing_without_reason": there | reason, "present_with_reason": ~there | ~reason}


def track_event_rules() -> dict[str, Column]:
    """Rows kind, confidence."""
    seen, sure = F.col("kind") == "observed", F.col("confidence")
    return {"observed_confidence": ~seen | (sure.isNotNull() & sure.between(0, 1)), "unobserved_confidence": seen | sure.isNull()}


def planner_rules() -> dict[str, Column]:
    """Rows pitch, h_fov, normalized, same (rows of the observation with this candidate)."""
    return {"unique_candidate": F.col("same") == 1, **geometry_rules(), "component_range": F.col("normalized").between(0, 1)}


def _finite(*names: str) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return ok


def keyframe_rules() -> dict[str, Column]:
    """Rows time, yaw, pitch, h_fov, before (the time of the keyframe ahead, null for the first)."""
    time = F.col("time")
    return {"finite": _finite("time", "yaw", "pitch", "h_fov"), "time_order": (time >= 0) & (F.col("before").isNull() | (time > F.col("before"))), **geometry_rules()}


def refresh_rules() -> dict[str, Column]:
    """Rows timestamp, track_id, before (the timestamp of the refresh ahead, null for the first)."""
    at = F.col("timestamp")
    return {"finite_timestamp": _finite("timestamp"), "timestamp_order": F.col("before").isNull() | (at > F.col("before")), "track_id": F.length("track_id") > 0}


def duration_ladder(df: DataFrame, available: str, declared: str, ladder: Column) -> DataFrame:
    """``df`` with ``expected``, the ladder's durations that are available, and ``matches``."""
    return df.withColumn("expected", F.filter(ladder, lambda d: d <= F.col(available))).withColumn("matches", F.col("expected") == F.col(declared))


# How far two detectors' outputs may be apart.
MOST_ERROR, MOST_MEAN_ERROR, TOP, LEAST_AGREEMENT, LEAST_IOU, MOST_SCORE_ERROR = 0.02, 0.005, 20, 19, 0.95, 0.03


def numeric_equivalence(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, maximum_error, mean_error, agreement, passed) for two arrays of numbers in each row.

    ``agreement``: how many of the greatest values' places (ties: the lesser place) they have in common. Arrays of
    different lengths, or without values, don't pass.
    """
    off = F.transform(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda z: F.abs(z["a"] - z["b"]))
    places = lambda c: F.transform(F.slice(F.array_sort(F.transform(c, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))), 1, TOP), lambda s: s["i"])
    rows = df.select(key, off.alias("_off"), F.size(F.array_intersect(places(a), places(b))).cast("long").alias("agreement"), F.size(a).alias("_n"), (F.size(a) == F.size(b)).alias("_same"))
    made = rows.select(key, F.array_max("_off").alias("maximum_error"), (F.aggregate("_off", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.col("_n"), F.lit(0))).alias("mean_error"), "agreement", "_n", "_same")
    enough = F.col("agreement") >= F.least(F.lit(LEAST_AGREEMENT), F.col("_n"))
    passed = F.col("_same") & (F.col("maximum_error") <= MOST_ERROR) & (F.col("mean_error") <= MOST_MEAN_ERROR) & enough
    return made.select(key, "maximum_error", "mean_error", "agreement", F.coalesce(passed, F.lit(False)).alias("passed"))


def decoded_equivalence(a: DataFrame, b: DataFrame, key: str, place: str) -> DataFrame:
    """(key, n_rows, least_iou, largest_score_error, passed) for two lists of boxes in order (key, place, class, x, top, w, h, score).

    A place that only one side has doesn't pass.
    """
    box = lambda k: [F.col(f"{k}.{c}") for c in ("x", "top", "w", "h")]
    both = a.alias("a").join(b.alias("b"), (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"a.{place}") == F.col(f"b.{place}")), "full")
    rows = both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), sphere.box_iou(box("a"), box("b"), 1.0).alias("iou"), F.abs(F.col("a.score") - F.col("b.score")).alias("off"), (F.col("a.class") == F.col("b.class")).alias("same"))
    ok = F.coalesce(F.col("same") & (F.col("off") <= MOST_SCORE_ERROR) & (F.col("iou") >= LEAST_IOU), F.lit(False))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.min("iou").alias("least_iou"), F.max("off").alias("largest_score_error"), F.bool_and(ok).alias("passed"))


def checksum_mismatches(contents: DataFrame, manifest: DataFrame, key: str, content: str) -> DataFrame:
    """(key, rule_id) for contents whose SHA-256 isn't the manifest's ``declared`` one (``checksum``), or not there (``undeclared``)."""
    made = contents.select(key, F.sha2(content, 256).alias("_made")).join(manifest.select(key, "declared"), key, "left")
    rule = F.when(F.col("declared").isNull(), "undeclared").when(F.col("declared") != F.col("_made"), "checksum")
    return made.select(key, rule.alias("rule_id")).where("rule_id is not null")
