"""The domain's ordered state machines over one source's rows, as streaming folds (see ``ordered``)."""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.ordered import fold, kind_of


def temporal_nms(df: DataFrame, key: str, t: str, score: str, row_id: str, separation: float) -> DataFrame:
    """Rows kept by greedy suppression: best score first (then earlier, then id), at least ``separation`` apart.

    State is the kept times of one key, of which there are at most its span over the separation.
    """
    rows = df.select(key, (-F.col(score)).alias("_best"), F.col(t).cast("double").alias("_t"), F.col(row_id).alias("_id"))

    def step(kept: list, row: tuple):
        _, worst, at, row_id = row
        place = bisect.bisect_left(kept, at)
        if all(abs(at - kept[i]) >= separation for i in (place - 1, place) if 0 <= i < len(kept)):
            kept.insert(place, at)
            yield row[0], row_id, at, -worst

    made = fold(rows, [key], ["_best", "_t", "_id"], list, step, f"{key} {kind_of(df, key)}, {row_id} {kind_of(df, row_id)}, {t} double, {score} double")
    return made


@dataclass
class Track:
    phase: str = "active"
    confidence: float | None = 0.0
    missing: int = 0
    outside: int = 0
    began: bool = False


def lifecycle(df: DataFrame, key: str, order: str, kind: str, confidence: str, missing_grace: int = 2, exit_grace: int = 1, decay: float = 0.75) -> DataFrame:
    """Track states row by row: active, grace, viewport_exit, terminated.

    ``kind``: observed, not_observed or outside_viewport; each kind of miss sets the other's counter back. The
    states are the longest valid prefix: rows before the first observation and after termination have none, as
    a track starts from an observation and a terminated one takes no events (``lifecycle_violations`` lists them).
    """
    rows = df.select(key, F.col(order).cast("long").alias("_o"), F.col(kind).alias("_k"), F.col(confidence).cast("double").alias("_c"))

    def step(track: Track, row: tuple):
        of, at, what, sure = row
        if track.phase == "terminated" or not (track.began or what == "observed"):
            return
        track.began = True
        if what == "observed":
            track.phase, track.confidence, track.missing, track.outside = "active", sure, 0, 0
        else:
            track.confidence = None if track.confidence is None else track.confidence * decay
            track.missing = track.missing + 1 if what == "not_observed" else 0
            track.outside = track.outside + 1 if what == "outside_viewport" else 0
            waits = "grace" if what == "not_observed" else "viewport_exit"
            track.phase = "terminated" if track.missing > missing_grace or track.outside > exit_grace else waits
        yield of, at, track.phase, track.confidence, track.missing, track.outside

    return fold(rows, [key], ["_o"], Track, step, f"{key} {kind_of(df, key)}, {order} long, phase string, confidence double, missing int, outside int")


def refresh_kinds(df: DataFrame, outcome: str) -> DataFrame:
    """``df`` with ``kind``: only a compatible refresh is an observation; missing and ambiguous ones are none."""
    return df.withColumn("kind", F.when(F.col(outcome) == "compatible", "observed").otherwise("not_observed"))


def lifecycle_violations(df: DataFrame, states: DataFrame, key: str, order: str, outcome: str, confidence: str) -> DataFrame:
    """(rule_id, key, order) for rows that a refresh lifecycle may not have.

    A lifecycle begins with a compatible refresh, a compatible refresh has a confidence, times are unique, and
    nothing follows termination.
    """
    rows, w = df.select(key, order, outcome, confidence), Window.partitionBy(key).orderBy(order)
    flagged = rows.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag(order).over(w))
    rules = {
        "starts_without_match": (F.col("_n") == 1) & (F.col(outcome) != "compatible"),
        "match_without_confidence": (F.col(outcome) == "compatible") & F.col(confidence).isNull(),
        "time_does_not_increase": F.col("_before") >= F.col(order),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    own = flagged.select(F.explode(broken).alias("rule_id"), key, order)
    ended = states.where("phase = 'terminated'").select(F.col(key).alias("_key"), F.col(order).alias("_end"))
    late = rows.join(ended, (F.col(key) == F.col("_key")) & (F.col(order) > F.col("_end")))
    return own.unionAll(late.select(F.lit("after_termination"), key, order))


def sparse_keyframes(df: DataFrame, key: str, order: str, selected: str, yaw: str, pitch: str, h_fov: str, threshold: float) -> DataFrame:
    """Camera keyframes: the first row, rows whose selection changes, and rows that have moved by at least
    ``threshold`` (great-circle) from the last emitted one; the last row's pose ends the path."""
    rows = df.select(key, F.col(order).cast("double").alias("_o"), F.col(selected).cast("string").alias("_s"), *[F.col(c).cast("double").alias(f"_{n}") for n, c in zip(("y", "p", "f"), (yaw, pitch, h_fov), strict=True)])

    def step(held: list, row: tuple):
        last = held[0] if held else None
        moved = last is not None and _angle(last[3], last[4], row[3], row[4]) >= threshold
        if last is None or last[2] != row[2] or moved:
            held[:] = [row, row, True]
            yield row
        else:
            held[1:] = [row, False]

    def finish(held: list):
        if held and not held[2]:
            yield held[1]

    kinds = f"{key} {kind_of(df, key)}, {order} double, {selected} string, yaw double, pitch double, h_fov double"
    return fold(rows, [key], ["_o"], list, step, kinds, finish=finish)


def _angle(yaw_a: float, pitch_a: float, yaw_b: float, pitch_b: float) -> float:
    """Great-circle distance of two directions, as ``sphere.distance``; to the last bit as SQL has it, so no hypot."""
    ax, ay, az = math.cos(pitch_a) * math.sin(yaw_a), math.sin(pitch_a), math.cos(pitch_a) * math.cos(yaw_a)
    bx, by, bz = math.cos(pitch_b) * math.sin(yaw_b), math.sin(pitch_b), math.cos(pitch_b) * math.cos(yaw_b)
    cx, cy, cz = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
    return math.atan2(math.sqrt(cx * cx + cy * cy + cz * cz), ax * bx + ay * by + az * bz)


@dataclass
class Reliability:
    scores: dict = field(default_factory=dict)
    pairs: int = 0


def causal_reliability(df: DataFrame, key: str, order: str, view: str, distance: str, keep: int, alpha: float = 0.2) -> DataFrame:
    """Which views a pair should trust, judged by earlier pairs only: (key, order, view, reliability, place, selected).

    ``distance``: a view's rotation distance from the pair's medoid. The first pair selects all of its views;
    then scores are that pair's distances, and each later pair moves them by ``alpha``. The ``keep`` lowest
    scores are selected, ties by view. Views without a score of their own (new ones) rank as 0. State is one score for each view.
    """
    rows = df.select(key, F.col(order).cast("long").alias("_o"), F.col(view).cast("string").alias("_v"), F.col(distance).cast("double").alias("_d"))

    def step(state: Reliability, rows: list):
        found = {row[2]: row[3] for row in rows}
        ranked = sorted(found, key=lambda v: (state.scores.get(v, 0.0), v))
        for place, v in enumerate(ranked, 1):
            yield rows[0][0], rows[0][1], v, state.scores.get(v) if state.pairs else None, place, state.pairs == 0 or place <= keep
        for v, d in found.items():
            state.scores[v] = d if state.pairs == 0 else (1 - alpha) * state.scores.get(v, 0.0) + alpha * d
        state.pairs += 1

    kinds = f"{key} {kind_of(df, key)}, {order} long, {view} string, reliability double, place int, selected boolean"
    return fold(rows, [key], ["_o", "_v"], Reliability, step, kinds, frame=1)


@dataclass
class TwoWays:
    """The best totals of a source's events so far that end with the current candidate kept, and with a cut.

    ``order``: the sign of comparing the two ways' candidate ids; ``back``: for each event what both ways came from.
    """

    keep: float = 0.0
    cut: float = -math.inf
    proposed: str | None = None
    order: int = 0
    back: list = field(default_factory=list)

    def better(self, keep: float, cut: float) -> int:
        """0 if the way that kept is the one to go on from, 1 if the one that cut is."""
        return int(cut > keep or (cut == keep and self.order > 0))


def choose_events(events: DataFrame, key: str, order: str, *, switch: float, angular: float, repeat: float, least_dwell: float, least_advantage: float) -> DataFrame:
    """The plan of a source's events with the greatest total: keep the current candidate or cut to the proposed one.

    ``events``: key, order, start, end, current_id, proposed_id, current_total, proposed_total, observed (the
    proposal's semantics) and angle (between the two views). A proposal is eligible if it is observed, lasts
    ``least_dwell`` and is better by ``least_advantage``. It costs twice ``switch`` and twice ``angular`` times
    the angle, and ``repeat`` if the event before chose the same candidate. Equal totals go to the path of
    lesser candidate ids. Events of one source are sparse; what each came from is held until its last one.

    As an event proposes one candidate, there are two ways to end in it, and a step is a 2 x 2 product in (max, +):
    keep' = here + max(keep, cut), cut' = there - cost + max(keep, cut - repeat). Of ways with equal totals the order of
    their ids is carried along, so nothing is walked back before the end.
    """
    names = ["start", "end", "current_id", "proposed_id", "current_total", "proposed_total", "observed", "angle"]
    rows = events.select(key, order, *names)

    def step(ways: TwoWays, row: tuple):
        start, end, current, proposed, here, there, observed, angle = row[2:]
        eligible = bool(observed) and end - start >= least_dwell and there >= here + least_advantage
        costs = [2.0 * (switch + angular * angle)] * 2  # of a cut after a kept event, and after another cut
        costs[1] += repeat if ways.proposed == proposed else 0.0
        to_keep = [ways.keep + here, ways.cut + here]
        to_cut = [ways.keep + there - costs[0], ways.cut + there - costs[1]] if eligible else [-math.inf] * 2
        via = [ways.better(*to_keep), ways.better(*to_cut)]
        ways.back.append((*row[:2], eligible, (current, proposed), via, costs))
        ahead = 0 if via[0] == via[1] else ways.order * (1 - 2 * via[0])
        ways.order = ahead or (current > proposed) - (current < proposed)
        ways.keep, ways.cut, ways.proposed = to_keep[via[0]], to_cut[via[1]], proposed
        return ()

    def finish(ways: TwoWays):
        at, objective, chosen = ways.better(ways.keep, ways.cut), max(ways.keep, ways.cut), []
        for of, when, eligible, ids, via, costs in reversed(ways.back):
            chosen.append((of, when, ids[at], costs[via[1]] if at else 0.0, eligible, objective))
            at = via[at]
        yield from reversed(chosen)

    kinds = f"{key} {kind_of(events, key)}, {order} {kind_of(events, order)}, selected string, cost double, eligible boolean, objective double"
    return fold(rows, [key], [order], TwoWays, step, kinds, finish=finish)


@dataclass
class Selection:
    own: str | None = None
    since: float = 0.0
    rival: str | None = None
    rival_since: float = 0.0


# The planner's reason codes.
REASONS = ("initial_best", "incumbent_missing_fallback", "incumbent_best", "minimum_dwell", "switch_margin", "challenger_hysteresis", "sustained_challenger")


def selection_step(dwell: float, margin: float, hold: float):
    """What one moment's candidates, best first, as rows (key, time, -utility, candidate), make of a selection."""

    def step(s: Selection, rows: list):
        of, now, worst, best = rows[0]
        mine = next((-row[2] for row in rows if row[3] == s.own), -math.inf)
        led = s.rival_since if s.rival == best else now
        holds = (s.own is None, mine == -math.inf, best == s.own, now - s.since < dwell, -worst < mine + margin, now - led < hold, True)
        reason = REASONS[holds.index(True)]  # the first that holds
        takes, had = reason in ("initial_best", "incumbent_missing_fallback", "sustained_challenger"), s.own is not None
        if takes:
            s.own, s.since = best, now
        s.rival, s.rival_since = (best, led) if reason == "challenger_hysteresis" else (None, 0.0)
        yield of, now, s.own, reason, takes and had

    return step


def greedy_hysteresis(df: DataFrame, key: str, at: str, candidate: str, utility: str, dwell: float = 2.0, margin: float = 0.1, hold: float = 0.5) -> DataFrame:
    """One selection for each key and time: (key, at, selected, reason, switched).

    The best candidate (ties: least name) replaces a present incumbent only after its dwell, by at least
    ``margin``, and once it has led for ``hold`` seconds; an absent incumbent is replaced at once.
    """
    rows = df.select(key, F.col(at).cast("double").alias("_o"), (-F.col(utility)).alias("_worst"), F.col(candidate).cast("string").alias("_id"))
    kinds = f"{key} {kind_of(df, key)}, {at} double, selected string, reason string, switched boolean"
    return fold(rows, [key], ["_o", "_worst", "_id"], Selection, selection_step(dwell, margin, hold), kinds, frame=1)


def box_nms(df: DataFrame, keys: list[str], box: list[str], score: str, row_id: list[str], most_overlap: float = 0.45) -> DataFrame:
    """Rows kept by greedy suppression within each key: best score first, then the id columns' order.

    A row stays unless it overlaps a kept one by more than ``most_overlap``. With the class among the keys
    suppression is class-aware; state is a frame's kept boxes of one class. Equal rows keep one of them if the
    overlap of a box with itself is above the bound; boxes without area overlap nothing.
    """
    ids = [f"_i{n}" for n in range(len(row_id))]
    rows = df.select(*keys, (-F.col(score)).alias("_best"), *[F.col(c).alias(i) for c, i in zip(row_id, ids, strict=True)], *[F.col(c).cast("double").alias(f"_b{n}") for n, c in enumerate(box)])
    first = len(keys)

    def step(kept: list, row: tuple):
        mine = row[first + 1 + len(ids) :]
        if all(_iou(mine, other) <= most_overlap for other in kept):
            kept.append(mine)
            yield (*row[:first], *row[first + 1 : first + 1 + len(ids)], -row[first])

    kinds = ", ".join([*(f"{c} {kind_of(df, c)}" for c in [*keys, *row_id]), f"{score} double"])
    return fold(rows, keys, ["_best", *ids], list, step, kinds)


def _iou(a: tuple, b: tuple) -> float:
    wide, high = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    shared = max(0.0, wide) * max(0.0, high)
    union = a[2] * a[3] + b[2] * b[3] - shared
    return shared / union if union > 0 else 0.0


def acquisitions(df: DataFrame, key: str, at: str, outcome: str, confirmations: int = 2, least_span: float = 0.25, most_gap: float = 1.0) -> DataFrame:
    """Every refresh after termination with its streak: (key, at, outcome, consecutive, span, acquired).

    A compatible refresh continues the streak if it follows the last compatible one by at most ``most_gap``, and
    begins a new one otherwise; any other outcome ends it. The first refresh with ``confirmations`` in a row
    over at least ``least_span`` acquires a track. A window form: islands by reset flags.
    """
    w = Window.partitionBy(key).orderBy(at)
    fits = F.col(outcome) == "compatible"
    # the row before is the last compatible one or the streak has ended
    opens = fits & ~F.coalesce(F.lag(outcome).over(w) == "compatible", F.lit(False)) | fits & (F.col(at) - F.lag(at).over(w) > most_gap)
    flagged = df.select(key, at, outcome, fits.alias("_fits"), opens.alias("_opens"))
    flagged = flagged.withColumn("_run", F.sum((F.col("_opens") | ~F.col("_fits")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = Window.partitionBy(key, "_run").orderBy(at)
    counted = flagged.withColumn("consecutive", F.when(F.col("_fits"), F.row_number().over(v)).otherwise(0)).withColumn("span", F.when(F.col("_fits"), F.col(at) - F.first(at).over(v)).otherwise(0.0))
    able = (F.col("consecutive") >= confirmations) & (F.col("span") >= least_span)
    first = F.min(F.when(able, F.col(at))).over(Window.partitionBy(key))
    return counted.withColumn("acquired", F.coalesce(F.col(at) == first, F.lit(False))).select(key, at, outcome, "consecutive", "span", "acquired")


