"""Structured Streaming twins of sessions, track states and selections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orbweave.operators.folds import Selection, selection_step

_STATES = "{key} {kind}, o long, phase string, confidence double, missing int, outside int"


def sessions_stream(df: DataFrame, key: str, at: str, gap: str, lateness: str, support: int) -> DataFrame:
    """(key, start, end, support): runs of times less than ``gap`` apart, once the watermark has passed them.

    ``end`` is the gap after the last time. Rows later than ``lateness`` behind the watermark don't count, as
    in any watermarked aggregate. State is one open run for each key.
    """
    runs = df.withWatermark(at, lateness).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("support"))
    return runs.where(F.col("support") >= support).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "support")


def lifecycle_stream(df: DataFrame, key: str, order: str, kind: str, confidence: str, missing_grace: int = 2, exit_grace: int = 1, decay: float = 0.75) -> DataFrame:
    """Track states as ``operators.folds.lifecycle`` gives them, for rows that arrive in their tracks' order.

    State is five values for each track. A micro-batch's rows are put in order; a row that isn't later than
    what an earlier micro-batch brought gets the phase ``late`` with the track's values and changes nothing.
    """
    key_type = df.schema[key].dataType.simpleString()

    def advance(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, phase, sure, missing, outside = state.get if state.exists else (None, "waiting", 0.0, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["o", "k", "c"])
        out, before = [], last
        for o, k, c in zip(rows["o"].tolist(), rows["k"].tolist(), rows["c"].tolist(), strict=True):
            if before is not None and o <= before:
                out.append((group[0], o, "late", sure, missing, outside))
                continue
            last = o
            if phase == "terminated" or (phase == "waiting" and k != "observed"):
                continue
            missing = missing + 1 if k == "not_observed" else 0
            outside = outside + 1 if k == "outside_viewport" else 0
            sure = c if k == "observed" else sure * decay
            over = missing > missing_grace or outside > exit_grace
            phase = "active" if k == "observed" else "terminated" if over else "grace" if k == "not_observed" else "viewport_exit"
            out.append((group[0], o, phase, sure, missing, outside))
        if last is not None:
            state.update((int(last), phase, float(sure), int(missing), int(outside)))
        yield pd.DataFrame(out, columns=[key, "o", "phase", "confidence", "missing", "outside"])

    rows = df.select(key, F.col(order).cast("long").alias("o"), F.col(kind).alias("k"), F.col(confidence).cast("double").alias("c"))
    made = rows.groupBy(key).applyInPandasWithState(advance, _STATES.format(key=key, kind=key_type), "last long, phase string, sure double, missing int, outside int", "append", GroupStateTimeout.NoTimeout)
    return made.withColumnRenamed("o", order)


def selections_stream(df: DataFrame, key: str, at: str, candidate: str, utility: str, dwell: float = 2.0, margin: float = 0.1, hold: float = 0.5) -> DataFrame:
    """Selections as ``operators.folds.greedy_hysteresis`` gives them, for moments that arrive whole and in order.

    State is four values for each key. A micro-batch's moments are put in order; one that isn't later than what an
    earlier micro-batch brought gets the reason ``late`` with the selection as it stands and changes nothing.
    """
    key_type, step = df.schema[key].dataType.simpleString(), selection_step(dwell, margin, hold)

    def advance(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *held = state.get if state.exists else (None, None, 0.0, None, 0.0)
        selection, out, before = Selection(*held), [], last
        rows = pd.concat(list(frames)).sort_values(["o", "worst", "id"])
        for now, moment in rows.groupby("o", sort=True):
            if before is not None and now <= before:
                out.append((group[0], float(now), selection.own, "late", False))
                continue
            last = float(now)
            out += step(selection, list(zip([group[0]] * len(moment), moment["o"].tolist(), moment["worst"].tolist(), moment["id"].tolist(), strict=True)))
        if last is not None:
            state.update((float(last), selection.own, float(selection.since), selection.rival, float(selection.rival_since)))
        yield pd.DataFrame(out, columns=[key, "o", "selected", "reason", "switched"])

    rows = df.select(key, F.col(at).cast("double").alias("o"), (-F.col(utility)).alias("worst"), F.col(candidate).cast("string").alias("id"))
    made = rows.groupBy(key).applyInPandasWithState(advance, f"{key} {key_type}, o double, selected string, reason string, switched boolean", "last double, own string, since double, rival string, rival_since double", "append", GroupStateTimeout.NoTimeout)
    return made.withColumnRenamed("o", at)
