"""Association as a stream with many open tracks for each source: map state, and event-time timers that close frames."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orbweave.operators import tracking

_ROW = {"frame": "long", "ms": "long", "kind": "string", "o_yaw": "double", "o_pitch": "double", "o_h_fov": "double", "id": "long", "yaw": "double", "pitch": "double", "h_fov": "double", "upstream": "string", "marks": "boolean"}
_TRACK = "kind string, upstream string, yaw double, pitch double, h_fov double, first long, seen long, missing long"
_ORDER = ["frame", "kind", "o_yaw", "o_pitch", "o_h_fov", "id"]  # as tracking.OBSERVATION_ORDER; names can't begin with underscores here


_KINDS = {"long": int, "double": float, "string": str, "boolean": bool}


def _plain(value, kind=None):
    """A cell as Python's own type; pandas' missing values are None."""
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    return value if kind is None else kind(value)


class Association(StatefulProcessor):
    """Rows wait until the watermark has passed their moment; then their frames go, in order, through the batch step.

    State of a source: its open tracks by number, the rows that wait, and the next track's number.
    """

    def __init__(self, key: str, radius: float, grace: int):
        self.key, self.step = key, tracking.association_step(radius, grace)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracks = handle.getMapState("tracks", "name long", _TRACK)
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {k}" for n, k in _ROW.items()))
        self.place = handle.getValueState("place", "next long")

    def frame_of(self, rows: list[tuple]) -> pd.DataFrame:
        names = [self.key, "frame", *(x.split()[0] for x in tracking._FRAMES.split(", "))]
        return pd.DataFrame(rows, columns=names).astype({"source_candidate": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moments = set()
        for frame in rows:
            for row in zip(*(frame[n] for n in _ROW), strict=True):
                row = tuple(map(_plain, row, map(_KINDS.get, _ROW.values())))
                self.waiting.appendValue(row)
                moments.add(row[1])
        for ms in moments:
            self.handle.registerTimer(ms)
        yield self.frame_of([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        rows = [dict(zip(_ROW, map(_plain, r), strict=True)) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r["ms"] <= upto), key=lambda r: [(r[n] is not None, r[n] if r[n] is not None else 0) for n in _ORDER])
        if not ready:
            return
        nxt = self.place.get()[0] if self.place.exists() else 1
        state = tracking.Tracks({name[0]: tracking.Track(*map(_plain, t)) for name, t in self.tracks.iterator()} if self.tracks.exists() else {}, nxt)
        state.open = dict(sorted(state.open.items()))
        before, out = set(state.open), []
        for frame in sorted({r["frame"] for r in ready}):
            out += self.step(state, key[0], frame, [r for r in ready if r["frame"] == frame and not r["marks"]])
        for name in before - set(state.open):
            self.tracks.removeKey((name,))
        for name, track in state.open.items():
            self.tracks.updateValue((name,), astuple(track))
        self.place.update((state.next,))
        self.waiting.clear()
        if rest := [tuple(r.values()) for r in rows if r["ms"] > upto]:
            self.waiting.put(rest)
        yield self.frame_of(out)

    def close(self) -> None:
        pass


def associate_stream(observations: DataFrame, key: str, at: str, lateness: str, radius: float = math.radians(25), grace: int = 2) -> DataFrame:
    """Rows of ``tracking.associate`` for a stream: (key, frame, candidate_id, ..., provenance).

    ``observations``: key, at (timestamp, one for each frame of a source, rising with it), frame, id, kind, yaw, pitch, h_fov,
    upstream; a row whose id is null marks a frame in which nothing may have been seen. A frame goes when the watermark,
    ``lateness`` behind the latest moment, has passed it, so a frame's rows may come in any micro-batches and any order. Rows
    that come later are dropped by the watermark, change nothing and are counted in the query's progress
    (numRowsDroppedByWatermark). Needs the RocksDB state store.
    """
    marks = F.col("id").isNull()
    rows = tracking.in_observation_order(observations.withWatermark(at, lateness)).select(key, at, F.unix_millis(F.col(at).cast("timestamp")).alias("ms"), "frame", "kind", *[F.col(f"_{c}").alias(f"o_{c}") for c in ("yaw", "pitch", "h_fov")], "id", "yaw", "pitch", "h_fov", "upstream", marks.alias("marks"))
    kind = observations.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithStateInPandas(Association(key, radius, grace), f"{key} {kind}, frame long, {tracking._FRAMES}", "Append", "EventTime")
