"""Interval algebra over (source, start, end) rows: windows and equality-keyed range joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, aggregates: dict[str, Column], slack: float = 1e-9, touching: bool = True) -> DataFrame:
    """Unions of intervals that overlap, or touch within ``slack``; ``aggregates`` summarise each union's members."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) > reach + slack if touching else F.col(start) >= reach
    flagged = df.withColumn("_new", F.when(reach.isNull() | apart, 1).otherwise(0))
    grouped = flagged.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_run").agg(F.min(start).alias("start"), F.max(end).alias("end"), *[c.alias(n) for n, c in aggregates.items()]).drop("_run")


def sessions(df: DataFrame, keys: list[str], at: str, gap: float, tail: float, support: int) -> DataFrame:
    """Runs of distinct times no more than ``gap`` apart; each ends ``tail`` after its last time."""
    order = Window.partitionBy(*keys).orderBy(at)
    times = df.select(*keys, at).distinct()
    times = times.withColumn("_new", F.when(F.col(at) - F.lag(at).over(order) > gap, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(order))
    runs = times.groupBy(*keys, "_run").agg(F.min(at).alias("start"), (F.max(at) + tail).alias("end"), F.count(F.lit(1)).alias("support"))
    return runs.where(F.col("support") >= support).drop("_run")


def runs_of(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``run``: the number of its stretch of equal values within the key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w)).drop("_changed")


_UNBOUNDED = 9999  # stands for the level of intervals without a finite length


def _length_level() -> Column:
    """The power of two that an interval's length doesn't exceed; null for intervals without one."""
    length = F.col("end") - F.col("start")
    finite = (F.abs("start") < float("inf")) & (F.abs("end") < float("inf"))
    return F.when(~finite, _UNBOUNDED).when(length > 0, F.ceil(F.log2(length)).cast("int"))


def _slot_levels(left: DataFrame, right: DataFrame) -> tuple[float, float, int, int, list[int], list[int]]:
    """(least and greatest bound, level of short and of unbounded intervals, levels of either side), out of one pass over both.

    The level of an interval is the power of two that its length doesn't exceed; what is shorter than half of all intervals
    shares the base level. The pass gives a row for each side and level, so at most as many as there are exponents.
    """
    side = lambda df, n: df.select(F.lit(n).alias("side"), _length_level().alias("level"), *[F.when(F.abs(c) < float("inf"), F.col(c)).alias(c) for c in ("start", "end")])
    rows = side(left, 0).unionAll(side(right, 1)).groupBy("side", "level").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("start", "end")).alias("low"), F.max(F.greatest("start", "end")).alias("high")).collect()
    low, high = min((r["low"] for r in rows if r["low"] is not None), default=0.0), max((r["high"] for r in rows if r["high"] is not None), default=0.0)
    known = sorted((r["level"], r["n"]) for r in rows if r["level"] not in (None, _UNBOUNDED))
    base, below = math.ceil(math.log2((high - low) / max(sum(r["n"] for r in rows), 1))) if high > low else 0, 0
    for level, n in known:
        base, below = level, below + n
        if 2 * below >= sum(x for _, x in known):
            break
    base = max(base, math.ceil(math.log2(max(abs(low), abs(high), 1.0))) - 50)  # slots are numbered within 64 bits
    whole = max(base, math.ceil(math.log2(high - low)) if high > low else base)
    of = lambda n: sorted({whole if r["level"] == _UNBOUNDED else max(base, base if r["level"] is None else r["level"]) for r in rows if r["side"] == n})
    return low, high, base, whole, of(0), of(1)


def overlaps(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of half-open intervals of one key that overlap, with the part they share.

    An equality join on slots of time, whose width grows with an interval's level (``_slot_levels``), so that each spans two
    or three slots at its own level. A pair meets at the coarser of its two levels, in the slot where its common part
    begins and in no other. So the intervals of one key are dealt to many tasks, and a short interval meets those near it
    and the long ones over it, not all of its key. Bounds may be infinite; null bounds overlap nothing.
    """
    low, high, base, whole, of_left, of_right = _slot_levels(left, right)
    clamped = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), c))
    slot = lambda t, level: F.floor(t / F.pow(F.lit(2.0), level)).cast("long")

    def dealt(df: DataFrame, own: list[int], others: list[int]) -> DataFrame:
        level = F.when(_length_level() == _UNBOUNDED, whole).otherwise(F.greatest(F.lit(base), F.coalesce(_length_level(), F.lit(base))))
        meets = F.filter(F.array(*map(F.lit, sorted({*own, *others, base}))), lambda x: (x == F.col("_level")) | ((x > F.col("_level")) & x.isin(others)))
        spread = df.where("start is not null and end is not null").withColumn("_level", level).withColumn("_at", F.explode(meets))
        first, last = slot(clamped(F.col("start")), F.col("_at")), slot(clamped(F.greatest("start", "end")), F.col("_at"))
        return spread.withColumn("_slot", F.explode(F.sequence(first, last)))

    a, b = dealt(left, of_left, of_right).alias("a"), dealt(right, of_right, of_left).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_at", "_slot"]]
    start, end = F.greatest("a.start", "b.start"), F.least("a.end", "b.end")
    once = (F.greatest("a._level", "b._level") == F.col("a._at")) & (slot(clamped(start), F.col("a._at")) == F.col("a._slot"))
    joined = a.join(b, [*on, F.col("a.start") < F.col("b.end"), F.col("b.start") < F.col("a.end"), once])
    kept = [F.col(f"a.{c}").alias(c) for c in left.columns] + [F.col(f"b.{c}").alias(c if c not in left.columns else f"{c}_right") for c in right.columns if c not in keys]
    return joined.select(*kept, start.alias("clip_start"), end.alias("clip_end"))


def elementary_cover(spans: DataFrame, overlays: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Spans cut at the overlays' bounds, each piece with the overlay's value or the default; equal neighbours join.

    Overlays of one key are disjoint and inside its span, so a piece is its lower bound's overlay or none.
    """
    cut = lambda t, v: F.struct(F.col(t).alias("t"), v.cast("string").alias("v"))
    bounds = lambda df, at_start, at_end: df.select(key, F.inline(F.array(cut("start", at_start), cut("end", at_end))))
    cuts = bounds(spans, F.lit(default), F.lit(None)).unionAll(bounds(overlays, F.col(value), F.lit(default)))
    # at one bound an overlay's begin wins over another's end, and the span's end over both
    best = cuts.groupBy(key, "t").agg(F.max(F.struct(F.when(F.col("v").isNull(), 2).when(F.col("v") == default, 0).otherwise(1).alias("p"), "v")).alias("b"))
    w = Window.partitionBy(key).orderBy("t")
    pieces = best.select(key, F.col("t").alias("start"), F.lead("t").over(w).alias("end"), F.col("b.v").alias("value")).where("end is not null")
    return runs_of(pieces, [key], ["start"], "value").groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("value").alias("value")).drop("run")


def asof_bracket(times: DataFrame, knots: DataFrame, key: str, value: str) -> DataFrame:
    """For each time the knots around it: (t0, v0) at or before, (t1, v1) after; null beyond the ends."""
    both = times.select(key, "t", F.lit(1).alias("_ask"), F.lit(None).cast("double").alias("_v")).unionAll(knots.select(key, "t", F.lit(0).alias("_ask"), F.col(value).cast("double").alias("_v")))
    mark = F.when(F.col("_ask") == 0, F.struct("t", "_v"))
    w = Window.partitionBy(key).orderBy("t", "_ask")
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    found = both.select(key, "t", "_ask", before.alias("a"), after.alias("b")).where("_ask = 1")
    return found.select(key, "t", F.col("a.t").alias("t0"), F.col("a._v").alias("v0"), F.col("b.t").alias("t1"), F.col("b._v").alias("v1"))


def near_in_time(df: DataFrame, key: str, at: str, radius: float, names: list[str]) -> DataFrame:
    """Each row of ``df`` with each row of its key within ``radius`` of it, as an equality join on slots of time.

    A row meets its own slot and the two beside it, so a dense stretch costs its own neighbours and no more. The
    other row's columns ``names`` come with the prefix ``near_``.
    """
    slot = F.floor(F.col(at) / radius)
    mine = df.withColumn("_slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    theirs = df.select(F.col(key).alias("near_key"), F.col(at).alias("near_at"), slot.alias("_slot"), *[F.col(c).alias(f"near_{c}") for c in names])
    joined = mine.join(theirs, (F.col(key) == F.col("near_key")) & (mine["_slot"] == theirs["_slot"])).drop(mine["_slot"]).drop("near_key", "_slot")
    return joined.where(F.abs(F.col("near_at") - F.col(at)) <= radius)
