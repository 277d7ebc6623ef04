"""Registered queries: batch, tracking, motion and gap summaries, each by its own rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbweave.operators import motion, paths
from orbweave.plans import relations as r
from orbweave.plans.catalog import query, r6, rounded
from orbweave.plans.motion import _STEPS, PAIR, _steps


def distribution(value: str, prefix: str) -> list[Column]:
    """Median, nearest-rank 95th percentile and maximum of a column, nulls left out."""
    return [r6(F.median(value)).alias(f"{prefix}_median"), r6(F.expr(f"percentile_disc(0.95) within group (order by {value})")).alias(f"{prefix}_p95"), r6(F.max(value)).alias(f"{prefix}_max")]


def sql_distribution(value: str, prefix: str) -> str:
    return f"round(median({value}), 6) AS {prefix}_median, round(quantile_disc({value}, 0.95), 6) AS {prefix}_p95, round(max({value}), 6) AS {prefix}_max"


@query(f"""WITH {r.SIGNAL} SELECT kind, source_id, count(*) AS n, round(sum(score), 6) AS total FROM signal GROUP BY GROUPING SETS ((source_id, kind), (kind), ())""")
def agg05_batch_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-04: histograms by sample and kind, by kind and in total."""
    s = r.signal(spark, sf)
    made = s.groupingSets([["source_id", "kind"], ["kind"], []], "source_id", "kind").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score")).alias("total"))
    return made.select("kind", "source_id", "n", "total")


_BATCH = f"""{r.CANDIDATE}, log AS (SELECT frame, id, kind, CASE WHEN id % 17 = 0 THEN 'no metrics' ELSE '        ' || (id % 90) || '.25 real         1.00 user' || chr(10) || '   ' || (id * 1000) || '  maximum resident set size' END AS metrics, CASE WHEN id % 13 = 0 THEN 'VNError:5' END AS error FROM candidate),
 said AS (SELECT *, CASE WHEN regexp_matches(metrics, '([0-9.]+)\\s+real') THEN regexp_extract(metrics, '([0-9.]+)\\s+real', 1)::DOUBLE END AS elapsed, CASE WHEN regexp_matches(metrics, '(\\d+)\\s+maximum resident set size') THEN regexp_extract(metrics, '(\\d+)\\s+maximum resident set size', 1)::BIGINT END AS rss FROM log)"""


def _batch(spark, sf):
    i = F.col("id")
    text = F.concat(F.lit("        "), (i % 90).cast("string"), F.lit(".25 real         1.00 user\n   "), (i * 1000).cast("string"), F.lit("  maximum resident set size"))
    c = r.candidate(spark, sf).select("frame", "id", "kind", F.when(i % 17 == 0, "no metrics").otherwise(text).alias("metrics"), F.when(i % 13 == 0, "VNError:5").alias("error"))
    number = lambda pattern, kind: F.expr(f"try_cast(nullif(regexp_extract(metrics, '{pattern}', 1), '') as {kind})")
    return c.withColumn("elapsed", number(r"([0-9.]+)\\s+real", "double")).withColumn("rss", number(r"(\\d+)\\s+maximum resident set size", "bigint"))


@query(f"""WITH {_BATCH} SELECT frame, count(*) AS candidates, count(error) AS errors, round(sum(elapsed), 6) AS elapsed_total, round(max(elapsed), 6) AS elapsed_max, max(rss) AS rss_max FROM said GROUP BY GROUPING SETS ((frame), ())""")
def agg05_batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-05: candidates, errors, and run times and memory read from metrics text, by sample and for the batch."""
    made = _batch(spark, sf).groupingSets([["frame"], []], "frame").agg(F.count(F.lit(1)).alias("candidates"), F.count("error").alias("errors"), r6(F.sum("elapsed")).alias("elapsed_total"), r6(F.max("elapsed")).alias("elapsed_max"), F.max("rss").alias("rss_max"))
    return made.select("frame", "candidates", "errors", "elapsed_total", "elapsed_max", "rss_max")


@query(f"""WITH {_BATCH}, t AS (SELECT id // 100 AS doc, kind, error IS NULL OR id % 26 <> 0 AS supported, error, frame FROM said) SELECT doc, kind, count(*) AS candidates, count(error) AS errors, bool_and(supported) AS supported_everywhere, count(DISTINCT frame) AS timestamps FROM t GROUP BY doc, kind""")
def agg36_frame_gate_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-36: a document's candidates and errors by kind, and whether all its frames support the request."""
    supported = F.col("error").isNull() | (F.col("id") % 26 != 0)
    t = _batch(spark, sf).withColumn("doc", F.floor(F.col("id") / 100))
    return t.groupBy("doc", "kind").agg(F.count(F.lit(1)).alias("candidates"), F.count("error").alias("errors"), F.bool_and(supported).alias("supported_everywhere"), F.count_distinct("frame").alias("timestamps"))


_CLIPS = f"""{r.SIGNAL}, {r.CANDIDATE}, {r.POSE}, clip AS (SELECT source_id, i, yaw, pitch, CASE kind WHEN 'error' THEN 'error' WHEN 'view' THEN 'lost' ELSE 'tracked' END AS state FROM pose), seen AS (SELECT *, lag(yaw) OVER w AS y0, lag(pitch) OVER w AS p0 FROM clip WHERE state = 'tracked' WINDOW w AS (PARTITION BY source_id ORDER BY i)),
 step AS (SELECT a.source_id, a.i, {r.sql_distance("a", "b")} AS step, abs(a.yaw - b.yaw) > pi() AS seam FROM seen a JOIN (SELECT source_id, i, y0 AS yaw, p0 AS pitch FROM seen WHERE y0 IS NOT NULL) b USING (source_id, i)),
 s AS (SELECT source_id, max(step) AS most, count(*) FILTER (seam) AS seams FROM step GROUP BY source_id), c AS (SELECT source_id, count(*) AS requested, count(*) FILTER (state = 'tracked') AS tracked, count(*) FILTER (state = 'lost') AS lost, count(*) FILTER (state = 'error') AS errors FROM clip GROUP BY source_id),
 clips AS (SELECT c.*, s.most, coalesce(s.seams, 0) AS seams, CASE WHEN tracked > 0 THEN 'tracking_observations_returned' ELSE 'no_tracking_observations' END AS outcome FROM c LEFT JOIN s USING (source_id))"""


def _clips(spark, sf):
    state = F.when(F.col("kind") == "error", "error").when(F.col("kind") == "view", "lost").otherwise("tracked")
    return paths.track_summary(r.pose(spark, sf).select("source_id", "i", "yaw", "pitch", state.alias("state")), "source_id", "i")


@query(f"""WITH {_CLIPS} SELECT source_id, outcome, requested, tracked, lost, errors, round(tracked / requested, 6) AS persistence, round(most, 6) AS maximum_step, seams FROM clips""")
def agg07_track_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-07: how long a clip was tracked, its greatest step between tracked frames, and how often it crossed the seam."""
    return rounded(_clips(spark, sf), "persistence", "maximum_step")


@query(f"""WITH {_CLIPS} SELECT source_id % 3 AS batch, outcome, count(*) AS clips, sum(requested)::BIGINT AS requested, sum(tracked)::BIGINT AS tracked, sum(lost)::BIGINT AS lost, sum(errors)::BIGINT AS errors, round(sum(tracked) / sum(requested), 6) AS weighted_persistence, round(max(most), 6) AS maximum_step, sum(seams)::BIGINT AS seams FROM clips GROUP BY ALL""")
def agg06_tracking_batch(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-06: outcomes of a batch of clips, persistence weighted by frames, and the greatest step known."""
    c = _clips(spark, sf).withColumn("batch", F.col("source_id") % 3)
    sums = [F.sum(k).alias(k) for k in ("requested", "tracked", "lost", "errors", "seams")]
    made = c.groupBy("batch", "outcome").agg(F.count(F.lit(1)).alias("clips"), *sums, F.max("maximum_step").alias("maximum_step"))
    return rounded(made.withColumn("weighted_persistence", F.try_divide("tracked", "requested")), "weighted_persistence", "maximum_step")


# Diagnostics of pairs and trials, from rotations: a trial's step and residual, its state and why it failed.
_TRIALS = f"""{r.QUATERNION}, trial AS (SELECT vec_id // 24 AS pair, (vec_id // 4) % 6 AS view, vec_id % 4 AS source, 2 * acos(least(abs(w), 1)) AS step, abs(x) AS residual, vec_id FROM quaternion),
 judged AS (SELECT *, CASE WHEN step > 2.9 THEN 'rotation_step_exceeds_configured_bound' WHEN residual > 0.8 THEN 'rotation_fit_residual_exceeds_bound' END AS reason, CASE WHEN vec_id % 19 = 0 THEN NULL ELSE step END AS known_step FROM trial)"""


def _trials(spark, sf):
    v = F.col("vec_id")
    t = r.quaternion(spark, sf).select("vec_id", F.floor(v / 24).alias("pair"), (F.floor(v / 4) % 6).alias("view"), (v % 4).alias("source"), (2 * F.acos(F.least(F.abs("w"), F.lit(1.0)))).alias("step"), F.abs("x").alias("residual"))
    reason = F.when(F.col("step") > 2.9, motion.FIT_REASONS[0]).when(F.col("residual") > 0.8, motion.FIT_REASONS[3])
    return t.select("*", reason.alias("reason"), F.when(v % 19 != 0, F.col("step")).alias("known_step"))


_SUMMED = "count(*) AS pairs, count(*) FILTER (reason IS NULL) AS measured, round(count(*) FILTER (reason IS NULL) / count(*), 6) AS measured_fraction"


def _summed() -> list[Column]:
    ok = F.count_if(F.col("reason").isNull())
    return [F.count(F.lit(1)).alias("pairs"), ok.alias("measured"), r6(ok / F.count(F.lit(1))).alias("measured_fraction")]


@query(f"""WITH {_TRIALS} SELECT view, {_SUMMED}, {sql_distribution("known_step", "step")}, {sql_distribution("residual", "residual")} FROM judged GROUP BY view""")
def agg11_leave_one_out(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11: trials by the view they leave out: how many are measured, and their steps and residuals."""
    return _trials(spark, sf).groupBy("view").agg(*_summed(), *distribution("known_step", "step"), *distribution("residual", "residual"))


@query(f"""WITH {_TRIALS} SELECT view, reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY view, reason""")
def agg11_failure_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-11..13, 15: why trials failed, by the view they leave out."""
    return _trials(spark, sf).where("reason is not null").groupBy("view", "reason").agg(F.count(F.lit(1)).alias("n"))


_CHOSEN = f"""{_TRIALS}, chosen AS (SELECT source, pair, any_value(view) AS any_view, count(*) FILTER (residual <= 0.4) AS n_selected, max(known_step) AS step, avg(residual) AS residual, CASE WHEN count(*) FILTER (residual <= 0.4) < 3 THEN 'insufficient_view_consensus' WHEN max(step) > 3.0 THEN 'rotation_step_exceeds_configured_bound' END AS reason FROM judged GROUP BY source, pair)"""


def _chosen(spark, sf):
    n = F.count_if(F.col("residual") <= 0.4)
    reason = F.when(n < 3, "insufficient_view_consensus").when(F.max("step") > 3.0, motion.FIT_REASONS[0])
    return _trials(spark, sf).groupBy(*PAIR).agg(n.alias("n_selected"), F.max("known_step").alias("known_step"), F.avg("residual").alias("residual"), reason.alias("reason"))


@query(f"""WITH {_CHOSEN} SELECT source, {_SUMMED}, {sql_distribution("step", "step")}, {sql_distribution("residual", "residual")} FROM chosen GROUP BY source""")
def agg12_consensus_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-12: a source's consensus fits."""
    return _chosen(spark, sf).groupBy("source").agg(*_summed(), *distribution("known_step", "step"), *distribution("residual", "residual"))


@query(f"""WITH {_CHOSEN} SELECT n_selected, count(*) AS n FROM chosen GROUP BY n_selected""")
def agg12_selected_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-12: how many pairs select how many views."""
    return _chosen(spark, sf).groupBy("n_selected").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_TRIALS} SELECT view, count(*) FILTER (residual <= 0.4) AS selected, count(*) FILTER (residual > 0.4) AS rejected FROM judged GROUP BY view""")
def agg13_selection_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-12, AGG-13: how often each view is selected and rejected."""
    near = F.col("residual") <= 0.4
    return _trials(spark, sf).groupBy("view").agg(F.count_if(near).alias("selected"), F.count_if(~near).alias("rejected"))


_BANDS = f"""{_TRIALS}, bands AS (SELECT view, CASE WHEN (vec_id % 30) / 30 < 1.0::DOUBLE / 3 THEN 'top' WHEN (vec_id % 30) / 30 < 2.0::DOUBLE / 3 THEN 'middle' ELSE 'bottom' END AS band, residual FROM judged)"""


@query(f"""WITH {_BANDS} SELECT view, band, count(*) AS pairs, {sql_distribution("residual", "residual")} FROM bands GROUP BY view, band""")
def agg14_spatial_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-14: residuals by view and vertical band."""
    rows = _trials(spark, sf).select("view", motion.band_of(F.col("vec_id") % 30 / 30).alias("band"), "residual")
    return rows.groupBy("view", "band").agg(F.count(F.lit(1)).alias("pairs"), *distribution("residual", "residual"))


@query(f"""WITH {_TRIALS}, masked AS (SELECT * FROM judged WHERE NOT (view IN (1, 2) AND (vec_id % 30) / 30 > 1 - 0.3)) SELECT source, {_SUMMED}, {sql_distribution("residual", "residual")}, {sql_distribution("known_step", "step")} FROM masked GROUP BY source""")
def agg15_masked_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-15, FIL-06: fits of what is left of the named views without their lowest part."""
    rows = motion.without_bottom(_trials(spark, sf).withColumn("row_fraction", F.col("vec_id") % 30 / 30), "view", [1, 2], 0.3)
    return rows.groupBy("source").agg(*_summed(), *distribution("residual", "residual"), *distribution("known_step", "step"))


@query(f"""WITH {_STEPS}, n AS (SELECT source, i, state, row_number() OVER (PARTITION BY source ORDER BY i) AS k, count(*) OVER (PARTITION BY source) AS total FROM step), g AS (SELECT *, k - row_number() OVER (PARTITION BY source ORDER BY k) AS run FROM n WHERE state <> 'measured'),
 runs AS (SELECT source, run, count(*) AS frames, CASE WHEN min(k) = 1 OR max(k) = max(total) THEN 'unbridgeable' WHEN count(*) <= 3 THEN 'bridge_candidate' ELSE 'unbridgeable' END AS classification FROM g GROUP BY source, run) SELECT source, classification, count(*) AS gap_runs, sum(frames)::BIGINT AS invalid_steps FROM runs GROUP BY source, classification""")
def agg31_gap_summary(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-31: a source's gaps by class, and the invalid steps in them."""
    steps = _steps(spark, sf)
    filled = motion.bridge_gaps(steps, "source", "i")
    w = Window.partitionBy("source").orderBy("i")
    rows = filled.withColumn("n", F.row_number().over(w)).where("gap_class is not null")
    rows = rows.withColumn("run", F.col("n") - F.row_number().over(w))
    runs = rows.groupBy("source", "run").agg(F.count(F.lit(1)).alias("frames"), F.first("gap_class").alias("gap_class"))
    kind = F.when(F.col("gap_class") == "bridge_candidate", "bridge_candidate").otherwise("unbridgeable")
    return runs.groupBy("source", kind.alias("classification")).agg(F.count(F.lit(1)).alias("gap_runs"), F.sum("frames").alias("invalid_steps"))


@query(f"""WITH {r.SIGNAL}, s AS (SELECT source_id, score, score - lag(score) OVER w AS step, row_number() OVER w AS i, count(*) OVER (PARTITION BY source_id) AS n FROM signal WINDOW w AS (PARTITION BY source_id ORDER BY t, id)), e AS (SELECT *, greatest(1, ceil(n * 0.2::DOUBLE)) AS edge FROM s),
 m AS (SELECT source_id, coalesce(quantile_cont(abs(step), 0.5) FILTER (i <= edge AND i > 1), 0) AS first, coalesce(quantile_cont(abs(step), 0.5) FILTER (i > n - edge + 1), 0) AS last, count(*) AS pair_count, round(quantile_cont(score, 0.5) / 640, 8) AS median_step_width_fraction FROM e GROUP BY source_id)
 SELECT source_id, pair_count, median_step_width_fraction, round(CASE WHEN first > 0 THEN last / first WHEN last = 0 THEN 0 END, 6) AS last_vs_first FROM m""")
def agg30_edge_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-30: how the changes of a source's last fifth compare with those of its first; null if only the first are none."""
    w = Window.partitionBy("source_id").orderBy("t", "id")
    s = r.signal(spark, sf).withColumn("step", F.abs(F.col("score") - F.lag("score").over(w)))
    parts = paths.edge_windows(s, "source_id", ["t", "id"], 0.2).withColumn("change", F.when(~F.col("opens"), F.col("step")))
    some = lambda part, c: F.coalesce(F.percentile(F.when(F.col("part") == part, F.col(c)), 0.5), F.lit(0.0))
    made = parts.groupBy("source_id").agg(some("first", "change").alias("a"), some("last", "change").alias("b"), F.count_if(F.col("part") == "all").alias("pair_count"), F.round(some("all", "score") / 640, 8).alias("median_step_width_fraction"))
    ratio = F.when(F.col("a") > 0, F.col("b") / F.col("a")).when(F.col("b") == 0, 0.0)
    return made.select("source_id", "pair_count", "median_step_width_fraction", r6(ratio).alias("last_vs_first"))

