"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.shared import discard, stage


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (long columns a and b); component is its least node.

    Every round is written to the shared folder, and the one before it is deleted. A round joins the edges with
    one row for each node, so a node with very many edges can be split by Spark's skew handling. Rounds go on
    until nothing changes; each brings every node nearer to its component's least one. No edges give an empty
    table, nodes that only link to themselves have no row, and repeated edges count once.
    """
    edges = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was, mark = None, _mark(edges)
    while mark != was:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b")))
        before, edges = edges, stage(small.where("a != b").distinct(), "edges")
        was, mark = mark, _mark(edges)
        discard(before)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
