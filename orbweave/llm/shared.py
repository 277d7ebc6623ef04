"""Folders that driver and executors share, and the column contract of ``documents``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.bitmaps import among, marks_of

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Only a local session (one machine by definition) may fall back to a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", f"file://{base}")
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the query that wrote them ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, what)
    with freed(df.sparkSession):
        df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.staged_at = path
    return made


def discard(staged: DataFrame) -> None:
    """Delete a staged table that no plan reads any more."""
    spark = staged.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(staged.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    """The text itself; a null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def text_digest(column: str = "text"):
    """64 bits that tell apart texts under one id."""
    return F.xxhash64(whole_text(column))


def fresh_name(columns, name: str) -> str:
    """``name`` with as many underscores before it as it needs to clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


HEAVY_KEYS = 1_000  # a key is heavy if it has more than one in so many of all rows, so there are fewer than that


def look_up(rows: DataFrame, table: DataFrame, key: str, size: str, spread: str) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row for each key and in ``size`` how many rows ask for it.

    Rows of heavy keys take what they look for from a broadcast of the heavy keys alone, fewer than HEAVY_KEYS rows by
    their definition, and pass the shuffle spread by ``spread``, as do rows with a null key, which find nothing; so a
    key with a third of all rows fills no task.
    """
    names = [c for c in table.columns if c != key]
    total = table.agg(F.sum(size)).first()[0] or 0
    heavy = table.where(F.col(size) > max(total // HEAVY_KEYS, 1))
    first = rows.join(F.broadcast(heavy.select(key, F.struct(*names).alias("_heavy"))), key, "left")
    dealt = F.when(F.col("_heavy").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.xxhash64(spread).cast(rows.schema[key].dataType))
    rest = table.select(F.col(key).alias("_key"), F.struct(*names).alias("_light"))
    both = first.withColumn("_dealt", dealt).join(rest, F.col("_dealt") == F.col("_key"), "left")
    found = F.when(F.col(key).isNotNull(), F.coalesce("_heavy", "_light"))
    return both.select(*rows.columns, *[found[c].alias(c) for c in names])


def settle(df: DataFrame, decided: DataFrame, digest) -> DataFrame:
    """``df`` without what ``decided`` (doc_id, digest, kept) rejects, and one of the rows that repeat both.

    ``digest`` makes the digest of a row of ``df``. Decisions hold for an id with its text: other texts of the
    id stay, and null ids match null ids. Rows that aren't decided stay; columns keep names and order. Only
    rows that may be decided on are shuffled, by a bitmap of the digests; ``df`` is read twice for that.
    """
    marks = decided.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("not kept or n > 1")
    marks = stage(marks.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__made"), "kept"), "decided")
    made = fresh_name(df.columns, "digest")
    marked = df.withColumn(made, digest)

    def matched(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
        return rows.join(others, rows["doc_id"].eqNullSafe(others["__id"]) & (rows[made] == others["__made"]), how)

    asked = fresh_name(marked.columns, "asked")
    parted = among(marked, stage(marks_of(marks, ["__made"]), "bitmap"), [made], asked)
    rest = matched(parted.where(asked), marks.where("not kept"), "left_anti")
    again = marks.where("kept")
    if not again.isEmpty():
        rest = matched(rest, again, "left_anti").unionAll(matched(rest, again, "left_semi").dropDuplicates(["doc_id", made]))
    return parted.where(~F.col(asked)).unionAll(rest).drop(made, asked)
