"""Registered queries: raw frames, detector heads and whole-or-nothing sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.operators import folds, frames
from orbweave.operators.staging import shared_path, staged
from orbweave.plans import relations as r
from orbweave.plans.catalog import query, rounded
from orbweave.sinks import atomic
from orbweave.sources import records

SIDE = 8  # an embedding's values are a frame of so many lines and columns
_FRAMES = f"""px AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS record, list_transform(embedding, lambda e: greatest(0, least(255, floor((e::DOUBLE + 1) * 127.5::DOUBLE)))::BIGINT) AS p FROM embeddings),
 both_px AS (SELECT record, p, lag(p) OVER (ORDER BY record) AS q FROM px)"""


def _recorded(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as gray frames in one raw file, read back by several tasks."""
    gray = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 1) * 127.5))).cast("int"))
    body = F.unhex(F.array_join(F.transform(gray, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    path = shared_path(spark, "raw-frames")
    atomic.write_file(r.table(spark, sf, "embeddings").select("vec_id", body.alias("body")).orderBy("vec_id").select("body"), path)
    return records.read_records(spark, path, SIDE * SIDE, records_per_task=4096)


@query(f"""WITH {_FRAMES} SELECT record, round(list_sum(list_transform(range(64), lambda k: abs(p[k + 1] - q[k + 1]))) / 64, 6) AS difference FROM both_px WHERE q IS NOT NULL""")
def agg34_frame_differences(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-15, SNK-02, AGG-34: how far each raw frame is from the one before it."""
    return rounded(frames.frame_differences(_recorded(spark, sf), SIDE, SIDE).select("record", "difference"), "difference")


@query(f"""WITH {_FRAMES}, shift AS (SELECT x.i AS dx, y.i AS dy FROM range(-2, 3) x(i), range(-2, 3) y(i)),
 tried AS (SELECT record, dx, dy, list_sum(list_transform(range(16), lambda k: abs(q[(2 + k // 4) * 8 + 3 + k % 4] - p[(2 + k // 4 + dy) * 8 + 3 + k % 4 + dx])))::BIGINT AS off FROM both_px, shift WHERE q IS NOT NULL),
 placed AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY off, dx * dx + dy * dy, abs(dy), abs(dx), dx, dy) AS place, max(CASE WHEN dx = 0 AND dy = 0 THEN off END) OVER (PARTITION BY record) AS still FROM tried)
 SELECT record, round(record / 25, 6) AS time_seconds, dx, dy, round(sqrt(dx * dx + dy * dy), 6) AS magnitude, round(off / 16, 6) AS best, round(still / 16, 6) AS zero FROM placed WHERE place = 1""")
def win20_block_motion(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-20: the shift of each raw frame's content since the one before."""
    made = frames.motion_series(_recorded(spark, sf), SIDE, SIDE, 25.0, radius=2, stride=1)
    return rounded(made.drop("path"), "time_seconds", "magnitude", "best", "zero")


_SIZE, _STRIDES, _LEAST = 32, (8, 16), 0.02
_HEADS = """cell AS (SELECT vec_id // 20 AS head_id, vec_id % 20 AS i, [embedding[1]::DOUBLE * 2, embedding[2]::DOUBLE * 2, embedding[3]::DOUBLE * 4, embedding[4]::DOUBLE * 4, abs(embedding[5]::DOUBLE) * 3, abs(embedding[6]::DOUBLE) * 3, abs(embedding[7]::DOUBLE) * 3, CASE WHEN vec_id % 97 = 5 THEN 'nan'::DOUBLE ELSE abs(embedding[8]::DOUBLE) * 3 END] AS row FROM embeddings),
 head AS (SELECT head_id, count(*) AS n, bool_or(isnan(row[8])) AS bad FROM cell GROUP BY head_id)"""


def _heads(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty embeddings are a small detector's head; some hold a value that is no number."""
    e = lambda i: F.element_at("embedding", i).cast("double")
    last = F.when(F.col("vec_id") % 97 == 5, float("nan")).otherwise(F.abs(e(8)) * 3)
    row = F.array(e(1) * 2, e(2) * 2, e(3) * 4, e(4) * 4, *[F.abs(e(i)) * 3 for i in (5, 6, 7)], last)
    cells = r.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("head_id"), F.struct((F.col("vec_id") % 20).alias("i"), row.alias("row")).alias("c"))
    return cells.groupBy("head_id").agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["row"]).alias("head"))


_OVERLAP = "greatest(0, least(k.x + k.w, n.x + n.w) - greatest(k.x, n.x)) * greatest(0, least(k.top + k.h, n.top + n.h) - greatest(k.top, n.top))"
_HELD = f"len(list_filter(f.kept, lambda k: {_OVERLAP} > 0.45::DOUBLE * (k.w * k.h + n.w * n.h - {_OVERLAP}))) > 0"


@query(f"""WITH RECURSIVE {_HEADS}, b AS (SELECT c.head_id, c.i, row, list_position(row[6:8], list_max(row[6:8])) - 1 AS class, row[5] * list_max(row[6:8]) AS score, CASE WHEN c.i < 16 THEN c.i % 4 ELSE (c.i - 16) % 2 END AS gx, CASE WHEN c.i < 16 THEN c.i // 4 ELSE (c.i - 16) // 2 END AS gy, CASE WHEN c.i < 16 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS unit FROM cell c JOIN head h ON h.head_id = c.head_id AND h.n = 20 AND NOT h.bad),
 boxes AS (SELECT head_id, i AS source_index, class, score, (row[1] + gx) * unit - exp(row[3]) * unit / 2 AS x, (row[2] + gy) * unit - exp(row[4]) * unit / 2 AS top, exp(row[3]) * unit AS w, exp(row[4]) * unit AS h FROM b WHERE score >= {_LEAST}),
 ordered AS (SELECT *, row_number() OVER (PARTITION BY head_id, class ORDER BY score DESC, source_index) AS place FROM boxes),
 f AS (SELECT head_id, class, place, [struct_pack(x := x, top := top, w := w, h := h)] AS kept, true AS stays FROM ordered WHERE place = 1 UNION ALL SELECT n.head_id, n.class, n.place, CASE WHEN {_HELD} THEN f.kept ELSE list_append(f.kept, struct_pack(x := n.x, top := n.top, w := n.w, h := n.h)) END, NOT ({_HELD}) FROM f JOIN ordered n ON n.head_id = f.head_id AND n.class = f.class AND n.place = f.place + 1)
 SELECT head_id, source_index, o.class, round(score, 6) AS score, round(x, 6) AS x, round(top, 6) AS top, round(w, 6) AS w, round(h, 6) AS h FROM f JOIN ordered o USING (head_id, class, place) WHERE f.stays""")
def src06_head_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-06, TOP-03, TOP-04: raw detector heads as boxes, without those that overlap a better one of their class."""
    boxes = staged(frames.decode_head(_heads(spark, sf), "head_id", "head", _SIZE, 3, _LEAST, _STRIDES), "head-boxes")
    kept = folds.box_nms(boxes, ["head_id", "class"], ["x", "top", "w", "h"], "score", ["source_index"], 0.45)
    return rounded(boxes.join(kept.select("head_id", "class", "source_index"), ["head_id", "class", "source_index"]).select("head_id", "source_index", "class", "score", "x", "top", "w", "h"), "score", "x", "top", "w", "h")


@query(f"""WITH {_HEADS} SELECT 'row_count' AS rule_id, head_id FROM head WHERE n <> 20 UNION ALL SELECT 'row_values', head_id FROM head WHERE bad""")
def src06_head_rules(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-06, FIL-17: heads that can't be decoded."""
    return frames.head_violations(_heads(spark, sf), "head_id", "head", _SIZE, 3, _STRIDES)


@query(f"""WITH {r.SIGNAL}, f AS (SELECT 'source-' || (source_id % 16) || '.txt' AS name, string_agg(id::VARCHAR, chr(10) ORDER BY id) AS content FROM signal GROUP BY ALL) SELECT name, strlen(content) AS bytes, sha256(content) AS sha256 FROM f""")
def snk03_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-03: sixteen files that appear as one bundle, read back."""
    ids = F.transform(F.sort_array(F.collect_list("id")), lambda i: i.cast("string"))
    files = r.signal(spark, sf).groupBy(F.format_string("source-%d.txt", F.col("source_id") % 16).alias("name")).agg(F.array_join(ids, "\n").alias("content"))
    path = shared_path(spark, "bundle")
    atomic.write_bundle(files, path)
    read = spark.read.format("binaryFile").load(path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return read.where(F.col("name") != atomic.MANIFEST).select("name", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
