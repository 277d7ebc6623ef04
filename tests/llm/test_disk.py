import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from orbweave.llm.jaccard_join import _asked_for
from orbweave.llm.shared import settle, stage, text_digest


def shuffled(spark):
    """Size of each shuffle file that is there."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f: os.path.getsize(f) for f in files if "shuffle_" in f and f.endswith(".data") and os.path.exists(f)}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    before = set(shuffled(spark))
    assert stage(spark.range(5000).repartition(3, "id"), "five").count() == 5000
    for _ in range(100):
        left = {f: n for f, n in shuffled(spark).items() if f not in before and n > 5000}
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_that_no_decision_names_are_not_shuffled(spark, no_broadcast):
    docs = stage(spark.range(2000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(0, 500), i -> hex(xxhash64(id, i)))) as text"), "docs")
    decided = stage(docs.select("doc_id", text_digest().alias("digest")).selectExpr("doc_id", "digest", "doc_id % 200 > 0 as kept"), "marks")
    before = set(shuffled(spark))
    left = sorted(r["doc_id"] for r in settle(docs, decided, text_digest()).collect())
    assert left == [i for i in range(2000) if i % 200]
    assert sum(n for f, n in shuffled(spark).items() if f not in before) < 2_000_000  # the texts have 17 MB


def test_settle_with_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, "d"), (3, None), (3, ""), (4, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    decided = docs.select("doc_id", text_digest().alias("digest"), docs["text"].eqNullSafe("d").alias("drop")).selectExpr("doc_id", "digest", "not drop as kept").where("doc_id is null or doc_id < 4")
    got = sorted((tuple(r) for r in settle(docs, decided, text_digest()).collect()), key=str)
    assert [(i, t or "") for i, t in got] == sorted([(1, "a"), (1, "b"), (3, ""), (4, "e"), (None, "c")], key=str)


def test_rows_that_may_be_named_are_found_without_python(spark):
    """A Python node in a stage that also reads texts in Python is one more worker for each task, with memory that it keeps."""
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id % 7 = 0, null, xxhash64(id)) as digest", "cast(id as string) as text")
    named = stage(rows.where("doc_id % 150 = 0"), "named")
    found, left = _asked_for(rows, named), settle(rows, named.selectExpr("doc_id", "digest", "false as kept"), F.col("digest"))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("ArrowEvalPython", "MapInArrow") if x in left._jdf.queryExecution().executedPlan().toString()]
    asked = {r["doc_id"] for r in found.collect()}
    assert asked >= {i for i in range(0, 3000, 150) if i % 7} and len(asked) < 1000
    assert left.count() == sum(i % 150 != 0 or i % 7 == 0 for i in range(3000))


HELD = """
import numpy as np
from orbweave.llm import bitmaps, exact_dedup, jaccard_join

def anonymous():
    with open("/proc/self/smaps_rollup") as f:
        return next(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) // 1024

for run in (jaccard_join._count, jaccard_join._meet, bitmaps._mark, exact_dedup._own):
    before = anonymous()
    made = [np.ones(8000) for _ in range(5000)]  # 320 MB; the last array keeps the heap from shrinking by itself
    last = made.pop()
    del made
    freed = anonymous() - before
    list(run(iter([])))
    print(freed, anonymous() - before)
"""


def test_a_worker_gives_back_what_a_task_has_freed():
    found = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True).stdout
    for line in found.splitlines():
        freed, left = map(int, line.split())
        assert freed > 250 and left < 50, found
