"""A summary beyond the broadcast limit is joined by key and salt, however small the planner takes it for."""

from __future__ import annotations

from pyspark.sql import functions as F

from mootlake.llm.common import attach
from mootlake.session import stage_table


def test_large_summaries_are_not_broadcast(spark):
    rows = spark.range(2_000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 300).alias("k"), "id")
    summary = stage_table(spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v")), "summary")
    got = attach(rows, summary, "k", F.xxhash64("id"), small_rows=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    want = sorted((i, i % 300 * 3 if i % 7 and i % 300 < 200 else None) for i in range(2_000))
    assert sorted((r.id, r.v) for r in got.collect()) == want
