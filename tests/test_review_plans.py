"""Rows of the review queue are never broadcast, however small its files are."""

from __future__ import annotations

from mootlake.operators.state import sync_gone, sync_taken
from mootlake.sources.snapshots import SnapshotTable


def test_queue_rows_are_not_broadcast(spark, tmp_path):
    key, schema = ["meeting_id", "src_key"], "meeting_id bigint, src_key string, status string, text string"
    old = spark.createDataFrame([(m, f"k{i}", "accepted" if i == 1 else "proposed", "old") for m in range(3) for i in range(3)], schema)
    queue = SnapshotTable(spark, str(tmp_path / "queue"), old.schema, key)
    queue.begin(old)
    batch = spark.createDataFrame([(m, f"k{i}", "new") for m in range(2) for i in (0, 1, 5)], "meeting_id bigint, src_key string, text string")
    known = queue.version(0).select(*key, "status")
    taken = sync_taken(known, batch)
    queue.set_rows(taken, 1)
    gone = sync_gone(known, queue.rows_set(1), batch.select("meeting_id"))
    queue.take_out(gone, 1)
    queue.finish(1)
    for df in (taken, gone, queue.current()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan
    want = [(m, *r) for m in range(2) for r in (("k0", "proposed", "new"), ("k1", "accepted", "old"), ("k5", "proposed", "new"))]
    want += [(2, "k0", "proposed", "old"), (2, "k1", "accepted", "old"), (2, "k2", "proposed", "old")]
    assert sorted(map(tuple, queue.current().collect())) == want
