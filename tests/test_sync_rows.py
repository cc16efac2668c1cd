"""Of the merged queue only open rows without a new item are looked up by meeting."""

from __future__ import annotations

from mootlake.operators.state import sync_proposals


def test_only_open_rows_without_an_item_move_by_meeting(spark):
    old = [(1, "a", "proposed", "old"), (1, "b", "proposed", "old"), (1, "c", "accepted", "old"), (2, "a", "proposed", "old"),
           (3, "a", None, "old"), (3, "b", "proposed", "old"), (None, "a", "proposed", "old")]
    new = [(1, "a", "new"), (1, "c", "new"), (1, "d", "new"), (None, "a", "new")]
    old = spark.createDataFrame(old, "meeting_id bigint, src_key string, status string, text string")
    new = spark.createDataFrame(new, "meeting_id bigint, src_key string, text string")
    touched = spark.createDataFrame([(1,), (3,), (3,), (None,)], "meeting_id bigint")
    merged = sync_proposals(old, new, touched)
    assert "FullOuter" not in merged._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, merged.collect()), key=str) == sorted([
        (1, "a", "proposed", "new", "updated"), (1, "c", "accepted", "old", "kept"), (1, "d", "proposed", "new", "inserted"),
        (2, "a", "proposed", "old", "kept"), (3, "a", "proposed", "old", "kept"), (None, "a", "proposed", "old", "kept"),
        (None, "a", "proposed", "new", "inserted")], key=str)
