"""The review queue as a stream of changes, against the whole merge of each batch."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from mootlake.operators.state import sync_proposals
from mootlake.sources import snapshots
from mootlake.sources.snapshots import SnapshotTable
from mootlake.streaming import review
from mootlake.streaming.common import file_stream

KEY = ["meeting_id", "src_key"]
RUN = "meeting_id bigint, src_key string, text string"
QUEUE = "meeting_id bigint, src_key string, status string, text string"


def items(rows):
    return rows.filter("src_key IS NOT NULL").dropDuplicates()


def random_queue(rng):
    old = [(m, f"k{i}", rng.choice(["proposed", "accepted", "rejected", "sent"]), f"old {i}") for m in range(12) for i in range(6) if rng.random() < 0.7]
    old += [(1, f"hot{i}", "proposed", "old") for i in range(200)] + [(None, "k0", "proposed", "old"), (None, "k1", "accepted", "old")]
    runs = []
    for b in range(5):
        touched = rng.sample(range(14), 4)
        rows = [(m, f"k{i}", f"run {b} {i}") for m in touched[1:] for i in range(8) if rng.random() < 0.5]
        runs.append([*rows, (touched[0], None, None), (None, "k0", f"run {b}")])
    runs[2] += [(1, f"hot{i}", "run 2") for i in range(0, 300, 3)]
    return old, runs


def test_queue_of_changes_equals_the_whole_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "FULL_EVERY", 3)
    old, runs = random_queue(random.Random(3))
    old, landing, checkpoint = spark.createDataFrame(old, QUEUE), str(tmp_path / "in"), str(tmp_path / "checkpoint")
    queue = SnapshotTable(spark, str(tmp_path / "queue"), old.schema, KEY)
    queue.begin(old)
    want = sorted(map(tuple, old.collect()), key=str)
    fails = [True]

    def fields(rows):
        if len(fails) == 1 and queue.current_version() == 2:
            fails.append(True)
            raise RuntimeError("killed in a batch")
        return items(rows)

    for n, run in enumerate(runs, 1):
        rows = spark.createDataFrame(run, RUN)
        rows.coalesce(1).write.mode("append").json(landing)
        drain = lambda: review.sync_stream(file_stream(spark, landing, rows.schema), queue, fields, checkpoint)
        if n == 3:
            with pytest.raises(StreamingQueryException):
                drain()
        drain()
        before = spark.createDataFrame(want, QUEUE)
        merged = sync_proposals(before, items(rows), rows.select("meeting_id"))
        want = sorted(map(tuple, merged.select(*old.columns).collect()), key=str)
        assert queue.current_version() == n
        assert sorted(map(tuple, queue.current().collect()), key=str) == want
        # a batch writes what it changes, not the queue
        outcome = {r.outcome: r["count"] for r in merged.groupBy("outcome").count().collect()}
        written = lambda kind: spark.table(queue.table).filter(f"by_version = {n} AND by_kind = '{kind}'").count()
        assert written("set") == outcome.get("inserted", 0) + outcome.get("updated", 0)
        assert written("gone") == before.count() + outcome.get("inserted", 0) - merged.count()
        assert (written("full") > 0) == (n % 3 == 0)
    # another session finds the table by its path, with the buckets it has
    spark.sql(f"DROP TABLE {queue.table}")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = SnapshotTable(spark, str(tmp_path / "queue"), old.schema, KEY)
        assert again.buckets == int(parts) and sorted(map(tuple, again.current().collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_no_row_of_the_queue_is_shuffled(spark, tmp_path):
    old = spark.range(1000).select(F.lit(1).cast("bigint").alias("meeting_id"), F.col("id").cast("string").alias("src_key"),
                                   F.lit("proposed").alias("status"), F.lit("t").alias("text"))
    queue = SnapshotTable(spark, str(tmp_path / "queue"), old.schema, KEY)
    queue.begin(old)
    queue.set_rows(old.filter("src_key < '2'"), 1)
    queue.take_out(old.filter("src_key > '8'").select(*KEY), 1)
    queue.finish(1)
    joins = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(joins, "-1")
    try:
        current = queue.version(1)
        assert current.count() == 1000 - old.filter("src_key > '8'").count()
        assert "Exchange" not in current._jdf.queryExecution().executedPlan().toString()
        # one meeting of 1000 rows lies in all buckets
        assert current.select(F.spark_partition_id().alias("p")).distinct().count() == queue.buckets
    finally:
        spark.conf.unset(joins)
