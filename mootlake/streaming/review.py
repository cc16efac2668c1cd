"""Continuous registration: every batch of extractor output updates the review queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.state import sync_gone, sync_taken
from ..sources.snapshots import SnapshotTable
from .common import Batch, drain


def sync_stream(stream: DataFrame, queue: SnapshotTable, fields: Callable[[DataFrame], DataFrame],
                checkpoint: str | None = None) -> None:
    """Batch n reads version n and writes what makes version n + 1 of it, so a repeated batch
    gives the same version again.  All items of a meeting come in one batch; a run
    without any action sends one row without a task, which clears its open proposals."""
    def each(rows: DataFrame, batch: Batch) -> None:
        old, made = queue.version(batch.number).select(*queue.key, "status"), batch.number + 1
        queue.set_rows(sync_taken(old, fields(rows)), made)
        # an open proposal of the run is among the rows just written, so the items are worked out once
        queue.take_out(sync_gone(old, queue.rows_set(made), rows.select("meeting_id")), made)
        queue.finish(made)
    drain(stream, each, "review", checkpoint)
