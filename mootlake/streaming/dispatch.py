"""The dispatch journal as a sink: every proposal is written once, whatever is sent or run again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .common import BatchSink, drain

JOURNAL = "proposal_id string, meeting_id bigint, text string, owner string, due_v1 date"


def journal_sink(spark, path: str) -> BatchSink:
    return BatchSink(spark, path, spark.createDataFrame([], JOURNAL).schema, ["proposal_id"])


def append_journal(sent: DataFrame, journal: BatchSink, checkpoint: str | None = None) -> None:
    """Sent proposals (JOURNAL columns) as they come; the first message about a proposal is its entry for good.

    Which proposals have one is Spark's state, so no batch reads the journal.  Only a stream that starts over with a new
    checkpoint meets the entries of the stream before it, by proposal.
    """
    drain(sent.dropDuplicates(["proposal_id"]), journal.write, "journal", checkpoint)
