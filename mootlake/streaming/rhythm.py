"""Meetings per series and week on arriving meetings, by meeting date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import filled
from ..session import scratch_path


def weekly_counts(meetings: DataFrame) -> DataFrame:
    """Seven-day windows of the meeting date; works on streams and on tables."""
    return meetings.filter(F.col("event_ts").isNotNull()).groupBy(
        F.window("event_ts", "7 days").alias("w"),
        F.coalesce(filled(F.col("category")), F.lit(fixed.DEFAULT_CATEGORY)).alias("series")).agg(
        F.count(F.lit(1)).alias("n_meetings")).select(
        "series", F.to_date("w.start").alias("week_start"), "n_meetings")


def run_rhythm(meetings: DataFrame, target: str, checkpoint: str | None = None) -> DataFrame:
    """Keep the counts of all weeks up to date.

    Recordings are often processed long after the meeting, so no week is ever
    closed: the query runs in complete mode and its state, one row per series
    and week, stays small whatever the number of meetings.
    """
    spark = meetings.sparkSession
    counts = weekly_counts(meetings)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={batch_id}")
        last.append(batch_id)

    last: list[int] = []
    query = (counts.writeStream.outputMode("complete").foreachBatch(each).trigger(availableNow=True)
             .option("checkpointLocation", checkpoint or scratch_path(spark, "rhythm-checkpoint")).start())
    query.awaitTermination()
    return spark.read.parquet(f"{target}/version={max(last)}") if last else weekly_counts(
        spark.createDataFrame([], "event_ts timestamp, category string"))


