"""Running a stream to the end of its input, and idempotent batch sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

FILES_PER_TRIGGER = 1_000


@dataclass(frozen=True)
class Batch:
    """Which batch of which stream: ``run`` lives as long as the checkpoint, so a repeated batch has the same name."""

    run: str
    number: int


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "json",
                files_per_trigger: int = FILES_PER_TRIGGER, **options) -> DataFrame:
    reader = (spark.readStream.format(fmt).schema(schema).option("recursiveFileLookup", True)
              .option("maxFilesPerTrigger", files_per_trigger))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, Batch], None], label: str,
          checkpoint: str | None = None, mode: str = "append") -> None:
    """Process what is there now, batch by batch; the checkpoint remembers it."""
    spark = stream.sparkSession
    run: list[str] = []

    def one(batch: DataFrame, number: int) -> None:
        # The stream's id is written into its checkpoint; the engine hands it to every batch.
        named = run[0] if run else batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not named:
            raise ValueError("a batch without the id of its stream")
        each(batch, Batch(named, number))

    query = (stream.writeStream.foreachBatch(one).trigger(availableNow=True).outputMode(mode)
             .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-checkpoint"))
             .start())
    query.awaitTermination()


class BatchSink:
    """Parquet sink with one folder per stream and batch: a repeated batch replaces itself.

    A stream that starts over with a new checkpoint has a new id and other folders, so it never overwrites what another
    one wrote.  With ``key`` it leaves out the rows that another stream has written, whole or in part, so that every row
    is there once whatever was restarted.  That look at the others is a semi join on the key, taken only where there are any.
    """

    def __init__(self, spark: SparkSession, path: str, schema, key: list[str] | None = None):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key or []
        # An empty first folder: reading needs no test whether there is one.
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/by_stream=none/by_batch=0")

    def _rows(self) -> DataFrame:
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        return self.spark.read.schema(f"{names}, by_stream string, by_batch bigint").parquet(self.path)

    def write(self, df: DataFrame, batch: Batch) -> None:
        rows = df.select(*[f.name for f in self.schema])
        if self.key:
            others = self._rows().filter(F.col("by_stream") != batch.run).select(*self.key)
            if others.take(1):
                rows = rows.join(others.distinct(), self.key, "left_anti").select(*rows.columns)
        rows.write.mode("overwrite").parquet(f"{self.path}/by_stream={batch.run}/by_batch={batch.number}")

    def read(self) -> DataFrame:
        return self._rows().select(*[f.name for f in self.schema])

    def batches(self) -> DataFrame:
        """run, batch, n_rows of everything written."""
        return self._rows().filter("by_stream <> 'none'").groupBy(F.col("by_stream").alias("run"), F.col("by_batch").alias("batch")).agg(
            F.count(F.lit(1)).alias("n_rows"))
