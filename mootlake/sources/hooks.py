"""Contracts for models that run outside: extraction and entity recognition.

Spark writes request rows and reads response rows; a user function may be
plugged in and then runs on Arrow batches inside the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Extractor = Callable[[pd.Series], pd.Series]            # chunk texts -> raw answers
Recognizer = Callable[[pd.Series], pd.Series]           # texts -> lists of (label, start, stop)


def extraction_requests(chunks: DataFrame) -> DataFrame:
    """What an extractor is asked per chunk: position, time range and text."""
    total = chunks.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    return chunks.join(total, "meeting_id").select(
        "meeting_id", "chunk_id", F.concat(
            F.lit("Фрагмент "), F.col("chunk_id").cast("string"), F.lit(" из "), F.col("n_chunks").cast("string"),
            F.lit(" ["), "start_time", F.lit(" — "), "end_time", F.lit("]:\n\n"), "text").alias("request"))


def run_extractor(requests: DataFrame, extract: Extractor) -> DataFrame:
    """Answers of a user function as (meeting_id, chunk_id, raw)."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"meeting_id": frame["meeting_id"], "chunk_id": frame["chunk_id"],
                                "raw": extract(frame["request"])})
    key = dict(requests.dtypes)
    return requests.mapInPandas(
        batches, f"meeting_id {key['meeting_id']}, chunk_id {key['chunk_id']}, raw string")


class ResultStore:
    """Answers by the content they were asked for; rows are only ever added.

    One folder per asking run, replaced when the run is repeated.  Two runs that ask the same at once add an answer each, and
    readers take one of them, the same for all.
    """

    SCHEMA = "fingerprint string, raw string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], self.SCHEMA).write.mode("ignore").parquet(f"{self.path}/asked=none")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"{self.SCHEMA}, asked string").parquet(self.path)

    def answers(self) -> DataFrame:
        return self.rows().groupBy("fingerprint").agg(F.min(F.struct("asked", "raw")).alias("a")).select("fingerprint", "a.asked", "a.raw")

    def add(self, answers: DataFrame, run: str) -> None:
        answers.select("fingerprint", "raw").write.mode("overwrite").parquet(f"{self.path}/asked={run}")


def answer_requests(requests: DataFrame, store: ResultStore, extract: Extractor, run: str) -> DataFrame:
    """Answers to (meeting_id, chunk_id, request); only requests whose text no earlier run has asked go to the extractor.

    ``asked`` names the run that an answer comes from.  What the store holds meets the new requests by fingerprint alone, so
    unchanged texts cost a narrow anti join and no call.
    """
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"fingerprint": frame["fingerprint"], "raw": extract(frame["request"])})

    keyed = requests.withColumn("fingerprint", F.sha2("request", 256))
    known = store.rows().filter(F.col("asked") != run).select("fingerprint")
    fresh = keyed.select("fingerprint", "request").dropDuplicates(["fingerprint"]).join(known, "fingerprint", "left_anti")
    store.add(fresh.mapInPandas(batches, store.SCHEMA), run)
    return keyed.select("meeting_id", "chunk_id", "fingerprint").join(store.answers(), "fingerprint")


def recognize_entities(texts: DataFrame, recognize: Recognizer, labels: dict[str, str]) -> DataFrame:
    """Entity spans of a user function; ``labels`` maps its labels to token types."""
    schema = "array<struct<label:string,start:bigint,stop:bigint>>"

    @F.pandas_udf(schema)
    def spans(text: pd.Series) -> pd.Series:
        return recognize(text).map(lambda found: [{"label": a, "start": b, "stop": c} for a, b, c in found])

    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    rows = texts.select("meeting_id", "part", "text", F.explode(spans("text")).alias("s"))
    return rows.select("meeting_id", "part", F.col("s.start").alias("start"), F.col("s.stop").alias("stop"),
                       F.try_element_at(known, F.col("s.label")).alias("type"),
                       F.substr("text", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start")).alias("value")
                       ).filter(F.col("type").isNotNull())
