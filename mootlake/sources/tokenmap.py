"""The token map: which token stands for which value.

It is the only table that leads back to the real values, so it has a folder of its own, which nothing else is written to or read
from; who may read that folder is for the store to say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pii import pii_tokens
from ..session import stage_table


class TokenMap:
    """A dictionary that grows: a value keeps its token, numbers go on behind the highest one of their type and meeting.

    Rows are added per run and never changed; a repeated run replaces its own rows and no others.
    """

    SCHEMA = "meeting_id bigint, type string, n bigint, token string, value string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], self.SCHEMA).write.mode("ignore").parquet(f"{self.path}/added=none")

    def read(self, without: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{self.SCHEMA}, added string").parquet(self.path)
        return (rows if without is None else rows.filter(F.col("added") != without)).drop("added")

    def add(self, spans: DataFrame, run: str) -> DataFrame:
        """Tokens for the values of ``spans`` that have none yet; returns the map as it stands then."""
        prior = self.read(without=run)
        every = pii_tokens(spans, prior)
        fresh = stage_table(every.join(prior.select("meeting_id", "token"), ["meeting_id", "token"], "left_anti"), "tokens")
        fresh.select(*[c.split()[0] for c in self.SCHEMA.split(", ")]).write.mode("overwrite").parquet(
            f"{self.path}/added={run}")
        return self.read()
