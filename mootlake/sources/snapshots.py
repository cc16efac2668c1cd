"""Versioned table that stores what each batch changes.

Version 0 is whole.  Version n+1 is written as the rows that batch n set and the keys that it took out, so a batch writes
what it changes and not the table.  All of it lies in one bucketed table, dealt by the whole key: joins with a version on
this key move none of its rows, and no group of keys meets in one task.  Its files are compressed so well that the planner
takes rows of a hundred times their size for small enough to broadcast, so joins with it are named merge joins.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# So often a version is written whole once more, which bounds what a reader has to put together.
FULL_EVERY = 16


class SnapshotTable:
    """Rows with an equal key stand for each other from version to version; a key with NULL in it equals no other."""

    def __init__(self, spark: SparkSession, path: str, schema, key: list[str]):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        # The number of buckets belongs to the files, whatever a later session is set to.
        spark.range(1).select(F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))).alias("buckets")).write.mode(
            "ignore").parquet(f"{self.path}/layout")
        self.buckets = int(spark.read.schema("buckets int").parquet(f"{self.path}/layout").first()[0])
        self.table = f"snapshot_{hashlib.sha1(self.path.encode()).hexdigest()[:16]}"
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({names}, by_version INT, by_kind STRING) USING parquet OPTIONS (compression 'zstd', "
                  f"partitionOverwriteMode 'dynamic') PARTITIONED BY (by_version, by_kind) CLUSTERED BY ({', '.join(f'`{k}`' for k in key)}) INTO {self.buckets} BUCKETS "
                  f"LOCATION '{self.path}/rows'")
        # an empty first folder, so that a later session finds the folders of an earlier one in any case
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/rows/by_version=-1/by_kind=none")
        spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def _rows(self) -> DataFrame:
        # a stream writes from a session of its own
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def _put(self, df: DataFrame, n: int, kind: str) -> None:
        """Idempotent: a repeated batch replaces what it wrote."""
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in self.schema]
        df.select(*cols).repartition(self.buckets, *self.key).select("*", F.lit(n).alias("by_version"), F.lit(kind).alias("by_kind")).write.insertInto(
            self.table, overwrite=True)

    def _at(self, n: int, full: int) -> DataFrame:
        """Version ``n`` from the whole version ``full`` and the changes since: what no later change has the key of."""
        names = [f.name for f in self.schema]
        whole = (F.col("by_version") == full) & (F.col("by_kind") == "full")
        if n == full:
            return self._rows().filter(whole).select(*names)
        since = F.col("by_version").between(full + 1, n) & F.col("by_kind").isin("set", "gone")
        held = self._rows().filter((whole | since) & (F.col("by_kind") != "gone")).alias("h")
        later = self._rows().filter(since).select(*self.key, "by_version").alias("l")
        replaced = F.col("l.by_version") > F.col("h.by_version")
        for k in self.key:
            replaced = replaced & (F.col(f"l.{k}") == F.col(f"h.{k}"))
        return held.join(later.hint("merge"), replaced, "left_anti").select(*names)

    def begin(self, df: DataFrame) -> None:
        """Version 0."""
        self._put(df, 0, "full")
        self._point(0)

    def set_rows(self, df: DataFrame, n: int) -> None:
        """Rows that come in with version ``n`` or replace those of the same key."""
        self._put(df, n, "set")

    def rows_set(self, n: int) -> DataFrame:
        return self._rows().filter((F.col("by_version") == n) & (F.col("by_kind") == "set")).select(*[f.name for f in self.schema])

    def take_out(self, keys: DataFrame, n: int) -> None:
        self._put(keys, n, "gone")

    def finish(self, n: int) -> None:
        """Version ``n`` is complete and becomes current by one row in the pointer table."""
        if n % FULL_EVERY == 0:
            self._put(self._at(n, n - FULL_EVERY), n, "full")
        self._point(n)

    def _point(self, n: int) -> None:
        self.spark.range(1).select(F.lit(n).alias("version")).write.mode("append").parquet(f"{self.path}/pointer")

    def version(self, n: int) -> DataFrame:
        return self._at(n, n - n % FULL_EVERY)

    def current_version(self) -> int:
        pointer = self.spark.read.schema("version int").parquet(f"{self.path}/pointer")
        return int(pointer.agg(F.max("version")).first()[0])

    def current(self) -> DataFrame:
        return self.version(self.current_version())
