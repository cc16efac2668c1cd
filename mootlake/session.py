"""Session settings and the shared scratch space.

Everything a job has to hand from one stage to the next is written as a table
below the folder named by ``spark.checkpoint.dir``.  On a cluster that is a
shared file system, so a lost executor costs a re-read and not a re-run.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Every setting here is a planner default; none depends on the data size.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# Up to so many narrow rows the small side of a join is broadcast; they stay below a few MB.
SMALL_SIDE = 50_000
_LOCAL_SCRATCH: str | None = None


def build_session(app: str = "mootlake", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings above; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this cluster; a private one only in local mode, where none is set."""
    global _LOCAL_SCRATCH
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _LOCAL_SCRATCH is None:
        _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="mootlake-")
    return _LOCAL_SCRATCH


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the scratch folder; never reused."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage_table(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: short lineage, real size statistics.  ``codec`` for tables of long texts."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, label: str, most: int = SMALL_SIDE) -> DataFrame:
    """A side of narrow rows for a join, written once: broadcast if it has few rows, so that the long rows of the other side
    need not move; else left to the planner."""
    written = stage_table(df, label)
    return F.broadcast(written) if written.count() <= most else written


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for work that is heavy per row when the input has few files.

    Large inputs have more files than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)

