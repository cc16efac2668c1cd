"""Mixing sources to target weights: hash-threshold histograms, no sort of documents.

Every document gets a key of 52 bits.  Words are summed by source and key bucket; the bucket where the running sum
meets the source's budget is split into finer buckets and at last into single keys.  What is left is one threshold
per source, and documents are taken by comparing their key with it.

Defined results: null texts have size 0; null sources form one source, ordered last; rows with the same ``doc_id`` share
a key and are taken together; null ids share one key; an empty table gives an empty result.  A document is taken
``floor(target / source_size)`` times, once more when its key is at or below the threshold.  A source ends within half of
its boundary document of its target.  Extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, attach, stage_table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
BUCKET_BITS = 10
KEY_BITS = 52


def _keys() -> list[Column]:
    """Source key (null last), size in words and hash key of a document."""
    return [F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("src"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long").alias("size"),
            F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10)
            .cast("long").alias("key")]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source key (null last), size in words, hash key; no texts."""
    return docs.select("doc_id", *_keys())


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: size, target, whole copies and the words still wanted after them.

    Sources are filled like vessels: ordered by cap / weight, all before the first that stays below its cap are full.
    The windows run over one row per source.
    """
    totals = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(Window.orderBy("src")) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeat))
              .withColumn("ratio", F.col("cap") / F.col("weight"))
              .withColumn("budget", F.sum("source_size").over(everything) * share)
              .withColumn("all_weight", F.sum("weight").over(everything))
              .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                          / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least("cap", F.col("water") * F.col("weight"))
    return (ranked.withColumn("water", level).withColumn("target", F.coalesce(target, F.col("cap")))
            .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
            .withColumn("wanted", F.col("target") - F.col("copies") * F.col("source_size"))
            .select("src", "source_size", "target", "copies", "wanted"))


def _boundary(sums: DataFrame, part: str) -> DataFrame:
    """Per source the bucket in which the running sum passes ``wanted``; ``wanted`` becomes what is left for it."""
    before = F.coalesce(F.sum("words").over(
        Window.partitionBy("src").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (sums.withColumn("before", before)
            .where((F.col("before") <= F.col("wanted")) & (F.col("before") + F.col("words") > F.col("wanted")))
            .withColumn("wanted", F.col("wanted") - F.col("before")))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """src, cut: documents with ``key <= cut`` are taken once more."""
    first, second = KEY_BITS - BUCKET_BITS, KEY_BITS - 2 * BUCKET_BITS
    sums = sizes.groupBy("src", F.shiftright("key", first).alias("b1")).agg(F.sum("size").alias("words"))
    one = stage_table(_boundary(attach(sums, targets.select("src", "wanted"), "src", F.col("b1")), "b1")
                      .select("src", "b1", "wanted"), "mix-one")
    inside = attach(sizes, one, "src", F.col("key"), "inner").where(F.shiftright("key", first) == F.col("b1"))
    sums = inside.groupBy("src", F.shiftright("key", second).alias("b2")).agg(
        F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    two = stage_table(_boundary(sums, "b2").select("src", "b2", "wanted"), "mix-two")
    keys = attach(sizes, two, "src", F.col("key"), "inner").where(F.shiftright("key", second) == F.col("b2"))
    keys = keys.groupBy("src", "key", "b2").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    before = F.coalesce(F.sum("words").over(
        Window.partitionBy("src").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fits = F.max(F.when(F.col("before") + F.col("words") / 2 <= F.col("wanted"), F.col("key")))
    return (keys.withColumn("before", before).groupBy("src")
            .agg(F.coalesce(fits, F.shiftleft(F.first("b2"), second) - 1).alias("cut")))


def plan(sizes: DataFrame) -> DataFrame:
    """Written table with one row per source: source_size, target, copies, cut."""
    targets = stage_table(source_targets(sizes), "mix-targets")
    cuts = stage_table(thresholds(sizes, targets), "mix-cuts")
    return stage_table(targets.drop("wanted").join(cuts, "src", "left"), "mix-plan")


def _taken(rows: DataFrame, made: DataFrame) -> DataFrame:
    copies = F.col("copies") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    return (attach(rows, made, "src", F.col("key")).withColumn("copies", copies.cast("long"))
            .withColumn("taken", F.col("size") * F.col("copies")))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of ``docs`` (doc_id, text, source)."""
    sizes = stage_table(sized(docs), "mix-sizes")
    return _taken(sizes, plan(sizes)).select("doc_id", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents of the mix with all columns, ``mix_copies`` (how often each is taken) and ``mix_words``."""
    made = plan(stage_table(sized(docs), "mix-sizes"))
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in ("mix_copies", "mix_words")]).alias("row"), *_keys())
    return (_taken(rows, made).where("copies > 0")
            .select("row.*", F.col("copies").alias("mix_copies"), F.col("taken").alias("mix_words")))
