"""Ordered scans that survive a hot group.

A plain ``Window.partitionBy(meeting).orderBy(pos)`` puts a whole meeting in one
task.  The functions here cut every group into blocks of its (integral) order
column, scan the blocks independently, and carry one summary row per block.
Only the summaries are ever ordered per group, so a meeting that holds a third
of all rows is still spread over the cluster, and small meetings pay one narrow
extra aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
FREQUENT_SHARE = 1_000
_BLK = "__blk"


def block_of(order: str, size: int = BLOCK_ROWS) -> Column:
    """Block number of a row; the order column must be an integer type."""
    return F.floor(F.col(order) / F.lit(size)).cast("long")


def blocked(df: DataFrame, order: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Tag rows with their block; several scans over one tag share a shuffle."""
    return df if _BLK in df.columns else df.withColumn(_BLK, block_of(order, size))


def _untag(df: DataFrame, original: DataFrame) -> DataFrame:
    return df if _BLK in original.columns else df.drop(_BLK)


def _carry(df: DataFrame, group: list[str], summary: Column) -> DataFrame:
    """Per (group, block): the total of all earlier blocks, zero rows left out."""
    per_block = df.groupBy(*group, _BLK).agg(summary.alias("__part"))
    before = (Window.partitionBy(*group).orderBy(_BLK)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (per_block
            .select(*group, _BLK, F.sum("__part").over(before).alias("__base"))
            .filter(F.col("__base").isNotNull() & (F.col("__base") != 0)))


def running_total(df: DataFrame, group: list[str], order: str, value: Column,
                  out: str, size: int = BLOCK_ROWS, inclusive: bool = False) -> DataFrame:
    """Prefix sum of ``value`` within the group (exclusive unless asked)."""
    data = blocked(df.withColumn("__v", value.cast("long")), order, size)
    end = 0 if inclusive else -1
    inside = (Window.partitionBy(*group, _BLK).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, end))
    scanned = data.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    base = _carry(data, group, F.sum("__v"))
    return _untag(scanned.join(base, [*group, _BLK], "left")
                  .withColumn(out, F.col("__in") + F.coalesce("__base", F.lit(0)))
                  .drop("__v", "__in", "__base"), df)


def row_numbers(df: DataFrame, group: list[str], order: str, out: str,
                size: int = BLOCK_ROWS, then: list[str] | None = None) -> DataFrame:
    """1-based position in the group, ordered by ``order`` and then ``then``."""
    data = blocked(df, order, size)
    inside = Window.partitionBy(*group, _BLK).orderBy(order, *(then or []))
    scanned = data.withColumn("__in", F.row_number().over(inside).cast("long"))
    base = _carry(data, group, F.count(F.lit(1)))
    return _untag(scanned.join(base, [*group, _BLK], "left")
                  .withColumn(out, F.col("__in") + F.coalesce("__base", F.lit(0)))
                  .drop("__in", "__base"), df)


def with_previous(df: DataFrame, group: list[str], order: str, cols: list[str],
                  out: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``out``: a struct of ``cols`` of the preceding row, NULL for the first."""
    data = blocked(df, order, size)
    payload = F.struct(*cols)
    inside = Window.partitionBy(*group, _BLK).orderBy(order)
    scanned = data.withColumn("__prev", F.lag(payload).over(inside))
    tails = data.groupBy(*group, _BLK).agg(F.max_by(payload, order).alias("__tail"))
    by_block = Window.partitionBy(*group).orderBy(_BLK)
    carried = (tails.select(*group, _BLK, F.lag("__tail").over(by_block).alias("__carry"))
               .filter(F.col("__carry").isNotNull()))
    return _untag(scanned.join(carried, [*group, _BLK], "left")
                  .withColumn(out, F.coalesce("__prev", "__carry"))
                  .drop("__prev", "__carry"), df)


def join_unique(rows: DataFrame, uniques: DataFrame, key: list[str], n_rows: int) -> DataFrame:
    """Inner join with a side that is unique per key and knows each key's ``size``.

    Keys that hold at least 1/FREQUENT_SHARE of all rows are at most
    FREQUENT_SHARE many, so exactly those are broadcast; the rest is shuffled.
    """
    floor = max(64, n_rows // FREQUENT_SHARE)
    big = uniques.filter(F.col("size") >= floor)
    hot = rows.join(F.broadcast(big.drop("size")), key)
    cold = (rows.join(F.broadcast(big.select(*key)), key, "left_anti")
            .join(uniques.filter(F.col("size") < floor).drop("size"), key))
    return hot.unionByName(cold)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep-first de-duplication as a partial aggregate (no window, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return picked.select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest])


def run_numbers(df: DataFrame, group: list[str], order: str, value: str, out: str,
                size: int = BLOCK_ROWS) -> DataFrame:
    """Number the runs of equal neighbouring values, from 0; NULL equals NULL.

    A block is summed up by its first value, last value and inner changes, so
    one small scan over the blocks gives each its first run number.
    """
    data = blocked(df, order, size)
    here = Window.partitionBy(*group, _BLK).orderBy(order)
    v = F.struct(F.col(value).alias("v"))

    def changes(rows: DataFrame) -> DataFrame:
        prev = F.lag(v).over(here)
        return rows.withColumn("__c", (prev.isNotNull() & ~prev["v"].eqNullSafe(F.col(value))).cast("long"))

    scanned = changes(data).withColumn("__in", F.sum("__c").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = changes(data.select(*group, _BLK, order, value)).groupBy(*group, _BLK).agg(
        F.min_by(v, order).alias("head"), F.max_by(v, order).alias("tail"), F.sum("__c").alias("inner"))
    by_block = Window.partitionBy(*group).orderBy(_BLK)
    before = F.lag("tail").over(by_block)
    entered = blocks.withColumn("step", (before.isNotNull() & ~before["v"].eqNullSafe(F.col("head.v"))).cast("long"))
    base = entered.select(*group, _BLK, (
        F.sum("step").over(by_block.rowsBetween(Window.unboundedPreceding, 0))
        + F.coalesce(F.sum("inner").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__base"))
    return _untag(scanned.join(base.filter(F.col("__base") != 0), [*group, _BLK], "left")
                  .withColumn(out, F.col("__in") + F.coalesce("__base", F.lit(0)))
                  .drop("__c", "__in", "__base"), df)


def join_in_order(pieces: Column, sep: str) -> Column:
    """Join the ``t`` fields of an array of structs, sorted by the fields before."""
    return F.array_join(F.transform(F.array_sort(pieces), lambda p: p["t"]), sep)


def ordered_concat(df: DataFrame, group: list[str], order: str, text: str, out: str,
                   sep: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Join texts in order: first inside a block, then one piece per block."""
    data = blocked(df.filter(F.col(text).isNotNull()), order, size)
    partial = data.groupBy(*group, _BLK).agg(
        join_in_order(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))),
                      sep).alias("t"))
    return partial.groupBy(*group).agg(
        join_in_order(F.collect_list(F.struct(F.col(_BLK).alias("o"), "t")), sep).alias(out))
