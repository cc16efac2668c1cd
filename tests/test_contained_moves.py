"""Grams travel as numbers and only where they may be asked for; texts do not move by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from mootlake.operators import contained as module
from mootlake.operators.contained import contained


def test_texts_do_not_move_by_group(spark):
    outer = "an outer text without any end in sight and more words than a window holds"
    rows = [(None, 1, outer), (None, 2, outer[9:70]), (None, 3, "sight"), (7, 1, outer[9:70]), (7, 2, outer), (7, 3, "sights")]
    df = spark.createDataFrame(rows, "g int, o long, t string")
    found = contained(df, ["g"], "o", "t")
    assert "hashpartitioning(g#" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.g, r.o) for r in found.collect()} == {(None, 2), (None, 3)}


def test_only_grams_that_may_be_asked_for_travel(spark):
    texts = [(i, f"note {i} of a section with a stretch of words like number {i * 7919} and no other one") for i in range(40)]
    given = spark.createDataFrame(texts, "o long, text string").select(
        F.struct(F.lit(5).cast("long").alias("gid"), "o", F.char_length("text").alias("n")).alias("id"), "text",
        F.array().cast("array<int>").alias("lengths"), F.array().cast("array<string>").alias("shorts"))
    every = module._placed_grams(given)
    assert [t for _, t in every.dtypes] == ["bigint", "bigint", "boolean", "bigint"]
    one = every.filter("own AND o = 3").limit(1)
    gram = one.first().gram
    some = module._placed_grams(given, module._bit_map(spark.createDataFrame([(gram,)], "gram long"))).collect()
    assert {r.gram for r in some} == {gram} and len(some) == every.filter(F.col("gram") == gram).count()
