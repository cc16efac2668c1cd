"""Document fingerprints by winnowing, in DataFrame functions only.

Overlapping grams of ``GRAM`` units are hashed; of every ``WINDOW`` grams in a row the one with the least hash is kept, the
rightmost on ties, together with its position.  A unit is a word of up to ``LONG`` code points; a longer word, such as a line
without white space, has a unit of ``GRAM`` code points at each of its code points.  Two texts that share
``WINDOW + GRAM - 1`` units in a row share a selected gram.  Texts of up to ``SHORT`` code points have grams of ``GRAM`` code
points behind those of units, so that they share one if they share as many code points in a row; three quarters of a longer
text always have enough units.  A gram is one long: 32 bits of hash, then 31 bits that fall with the position, so that
``array_min`` alone finds the least hash and the rightmost tie.

Defined results: null texts count as empty; a text without words has an empty fingerprint; a text with fewer units than a
gram has one gram of all its units; with fewer grams than a window, the least gram is kept.  Likeness is the Dice measure of
the two sets of hashes, 1 for two empty fingerprints, 0 for one.  Rows are ordered by ``doc_id`` (null first), then by text
hash.  A single row is its own next document.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table, words

GRAM = 4
WINDOW = 8
LONG = 16
SHORT = 256
_POSITIONS = 2 ** 31
BLOCKS_PER_PARTITION = 8
MAX_BLOCKS = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _units(tokens: Column, gram: int) -> Column:
    """Words, the long ones cut into overlapping pieces."""
    def pieces(word: Column) -> Column:
        return _let(F.split(word, ""), lambda c: F.transform(
            F.sequence(F.lit(0), F.size(c) - gram), lambda i: F.concat(*[F.get(c, i + j) for j in range(gram)])))

    long = lambda word: F.char_length(word) > max(LONG, gram)
    cut = F.flatten(F.transform(tokens, lambda w: F.when(long(w), pieces(w)).otherwise(F.array(w))))
    return F.when(F.exists(tokens, long), cut).otherwise(tokens)


def _grams(tokens: Column, gram: int) -> Column:
    """Hash and position of every gram as one long; grams of code points follow in short texts."""
    def hashed(units: Column, first: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(units) - gram, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(units, i + j) for j in range(gram)]).bitwiseAND(F.lit(0xFFFFFFFF)) * _POSITIONS
            + (F.lit(_POSITIONS - 1) - first - i))

    line = F.array_join(tokens, " ")
    whole = _let(_units(tokens, gram), lambda u: hashed(u, F.lit(0)))
    short = (F.size(tokens) <= SHORT) & (F.char_length(line) <= SHORT)
    grams = _let(whole, lambda w: F.when(short, F.concat(w, _let(F.split(line, ""), lambda c: hashed(c, F.size(w))))).otherwise(w))
    return F.when(F.size(tokens) > 0, grams).otherwise(F.array().cast("array<bigint>"))


def _select(grams: Column, window: int) -> Column:
    """The least gram of every window, each once, in order of position."""
    least = F.transform(F.sequence(F.lit(1), F.greatest(F.size(grams) - window + 1, F.lit(1))),
                        lambda i: F.array_min(F.slice(grams, i, window)))
    return F.when(F.size(grams) > 0, F.array_distinct(least)).otherwise(grams)


def with_fingerprint(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``out``: array of selected grams of the column ``text``."""
    steps = df.withColumn("_tokens", words(F.col(text)))
    steps = steps.withColumn("_grams", _grams(F.col("_tokens"), gram))
    return steps.withColumn(out, _select(F.col("_grams"), window)).drop("_tokens", "_grams")


def hashes(selected: Column) -> Column:
    """32-bit hashes of the selected grams."""
    return F.transform(selected, lambda v: F.shiftright(v, 31))


def positions(selected: Column) -> Column:
    """Positions of the selected grams: units, then code points of short texts."""
    return F.transform(selected, lambda v: F.lit(_POSITIONS - 1) - v.bitwiseAND(F.lit(_POSITIONS - 1)))


def as_text(selected: Column) -> Column:
    """``hash@position`` of every selected gram, joined by commas."""
    return F.array_join(F.transform(selected, lambda v: F.concat(
        F.lower(F.hex(F.shiftright(v, 31))), F.lit("@"),
        (F.lit(_POSITIONS - 1) - v.bitwiseAND(F.lit(_POSITIONS - 1))).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Dice measure of two fingerprints' hash sets."""
    x, y = F.array_distinct(hashes(a)), F.array_distinct(hashes(b))
    both = F.size(x) + F.size(y)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / both)


def _block_of(cuts: list[int]) -> Column:
    """How many cuts are at or below ``doc_id``, looked up in two steps of about 64 comparisons; 0 for null ids."""
    coarse, fine = [F.array(*[F.lit(c) for c in part]).cast("array<bigint>") for part in (cuts[::64], cuts)]
    reached = F.size(F.filter(coarse, lambda c: c <= F.col("doc_id")))
    start = F.greatest(reached - 1, F.lit(0)) * 64
    inside = F.size(F.filter(F.slice(fine, start + 1, F.lit(64)), lambda c: c <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(start + inside)


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp, next_text, next_fp for every row; the first row follows the last.

    Ids are cut into blocks of nearly equal row counts by approximate percentiles, a bounded number whatever the input;
    each cut is an id of the table.  A block is ordered by itself; a copy of the first row of the following block, which
    is the row whose id equals the cut, closes it.  Texts move once.
    """
    spark = docs.sparkSession
    n = min(MAX_BLOCKS, BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    seen = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("cuts"),
                    F.min("doc_id").alias("least"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    cuts = sorted(set(seen["cuts"] or []) - {seen["least"]})
    first = F.col("doc_id").isNull() if seen["nulls"] else F.col("doc_id") == F.lit(seen["least"])
    closes = (F.when(first, F.lit(len(cuts)))
              .when(F.col("doc_id").isin(cuts) if cuts else F.lit(False), F.col("_block") - 1))
    spread = (rows.withColumn("_block", _block_of(cuts).cast("int"))
              .withColumn("_block", F.explode(F.filter(F.array(
                  F.struct(F.col("_block").alias("at"), F.lit(False).alias("copy")),
                  F.struct(closes.alias("at"), F.lit(True).alias("copy"))), lambda x: x["at"].isNotNull())))
              .select("doc_id", "text", F.col("_block.at").alias("_block"), F.col("_block.copy").alias("_copy")))
    dealt = with_fingerprint(spread.repartition("_block"), "text", "fp").withColumn("_order", F.xxhash64("text"))
    within = Window.partitionBy("_block").orderBy("_copy", F.asc_nulls_first("doc_id"), "_order")
    return (dealt.withColumn("next_text", F.lead("text").over(within)).withColumn("next_fp", F.lead("fp").over(within))
            .where(~F.col("_copy")).select("doc_id", "text", "fp", "next_text", "next_fp"))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last quarter replaced by the next document's beginning."""
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    both = with_fingerprint(linked(docs).withColumn("edited", edited), "edited", "edited_fp")
    return both.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
