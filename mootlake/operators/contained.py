"""Which texts are contained in another one of their group, without a group in one place and without all pairs.

A text that lies inside another shares the least hashes of its stretches with it (winnowing): each stretch of ``WINDOW`` grams
of ``GRAM`` code points selects the gram of the least hash, and the same stretch selects the same gram wherever it stands.  So
the outer text is found through any selected gram of the inner one, and the rarest is asked: a text with a word of its own has
a gram of its own and asks nobody.  Texts too short for a stretch are asked for whole: outer texts answer with those of the short ones
of their group that they hold, or, where a group has more than ``SHORT_TEXTS`` of them, with all their grams of the lengths that occur
among these.  Every answer is then tested by ``contains``.

Grams travel as (gram, group, order), three numbers; the answers only where a bit map of fixed size says that a text may ask for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import small_side, stage_table

GRAM, WINDOW = 8, 16
SHORTEST = GRAM + WINDOW - 1
TEXTS_AT_ONCE = 256
SHORT_TEXTS = 512
SMALL_GROUPS = 1_000
MAP_BITS = 24
_MULT = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` code points; a polynomial, so one pass over the text whatever the size."""
    if len(codes) < size:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        out = np.zeros(len(codes) - size + 1, np.uint64)
        for j in range(size):
            out = out * _MULT + wide[j:len(codes) - size + 1 + j]
        out ^= out >> np.uint64(29)
        return out * _MULT


def selected(hashes: np.ndarray) -> np.ndarray:
    """Distinct least hashes of all windows."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.uint64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, WINDOW).min(axis=1))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _grams(batches: Iterator) -> Iterator:
    """(id, size, gram): the selected grams, of size 0, and the short texts of the group that occur, or all grams of their lengths."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            part = batch.slice(at, TEXTS_AT_ONCE)
            owner, size, gram = [], [], []
            columns = [part.column(c).to_pylist() for c in ("text", "lengths", "shorts")]
            for i, (text, lengths, shorts) in enumerate(zip(*columns, strict=True)):
                codes = _codes(text)
                found = [(0, selected(gram_hashes(codes, GRAM)))] if len(codes) >= SHORTEST else []
                found += [(len(t), gram_hashes(_codes(t), len(t))) for t in shorts if t in text]
                for n, hashes in found + [(n, np.unique(gram_hashes(codes, n))) for n in lengths if n <= len(codes)]:
                    owner.append(np.full(len(hashes), i, np.int64))
                    size.append(np.full(len(hashes), n, np.int32))
                    gram.append(hashes.view(np.int64))
            if owner:
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(size)),
                                                  pa.array(np.concatenate(gram))], names=["id", "size", "gram"])


def _placed(hashes: np.ndarray, gid: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Grams with their group and size in the hash, so that a gram travels as one number."""
    out = hashes.view(np.uint64) ^ (gid.view(np.uint64) * _MULT + size.astype(np.uint64))
    out ^= out >> np.uint64(32)
    out *= _MULT
    return out ^ out >> np.uint64(29)


def _placed_grams(texts: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """(gid, o, own, gram) of texts whose id has gid, o and n; ``own`` are those that a text may ask by.  With a bit map of
    the grams that are asked by, only those that may be among them."""
    kind = texts.schema["id"].dataType["o"].dataType.simpleString()
    shared = None if asked is None else texts.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in _grams(batches):
            who = batch.column("id")
            gid, n = who.field("gid").to_numpy(), who.field("n").to_numpy()
            size = batch.column("size").to_numpy()
            gram = _placed(batch.column("gram").to_numpy(), gid, size)
            out = pa.RecordBatch.from_arrays([who.field("gid"), who.field("o"), pa.array(size == np.where(n < SHORTEST, n, 0)),
                                              pa.array(gram.view(np.int64))], names=["gid", "o", "own", "gram"])
            yield out if shared is None else out.filter(pa.array(_may_hold(shared.value, gram)))

    return texts.mapInArrow(run, f"gid bigint, o {kind}, own boolean, gram bigint")


def _bit_map(grams: DataFrame) -> np.ndarray:
    """Bits of a fixed number of places, set where one of the grams has its place."""
    place = F.shiftrightunsigned("gram", 64 - MAP_BITS)
    cells = grams.select(F.shiftright(place, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("bit"))
    rows = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[rows["cell"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _may_hold(bits: np.ndarray, grams: np.ndarray) -> np.ndarray:
    place = grams >> np.uint64(64 - MAP_BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def contained(texts: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """(group, order) of the texts that an earlier text of their group contains; texts of a group are distinct, not null, not
    empty, and ``order`` is unique."""
    # a group travels as a hash of its columns; groups of one hash are told apart where texts are tested
    gid = F.xxhash64(*[x for c in group for x in (F.col(c), F.col(c).isNull())])
    rows = texts.select(F.struct(*group).alias("g"), gid.alias("gid"), F.col(order).alias("o"), F.col(text).alias("text")).withColumn(
        "n", F.char_length("text"))
    small = rows.filter(F.col("n") < SHORTEST)
    lengths = small.groupBy("g").agg(F.collect_set("n").alias("lengths"), F.count(F.lit(1)).alias("many"))  # SHORTEST values at most
    few = small.join(lengths.filter(F.col("many") <= SHORT_TEXTS).select("g"), "g", "left_semi")
    short = lengths.filter(F.col("many") > SHORT_TEXTS).select("g", "lengths", F.array().cast("array<string>").alias("shorts")).unionByName(
        few.groupBy("g").agg(F.array().cast("array<int>").alias("lengths"), F.collect_list("text").alias("shorts")))
    # a row holds SHORT_TEXTS short texts at most
    short = small_side(short, "short-texts", SMALL_GROUPS)
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    given = rows.join(short, "g", "left").select(F.struct("gid", "o", "n").alias("id"), "text", none("lengths", "int"), none("shorts", "string"))
    # The gram that a text asks by: the rarest of its own; one that no other text has needs no question.
    grams = _placed_grams(given)
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    rarest = (grams.filter("own").select("gram", "gid", "o").join(shared, "gram", "left").groupBy("gid", "o")
              .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).filter("r.df > 0"))
    asking = stage_table(rarest.select("gid", F.col("o").alias("inner"), "r.gram"), "asking")
    # Of all grams only those travel that may be asked for.
    answers = _placed_grams(given, _bit_map(asking)).select("gid", F.col("o").alias("outer"), "gram")
    pairs = asking.join(answers, ["gid", "gram"]).filter(F.col("outer") < F.col("inner")).select("gid", "inner", "outer")
    pairs = small_side(pairs, "contained-pairs")
    texts_of = lambda name: rows.select("gid", F.col("o").alias(name), F.col("g").alias(f"{name}_g"), F.col("text").alias(f"{name}_text"))
    tested = pairs.join(texts_of("inner"), ["gid", "inner"]).join(texts_of("outer"), ["gid", "outer"]).filter(
        F.col("inner_g").eqNullSafe(F.col("outer_g")) & F.contains("outer_text", F.col("inner_text")))
    return tested.select("inner_g", "inner").distinct().select(*[F.col(f"inner_g.{c}").alias(c) for c in group], F.col("inner").alias(order))
