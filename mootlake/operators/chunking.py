"""Overlapping chunks of whole turns under a character budget.

Where a chunk ends and where the next one starts depends only on the turns that
follow, but which starts are used depends on all earlier choices.  The scan is
therefore done block-wise: every block of turns computes, for each position an
earlier chunk could hand over, where it would hand over in turn; these small
tables are followed once per meeting; then every block writes its own chunks.
Meetings that fit one block skip the first two steps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import hms
from . import scan
from .transcript import KEY, turn_text

CHUNK_CHARS = 12_000
OVERLAP_CHARS = 2_000
BLOCK_TURNS = 65_536
SHORTEST_TURN = 25  # a written turn has at least its time header


def steps(lengths: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start turn: end of its chunk (exclusive) and the next start."""
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    start = np.arange(len(lengths))
    end = np.maximum(start + 1, np.searchsorted(total, total[:-1] + size, side="right") - 1)
    back = np.searchsorted(total, total[end] - overlap, side="right") - 1
    follow = np.maximum(start + 1, np.minimum(back, end - 1))
    return end, follow


def _hand_over(size: int, overlap: int, block: int):
    """Entry position to exit position, both counted from their block's start."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        blk, n = int(pdf["__blk"].iloc[0]), int(pdf["n_turns"].iloc[0])
        own = min(block, n - blk * block)
        end, follow = steps(pdf["char_len"].to_numpy(), size, overlap)
        last = blk * block + end >= n
        exits = np.full(own, -1, dtype=np.int64)
        for i in range(own - 1, -1, -1):
            if not last[i]:
                exits[i] = follow[i] - block if follow[i] >= block else exits[follow[i]]
        reach = size // SHORTEST_TURN + 2
        return pd.DataFrame({"meeting_id": [pdf["meeting_id"].iloc[0]], "__blk": [blk],
                             "exits": [exits[:reach].tolist()]})
    return run


def _write(size: int, overlap: int, block: int):
    """Chunks that start in this block, from its entry position on."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        blk, n = int(pdf["__blk"].iloc[0]), int(pdf["n_turns"].iloc[0])
        at, base = int(pdf["entry"].iloc[0]), blk * block
        found: list[tuple[int, int]] = []
        if pdf["n_chars"].iloc[0] <= 2 * size:
            found = [(0, n)] if blk == 0 else []
        elif at >= 0:
            end, follow = steps(pdf["char_len"].to_numpy(), size, overlap)
            while at < min(block, n - base):
                found.append((base + at, base + int(end[at])))
                if base + end[at] >= n:
                    break
                at = int(follow[at])
        return pd.DataFrame({"meeting_id": [pdf["meeting_id"].iloc[0]] * len(found),
                             "pos_from": [f for f, _ in found], "pos_to": [t for _, t in found]})
    return run


def chunk_ranges(turns: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
                 block: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """(chunks as position ranges, turns with position and written text)."""
    reach = size // SHORTEST_TURN + 2
    block = max(block, 2 * reach)
    text = turns.select("meeting_id", "turn_no", "speaker", turn_text(turns).alias("line"),
                        F.col("start_s" if "start_s" in turns.columns else "start_sec").alias("t0"),
                        F.col("end_s" if "end_s" in turns.columns else "end_sec").alias("t1"))
    placed = scan.row_numbers(text, KEY, "turn_no", "pos").withColumn("pos", F.col("pos") - 1)
    sized = placed.select("meeting_id", "pos", F.length("line").cast("long").alias("char_len"),
                          F.floor(F.col("pos") / block).alias("__blk"))
    totals = sized.groupBy("meeting_id", "__blk").agg(
        F.count(F.lit(1)).alias("n"), F.sum("char_len").alias("c"))
    meeting = totals.groupBy("meeting_id").agg(F.sum("n").alias("n_turns"), F.sum("c").alias("n_chars"))
    blocks = totals.join(meeting, "meeting_id").select("meeting_id", "__blk", "n_turns", "n_chars")
    # the first turns of a block are also read by the block before it
    halo = F.when((F.col("pos") % block < reach + 1) & (F.col("__blk") > 0),
                  F.array(F.col("__blk"), F.col("__blk") - 1)).otherwise(F.array(F.col("__blk")))
    rows = sized.withColumn("__blk", F.explode(halo)).join(blocks, ["meeting_id", "__blk"])

    key_type = dict(turns.dtypes)["meeting_id"]
    long_ones = rows.filter((F.col("n_turns") > block) & (F.col("n_chars") > 2 * size))
    exits = long_ones.groupBy("meeting_id", "__blk").applyInPandas(
        _hand_over(size, overlap, block), f"meeting_id {key_type}, __blk long, exits array<bigint>")
    empty = F.array().cast("array<struct<b:bigint,e:bigint>>")
    path = exits.groupBy("meeting_id").agg(F.array_sort(F.collect_list(F.struct("__blk", "exits"))).alias("b")).select(
        "meeting_id", F.explode(F.aggregate(
            "b", F.struct(F.lit(0).cast("long").alias("at"), empty.alias("path")),
            lambda acc, x: F.struct(
                F.when(acc["at"] >= 0, F.get(x["exits"], acc["at"].cast("int"))).otherwise(F.lit(-1)).cast("long").alias("at"),
                F.array_append(acc["path"], F.struct(x["__blk"].alias("b"), acc["at"].alias("e"))).alias("path")),
        )["path"]).alias("p")).select("meeting_id", F.col("p.b").alias("__blk"), F.col("p.e").alias("entry"))
    ready = rows.join(path, ["meeting_id", "__blk"], "left").withColumn(
        "entry", F.coalesce("entry", F.when(F.col("n_turns") > block, F.lit(-1)).otherwise(F.lit(0)).cast("long")))
    ranges = ready.groupBy("meeting_id", "__blk").applyInPandas(
        _write(size, overlap, block), f"meeting_id {key_type}, pos_from long, pos_to long")
    return scan.row_numbers(ranges, KEY, "pos_from", "chunk_id"), placed


def build_chunks(turns: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
                 block: int = BLOCK_TURNS) -> DataFrame:
    """Chunk texts with their turn and time range."""
    ranges, placed = chunk_ranges(turns, size, overlap, block)
    member = ranges.withColumn("pos", F.explode(F.sequence("pos_from", F.col("pos_to") - 1)))
    return (member.join(placed, ["meeting_id", "pos"]).groupBy("meeting_id", "chunk_id")
            .agg(F.min("turn_no").alias("turn_from"), F.max("turn_no").alias("turn_to"),
                 hms(F.min_by("t0", "pos")).alias("start_time"), hms(F.max_by("t1", "pos")).alias("end_time"),
                 F.count(F.lit(1)).alias("n_turns"), F.sum(F.length("line")).alias("n_chars"),
                 scan.join_in_order(F.collect_list(F.struct(F.col("pos").alias("o"), F.col("line").alias("t"))),
                                    "\n\n").alias("text")))
