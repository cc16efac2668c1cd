"""Live transcripts: turns are written as soon as the voice changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import filled, strip
from ..functions.times import number_or
from ..operators.transcript import finish_turns
from .common import BatchSink, drain

RUNS = ("meeting_id bigint, run bigint, first_seg bigint, start_s double, end_s double, last_seg bigint, "
        "speaker string, text string")
_SEGMENT = "meeting_id bigint, seg_no bigint, start_s double, end_s double, speaker string, text string"
# The open run, the number of the segment that comes next, and segments that came before their turn.
_STATE = ("run bigint, first_seg bigint, start_s double, end_s double, last_seg bigint, speaker string, text string, next_seg bigint, "
          "waiting array<struct<seg_no:bigint,start_s:double,end_s:double,speaker:string,text:string>>")
_FIELDS = ["seg_no", "start_s", "end_s", "speaker", "text"]


def _given(value):
    return None if value is None or value != value else value


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Segments of one meeting, whatever their order; runs come out when the next voice begins or, open, at the batch's end."""
    if state.exists:
        run, first, start, end, last, speaker, text, follows, waiting = state.get
        early = {w[0]: tuple(w) for w in waiting or ()}
    else:
        run, first, start, end, last, speaker, text, follows, early = None, None, None, None, None, None, None, 1, {}
    said = [text] if text else []
    out: list[tuple] = []

    def take(segment: tuple) -> None:
        nonlocal run, first, start, end, last, speaker, said, follows
        number, begins, ends, voice, words = segment
        if run is None or voice != speaker:
            if run is not None:
                out.append((key[0], run, first, start, end, last, speaker, " ".join(said) or None))
            # Run 0 is the unlabelled beginning.
            run = (0 if voice is None else 1) if run is None else run + 1
            first, start, speaker, said = number, begins, voice, []
        end, last, follows = ends, number, number + 1
        said += [words] if words else []

    for frame in frames:
        # A frame holds a few rows of one meeting: plain lists cost a fraction of pandas' own sort and types.
        for row in sorted(zip(*[frame[c].tolist() for c in _FIELDS], strict=True), key=lambda r: r[0]):
            segment = (int(row[0]), *map(_given, row[1:]))
            if segment[0] >= follows:  # earlier numbers are repeats
                early[segment[0]] = segment
        while follows in early:
            take(early.pop(follows))
    text = " ".join(said) or None
    if run is not None:
        out.append((key[0], run, first, start, end, last, speaker, text))
    state.update((run, first, start, end, last, speaker, text, follows, [early[n] for n in sorted(early)]))
    if out:
        yield pd.DataFrame(dict(zip([c.split()[0] for c in RUNS.split(", ")], map(list, zip(*out, strict=True)), strict=True)))


def live_runs(segments: DataFrame) -> DataFrame:
    """Runs of one voice: closed ones once, the open one of a meeting as it stands after each batch.

    The open run is Spark's state of the meeting, and so are segments that arrived before an earlier one: numbers count from 1
    without gaps, and a segment waits until all before it are there.  A repeated segment changes nothing.
    """
    start = number_or(F.col("start_s"), F.lit(0.0))
    ready = segments.select("meeting_id", "seg_no", start.alias("start_s"), number_or(F.col("end_s"), start).alias("end_s"), "speaker",
                            filled(strip(F.col("text"))).alias("text"))
    return ready.groupBy("meeting_id").applyInPandasWithState(_follow, RUNS, _STATE, "update", GroupStateTimeout.NoTimeout)


def run_turns(segments: DataFrame, runs: BatchSink, checkpoint: str | None = None) -> None:
    drain(live_runs(segments), runs.write, "turns", checkpoint, "update")


def all_turns(runs: BatchSink) -> DataFrame:
    """Everything said so far, the open turns included: of a run the state after its last segment."""
    newest = runs.read().groupBy("meeting_id", "run").agg(F.max_by(F.struct(*[c.split()[0] for c in RUNS.split(", ")[2:]]), "last_seg").alias("r"))
    return finish_turns(newest.select("meeting_id", "run", "r.*"))
