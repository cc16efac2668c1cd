"""At most one overdue digest per board and day."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import BatchSink, drain

SENT = "board bigint, day date, n_overdue bigint"
_CHECK = "board bigint, day date, checked_at timestamp, check_no bigint, n_overdue bigint"


def _earliest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every batch of rows the first check per board and day, before anything is shuffled."""
    for frame in frames:
        yield frame.sort_values(["checked_at", "check_no"]).drop_duplicates(["board", "day"])


def _once(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The digests of one board; the state is the days that had theirs, as ordinals (-1: no day)."""
    sent = set(state.get[0]) if state.exists else set()
    best: dict[int, tuple] = {}
    for frame in frames:
        for day, at, number, n in zip(*(frame[c] for c in ("day", "checked_at", "check_no", "n_overdue")), strict=True):
            nth = -1 if pd.isna(day) else day.toordinal()
            order = (2**63 if pd.isna(at) else at.value, float("inf") if pd.isna(number) else number)
            if nth not in sent and (nth not in best or order < best[nth][0]):
                best[nth] = (order, day, n)
    if best:
        yield pd.DataFrame({"board": [key[0]] * len(best), "day": [b[1] for b in best.values()], "n_overdue": [b[2] for b in best.values()]})
        state.update((sorted(sent | set(best)),))


def daily(checks: DataFrame) -> DataFrame:
    """Checks (board, checked_at, check_no, n_overdue): the first with overdue cards wins the day, and is sent at once.

    Which days have their digest is kept as Spark's state of the board: a call per board and batch, not per day.  A busy board is no hot task: every task
    reduces its checks before the shuffle.
    """
    due = checks.filter("n_overdue > 0").select("board", F.to_date("checked_at").alias("day"), "checked_at", "check_no", "n_overdue")
    return due.mapInPandas(_earliest, _CHECK).groupBy("board").applyInPandasWithState(
        _once, SENT, "days array<int>", "append", GroupStateTimeout.NoTimeout)


def send_daily(checks: DataFrame, sent: BatchSink, checkpoint: str | None = None) -> None:
    drain(daily(checks), sent.write, "digest", checkpoint)
