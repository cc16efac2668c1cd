"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table

__all__ = ["SPACE", "ascii_lower", "attach", "slices", "stage_table", "words"]

# The white space that separates words in every contract of this package.
SPACE = r"\x20\x09-\x0D"
_TRIM = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Up to so many rows a summary table counts as small; its rows are narrow, so it stays below a few MB.
SMALL_ROWS = 50_000
SALTS = 32


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; no other letter changes."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` in order; an empty array for null, empty or blank texts."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))


def attach(rows: DataFrame, summary: DataFrame, key: str, salt: Column, how: str = "left",
           small_rows: int = SMALL_ROWS) -> DataFrame:
    """Join ``rows`` with a summary table that has one row per ``key``.

    The summary is a written table, so counting it is cheap.  Up to ``small_rows`` rows it is broadcast; beyond, both
    sides are dealt by key and salt, so a key that holds a third of all rows meets its summary row in many tasks.  The
    planner takes the salted summary for as small as the summary, so the join is named: it must not be broadcast.
    """
    if summary.count() <= small_rows:
        return rows.join(F.broadcast(summary), key, how)
    salted = summary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(
        salted.hint("merge"), [key, "_salt"], how).drop("_salt")


def slices(batch, limit: int) -> Iterator:
    """An Arrow batch in slices whose texts stay below ``limit`` bytes, except for single longer texts."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
