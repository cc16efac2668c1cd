"""Extracted items checked against the transcript: quotes, times, owners, kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_filled, strip
from ..session import stage_table
from .evidence import quote_time
from .items import task_or_minor
from .people import normalize_owner
from .pii import clear_invented_owners

KEY = ["meeting_id", "item_no"]


def verified_quotes(items: DataFrame, turns: DataFrame, words: DataFrame | None, first: str, second: str) -> DataFrame:
    """meeting_id, item_no, quote_verified, t_sec of the items that quote something."""
    quoted = items.select(*KEY, strip(first_filled(F.col(first), F.col(second))).alias("quote")).filter("quote <> ''")
    return quote_time(stage_table(quoted, "quoted"), turns, words).withColumnRenamed("verified", "quote_verified")


def enrich_actions(actions: DataFrame, turns: DataFrame, people: DataFrame, token_map: DataFrame,
                   words: DataFrame | None = None) -> DataFrame:
    """Actions (meeting_id, item_no, owner, confidence, evidence, quote, ...) with everything that is checked and not believed.

    ``quote_verified`` and ``t_sec`` come from the transcript; an item without a found quote keeps its own time, if it has one.
    Owners become the registry's spelling; one that names a token which the meeting's map does not hold is cleared, with a note.
    What has an owner and high confidence then is a task.
    """
    checked = verified_quotes(actions, turns, words, "evidence", "quote")
    known = F.col("t_sec") if "t_sec" in actions.columns else F.lit(None).cast("bigint")
    rows = actions.withColumn("own_time", known).drop("t_sec", "quote_verified").join(checked, KEY, "left").withColumns({
        "quote_verified": F.coalesce("quote_verified", F.lit(False)), "t_sec": F.coalesce("t_sec", "own_time")}).drop("own_time")
    named = normalize_owner(rows.withColumnRenamed("owner", "raw"), people).drop("raw")
    cleared = clear_invented_owners(named, KEY, token_map)
    matched = F.col("matched") & F.col("owner_note").isNull()
    return cleared.withColumn("owner_matched", matched).drop("matched").withColumn(
        "kind", task_or_minor(F.col("owner"), F.coalesce("confidence", F.lit(""))))


def enrich_decisions(decisions: DataFrame, turns: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Decisions with their quotes checked; the quote comes before the evidence here, and items without one are left as they are."""
    checked = verified_quotes(decisions, turns, words, "quote", "evidence")
    return decisions.drop("quote_verified", "t_sec").join(checked, KEY, "left")
