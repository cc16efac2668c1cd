"""Series rhythm, pulse, inbox and board analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import filled, is_speaker_label, strip
from ..session import stage_table
from . import scan

PULSE_DAYS = 90
SILENT_DAYS = 14
WEEKS = 12


def _series() -> Column:
    return F.coalesce(filled(F.col("category")), F.lit(fixed.DEFAULT_CATEGORY))


def series_stats(meetings: DataFrame, as_of: Column) -> DataFrame:
    """Rhythm of every series, measured from its recordings."""
    per = (meetings.filter(F.col("date").isNotNull()).groupBy(_series().alias("series"))
           .agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"),
                F.max("date").alias("last_date"),
                F.coalesce(F.sum("n_actions"), F.lit(0)).alias("n_actions"),
                F.coalesce(F.sum("n_decisions"), F.lit(0)).alias("n_decisions")))
    span = F.greatest(F.lit(1), F.datediff("last_date", "first"))
    return per.select(
        "series", "n", "last_date",
        F.datediff(as_of, F.col("last_date")).cast("long").alias("days_since"),
        F.when(F.col("n") > 1, F.bround(F.col("n") / (span / 7), 1)).otherwise(
            F.col("n").cast("double")).alias("per_week"),
        "n_actions", "n_decisions")


def silent_series(meetings: DataFrame, as_of: Column, days: int = SILENT_DAYS) -> DataFrame:
    return series_stats(meetings, as_of).filter(F.col("days_since") > days)


def in_window(meetings: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Meetings of the last ``days`` (7..365); the future is not cut off."""
    span = max(7, min(365, int(days)))
    return meetings.filter(F.col("date") >= F.date_sub(as_of, span))


def _window_proposals(meetings: DataFrame, proposals: DataFrame, as_of: Column, days: int) -> DataFrame:
    recent = in_window(meetings, as_of, days).select(F.col("id").alias("meeting_id"))
    return proposals.join(recent, "meeting_id", "left_semi")


def pulse_kpis(meetings: DataFrame, proposals: DataFrame, as_of: Column,
               days: int = PULSE_DAYS) -> DataFrame:
    """One row of totals; each side is aggregated on its own, then unioned."""
    owner = F.col("owner")
    m = in_window(meetings, as_of, days).agg(
        F.count(F.lit(1)).alias("n_meetings"), F.sum("n_actions").alias("n_actions"),
        F.sum("n_decisions").alias("n_decisions"), F.lit(0).cast("long").alias("n_tasks"),
        F.lit(0).cast("long").alias("no_owner"))
    p = (_window_proposals(meetings, proposals, as_of, days).filter(F.col("kind") == "task")
         .agg(F.lit(0).cast("long").alias("n_meetings"), F.lit(0).cast("long").alias("n_actions"),
              F.lit(0).cast("long").alias("n_decisions"), F.count(F.lit(1)).alias("n_tasks"),
              F.count_if(filled(owner).isNull() | is_speaker_label(owner)).alias("no_owner")))
    total = m.unionByName(p).agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c)
        for c in ("n_meetings", "n_actions", "n_decisions", "n_tasks", "no_owner")])
    per = lambda c: F.when(F.col("n_meetings") > 0,
                           F.round(F.col(c) / F.col("n_meetings"), 1)).otherwise(F.lit(0.0))
    return total.select(
        F.lit(max(7, min(365, days))).cast("long").alias("days"), "*",
        F.when(F.col("n_tasks") > 0, F.floor(F.col("no_owner") * 100.0 / F.col("n_tasks") + 0.5))
        .otherwise(F.lit(0)).cast("long").alias("no_owner_pct"),
        per("n_actions").alias("actions_per_meeting"), per("n_decisions").alias("decisions_per_meeting"))


def _top(df: DataFrame, key: Column, name: str, limit: int) -> DataFrame:
    """Most frequent values; ties go to the value seen first."""
    counted = df.groupBy(key.alias(name)).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "id")).alias("__first"))
    return counted.orderBy(F.desc("n"), "__first").limit(limit).drop("__first")


def pulse_by_owner(meetings: DataFrame, proposals: DataFrame, as_of: Column,
                   days: int = PULSE_DAYS, limit: int = 8) -> DataFrame:
    tasks = _window_proposals(meetings, proposals, as_of, days).filter(
        (F.col("kind") == "task") & filled(F.col("owner")).isNotNull()
        & ~is_speaker_label(F.col("owner")))
    return _top(tasks, F.col("owner"), "owner", limit)


def pulse_by_section(meetings: DataFrame, proposals: DataFrame, as_of: Column,
                     days: int = PULSE_DAYS, limit: int = 8) -> DataFrame:
    named = _window_proposals(meetings, proposals, as_of, days).withColumn(
        "section", strip("section")).filter(filled(F.col("section")).isNotNull())
    return _top(named, F.col("section"), "section", limit)


def weekly_rhythm(meetings: DataFrame, as_of: Column, days: int = PULSE_DAYS) -> DataFrame:
    """Meetings per week, index 11 is the current one; empty weeks stay."""
    age = F.floor(F.datediff(as_of, "date") / 7)
    counts = (in_window(meetings, as_of, days).filter(age.between(0, WEEKS - 1))
              .groupBy((F.lit(WEEKS - 1) - age).cast("long").alias("week"))
              .agg(F.count(F.lit(1)).alias("c")))
    weeks = meetings.sparkSession.range(WEEKS).select(F.col("id").alias("week"))
    return weeks.join(counts, "week", "left").select(
        "week", F.coalesce("c", F.lit(0)).alias("n_meetings"))


def pulse(meetings: DataFrame, proposals: DataFrame, as_of: Column, days: int = PULSE_DAYS) -> DataFrame:
    """The whole pulse screen as rows (part, key, value)."""
    kpis = pulse_kpis(meetings, proposals, as_of, days)
    names = [c for c in kpis.columns if c not in ("actions_per_meeting", "decisions_per_meeting")]
    kpi_rows = kpis.select(F.expr("stack({}, {}) as (key, value)".format(
        len(names), ", ".join(f"'{c}', {c}" for c in names))))
    part = lambda df, label, key, value: df.select(
        F.lit(label).alias("part"), F.col(key).cast("string").alias("key"),
        F.col(value).cast("long").alias("value"))
    return (part(kpi_rows, "kpi", "key", "value")
            .unionByName(part(weekly_rhythm(meetings, as_of, days), "week", "week", "n_meetings"))
            .unionByName(part(pulse_by_owner(meetings, proposals, as_of, days), "owner", "owner", "n"))
            .unionByName(part(pulse_by_section(meetings, proposals, as_of, days), "section", "section", "n"))
            .unionByName(part(silent_series(meetings, as_of), "silent", "series", "days_since")))


def inbox_meetings(meetings: DataFrame, proposals: DataFrame, limit: int = 30) -> DataFrame:
    """Newest meetings that have proposals, with total and pending-task counts."""
    counts = proposals.groupBy("meeting_id").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if((F.col("status") == "proposed") & (F.col("kind") == "task")).alias("n_pending"))
    return (meetings.join(counts, meetings["id"] == counts["meeting_id"])
            .select("id", "date", "title", "category", "n_total", "n_pending",
                    F.col("date_source").isin("mtime", "processing_day").alias("date_is_indirect"))
            .orderBy(F.col("date").desc_nulls_last(), F.desc("id")).limit(limit))


def open_tasks_for_series(meetings: DataFrame, proposals: DataFrame, limit: int = 12) -> DataFrame:
    """The newest unsent tasks of every series at once."""
    open_tasks = proposals.filter((F.col("kind") == "task") & F.col("status").isin("proposed", "accepted"))
    dated = meetings.select(F.col("id").alias("meeting_id"), _series().alias("series"),
                            F.col("date").alias("m_date"), F.col("title").alias("m_title"))
    rank = Window.partitionBy("series").orderBy(F.col("m_date").desc_nulls_last(), "idx", "id")
    return (open_tasks.join(dated, "meeting_id")
            .withColumn("rank", F.row_number().over(rank).cast("long"))
            .filter(F.col("rank") <= limit)
            .select("series", "rank", "id", "text", "owner", "m_date", "m_title"))


def latest_per_series(meetings: DataFrame, recent: int = 6) -> DataFrame:
    """The newest meetings of every series; rank 1 is the one to brief from."""
    rank = Window.partitionBy("series").orderBy(F.desc("date"), F.desc("id"))
    return (meetings.filter(F.col("date").isNotNull()).withColumn("series", _series())
            .withColumn("rank", F.row_number().over(rank).cast("long"))
            .filter(F.col("rank") <= recent).select("series", "rank", "id", "date", "title"))


def due_drift(journal: DataFrame, cards: DataFrame, limit: int = 50) -> DataFrame:
    """First due date against today's card, for the last dispatched tasks."""
    last = (journal.filter(F.coalesce(F.col("card_id"), F.lit("")) != "")
            .orderBy(F.desc("seq"), F.desc("proposal_id")).limit(limit))
    # at most ``limit`` keys are broadcast to the card snapshot
    wanted = F.broadcast(last.select("card_id").distinct())
    found = cards.join(wanted, "card_id", "left_semi").select(
        "card_id", F.col("due").alias("current_due"),
        (F.coalesce("closed", F.lit(False)) | F.coalesce("due_complete", F.lit(False))).alias("closed"),
        F.lit(True).alias("__hit"))
    return last.join(found, "card_id", "left").select(
        "proposal_id", "text", "owner", "due_v1", "current_due",
        F.coalesce(F.datediff("current_due", "due_v1"), F.lit(0)).cast("long").alias("moved_days"),
        F.coalesce("closed", F.lit(False)).alias("closed"), F.col("__hit").isNull().alias("missing"))


def done_lists(lists: DataFrame, done_names: list[str] | None = None) -> DataFrame:
    """Lists whose name contains any of the names that mean 'done'."""
    names = [n.strip().lower() for n in (done_names or fixed.DONE_LISTS) if n.strip()]
    name = F.lower(strip(F.coalesce("name", F.lit(""))))
    return lists.filter(F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(name, n))
                        ).select("list_id")


def overdue_cards(cards: DataFrame, lists: DataFrame, now: Column,
                  done_names: list[str] | None = None) -> DataFrame:
    """Open cards past their due moment, outside the done lists."""
    late = cards.filter(~F.coalesce("closed", F.lit(False)) & ~F.coalesce("due_complete", F.lit(False))
                        & (F.col("due").cast("timestamp") < now))
    seconds = F.unix_timestamp(now) - F.unix_timestamp(F.col("due").cast("timestamp"))
    return late.join(done_lists(lists, done_names), "list_id", "left_anti").select(
        "card_id", F.coalesce(filled(F.col("name")), F.lit("Без названия")).alias("name"), "due",
        F.floor(seconds / 86400).alias("days"))


def overdue_digest(overdue: DataFrame, shown: int = 15) -> DataFrame:
    """The daily message: the longest overdue cards and how many more there are."""
    top = overdue.orderBy(F.desc("days"), "card_id").limit(shown)
    line = F.concat(F.lit("• "), "name", F.lit(" — до "), F.date_format("due", "dd.MM"), F.lit(" ("),
                    F.when(F.col("days") > 0, F.concat(F.lit("+"), F.col("days").cast("string"), F.lit(" дн.")))
                    .otherwise("сегодня"), F.lit(")"))
    lines = top.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("days")).alias("d"), "card_id", line.alias("t")))),
        lambda x: x["t"]), "\n").alias("lines"), F.lit(0).cast("long").alias("n"))
    count = overdue.agg(F.lit(None).cast("string").alias("lines"), F.count(F.lit(1)).alias("n"))
    both = lines.unionByName(count).agg(F.max("lines").alias("lines"), F.sum("n").alias("n"))
    more = F.when(F.col("n") > shown, F.concat(F.lit("…и ещё "), (F.col("n") - shown).cast("string")))
    return both.filter(F.col("n") > 0).select(F.col("n").alias("n_overdue"), F.concat_ws(
        "\n", F.concat(F.lit("⏰ Просроченных задач на доске: "), F.col("n").cast("string")), "lines",
        more, F.lit("Статусы двигаем в Trello, бот только напоминает.")).alias("message"))


def meeting_search(meetings: DataFrame, needle: str, shown: int = 40) -> DataFrame:
    """Case-insensitive substring search with the number of hits not shown."""
    text = needle.strip().lower()
    hit = F.lit(False)
    for c in ("title", "category", "subcategory", "stem"):
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text))
    hits = meetings.filter(hit if text else F.lit(True))
    more = hits.agg(F.greatest(F.count(F.lit(1)) - shown, F.lit(0)).alias("n_more"))
    top = hits.orderBy(F.col("date").desc_nulls_last(), F.desc("id")).limit(shown)
    return top.select("id", "date", "title", "category", more.scalar().alias("n_more"))


def extraction_profile(proposals: DataFrame) -> DataFrame:
    """Owner class by month of the due date, with due coverage."""
    owner = (F.when(filled(F.col("owner")).isNull(), "none").when(is_speaker_label(F.col("owner")), "label")
             .otherwise("person"))
    return (proposals.withColumn("owner_class", owner)
            .withColumn("month", F.date_format(F.trunc("due", "month"), "yyyy-MM"))
            .rollup("kind", "owner_class", "month")
            .agg(F.count(F.lit(1)).alias("n"), F.count("due").alias("n_due"),
                 F.grouping_id().alias("level")))




def archive_by_category(meetings: DataFrame) -> DataFrame:
    """Archive index: how many meetings a category holds, how many in detail."""
    return meetings.groupBy(_series().alias("series")).agg(
        F.count(F.lit(1)).alias("n_meetings"), F.max("date").alias("last_date"),
        F.count_if(F.col("n_actions") > 0).alias("n_detailed"))


def confidence_profile(proposals: DataFrame) -> DataFrame:
    """How sure the extractor was, by kind, with the due dates known."""
    level = F.coalesce(filled(F.lower("confidence")), F.lit("none"))
    return proposals.groupBy("kind", level.alias("confidence")).agg(F.count(F.lit(1)).alias("n"), F.count("due").alias("n_due"))


# --- ordered reports -------------------------------------------------------------


def newest_first(rows: DataFrame, order: list[str]) -> DataFrame:
    """All rows, newest first (``order`` descending, unknown last), with their ``rank``.

    A range sort and one offset per task: no window puts the report into a single task.
    """
    by = [F.col(c).desc_nulls_last() for c in order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stage_table(placed.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id()}), "report")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row per task
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(offsets, "__part").withColumn("rank", rank).drop("__part", "__place", "__before")


def review_report(proposals: DataFrame) -> DataFrame:
    """Proposals of each meeting in the extractor's order."""
    return scan.row_numbers(proposals, ["meeting_id"], "idx", "rank", then=["id"])


def archive_index(meetings: DataFrame) -> DataFrame:
    """The archive, newest first, as a whole and inside each category."""
    rows = meetings.select(_series().alias("category"), "stem", "date", *[c for c in ("mtime",) if c in meetings.columns])
    order = [c for c in ("date", "mtime", "stem") if c in rows.columns]
    ranked = newest_first(rows, order)
    # Inside a category the order is that of the whole, so the whole rank is an integer position to count by.
    return scan.row_numbers(ranked, ["category"], "rank", "rank_in_category")


def last_entries(journal: DataFrame, n: int) -> DataFrame:
    """The newest entries of the journal."""
    return journal.orderBy(F.desc("seq"), F.desc("proposal_id")).limit(n)
