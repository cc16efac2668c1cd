"""Review state as versioned snapshots: merge, patch, gate, journal.

Every function maps (old snapshot, batch) to the next snapshot; writing it is
the caller's business (see ``sources.snapshots``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import filled, first_filled, source_key, strip
from ..functions.times import timecode
from ..session import stage_table
from . import scan
from .items import task_or_minor


def upsert_meetings(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge by (dir, stem); an empty date or hash never replaces a known one.

    ``batch_no`` orders repeated messages about one meeting; per field the last
    usable value wins.
    """
    key = ["dir", "stem"]
    last = lambda c: F.max_by(c, "batch_no")
    # Like the category these follow the last message, whatever it says.
    more = [c for c in ("subcategory", "audio") if c in old.columns and c in batch.columns]
    new = batch.groupBy(*key).agg(
        *[F.coalesce(last(c), F.lit("")).alias(c) for c in more],
        F.coalesce(filled(last("title")), F.first("stem")).alias("title"),
        F.coalesce(last("category"), F.lit("")).alias("category"),
        F.max_by(F.struct("date", F.coalesce("date_source", F.lit("")).alias("source")),
                 F.when(F.col("date").isNotNull(), F.col("batch_no"))).alias("d"),
        F.max_by("content_hash", F.when(filled(F.col("content_hash")).isNotNull(), F.col("batch_no"))).alias("content_hash"))
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    return o.join(n, key, "full_outer").select(
        *key, pick("title"), pick("category"), *[pick(c) for c in more], F.coalesce("n.d.date", "o.date").alias("date"),
        F.when(F.col("n.d").isNotNull(), F.col("n.d.source")).otherwise(F.coalesce("o.date_source", F.lit(""))).alias("date_source"),
        pick("content_hash"))


def fill_meta(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Meta documents with their gaps filled by later messages; what is known stays.

    Here precedence differs from the register's: title, category and subcategory of the document win even when empty, a date is
    taken only where there is none, and only a new audio file replaces the old one.  Absent fields are NULL.  Of several messages
    the first fills a gap.
    """
    key = ["dir", "stem"]
    first = lambda c, given: F.min_by(c, F.when(given, F.col("batch_no")))
    dated = F.struct("date", F.coalesce("date_source", F.lit("none")).alias("source"))
    new = batch.groupBy(*key).agg(
        *[F.min_by(F.coalesce(c, F.lit("")), "batch_no").alias(c) for c in ("category", "subcategory")],
        F.max_by("audio", F.when(filled(F.col("audio")).isNotNull(), F.col("batch_no"))).alias("audio"),
        first(dated, F.col("date").isNotNull()).alias("d"))
    o, n = old.alias("o"), new.alias("n")
    keep = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    gap = F.col("o.date").isNull() & F.col("n.d").isNotNull()
    return o.join(n, key, "full_outer").select(
        *key, F.coalesce("o.title", "stem").alias("title"), keep("category"), keep("subcategory"),
        F.coalesce("n.audio", "o.audio").alias("audio"), F.when(gap, F.col("n.d.date")).otherwise(F.col("o.date")).alias("date"),
        F.when(gap, F.col("n.d.source")).otherwise(F.col("o.date_source")).alias("date_source"))


def action_fields(actions: DataFrame) -> DataFrame:
    """Extractor rows as proposals: fallbacks, kind, identity; empty texts are dropped.

    Fields the extractor did not send are false, empty or, for the time, unknown.
    """
    def has(c: str, kind: str = "string") -> Column:
        return F.col(c) if c in actions.columns else F.lit(None).cast(kind)

    text = first_filled(has("task"), has("text"))
    return actions.withColumn("__text", text).filter(filled(strip("__text")).isNotNull()).select(
        "meeting_id", source_key(F.col("__text")).alias("src_key"), "idx", strip("__text").alias("text"),
        filled(F.col("owner")).alias("owner"), F.lower(F.coalesce("confidence", F.lit(""))).alias("confidence"),
        F.coalesce(filled(has("kind")), task_or_minor(F.col("owner"), F.col("confidence"))).alias("kind"),
        F.coalesce(first_filled(has("evidence"), has("quote")), F.lit("")).alias("quote"),
        F.coalesce(has("deadline"), F.lit("")).alias("source_deadline"),
        *[F.coalesce(has(c, "boolean"), F.lit(False)).alias(c) for c in ("owner_matched", "quote_verified")],
        has("t_sec", "bigint").alias("t_sec"), *[F.coalesce(has(c), F.lit("")).alias(c) for c in ("context", "section", "extractor")],
        *[c for c in actions.columns if c in ("tie", "status")])


def keep_first(fields: DataFrame) -> DataFrame:
    """One row per identity inside a batch, the earliest one."""
    order = ["idx", "tie"] if "tie" in fields.columns else ["idx"]
    return scan.first_per_key(fields, ["meeting_id", "src_key"], order).drop("tie")


def sync_proposals(old: DataFrame, batch: DataFrame, touched: DataFrame) -> DataFrame:
    """Next snapshot of the review queue after a new extraction run.

    New items come in as 'proposed'; proposed rows take the new text fields or
    vanish with their item; rows a person decided on stay as they are.
    ``touched`` lists the meetings of the run, also those without any item; only open rows without an item of the run are
    asked for in it, so the merged rows are written once and no others move by meeting.
    """
    key = ["meeting_id", "src_key"]
    fields = [c for c in old.columns if c not in (*key, "status")]
    o = old.select(*key, F.struct("status", *fields).alias("o"))
    n = batch.select(*key, F.struct(*fields).alias("n"))
    merged = stage_table(o.join(n, key, "full_outer"), "merged")
    open_row = F.col("o.status") == "proposed"
    missing = F.coalesce(F.col("n").isNull() & open_row, F.lit(False))
    stays = merged.filter(missing).join(touched.select("meeting_id").distinct(), "meeting_id", "left_anti")
    outcome = F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNotNull() & open_row, "updated").otherwise("kept")
    take_new = F.col("outcome").isin("inserted", "updated")
    return merged.filter(~missing).unionByName(stays).withColumn("outcome", outcome).select(
        *key, F.coalesce("o.status", F.lit("proposed")).alias("status"),
        *[F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in fields], "outcome")


def sync_taken(old: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows that ``sync_proposals`` inserts or updates, without those it keeps; of ``old`` the key and the status will do.

    ``old`` is read from well compressed files, which the planner takes for small; here and below it must not be broadcast.
    """
    key = ["meeting_id", "src_key"]
    o = old.select(*key, F.struct("status").alias("o"))
    taken = batch.join(o.hint("merge"), key, "left").filter(F.col("o").isNull() | (F.col("o.status") == "proposed"))
    return taken.select(*key, F.lit("proposed").alias("status"), *[c for c in batch.columns if c not in (*key, "status")])


def sync_gone(old: DataFrame, taken: DataFrame, touched: DataFrame) -> DataFrame:
    """The keys that ``sync_proposals`` deletes: open, of a meeting of the run, and not among the rows of ``sync_taken``."""
    key = ["meeting_id", "src_key"]
    missing = old.filter(F.col("status") == "proposed").select(*key).join(taken.select(*key).hint("merge"), key, "left_anti")
    return missing.join(touched.select("meeting_id").distinct().hint("merge"), "meeting_id", "left_semi")


def latest_names(speaker_map: DataFrame, order: str | None = None) -> DataFrame:
    """meeting_id, speaker_label, person: of several assignments of a label the one with the greatest ``order`` wins."""
    by = F.struct(*([order] if order else []), "person")
    return speaker_map.groupBy("meeting_id", "speaker_label").agg(F.max_by("person", by).alias("person"))


def assign_speakers(proposals: DataFrame, speaker_map: DataFrame, order: str | None = None) -> DataFrame:
    """Voice labels become people in rows that were not sent or rejected; a row matched before stays matched."""
    names = latest_names(speaker_map, order).withColumnRenamed("speaker_label", "owner")
    hit = F.col("person").isNotNull() & F.col("status").isin("proposed", "accepted")
    before = F.coalesce("owner_matched", F.lit(False)) if "owner_matched" in proposals.columns else F.lit(False)
    return proposals.join(names, ["meeting_id", "owner"], "left").withColumn("owner_matched", before | hit).withColumn(
        "owner", F.when(hit, F.col("person")).otherwise(F.col("owner"))).drop("person")


def rename_attendees(attendees: DataFrame, speaker_map: DataFrame) -> DataFrame:
    names = speaker_map.select("meeting_id", F.col("speaker_label").alias("speaker"), "person")
    return attendees.join(names, ["meeting_id", "speaker"], "left").select(
        "meeting_id", F.coalesce("person", "speaker").alias("attendee")).distinct()


def apply_patches(proposals: DataFrame, patches: DataFrame) -> DataFrame:
    """Human edits (id, patch_no, patch JSON) in order; unknown fields are ignored.

    A malformed due date refuses its whole patch, an unknown status only itself.
    """
    fields = F.from_json("patch", "map<string,string>")
    due = strip(F.coalesce(F.try_element_at("m", F.lit("due")), F.lit("")))
    good = patches.withColumn("m", fields).filter((due == "") | due.rlike(r"^20\d{2}-\d{2}-\d{2}$"))
    usable = [c for c in fixed.PATCHABLE if c in proposals.columns]

    def last(c: str):
        value = F.try_element_at("m", F.lit(c))
        sets = F.map_contains_key("m", c)
        if c == "status":
            sets = sets & F.coalesce(value.isin(fixed.PROPOSAL_STATES), F.lit(False))
        if c == "due":
            value = filled(strip(value))
        return F.max_by(F.struct(value.alias("v")), F.when(sets, F.col("patch_no"))).alias(c)

    final = good.groupBy("id").agg(*[last(c) for c in usable])
    p, e = proposals.alias("p"), final.alias("e")
    types = dict(proposals.dtypes)
    return p.join(e, "id", "left").select(*[
        F.when(F.col(f"e.{c}").isNotNull(), F.col(f"e.{c}.v").cast(types[c])).otherwise(F.col(f"p.{c}")).alias(c)
        if c in usable else (F.col(c) if c == "id" else F.col(f"p.{c}")) for c in proposals.columns])


def dispatch_gate(proposals: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (meeting_id, id) with the reason not to send, NULL when ready."""
    rows = proposals.select("meeting_id", "id", "status", "kind", "criterion", "due", "text", "owner")
    joined = requests.select("meeting_id", "id").distinct().join(rows, ["meeting_id", "id"], "left")
    reason = (F.when(F.col("status").isNull(), fixed.GATE_MISSING)
              .when(F.col("status") == "sent", fixed.GATE_SENT)
              .when(F.col("kind") != "task", fixed.GATE_MINOR)
              .when(F.coalesce(strip("criterion"), F.lit("")) == "", fixed.GATE_NO_CRITERION)
              .when(F.col("due").isNull(), fixed.GATE_NO_DUE))
    return joined.withColumn("skip_reason", reason)


def journal_append(journal: DataFrame, ready: DataFrame) -> DataFrame:
    """Rows to append: ready tasks whose proposal is not in the journal yet."""
    return ready.dropDuplicates(["proposal_id"]).join(
        journal.select("proposal_id"), "proposal_id", "left_anti")


def due_v1_audit(history: DataFrame) -> DataFrame:
    """The first due date of a journal row never changes: one row per entry."""
    return history.groupBy("proposal_id").agg(
        F.count(F.lit(1)).alias("n_versions"), F.min_by("due_v1", "version").alias("due_v1"),
        (F.min("due_v1") != F.max("due_v1")).alias("violated"))


def card_text(proposals: DataFrame, meetings: DataFrame) -> DataFrame:
    """Description of the board card of each proposal."""
    title = filled(F.col("title"))
    about = meetings.select(F.col("id").alias("meeting_id"), (F.coalesce(title, "stem") if "stem" in meetings.columns else title)
                            .alias("title"), "date")
    where = F.concat(F.lit("Из планёрки: "), F.regexp_replace(F.concat(
        F.coalesce("title", F.lit("")), F.lit(" · "), F.coalesce(F.col("date").cast("string"), F.lit(""))), r"[ ·]+$", ""),
        F.when(F.col("t_sec").isNotNull(), F.concat(F.lit(" · таймкод "), timecode(F.col("t_sec")))).otherwise(""))
    return proposals.join(about, "meeting_id", "left").select("id", F.concat_ws(
        "\n\n", F.concat(F.lit("Ответственный: "), F.coalesce(filled(F.col("owner")), F.lit("—"))),
        F.when(F.col("criterion") != "", F.concat(F.lit("Критерий готовности: "), "criterion")), where,
        F.when(F.col("quote") != "", F.concat(F.lit("Цитата: «"), "quote", F.lit("»"))),
        F.lit("— создано транскрайбером, статусы ведём в Trello")).alias("description"))
