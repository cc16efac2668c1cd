"""Segments to speaker turns, turns to transcripts and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import file_name, filled, fold_yo, strip
from ..functions.times import hms, number_or, seconds_of
from . import scan

KEY = ["meeting_id"]
_BLOCK = r"(?s)\[(\d{2}:\d{2}:\d{2}) - (\d{2}:\d{2}:\d{2})\] ([^\n:]+):\n(.*?)(?=\n\[\d{2}:\d{2}|\z)"


def _segments(segments: DataFrame) -> DataFrame:
    start = number_or(F.col("start_s"), F.lit(0.0))
    return scan.blocked(segments.select(
        "meeting_id", "seg_no", "speaker", start.alias("start_s"),
        number_or(F.col("end_s"), start).alias("end_s"),
        filled(strip(F.col("text"))).alias("text")), "seg_no")


def _local_runs(segments: DataFrame) -> DataFrame:
    """Runs of one voice, counted from 0 in each meeting: one row per run.

    Runs are found block-wise, so a meeting of any length is spread over tasks;
    texts are joined inside a block first.
    """
    runs = scan.run_numbers(_segments(segments), KEY, "seg_no", "speaker", "run")
    piece = runs.groupBy("meeting_id", "run", "__blk").agg(
        F.min("seg_no").alias("first_seg"), F.min_by("start_s", "seg_no").alias("start_s"),
        F.max_by("end_s", "seg_no").alias("end_s"), F.max("seg_no").alias("last_seg"),
        F.first("speaker").alias("speaker"),
        filled(scan.join_in_order(F.collect_list(F.when(
            F.col("text").isNotNull(), F.struct(F.col("seg_no").alias("o"), F.col("text").alias("t")))),
            " ")).alias("text"))
    return _fold_pieces(piece)


def _fold_pieces(piece: DataFrame) -> DataFrame:
    """Pieces of a run, in segment order, become one row."""
    return piece.groupBy("meeting_id", "run").agg(
        F.min("first_seg").alias("first_seg"), F.min_by("start_s", "first_seg").alias("start_s"),
        F.max_by("end_s", "last_seg").alias("end_s"), F.max("last_seg").alias("last_seg"),
        F.first("speaker").alias("speaker"),
        filled(scan.join_in_order(F.collect_list(F.when(
            F.col("text").isNotNull(), F.struct(F.col("first_seg").alias("o"), F.col("text").alias("t")))),
            " ")).alias("text"))


def _number_runs(runs: DataFrame, open_turns: DataFrame | None) -> DataFrame:
    """Meeting-wide run numbers; run 0 is the unlabelled beginning.

    With ``open_turns`` (the last run so far of each meeting) the first run goes
    on with it when the voice is the same.
    """
    heads = runs.filter("run = 0").select("meeting_id", F.struct("speaker").alias("h"))
    if open_turns is None:
        shift = heads.select("meeting_id", F.col("h.speaker").isNotNull().cast("long").alias("shift"))
    else:
        known = open_turns.select("meeting_id", F.struct("speaker", "run").alias("k"))
        shift = heads.join(known, "meeting_id", "left").select("meeting_id", F.when(
            F.col("k").isNull(), F.col("h.speaker").isNotNull().cast("long")).otherwise(
            F.col("k.run") + (~F.col("h.speaker").eqNullSafe(F.col("k.speaker"))).cast("long")).alias("shift"))
    return runs.join(shift, "meeting_id").withColumn("run", F.col("run") + F.col("shift")).drop("shift")


def advance_turns(segments: DataFrame, open_turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step of a live transcript: (runs closed by this batch, runs still open).

    Segments of a meeting arrive in order; ``open_turns`` holds one row per meeting.
    """
    fresh = _number_runs(_local_runs(segments), open_turns)
    runs = _fold_pieces(fresh.unionByName(open_turns))
    last = runs.groupBy("meeting_id").agg(F.max("run").alias("run"))
    return runs.join(last, ["meeting_id", "run"], "left_anti"), runs.join(last, ["meeting_id", "run"], "left_semi")


def finish_turns(runs: DataFrame) -> DataFrame:
    """Runs with words as turns, numbered from 1; the unlabelled beginning starts at 0."""
    spoken = runs.filter(F.col("text").isNotNull())
    return scan.row_numbers(spoken, KEY, "first_seg", "turn_no").select(
        "meeting_id", "turn_no",
        F.coalesce(filled(F.col("speaker")), F.lit(fixed.UNKNOWN_SPEAKER)).alias("speaker"),
        F.when(F.col("run") == 0, F.lit(0.0)).otherwise(F.col("start_s")).alias("start_s"), "end_s", "text")


def speaker_turns(segments: DataFrame) -> DataFrame:
    """Merge neighbouring segments of one voice into turns."""
    return finish_turns(_number_runs(_local_runs(segments), None))


def rendered(start: Column, end: Column, speaker: Column, text: Column) -> Column:
    """The written form of one turn."""
    return F.concat(F.lit("["), hms(start), F.lit(" - "), hms(end), F.lit("] "), speaker, F.lit(":\n"), text)


def turn_text(turns: DataFrame) -> Column:
    start = "start_s" if "start_s" in turns.columns else "start_sec"
    end = "end_s" if "end_s" in turns.columns else "end_sec"
    return rendered(F.col(start), F.col(end), F.col("speaker"), F.col("text"))


def turn_offsets(turns: DataFrame) -> DataFrame:
    """Character position of every turn in the written transcript."""
    sized = turns.withColumn("char_len", F.length(turn_text(turns)).cast("long"))
    return scan.running_total(sized, KEY, "turn_no", F.col("char_len") + 2, "char_offset")


def render_transcript(turns: DataFrame) -> DataFrame:
    """One text per meeting; blank line between turns."""
    lines = turns.select("meeting_id", "turn_no", turn_text(turns).alias("line"))
    whole = scan.ordered_concat(lines, KEY, "turn_no", "line", "text", "\n\n")
    return whole.select("meeting_id", F.concat("text", F.lit("\n")).alias("text"))


def parse_turns(transcripts: DataFrame) -> DataFrame:
    """Written transcripts back to turns; text without headers is one turn."""
    found = F.regexp_extract_all("text", F.lit(_BLOCK), F.lit(0))
    blocks = transcripts.select("meeting_id", F.posexplode(
        F.when(F.size(found) > 0, found).otherwise(F.array("text"))).alias("turn_no", "block"))
    part = lambda i: F.regexp_extract("block", _BLOCK, i)
    is_block = F.col("block").rlike(_BLOCK)
    return blocks.select(
        "meeting_id", F.col("turn_no").cast("long").alias("turn_no"),
        F.when(is_block, strip(part(3))).otherwise("SPEAKER").alias("speaker"),
        F.when(is_block, seconds_of(part(1))).otherwise(F.lit(0)).cast("long").alias("start_sec"),
        F.when(is_block, seconds_of(part(2))).otherwise(F.lit(0)).cast("long").alias("end_sec"),
        F.when(is_block, strip(part(4))).otherwise(F.col("block")).alias("text"))


def attendees(turns: DataFrame) -> DataFrame:
    """Distinct speakers of a meeting, one row each."""
    return turns.filter(F.coalesce("speaker", F.lit("")) != "").select("meeting_id", "speaker").distinct()


def speaker_samples(turns: DataFrame, samples: int = 3) -> DataFrame:
    """What a voice says first, to recognise it: second of the first turn, three lines."""
    voice = turns.filter(F.col("speaker").rlike(r"^SPEAKER_\w+$"))
    first = voice.groupBy("meeting_id", "speaker").agg(F.min_by("start_sec", "turn_no").alias("t_sec"))
    lines = F.slice(F.filter(F.transform(F.split("text", r"\r?\n"), strip), lambda s: s != ""), 1, samples)
    rank = Window.partitionBy("meeting_id", "speaker").orderBy("turn_no", "line_no")
    top = (voice.select("meeting_id", "speaker", "turn_no", F.posexplode(lines).alias("line_no", "line"))
           .withColumn("rn", F.row_number().over(rank)).filter(F.col("rn") <= samples)
           .groupBy("meeting_id", "speaker").agg(scan.join_in_order(
               F.collect_list(F.struct(F.col("rn").alias("o"), F.col("line").alias("t"))), " | ").alias("samples")))
    return first.join(top, ["meeting_id", "speaker"], "left").select(
        "meeting_id", "speaker", "t_sec", F.coalesce("samples", F.lit("")).alias("samples"))


def speaker_review(samples: DataFrame, speaker_map: DataFrame) -> DataFrame:
    """Voices with the person already assigned to them, if any."""
    named = speaker_map.select("meeting_id", F.col("speaker_label").alias("speaker"), "person")
    return samples.join(named, ["meeting_id", "speaker"], "left").withColumn(
        "person", F.coalesce("person", F.lit("")))


def word_timings(segments: DataFrame) -> DataFrame:
    """Words with their own start, else the segment's; text is cut into words if none.

    Adds ``word_no``, the position of the word in the meeting.
    """
    timed = F.transform("words", lambda w: F.struct(
        fold_yo(F.btrim(w["word"], F.lit(fixed.WORD_EDGE))).alias("word"),
        F.coalesce(w["start"], F.col("start_s")).alias("start_s")))
    plain = F.transform(F.regexp_extract_all("text", F.lit(fixed.QUOTE_WORD), F.lit(0)),
                        lambda w: F.struct(fold_yo(w).alias("word"), F.col("start_s").alias("start_s")))
    usable = F.filter(F.when(F.size(F.coalesce("words", F.array())) > 0, timed).otherwise(plain),
                      lambda w: (w["word"] != "") & w["start_s"].isNotNull())
    listed = segments.select("meeting_id", "seg_no", usable.alias("usable"))
    placed = scan.running_total(listed, KEY, "seg_no", F.size("usable"), "before")
    return placed.select("meeting_id", "seg_no", "before", F.posexplode("usable").alias("pos", "w")).select(
        "meeting_id", "seg_no", (F.col("before") + F.col("pos")).alias("word_no"), "w.word", "w.start_s")


def prefer_document(paths: DataFrame) -> DataFrame:
    """Of several documents of a meeting the best-named one.

    Input: meeting_id, path, and stem where it is not the id.  Order: ``{stem}.json``, ``{stem}.words.json``, others by name.
    """
    name = file_name(F.col("path"))
    stem = F.col("stem") if "stem" in paths.columns else F.col("meeting_id").cast("string")
    rank = (F.when(name == F.concat(stem, F.lit(".json")), 0)
            .when(name == F.concat(stem, F.lit(".words.json")), 1).otherwise(2))
    return paths.groupBy("meeting_id").agg(F.min_by("path", F.struct(rank, name)).alias("path"))
