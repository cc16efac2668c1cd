"""Watch folder: new recordings and transcripts become registered meetings, turns and chunks, and are filed away."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..functions.text import is_valid_name
from ..operators.archive import route_files
from ..operators.chunking import CHUNK_CHARS, OVERLAP_CHARS, build_chunks
from ..operators.transcript import parse_turns
from ..session import stage_table
from ..sources.files import PACKED, named_path, plain_folder, relative_path
from .common import FILES_PER_TRIGGER, Batch, BatchSink, drain, file_stream

REGISTERED = "name string, stem string, kind string, category string, subcategory string, content_hash string"
REJECTED = "name string, reason string"
RECORD = "name string, text string"
FILED = ("path string, name string, modified timestamp, stem string, kind string, category string, subcategory string, reason string, "
         "area string, target string, text string")
TURNS = "meeting_id string, turn_no bigint, speaker string, start_sec bigint, end_sec bigint, text string"
CHUNKS = ("meeting_id string, chunk_id bigint, turn_from bigint, turn_to bigint, start_time string, end_time string, "
          "n_turns bigint, n_chars bigint, text string")


def watch_folder(spark: SparkSession, inbox: str, fmt: str = "json", files_per_trigger: int = FILES_PER_TRIGGER,
                 processed: str | None = None) -> DataFrame:
    """Records of complete files below the inbox, with their folders.

    Writers put a file under its final name only when it is whole (an atomic
    rename), hidden names are skipped by the source, and the checkpoint
    remembers what was read.  ``processed`` moves files away afterwards.
    """
    options = {"cleanSource": "archive", "sourceArchiveDir": processed} if processed else {}
    stream = file_stream(spark, inbox, RECORD, fmt, files_per_trigger, **options)
    return stream.select("name", "text", relative_path(inbox).alias("file"))


def watch_transcripts(spark: SparkSession, inbox: str, files_per_trigger: int = FILES_PER_TRIGGER,
                      archive: str | None = None, packed: bool = False) -> DataFrame:
    """Whole transcript files below the inbox: path below it, time of the last change, text.

    A folder ``name=...`` of a partitioned writer names the file; else its own name does.  The source reads a path once, so a
    name that is delivered again comes as another file of its folder.  With ``archive`` the source moves files there once
    their batch is done.  ``packed``: the files are packs of transcripts, which name their paths (``files.write_packed``).
    """
    options = {"cleanSource": "archive", "sourceArchiveDir": archive} if archive else {}
    if packed:
        stream = file_stream(spark, inbox, PACKED, "json", files_per_trigger, **options)
        return stream.select("path", F.col("_metadata.file_modification_time").alias("modified"), F.col("body").alias("text"))
    stream = file_stream(spark, inbox, "value string", "text", files_per_trigger, wholetext=True, **options)
    return stream.select(named_path(inbox).alias("path"), F.col("_metadata.file_modification_time").alias("modified"),
                         F.col("value").alias("text"))


def route_records(records: DataFrame) -> DataFrame:
    """Kind, stem and category per record; the folders come from its file."""
    parts = F.split("file", "/")
    folder = lambda i: F.when(F.size(parts) > i + 1, plain_folder(F.get(parts, F.lit(i))))
    valid = lambda i, default: F.when(is_valid_name(folder(i)), folder(i)).otherwise(default)
    routed = route_files(records.withColumn("path", F.col("name"))).drop("category", "subcategory", "path")
    return routed.withColumn("category", valid(0, fixed.DEFAULT_CATEGORY)).withColumn(
        "subcategory", valid(1, fixed.DEFAULT_SUBCATEGORY))


def refusal(routed: DataFrame) -> DataFrame:
    """Adds ``reason``, NULL for records that can be worked on."""
    return routed.withColumn("reason", F.when(F.col("kind").isNull(), "unsupported kind").when(
        ~F.col("is_watched"), "incomplete file").when(F.coalesce("text", F.lit("")) == "", "empty"))


def register_new(stream: DataFrame, registered: BatchSink, rejected: BatchSink, checkpoint: str | None = None) -> None:
    """Good records go to the register, the others with a reason to the dead-letter table."""
    def each(rows: DataFrame, batch: Batch) -> None:
        routed = refusal(route_records(rows))
        registered.write(routed.filter("reason IS NULL").withColumn("content_hash", F.sha2("text", 256)), batch)
        rejected.write(routed.filter("reason IS NOT NULL"), batch)
    drain(stream, each, "ingest", checkpoint)


# --- filing away ---------------------------------------------------------------

_STAMPED = r"_\d{8}-\d{6}(_\d+)?$"


def _free_names(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Targets of the files of one area, folder and plain name; the state is the list of names given away."""
    area, folder, _, ending = key
    given = list(state.get[0]) if state.exists else []
    taken = set(given)
    for frame in frames:
        rows = frame.sort_values(["modified", "text"])
        targets = []
        for name, at in zip(rows["name"], rows["modified"], strict=True):
            base = name[:len(name) - len(ending)] if ending else name
            tries = (x for x in [name, *(f"{base}_{at:%Y%m%d-%H%M%S}{more}{ending}" for more in ["", *(f"_{i}" for i in range(2, len(taken) + 3))])])
            free = next(x for x in tries if x not in taken)
            taken.add(free)
            given.append(free)
            targets.append(f"{area}/{folder}/{free}" if folder else f"{area}/{free}")
        yield rows.assign(target=targets)[[c.split()[0] for c in FILED.split(", ")]]
    state.update((given,))


def file_away(files: DataFrame) -> DataFrame:
    """Where each finished file goes: below ``processed`` or ``failed``, in its folders, under a name no other file has.

    Needs path, modified, text, reason and what routing adds.  A second file of the same path takes the time of its last change
    into its name.  The names given away are Spark's state, per area, folder and name without such a time.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ending = F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1)
    plain = F.regexp_replace(F.left(name, F.length(name) - F.length(ending)), _STAMPED, "")
    rows = files.select(*[c.split()[0] for c in FILED.split(", ")[:8] if c.split()[0] != "name"], name.alias("name"), "text",
                        F.when(F.col("reason").isNull(), "processed").otherwise("failed").alias("area"),
                        F.regexp_extract("path", r"^(.*)/", 1).alias("folder"), plain.alias("plain"), ending.alias("ending"))
    return rows.groupBy("area", "folder", "plain", "ending").applyInPandasWithState(
        _free_names, FILED, "given array<string>", "append", GroupStateTimeout.NoTimeout)


@dataclass(frozen=True)
class Workplace:
    """The tables that a watched folder feeds."""

    filed: BatchSink
    turns: BatchSink
    chunks: BatchSink
    size: int = CHUNK_CHARS
    overlap: int = OVERLAP_CHARS


def ingest_transcripts(files: DataFrame, work: Workplace, checkpoint: str | None = None) -> None:
    """Files as ``watch_transcripts`` gives them: routed, filed away, cut into turns and chunks.

    A meeting is named by its target, so a second file of the same name is a meeting of its own.  Failed files end in the same
    table with their reason and have neither turns nor chunks.
    """
    routed = refusal(route_files(files))

    def each(rows: DataFrame, batch: Batch) -> None:
        filed = stage_table(rows, "filed")
        work.filed.write(filed, batch)
        good = filed.filter("reason IS NULL").select(F.col("target").alias("meeting_id"), "text")
        turns = stage_table(parse_turns(good), "turns")
        work.turns.write(turns, batch)
        work.chunks.write(build_chunks(turns, work.size, work.overlap), batch)
    drain(file_away(routed), each, "transcripts", checkpoint)
