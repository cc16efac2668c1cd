"""Inbound messages: de-duplication, admission, naming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..functions.text import extension, file_stem, filled, path_part

_FILE = "struct<file_id:string,file_name:string,file_size:bigint>"
UPDATE = ("update_id bigint, message struct<message_id:bigint,date:bigint,chat:struct<id:bigint>,`from`:struct<id:bigint>,"
          f"caption:string,text:string,voice:{_FILE},audio:{_FILE},video_note:{_FILE},video:{_FILE},document:{_FILE}>")


def first_seen(updates: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each update once, however often the sender repeats it within ``delay``."""
    timed = updates.withColumn("event_time", F.timestamp_seconds("message.date"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["update_id"])


IDS_PER_STATE = 4_096


def _unseen(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one range of ids, each id once; the state is one bit per id."""
    seen = np.frombuffer(state.get[0], np.uint8).copy() if state.exists else np.zeros(IDS_PER_STATE // 8, np.uint8)
    behind = state.getCurrentWatermarkMs()
    for frame in frames:
        fresh = frame.sort_values(["event_time", "body"]).drop_duplicates("update_id")
        at = (fresh["update_id"].to_numpy(np.int64) % IDS_PER_STATE).astype(np.int64)
        known = (seen[at >> 3] >> (at & 7)) & 1 == 1
        fresh, at = fresh[~known], at[~known]
        np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        sent = fresh["event_time"].dt.tz_localize(None).to_numpy().astype("datetime64[ms]").astype(np.int64)
        if len(fresh):
            yield pd.DataFrame({"update_id": fresh["update_id"], "body": fresh["body"], "late": sent < behind})
    state.update((seen.tobytes(),))


def once_or_late(updates: DataFrame, delay: str = "1 day") -> DataFrame:
    """Every update once, those behind the watermark marked ``late`` instead of lost: update_id, message, late.

    Ids are remembered as bits, one state row per 4,096 consecutive ids, and for good: a million updates take 128 KB.  Nothing is
    dropped for its age: what comes later than ``delay`` behind the newest update goes out as well, for a table of its own.
    """
    kind = updates.schema["message"].dataType.simpleString()
    timed = updates.select("update_id", F.timestamp_seconds("message.date").alias("event_time"), F.to_json("message").alias("body"))
    ranges = timed.withWatermark("event_time", delay).withColumn("ids", F.floor(F.col("update_id") / IDS_PER_STATE))
    found = ranges.groupBy("ids").applyInPandasWithState(_unseen, "update_id bigint, body string, late boolean", "seen binary", "append",
                                          GroupStateTimeout.NoTimeout)
    return found.select("update_id", F.from_json("body", kind).alias("message"), "late")


def _attachment() -> Column:
    """The first attachment in the fixed order, documents only of media kinds."""
    def kind(name: str, label: str, default: str, named: bool) -> Column:
        f = F.col(f"message.{name}")
        chosen = F.coalesce(filled(f["file_name"]), F.lit(default)) if named else F.lit(default)
        ok = f.isNotNull()
        if name == "document":
            ok = ok & extension(chosen).isin(fixed.DOCUMENT_EXTENSIONS)
        return F.when(ok, F.struct(F.lit(label).alias("label"), chosen.alias("file_name"), f["file_id"].alias("file_id"),
                                   F.coalesce(f["file_size"], F.lit(0)).alias("size")))
    return F.coalesce(kind("voice", "войс", "voice.ogg", False), kind("audio", "аудио", "audio.mp3", True),
                      kind("video_note", "кружок", "video_note.mp4", False), kind("video", "видео", "video.mp4", True),
                      kind("document", "файл", "file.bin", True))


def save_path(caption: Column, name: Column, sent: Column) -> Column:
    """Folder from the caption, file name with the message time in it."""
    parts = F.split(F.trim(F.coalesce(caption, F.lit(""))), "/")
    folders = F.filter(F.transform(F.slice(parts, 1, 2), path_part), lambda p: p.isNotNull())
    base = F.coalesce(filled(F.substring(F.regexp_replace(file_stem(name), fixed.BAD_NAME_CHARS, "-"), 1, 60)), F.lit("recording"))
    file = F.concat(F.lit("tg_"), F.date_format(sent, "yyyy-MM-dd_HHmm"), F.lit("_"), base,
                    F.coalesce(filled(extension(name)), F.lit(".bin")))
    return F.array_join(F.concat(folders, F.array(file)), "/")


def admit(updates: DataFrame, allowed: list[int], max_bytes: int = fixed.MAX_MESSAGE_FILE) -> DataFrame:
    """Target path of accepted messages, or the reason of the refusal.

    ``allowed`` is the configured list of sender and chat ids.
    """
    picked = updates.withColumn("a", _attachment())
    m = F.col("message")
    known = F.coalesce(m["from"]["id"].isin(allowed), F.lit(False)) | F.coalesce(m["chat"]["id"].isin(allowed), F.lit(False))
    reason = (F.when(~known, "not allowed").when(F.col("a").isNull(), "no recording")
              .when(F.col("a.size") > max_bytes, "too large"))
    return picked.select("update_id", *[c for c in updates.columns if c == "late"], reason.alias("reason"), F.when(known, F.col("a.label")).alias("label"), F.when(
        reason.isNull(), save_path(m["caption"], F.col("a.file_name"), F.timestamp_seconds(m["date"]))).alias("path"))


def next_offset(updates: DataFrame) -> DataFrame:
    return updates.agg((F.max("update_id") + 1).alias("next_offset"))
