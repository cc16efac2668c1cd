"""Routing and listing of meeting files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import (extension, file_name, filled, is_valid_name, keyword_category, meeting_stem, slugify,
                              source_kind, strip)

SKIPPED_ROOTS = ["_obsidian", "backups"]
_META, _SUMMARY, _AUDIO = r"_meta\.json$", r"_summary\.md$", r"_audio\.[^/]*$"


def _folder(path: Column, i: int) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > i + 1, filled(strip(F.get(parts, F.lit(i)))))


def route_files(files: DataFrame) -> DataFrame:
    """Kind, meeting name and category of every file by its path below the inbox."""
    path, name = F.col("path"), file_name(F.col("path"))
    place = lambda i, default: F.when(
        is_valid_name(F.coalesce(_folder(path, i), F.lit(default))),
        F.coalesce(_folder(path, i), F.lit(default))).otherwise(default)
    return files.select("*", source_kind(extension(name)).alias("kind"), meeting_stem(name).alias("stem"),
                        place(0, fixed.DEFAULT_CATEGORY).alias("category"),
                        place(1, fixed.DEFAULT_SUBCATEGORY).alias("subcategory"),
                        keyword_category(name).alias("keyword_category"), slugify(name).alias("slug"),
                        is_watched(path).alias("is_watched"))


def is_watched(path: Column) -> Column:
    """Complete files of a supported kind; hidden and partial files wait."""
    name = file_name(path)
    partial = F.lit(False)
    for suffix in fixed.PARTIAL_SUFFIXES:
        partial = partial | F.lower(name).endswith(suffix)
    return ~name.startswith(".") & ~partial & source_kind(extension(name)).isNotNull()


def _listed(files: DataFrame, pattern: str) -> DataFrame:
    """(dir, stem) of all files with this ending, outside the skipped folders."""
    path = F.col("path")
    keep = path.rlike(pattern) & ~F.split(path, "/")[0].isin(SKIPPED_ROOTS) & ~F.array_contains(
        F.split(path, "/"), "intermediate")
    name = file_name(path)
    return files.filter(keep).select(
        "*", F.regexp_replace(path, r"/?[^/]*$", "").alias("dir"), F.regexp_replace(name, pattern, "").alias("stem"))


def archive_list(files: DataFrame) -> DataFrame:
    """Meetings that have both a meta file and a summary."""
    summaries = _listed(files, _SUMMARY).select("dir", "stem", F.col("mtime").alias("summary_mtime"))
    metas = _listed(files, _META).select("dir", "stem")
    return metas.join(summaries, ["dir", "stem"]).select(
        "dir", "stem", F.coalesce(filled(F.split("dir", "/")[0]), F.lit(fixed.DEFAULT_CATEGORY)).alias("category"),
        F.coalesce(F.get(F.split("dir", "/"), F.lit(1)), F.lit("")).alias("subcategory"), "summary_mtime")


def interrupted_runs(files: DataFrame, inbox: DataFrame) -> DataFrame:
    """Saved audio without meta whose source is not waiting in the inbox."""
    audio = _listed(files, _AUDIO).filter(F.col("stem") != "").select("dir", "stem", "path")
    waiting = inbox.select(F.regexp_replace(file_name(F.col("path")), r"(?<=.)\.[^.]*$", "").alias("stem")).distinct()
    return (audio.join(_listed(files, _META).select("dir", "stem"), ["dir", "stem"], "left_anti")
            .join(waiting, "stem", "left_anti").select("dir", "stem", "path"))


def stem_lengths(meetings: DataFrame) -> list[int]:
    """The lengths that occur among the stems; a file name is bounded by the file system, so there are a few hundred at most."""
    return sorted(r[0] for r in meetings.select(F.length("stem")).distinct().collect() if r[0])


def named_after(files: DataFrame, meetings: DataFrame, keep: list[str]) -> DataFrame:
    """Files (path) beside the meetings (dir, stem) whose stem their name starts with.

    Each name offers its beginnings of the lengths that occur as stems, so the prefix test is an equi-join even in a crowded
    folder, and a name makes as many rows as there are such lengths.
    """
    name = file_name(F.col("path"))
    lengths = stem_lengths(meetings)
    if not lengths:
        lengths = [1]
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(name))
    offered = files.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), name.alias("name"), *keep,
                           F.explode(F.transform(fits, lambda n: F.substring(name, F.lit(1), n))).alias("stem"))
    return offered.join(meetings, ["dir", "stem"])


def meeting_files(files: DataFrame, meetings: DataFrame) -> DataFrame:
    """Files whose name starts with a meeting's stem, in the meeting's folder."""
    live = files.filter(~F.array_contains(F.split("path", "/"), "intermediate"))
    primary = F.array(*[F.concat("stem", F.lit(s)) for s in ("_summary.md", "_speakers.txt", "_anonymized_speakers.txt")])
    return named_after(live, meetings.select("dir", "stem"), []).select(
        "dir", "stem", "name", F.array_contains(primary, F.col("name")).alias("is_primary"))


def recognition_files(files: DataFrame, meetings: DataFrame) -> DataFrame:
    """meeting_id, path of the JSON files that may hold a meeting's segments: those named after it."""
    own = files.filter(F.col("path").endswith(".json"))
    return named_after(own, meetings.select("meeting_id", "dir", "stem"), ["path"]).select("meeting_id", "stem", "path")


def sidecar_counts(meetings: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Entries of the action and decision files; broken or missing files count 0."""
    entries = F.from_json("body", "array<string>", {"mode": "PERMISSIVE"})
    counted = sidecars.groupBy("meeting_id").agg(*[
        F.max(F.when(F.col("kind") == k, F.size(entries))).alias(c)
        for k, c in (("actions", "n_actions"), ("decisions", "n_decisions"))])
    count = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("long").alias(c)
    return meetings.select("meeting_id").join(counted, "meeting_id", "left").select(
        "meeting_id", count("n_actions"), count("n_decisions"))


def category_pairs(known: DataFrame, meetings: DataFrame) -> DataFrame:
    """The category tree (category, subcategory) with the pairs that meetings add."""
    seen = meetings.select(F.coalesce(filled(F.col("category")), F.lit(fixed.DEFAULT_CATEGORY)).alias("category"),
                           filled(F.col("subcategory")).alias("subcategory")).filter("subcategory IS NOT NULL").distinct()
    return known.unionByName(seen.join(known, ["category", "subcategory"], "left_anti")).distinct()
