"""Readers and writers for the file kinds of a meeting archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import file_name, filled
from ..operators.archive import SKIPPED_ROOTS

SEGMENT_DOC = ("segments array<struct<start:double,end:double,speaker:string,text:string,"
               "words:array<struct<word:string,start:double>>>>")
SEGMENT_STRUCT = "struct<" + SEGMENT_DOC.replace("segments ", "segments:", 1) + ">"
META = ("stem string, title string, date date, date_source string, category string, subcategory string, "
        "audio string, attendees array<string>, _broken string")
ACTION = ("task string, text string, owner string, deadline string, context string, section string, "
          "source_time string, evidence string, quote string, confidence string, kind string, quote_verified boolean, "
          "t_sec bigint, owner_matched boolean, extractor string")


def relative_path(root: str) -> Column:
    """Path of the row's file below ``root``, without scheme; spaces decoded."""
    full = F.try_url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return F.regexp_replace(F.regexp_replace(full, "^[a-z0-9]+:/*", "/"), "^" + _literal("/" + root.split("://")[-1].strip("/")) + "/", "")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def plain_folder(part: Column) -> Column:
    """Folder name without a ``key=`` prefix of a partitioned writer."""
    return F.regexp_replace(part, r"^\w+=", "")


PACKED = "path string, body string"


def write_packed(documents: DataFrame, root: str) -> None:
    """Many small documents (path, body) as lines of few files.

    One file per document costs a folder, an open and a rename each, which is far more than the content; the readers below take
    such packs with ``packed``.  More documents may be added to the same folder, also under a path that is there.
    """
    documents.select("path", "body").write.mode("append").json(root)


def _packed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(PACKED).option("recursiveFileLookup", True).json(root)


def read_segment_documents(spark: SparkSession, root: str, whole_files: bool = True, packed: bool = False) -> DataFrame:
    """One row per segment of every document below ``root``, one document per file
    (or per line, or per line of a pack).

    ``doc`` is the path of the document, ``seg_no`` counts from 1 inside it.
    """
    if packed:
        docs = _packed(spark, root).select(F.col("path").alias("doc"), F.from_json("body", SEGMENT_STRUCT)["segments"].alias("segments"))
    else:
        docs = (spark.read.schema(SEGMENT_DOC).option("recursiveFileLookup", True).json(root, multiLine=whole_files)
                .select(relative_path(root).alias("doc"), "segments"))
    return docs.select("doc", F.posexplode("segments").alias("pos", "s")).select(
        "doc", (F.col("pos") + 1).cast("long").alias("seg_no"), F.col("s.start").alias("start_s"),
        F.col("s.end").alias("end_s"), F.col("s.speaker").alias("speaker"), F.col("s.text").alias("text"),
        F.col("s.words").alias("words"))


def named_path(root: str) -> Column:
    """Path below ``root``; a folder ``name=...`` of a partitioned writer stands for the file in it, other keys are dropped."""
    parts = F.split(relative_path(root), "/")
    return F.array_join(F.transform(F.when(F.try_element_at(parts, F.lit(-2)).startswith("name="), F.slice(parts, 1, F.size(parts) - 1))
                                    .otherwise(parts), plain_folder), "/")


def list_files(spark: SparkSession, root: str, pattern: str | None = None, packed: bool = False) -> DataFrame:
    """path, mtime, size of all files below ``root``; no content is read, but for the documents of packs."""
    if packed:
        names = F.lit(True) if pattern is None else file_name(F.col("path")).rlike("^" + ".*".join(map(_literal, pattern.split("*"))) + r"\z")
        return _packed(spark, root).select("path", F.col("_metadata.file_modification_time").alias("mtime"),
                                           F.octet_length("body").cast("long").alias("size")).filter(names)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(root).select(named_path(root).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def read_documents(spark: SparkSession, root: str, chosen: DataFrame, packed: bool = False) -> DataFrame:
    """Segments of the chosen documents (meeting_id, path), one document per file: meeting_id, seg_no, start_s, end_s, ..."""
    if packed:  # only the chosen ones are parsed
        docs = _packed(spark, root).join(chosen.select("meeting_id", "path"), "path").select(
            "meeting_id", F.from_json("body", SEGMENT_STRUCT)["segments"].alias("segments"))
    else:
        docs = (spark.read.schema(SEGMENT_DOC).option("recursiveFileLookup", True).json(root, multiLine=True)
                .select(named_path(root).alias("path"), "segments")).join(chosen.select("meeting_id", "path"), "path")
    rows = docs.select("meeting_id", F.posexplode("segments").alias("pos", "s"))
    return rows.select("meeting_id", (F.col("pos") + 1).cast("long").alias("seg_no"), F.col("s.start").alias("start_s"),
                       F.col("s.end").alias("end_s"), F.col("s.speaker").alias("speaker"), F.col("s.text").alias("text"), F.col("s.words").alias("words"))


SIDECARS = {"actions": "_actions.json", "decisions": "_decisions.json"}


def read_sidecars(spark: SparkSession, root: str, packed: bool = False) -> DataFrame:
    """dir, stem, kind, body, broken of the side-car files of an archive; what is no JSON array stays as a broken row."""
    path = F.col("path")
    ending = F.lit(None).cast("string")
    for kind, suffix in SIDECARS.items():
        ending = F.when(path.endswith(suffix), kind).otherwise(ending)
    every = _packed(spark, root) if packed else spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(
        named_path(root).alias("path"), F.col("value").alias("body"))
    files = every.withColumn("kind", ending).filter(F.col("kind").isNotNull())
    entries = F.from_json("body", "array<string>", {"mode": "PERMISSIVE"})
    return files.select(F.regexp_extract(path, "^(.*)/", 1).alias("dir"), F.regexp_replace(file_name(path), r"_(actions|decisions)\.json$", "").alias("stem"),
                        "kind", "body", (entries.isNull() | ~F.btrim("body", F.lit(" \n\r\t")).startswith("[")).alias("broken"))


BOARD = {"cards": "id string, name string, due string, dueComplete boolean, closed boolean, idList string, shortUrl string",
         "lists": "id string, name string, closed boolean"}


def read_board(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A snapshot of a board's cards or lists: JSON documents that hold one array each."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"array<struct<{BOARD[kind].replace(' string', ':string').replace(' boolean', ':boolean')}>>")).alias("r"))
    if kind == "lists":
        return rows.select(F.col("r.id").alias("list_id"), F.col("r.name").alias("name"))
    return rows.select(F.col("r.id").alias("card_id"), F.col("r.name").alias("name"), F.to_date(F.left(F.col("r.due"), F.lit(10))).alias("due"),
                       F.coalesce("r.dueComplete", F.lit(False)).alias("due_complete"), F.coalesce("r.closed", F.lit(False)).alias("closed"),
                       F.col("r.idList").alias("list_id"), F.col("r.shortUrl").alias("url"))


def scan_archive(spark: SparkSession, root: str, pattern: str = "*_meta.json", whole_files: bool = True) -> DataFrame:
    """Meta documents of the archive; folders name category and subcategory.

    One document per file, or per line with ``whole_files=False``.  Broken
    documents and the skipped folders are left out, as in a listing.
    """
    text = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
            .text(root, wholetext=whole_files).select("value", relative_path(root).alias("path")))
    meta = text.select("path", F.from_json("value", META, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("m")).select("path", "m.*")
    parts = F.transform(F.split("path", "/"), plain_folder)
    top, sub = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    listed = meta.filter(F.col("_broken").isNull() & ~top.isin(SKIPPED_ROOTS) & ~F.array_contains(parts, "intermediate"))
    return listed.select(
        F.coalesce(filled(F.col("stem")), F.regexp_replace(file_name(F.col("path")), r"_meta\.json$", "")).alias("stem"),
        F.coalesce(filled(F.col("title")), F.col("stem")).alias("title"), "date",
        F.when(F.size(parts) > 1, filled(top)).otherwise(F.coalesce(
            filled(F.col("category")), F.lit(fixed.DEFAULT_CATEGORY))).alias("category"),
        F.when(F.size(parts) > 2, sub).otherwise(F.coalesce("subcategory", F.lit(""))).alias("subcategory"))


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """Registry file, a JSON array of names, with positions."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("ord", "name"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Category tree, ``{category: [subcategory]}``, one row per pair."""
    tree = F.from_json("value", "map<string,array<string>>")
    pairs = spark.read.text(path, wholetext=True).select(F.explode(tree).alias("category", "subs"))
    return pairs.select(F.trim("category").alias("category"), F.explode_outer("subs").alias("subcategory")).select(
        "category", filled(F.trim("subcategory")).alias("subcategory")).filter("category <> ''")


def read_speaker_map(spark: SparkSession, path: str) -> DataFrame:
    """Assignments of voices to people, ``{label: person}`` per file ``{meeting_id}_speakers.json``: meeting_id, speaker_label, person."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(named_path(path).alias("path"), "value")
    pairs = files.select(F.regexp_replace(file_name(F.col("path")), r"_speakers\.json$", "").alias("meeting_id"),
                         F.explode(F.from_json("value", "map<string,string>")).alias("speaker_label", "person"))
    return pairs.select("meeting_id", "speaker_label", F.trim("person").alias("person")).filter(filled(F.col("person")).isNotNull())


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet", mode: str = "append") -> None:
    """Artefact sink; the folders carry category and subcategory."""
    df.write.mode(mode).partitionBy(*by).format(fmt).save(path)
