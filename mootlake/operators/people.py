"""People registry: owners, members, speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_owner, filled, fold_yo, is_speaker_label, owner_base, stem_ru, strip

STEM_SLACK = 3      # inflected stems may differ by this many letters
SHORTEST_STEM = 3


def registry(names: DataFrame) -> DataFrame:
    """Clean registry (name, ord): trimmed, first spelling of each name, in order."""
    clean = names.select(strip("name").alias("name"), "ord").filter(filled(F.col("name")).isNotNull())
    first = clean.groupBy(F.lower("name").alias("__key")).agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"))
    return first.select("name", "ord")


def registry_additions(people: DataFrame, names: DataFrame) -> DataFrame:
    """Names that the registry does not have yet."""
    fresh = names.select(strip("name").alias("name")).filter(filled(F.col("name")).isNotNull()).distinct()
    return fresh.join(people.select("name"), "name", "left_anti")


def _shorter_stems(stem: Column) -> Column:
    """Prefixes of a stem that are up to STEM_SLACK letters shorter."""
    low = F.greatest(F.lit(SHORTEST_STEM), F.length(stem) - STEM_SLACK)
    return F.when(F.length(stem) > low, F.transform(
        F.sequence(low, F.length(stem) - 1), lambda n: F.substring(stem, F.lit(1), n))).otherwise(
        F.array().cast("array<string>"))


def _tag(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(kind), v))


def _owner_keys(word: Column) -> Column:
    return F.concat(_tag("=", F.array(fold_yo(word))), _tag("stem:", F.array(stem_ru(word))),
                    _tag("short:", F.array(stem_ru(word))), _tag("stem:", _shorter_stems(stem_ru(word))))


def match_registry(words: DataFrame, people: DataFrame) -> DataFrame:
    """(raw, attempt, word) against the registry, by keys that meet in an equi-join.

    An exact name anywhere in the registry beats every inflected form; within a
    rule the earlier entry wins.
    """
    name = F.col("name")
    keys = F.concat(
        F.transform(F.array(fold_yo(name)), lambda v: F.struct(F.concat(F.lit("="), v).alias("key"), F.lit(0).alias("rule"))),
        F.transform(F.array(stem_ru(name)), lambda v: F.struct(F.concat(F.lit("stem:"), v).alias("key"), F.lit(1).alias("rule"))),
        F.transform(_shorter_stems(stem_ru(name)), lambda v: F.struct(F.concat(F.lit("short:"), v).alias("key"), F.lit(1).alias("rule"))))
    # per key only the first person can win
    listed = (people.select("name", "ord", F.explode(keys).alias("k")).groupBy("k.key", "k.rule")
              .agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord")))
    asked = words.select("raw", "attempt", F.explode(F.array_distinct(_owner_keys(F.col("word")))).alias("key"))
    return asked.join(listed, "key").groupBy("raw").agg(
        F.min_by("name", F.struct("attempt", "rule", "ord")).alias("person"))


def resolve_owners(raw_owners: DataFrame, people: DataFrame) -> DataFrame:
    """(raw, owner, matched) for every distinct raw owner."""
    seen = raw_owners.select("raw").filter(F.col("raw").isNotNull()).distinct()
    clean = seen.withColumn("clean", clean_owner(F.col("raw"))).withColumn("label", is_speaker_label(F.col("clean")))
    base = owner_base(F.col("clean"))
    tries = F.array(F.struct(F.lit(0).alias("attempt"), base.alias("word")),
                    F.struct(F.lit(1).alias("attempt"), F.when(F.contains(base, F.lit(" ")), F.split(base, " ")[0]).alias("word")))
    words = (clean.filter(F.col("clean").isNotNull() & ~F.col("label"))
             .select("raw", F.explode(tries).alias("t")).select("raw", "t.attempt", "t.word").filter(F.col("word").isNotNull()))
    hits = match_registry(words, people)
    return clean.join(hits, "raw", "left").select(
        "raw", F.coalesce("person", "clean").alias("owner"), F.col("person").isNotNull().alias("matched"))


def normalize_owner(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Rows with ``raw`` get ``owner`` and ``matched``; each spelling is resolved once.

    The resolved spellings are unique per key: a short list is broadcast by the
    planner at run time, for a long one AQE splits the rows of a frequent name.
    """
    known = resolve_owners(rows, people)
    return rows.join(known, "raw", "left").select(
        *rows.columns, "owner", F.coalesce("matched", F.lit(False)).alias("matched"))


def match_members(owners: DataFrame, members: DataFrame) -> DataFrame:
    """Board member of each distinct owner: full name, user name or one word of the name."""
    full = F.lower(F.coalesce("full_name", F.lit("")))
    words = F.filter(F.split(full, r"(?U)\s+"), lambda w: w != "")
    keys = F.array_distinct(F.filter(F.concat(F.array(full, F.lower(F.coalesce("username", F.lit("")))), words), lambda k: k != ""))
    listed = members.select("member_id", "ord", F.explode(keys).alias("key")).groupBy("key").agg(
        F.min_by("member_id", "ord").alias("member_id"))
    asked = owners.select("owner").distinct().withColumn("key", F.lower(strip("owner")))
    usable = asked.filter(~F.col("key").startswith("speaker_") & ~F.col("key").startswith("person_"))
    return usable.join(listed, "key").select("owner", "member_id")


def match_labels(names: DataFrame, labels: DataFrame) -> DataFrame:
    """Board label of each distinct section name, by equal lower-case name."""
    listed = labels.withColumn("key", F.lower(strip(F.coalesce("name", F.lit(""))))).filter("key <> ''").groupBy("key").agg(
        F.min_by("label_id", "ord").alias("label_id"))
    return (names.select("section").distinct().withColumn("key", F.lower(strip("section")))
            .join(listed, "key").select("section", "label_id"))
