"""String expressions; every function maps columns to a column, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` (an expression, not a UDF)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Trim any white space, not only blanks; each run of blanks is looked at once, so the time is linear in the text."""
    return F.regexp_replace(c, r"(?U)^\s++|\s(?<!\s\s)\s*+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def filled(c: Column) -> Column:
    """The value, or NULL where it is the empty string."""
    return F.when(c != "", c)


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[filled(c) for c in cols])


def is_null_text(c: Column) -> Column:
    """NULL, blank, or the words 'null' / 'none'."""
    return c.isNull() | F.lower(strip(c)).isin(fixed.NULL_TEXTS)


def normalize(c: Column) -> Column:
    """Lower case without punctuation, the key of every near-duplicate test."""
    return strip(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", ""))


def fold_yo(c: Column) -> Column:
    return F.translate(F.lower(c), "ё", "е")


def word_set(c: Column) -> Column:
    """Distinct words of the normalised text; NULL, an absent key, has none and repeats nothing.

    An explicit JSON null is the text "None" instead; ``items.same_text`` tells the two apart.
    """
    words = F.split(normalize(F.coalesce(c, F.lit(""))), r"(?U)\s+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two distinct-word arrays; empty on either side gives 0."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        common / (F.size(a) + F.size(b) - common))


def quote_words(c: Column) -> Column:
    """Words used to anchor a quote, lower-cased, ё folded."""
    return F.transform(F.regexp_extract_all(c, F.lit(fixed.QUOTE_WORD), F.lit(0)), fold_yo)


def running_offsets(lengths: Column, nth: Column, step: int = 32) -> Column:
    """Sum of the first ``nth`` lengths, for use inside a lambda over the array.

    ``lengths`` is struct(len: array, block: array) from ``offset_table``; only
    one block is walked, elements are fetched by index.
    """
    done = F.floor(nth / step).cast("int")
    rest = F.when(nth % step > 0, F.sequence(done * step, nth - 1)).otherwise(F.array().cast("array<int>"))
    return F.get(lengths["block"], done) + F.aggregate(rest, F.lit(0), lambda a, j: a + F.get(lengths["len"], j))


def offset_table(lengths: Column, step: int = 32) -> Column:
    """Lengths with the running total at every ``step``-th position."""
    total = lambda arr, idx: F.aggregate(idx, F.lit(0), lambda a, j: a + F.coalesce(F.get(arr, j), F.lit(0)))

    def table(arr: Column) -> Column:
        n_blocks = F.ceil(F.size(arr) / step).cast("int")
        sums = F.transform(F.sequence(F.lit(0), n_blocks), lambda b: total(arr, F.sequence(b * step, b * step + step - 1)))
        return let(sums, lambda s: F.struct(arr.alias("len"), F.transform(
            F.sequence(F.lit(0), n_blocks), lambda b: F.when(b > 0, total(s, F.sequence(F.lit(0), b - 1))).otherwise(0)).alias("block")))
    return let(lengths, table)


def word_offset(c: Column, nth: Column) -> Column:
    """Character offset of the nth (0-based) quote word of a text."""
    gaps = F.split(c, fixed.QUOTE_WORD, -1)
    words = F.regexp_extract_all(c, F.lit(fixed.QUOTE_WORD), F.lit(0))
    before = F.array_join(F.slice(gaps, F.lit(1), nth + 1), "")
    passed = F.array_join(F.slice(words, F.lit(1), nth), "")
    return (F.length(before) + F.length(passed)).cast("long")


def is_speaker_label(c: Column) -> Column:
    """Voice label rather than a name; a prefix test, NULL counts as no label."""
    return F.coalesce(strip(c).rlike(fixed.SPEAKER_LABEL), F.lit(False))


def is_valid_name(c: Column) -> Column:
    name = strip(c)
    return F.coalesce(
        (F.length(name).between(1, fixed.NAME_LIMIT)) & ~name.isin(".", "..")
        & ~name.rlike(fixed.BAD_NAME_CHARS), F.lit(False))


def _strip_dots(c: Column) -> Column:
    return F.regexp_replace(c, r"^\.+|\.+\z", "")


def slugify(c: Column, limit: int = fixed.NAME_LIMIT, default: str = "meeting") -> Column:
    """A name that every file system accepts."""
    safe = _strip_dots(strip(F.regexp_replace(c, fixed.BAD_NAME_CHARS, "-")))
    flat = F.regexp_replace(safe, r"(?U)\s+", " ")
    cut = F.when(F.length(flat) > limit, rstrip(F.substring(flat, 1, limit))).otherwise(flat)
    return F.coalesce(filled(cut), F.lit(default))


def path_part(c: Column) -> Column:
    """One folder name from a caption, NULL when nothing usable is left."""
    return filled(_strip_dots(strip(F.regexp_replace(c, fixed.BAD_NAME_CHARS, "-"))))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-cased suffix with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=[^/.])\.[^./]+$", "")


def source_kind(ext: Column) -> Column:
    return (F.when(ext.isin(fixed.AUDIO_EXTENSIONS), "audio")
            .when(ext == ".json", "transcript_json")
            .when(ext == ".txt", "transcript_txt"))


def meeting_stem(name: Column) -> Column:
    """Meeting name behind a file name; ready transcripts lose their suffix."""
    stem = file_stem(name)
    plain = F.when(extension(name) == ".txt",
                   F.regexp_replace(stem, fixed.TRANSCRIPT_SUFFIX, "")).otherwise(stem)
    return F.coalesce(filled(plain), F.lit("transcript"))


def keyword_category(name: Column) -> Column:
    rule = F
    for word, label in fixed.KEYWORD_CATEGORIES:
        rule = rule.when(F.contains(F.lower(name), F.lit(word)), label)
    return rule.otherwise(fixed.DEFAULT_CATEGORY)


def clean_response(raw: Column) -> Column:
    """Drop thinking blocks; inside fences keep only the fenced part.

    A fenced part is never empty, so one search both finds it and tells whether there is one.  It ends at the first closing fence;
    the blanks before that are stripped afterwards and not searched for at every character.
    """
    fenced = r"(?s)```(?:json)?\s*(.+?)```"
    inside = lambda plain: F.when(F.contains(plain, F.lit("```")), F.regexp_extract(plain, fenced, 1)).otherwise("")
    return let(strip(F.when(F.contains(raw, F.lit("<")), F.regexp_replace(raw, r"(?is)<think>.*?</think>", "")).otherwise(raw)),
               lambda plain: let(inside(plain), lambda part: F.when(part != "", strip(part)).otherwise(plain)))


def strip_leading_front_matter(md: Column) -> Column:
    """Remove a closed metadata block at the very start of a document."""
    bare = F.regexp_replace(md, "^﻿+", "")
    block = r"(?s)^---\s*\n.*?\n---\s*\n"
    return F.when(bare.rlike(block), F.regexp_replace(bare, block, "")).otherwise(md)


def strip_front_matter(md: Column) -> Column:
    """Reader's form: cut at the first closing line, even without a trailing break."""
    block = r"(?s)^---.*?\n---"
    body = F.regexp_replace(F.regexp_replace(md, block, ""), r"(?U)^\s+", "")
    return F.when(md.rlike(block), body).otherwise(md)


def json_text(c: Column) -> Column:
    """A string as a JSON literal, NULL as ``null``."""
    listed = F.to_json(F.array(c))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def front_matter(title: Column, date: Column, category: Column, attendees: Column, stem: Column) -> Column:
    """The metadata block and the heading that a written summary begins with."""
    names = F.array_join(F.transform(attendees, json_text), ", ")
    return F.concat(F.lit("---\ntitle: "), json_text(title), F.lit("\ndate: "), date.cast("string"), F.lit("\ncategory: "), json_text(category),
                    F.lit("\nattendees: ["), names, F.lit("]\ntags: [meeting, "), F.lower(category), F.lit(']\nsource: "[['), stem,
                    F.lit('_speakers]]"\n---\n\n# '), title, F.lit("\n\n"))


def has_tokens(c: Column) -> Column:
    """Whether a text holds anonymisation tokens."""
    return F.coalesce(c.rlike(rf"(?U)\b{fixed.TOKEN}\b"), F.lit(False))


def clean_title(raw: Column) -> Column:
    plain = strip(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""))
    line = strip(F.regexp_extract(plain, r"^[^\r\n]*", 0))
    bare = F.regexp_replace(F.regexp_replace(line, '^"+|"+$', ""), "^'+|'+$", "")
    bare = F.regexp_replace(bare, r"\.+$", "")
    cut = F.when(F.length(bare) > 120,
                 F.concat(rstrip(F.substring(bare, 1, 120)), F.lit("…"))).otherwise(bare)
    return F.coalesce(filled(cut), F.lit(fixed.DEFAULT_TITLE))


def source_key(text: Column) -> Column:
    """Identity of an extracted item between runs: hash of the folded text."""
    folded = fold_yo(strip(F.regexp_replace(text, r"(?U)\s+", " ")))
    return F.substring(F.sha1(folded), 1, 16)


def clean_owner(raw: Column) -> Column:
    """Collapse blanks; NULL for every spelling of 'nobody'."""
    flat = strip(F.regexp_replace(raw, r"(?U)\s+", " "))
    return F.when(~F.lower(flat).isin(fixed.EMPTY_OWNERS), flat)


def owner_base(clean: Column) -> Column:
    """The name without brackets, alternatives and remarks."""
    head = strip(F.get(F.split(clean, fixed.OWNER_CUT), F.lit(0)))
    return F.coalesce(filled(head), clean)


def stem_ru(word: Column) -> Column:
    """Crude stem: trailing vowels and soft signs go, two characters stay."""
    folded = fold_yo(word)
    return F.coalesce(filled(F.regexp_extract(folded, r"^(.{2}.*?)[аеиоуыэюяйь]*$", 1)), folded)


def tokens_in(c: Column) -> Column:
    """Distinct anonymisation tokens of a text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?U)\b{fixed.TOKEN}\b"), F.lit(0)))
