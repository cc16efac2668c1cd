"""Anchored quote search, as-of times, and the quality of the evidence.

A quote is found where its longest run of consecutive words occurs.  Both sides
are cut into word k-grams that meet in an equi-join; grams on one diagonal that
follow each other form a run.  Grams of a text that no quote of its meeting has
are left out before the join, by a bit map of bounded size.  No side is
collected and no pair of texts is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import MIN_ANCHOR_WORDS
from ..functions.text import filled, quote_words, strip, word_offset
from ..session import spread, stage_table
from . import scan

BUCKET_CHARS = 4_096
FILTER_SLOTS = 512


def _positions(words: Column, k: Column) -> Column:
    """Where a k-gram begins; empty when there are fewer words."""
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))


def _words_at(words: Column, i: Column, k: Column, longest: int) -> list[Column]:
    """Single elements are fetched by index: a slice would copy the whole array."""
    return [F.get(words, i), *[F.when(F.lit(j) < k, F.get(words, i + j)) for j in range(1, longest)]]


def _bit(words: Column, i: Column, k: Column, longest: int, slots) -> Column:
    """Place of a gram among ``slots`` times 64 bits."""
    return F.xxhash64(*_words_at(words, i, k, longest)).bitwiseAND((F.lit(64) * slots - 1).cast("long")).cast("int")


def _grams(words: Column, k: Column, longest: int = MIN_ANCHOR_WORDS) -> Column:
    """All k-grams (k <= longest) in order."""
    return F.transform(_positions(words, k), lambda i: F.concat_ws(" ", *_words_at(words, i, k, longest)))


def _wanted_grams(words: Column, k: Column, bits: Column, longest: int, more: list[Column] | None = None) -> Column:
    """The k-grams (at, gram) whose bit is set: all that some quote has, and few others.

    Elements of the arrays ``more`` at the gram's place follow; fetched here, the arrays need not be copied to every gram.
    """
    placed = F.transform(_positions(words, k), lambda i: F.struct(
        i.alias("at"), _bit(words, i, k, longest, F.size(bits)).alias("bit")))
    wanted = F.filter(placed, lambda p: F.getbit(F.get(bits, F.shiftright(p["bit"], 6)), p["bit"].bitwiseAND(63)) == 1)
    return F.transform(wanted, lambda p: F.struct(
        p["at"].alias("at"), F.concat_ws(" ", *_words_at(words, p["at"], k, longest)).alias("gram"),
        *[F.get(c, p["at"]).alias(f"more_{n}") for n, c in enumerate(more or [])]))


def _per_filter(texts: DataFrame) -> DataFrame:
    """A row for each of a text's filters, with its gram length and bits."""
    rest = [c for c in texts.columns if c != "filters"]
    return texts.select(*rest, F.explode("filters").alias("f")).select(*rest, F.col("f.k").alias("k"), F.col("f.bits").alias("bits"))


def _quotes(quotes: DataFrame, min_words: int) -> DataFrame:
    """Distinct quotes of a meeting with the gram length they need."""
    words = spread(quotes).select("meeting_id", "item_no", quote_words(F.col("quote")).alias("words")).filter(
        F.size("words") > 0)
    return words.select("meeting_id", "item_no", "words", F.least(F.lit(min_words), F.size("words")).alias("k"),
                        F.sha2(F.array_join("words", " "), 256).alias("quote_key"))


def _filters(asked: DataFrame, longest: int) -> DataFrame:
    """Per meeting: for each gram length k its quotes ask for, a bit map of their grams.

    A map has some 32 bits per gram, ``FILTER_SLOTS`` longs at most.  Where a meeting has so many quotes that the map fills up, more
    grams of its texts pass; the join compares the words themselves.
    """
    words, k = F.col("words"), F.col("k")
    bits = asked.dropDuplicates(["meeting_id", "quote_key"]).select("meeting_id", "k", F.explode(
        F.transform(_positions(words, k), lambda i: _bit(words, i, k, longest, FILTER_SLOTS))).alias("bit"))
    sets = bits.groupBy("meeting_id", "k").agg(F.collect_set("bit").alias("found")).withColumn("slots", F.greatest(F.lit(1), F.least(
        F.lit(FILTER_SLOTS), F.pow(F.lit(2), F.ceil(F.log2(F.size("found") / 2))).cast("int"))))
    one = F.lit(1).cast("long")
    maps = F.transform(F.sequence(F.lit(0), F.col("slots") - 1), lambda at: F.aggregate(
        F.filter("found", lambda b: F.shiftright(b, 6).bitwiseAND(F.col("slots") - 1) == at), F.lit(0).cast("long"),
        lambda m, b: m.bitwiseOR(F.call_function("shiftleft", one, b.bitwiseAND(63)))))
    return sets.select("meeting_id", "k", maps.alias("bits")).groupBy("meeting_id").agg(
        F.collect_list(F.struct("k", "bits")).alias("filters"))


def _best_runs(asked: DataFrame, hay_grams: DataFrame, longest: int) -> DataFrame:
    """Longest run per distinct quote: earliest in the quote, then in the text.

    Further columns of the grams come along, from the run's first gram.
    """
    more = [c for c in hay_grams.columns if c not in ("meeting_id", "part_no", "k", "hp", "gram")]
    q_grams = asked.dropDuplicates(["meeting_id", "quote_key"]).select(
        "meeting_id", "quote_key", "k", F.posexplode(_grams(F.col("words"), F.col("k"), longest)).alias("qp", "gram"))
    hits = hay_grams.join(q_grams, ["meeting_id", "k", "gram"]).withColumn("diagonal", F.col("hp") - F.col("qp"))
    line = Window.partitionBy("meeting_id", "quote_key", "part_no", "diagonal").orderBy("qp")
    runs = (hits.withColumn("run", F.col("qp") - F.row_number().over(line))
            .groupBy("meeting_id", "quote_key", "part_no", "diagonal", "run")
            .agg((F.count(F.lit(1)) + F.first("k") - 1).alias("run_len"), F.min("qp").alias("qp"), F.min("hp").alias("hp"),
                 *[F.min_by(c, "hp").alias(c) for c in more]))
    best = F.min_by(F.struct("part_no", "hp", "run_len", *more), F.struct(-F.col("run_len"), "qp", "part_no", "hp"))
    return runs.groupBy("meeting_id", "quote_key").agg(best.alias("b")).select(
        "meeting_id", "quote_key", "b.part_no", "b.hp", "b.run_len", *[f"b.{c}" for c in more])


def _text_grams(texts: DataFrame, asked: DataFrame, longest: int) -> DataFrame:
    """Grams of the texts that quotes of the meeting may have, only in the lengths asked for.

    The text travels once, not its grams: what no quote has is left out where the grams are formed.
    """
    words = spread(texts).select("meeting_id", "part_no", "text").join(_filters(asked, longest), "meeting_id").select(
        "meeting_id", "part_no", "filters", quote_words(F.col("text")).alias("words"))
    return _per_filter(words).select("meeting_id", "part_no", "k", F.inline(
        _wanted_grams(F.col("words"), F.col("k"), F.col("bits"), longest)).alias("hp", "gram"))


def _anchored(asked: DataFrame, texts: DataFrame, min_words: int) -> DataFrame:
    best = _best_runs(asked, _text_grams(texts, asked, min_words), min_words)
    return asked.select("meeting_id", "item_no", "quote_key").join(best, ["meeting_id", "quote_key"])


def anchor_quotes(quotes: DataFrame, texts: DataFrame, min_words: int = MIN_ANCHOR_WORDS,
                  offsets: bool = True) -> DataFrame:
    """Where each quote (meeting_id, item_no, quote) occurs in (meeting_id, part_no, text)."""
    out = _anchored(stage_table(_quotes(quotes, min_words), "quotes"), texts, min_words)
    if offsets:
        out = out.join(texts.select("meeting_id", "part_no", "text"), ["meeting_id", "part_no"]).withColumn(
            "char_pos", word_offset(F.col("text"), F.col("hp").cast("int")))
    found = ["part_no", F.col("hp").cast("long").alias("word_no"), F.col("run_len").cast("long").alias("run_len")]
    return out.select("meeting_id", "item_no", *found, *(["char_pos"] if offsets else []))


def _timed_grams(words: DataFrame, asked: DataFrame, longest: int, block: int = scan.BLOCK_ROWS) -> DataFrame:
    """Grams over timed words that quotes may have, with the second of their first word.

    A block of words travels as one row, which also holds the first words of the next block.
    """
    blk = F.floor(F.col("word_no") / block)
    copies = F.when((F.col("word_no") % block < longest - 1) & (blk > 0), F.array(blk, blk - 1)).otherwise(F.array(blk))
    rows = words.select("meeting_id", "word_no", "word", "start_s", F.explode(copies).alias("blk"))
    packed = rows.groupBy("meeting_id", "blk").agg(F.sort_array(F.collect_list(F.struct(
        (F.col("word_no") - F.col("blk") * block).cast("int").alias("nth"), "word", "start_s"))).alias("w")).select(
        "meeting_id", "blk", F.col("w.nth").alias("nth"), F.col("w.word").alias("words"), F.col("w.start_s").alias("starts"))
    found = _per_filter(packed.join(_filters(asked, longest), "meeting_id")).select("meeting_id", "blk", "k", F.inline(_wanted_grams(
        F.col("words"), F.col("k"), F.col("bits"), longest, [F.col("nth"), F.col("starts")])).alias("at", "gram", "nth", "start_s"))
    return found.filter(F.col("nth") < block).select(
        "meeting_id", F.lit(0).cast("long").alias("part_no"), "k", (F.col("blk") * block + F.col("nth")).alias("hp"), "gram", "start_s")


def quote_time(quotes: DataFrame, turns: DataFrame, words: DataFrame | None = None,
               min_words: int = MIN_ANCHOR_WORDS) -> DataFrame:
    """(verified, t_sec) per quote: second of its first word, else of its turn.

    ``turns`` carries (meeting_id, turn_no, start_sec, line) with the written
    turn; a time header stands between two turns, so no run spans them.
    """
    parts = turns.select("meeting_id", F.col("turn_no").alias("part_no"), F.col("line").alias("text"))
    asked = stage_table(_quotes(quotes, min_words), "quotes")
    at = _anchored(asked, parts, min_words)
    seconds = turns.select("meeting_id", F.col("turn_no").alias("part_no"), F.col("start_sec").alias("block_sec"))
    timed = at.join(seconds, ["meeting_id", "part_no"]).select("meeting_id", "item_no", "block_sec")
    if words is not None:
        best = _best_runs(asked, _timed_grams(words, asked, min_words), min_words)
        exact = asked.select("meeting_id", "item_no", "quote_key").join(best, ["meeting_id", "quote_key"]).select(
            "meeting_id", "item_no", F.col("start_s").cast("long").alias("word_sec"))
        timed = timed.join(exact, ["meeting_id", "item_no"], "left")
    else:
        timed = timed.withColumn("word_sec", F.lit(None).cast("long"))
    return quotes.select("meeting_id", "item_no").join(timed, ["meeting_id", "item_no"], "left").select(
        "meeting_id", "item_no", F.col("block_sec").isNotNull().alias("verified"),
        F.coalesce("word_sec", F.col("block_sec").cast("long")).alias("t_sec"))


def asof_turn_time(positions: DataFrame, turns: DataFrame, bucket: int = BUCKET_CHARS) -> DataFrame:
    """Second of the last turn that starts at or before a character position.

    A turn covers a range of characters; ranges and positions meet in buckets of
    fixed width, so the join is an equi-join.  Positions behind the last turn
    belong to it, positions before the first one to none.
    """
    spans = turns.select("meeting_id", F.col("start_sec").cast("long").alias("t"), F.col("char_offset").alias("a"),
                         (F.col("char_offset") + F.col("char_len") + 2).alias("z"))
    ends = spans.groupBy("meeting_id").agg(F.max_by("t", "a").alias("t_last"), F.max("z").alias("z_last"))
    cells = spans.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("a") / bucket), F.floor((F.col("z") - 1) / bucket))))
    asked = positions.select("meeting_id", "item_no", "char_pos", F.floor(F.col("char_pos") / bucket).alias("cell"))
    near = asked.join(cells, ["meeting_id", "cell"]).filter(
        (F.col("char_pos") >= F.col("a")) & (F.col("char_pos") < F.col("z"))).select("meeting_id", "item_no", "t")
    return (positions.join(near, ["meeting_id", "item_no"], "left").join(ends, "meeting_id", "left")
            .select("meeting_id", "item_no", "char_pos",
                    F.coalesce("t", F.when(F.col("char_pos") >= F.col("z_last"), F.col("t_last"))).alias("t_sec")))


def evidence_quality(items: DataFrame) -> DataFrame:
    """Per meeting: quotes checked and confirmed, times found, tasks and minor items."""
    asked = filled(strip(F.col("quote"))).isNotNull()
    return items.groupBy("meeting_id").agg(
        F.count_if(asked).alias("n_quotes"), F.count_if(asked & F.col("verified")).alias("n_verified"),
        F.count("t_sec").alias("n_timed"), F.count_if(F.col("kind") == "task").alias("n_tasks"),
        F.count_if(F.col("kind") == "minor").alias("n_minor"))
