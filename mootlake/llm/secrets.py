"""Secret scans: fixed patterns, and a battery of randomness tests for everything else.

A candidate is a maximal run of at least ``MIN_RUN`` characters of ``[A-Za-z0-9+/_=-]`` outside the base spans whose
encoding can be inferred (hex, base32, base36, base64, each with its alphabet).  Three tests ask whether its symbols look
drawn at random from that alphabet: chi-squared uniformity, runs about the middle of the alphabet, and serial correlation.
The least of the three p-values, times three, is the score.  A decoy of the same length and alphabet, made from the text
around the candidate, gets the same tests; inside each length class the score threshold is the least one at which decoys
are at most ``FDR`` of the candidates above it.  Short runs, which the tests cannot tell from prose, need a higher score.

Defined results: null texts are scanned as empty; a text without spans has the digest of the empty string; repeated rows
are scanned each for itself; an empty table gives an empty result.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

# The base patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
SHORTEST = {"assign": 12, "access": 18, "hex": 16}

MIN_RUN = 20
FDR = 0.05
LEAST_SCORE = 0.01
SCORE_STEPS = 200
CONTEXT = 400
RUN = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RUN
ALPHABETS = {
    "hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
MASK = "[SECRET]"


def _matches(text: Column, kind: str) -> Column:
    """Array of all matches in order, each with the length of the gap before it; null if there is none.

    Every hex run of the least length is a maximal run of its own, and so are access keys.  Only an assignment that fails
    can swallow the beginning of another match, so assignments are matched at every length.
    """
    pattern = {"hex": "[0-9a-f]{16,}", "access": "AKIA[A-Z0-9]{14,}", "random": RUN}.get(kind) or PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    gaps = F.split(text, pattern, -1)
    none = F.lit(None).cast("string")
    each = F.transform(found, lambda m, i: F.struct(
        F.lit(KINDS.index(kind)).alias("rank"), i.alias("at"), F.char_length(F.get(gaps, i)).alias("gap"),
        F.char_length(m).alias("size"), F.char_length(F.get(value, i)).alias("counted"),
        (m if kind == "random" else none).alias("run"),
        (F.concat(F.substring(F.get(gaps, i), -CONTEXT, CONTEXT), F.substring(F.get(gaps, i + 1), 1, CONTEXT))
         if kind == "random" else none).alias("around")))
    return F.when(text.rlike(pattern), each)


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by a logistic curve."""
    return 1.0 / (1.0 + F.exp(1.5976 * z + 0.070565 * z * z * z))


def _two_sided(z: Column) -> Column:
    return 2.0 * _normal_tail(F.abs(z))


def encoding(run: Column) -> Column:
    """The narrowest encoding that a run can have; null for plain words and numbers."""
    body = F.regexp_replace(run, "=+$", "")
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    return (F.when(~mixed, F.lit(None).cast("string")).when(body.rlike("^[0-9A-F]+$"), "hex")
            .when(body.rlike("^[A-Z2-7]+$"), "base32").when(body.rlike("^[0-9a-z]+$"), "base36").otherwise("base64"))


def symbols(run: Column, alphabet: Column) -> Column:
    """Places in the alphabet; a symbol outside it falls on its code modulo the alphabet's size."""
    plain = F.translate(F.regexp_replace(run, "=+$", ""), "-_", "+/")
    return F.transform(F.split(plain, ""), lambda c: F.when(F.instr(alphabet, c) > 0, F.instr(alphabet, c) - 1)
                       .otherwise(F.pmod(F.ascii(c), F.length(alphabet))).cast("double"))


def battery(x: Column, size: Column) -> Column:
    """Three times the least p-value of uniformity, runs and serial correlation, at most 1; 0 below MIN_RUN symbols."""
    n, k = F.size(x).cast("double"), size.cast("double")
    squares = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0.0), lambda s, v: s + F.pow(
        F.size(F.filter(x, lambda y: y == v)).cast("double"), 2.0))
    chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(
        a.alias("a"), b.alias("b")))
    middle = (k - 1) / 2
    sums = F.aggregate(pairs, F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("s")), lambda s, p: F.struct(
        (s["r"] + F.when((p["a"] > middle) != (p["b"] > middle), 1.0).otherwise(0.0)).alias("r"),
        (s["s"] + (p["a"] - middle) * (p["b"] - middle)).alias("s")))
    runs = (sums["r"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    serial = sums["s"] / ((k * k - 1) / 12 * F.sqrt(n - 1))
    score = F.least(F.lit(1.0), 3.0 * F.least(_normal_tail(chi), _two_sided(runs), _two_sided(serial)))
    return F.when(F.size(x) >= MIN_RUN, score).otherwise(0.0)


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two written tables: rows (rid, doc_id, text_key) of all documents, and spans (rid, rank, start, end).

    Texts are read once and never shuffled; spans travel as lengths.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.monotonically_increasing_id().alias("rid"), F.xxhash64("text").alias("text_key"),
        F.flatten(F.array_compact(F.array(*[_matches(F.col("text"), kind) for kind in KINDS]))).alias("found"))
    rows = stage_table(read, "secret-rows")
    each = rows.select("rid", F.inline("found"))
    before = Window.partitionBy("rid", "rank").orderBy("at")
    placed = (each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before))
              .withColumn("start", F.col("end") - F.col("size")))
    least = F.element_at(F.array(*[F.lit(SHORTEST.get(kind, MIN_RUN)) for kind in KINDS]), F.col("rank") + 1)
    placed = placed.where(F.col("counted") >= least)
    base = F.col("rank") < KINDS.index("random")
    ends = F.max(F.when(base, F.col("end"))).over(
        Window.partitionBy("rid").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.min(F.when(base, F.col("start"))).over(
        Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1))
    free = (placed.withColumn("ends", ends).withColumn("starts", starts)
            .where(base | ((F.coalesce("ends", F.lit(0)) <= F.col("start"))
                           & (F.coalesce("starts", F.col("end")) >= F.col("end")))))
    names = F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])
    tested = (free.withColumn("code", F.when(~base, encoding(F.col("run"))))
              .where(base | F.col("code").isNotNull())
              .withColumn("alphabet", names[F.col("code")])
              .withColumn("x", symbols(F.col("run"), F.col("alphabet")))
              .withColumn("y", symbols(F.substring(F.regexp_replace("around", "[^A-Za-z0-9]", ""), F.lit(1), F.size("x")),
                                       F.col("alphabet")))
              .select("rid", "rank", "start", "end", F.floor(F.log2(F.size("x").cast("double"))).alias("length_class"),
                      F.when(~base, battery(F.col("x"), F.length("alphabet"))).alias("score"),
                      F.when(~base, battery(F.col("y"), F.length("alphabet"))).alias("decoy")))
    spans = stage_table(tested, "secret-spans")
    cuts = discoveries(spans.where(~base))
    kept = (spans.join(F.broadcast(cuts), "length_class", "left")
            .where(base | ((F.col("score") >= LEAST_SCORE) & (F.floor(F.col("score") * SCORE_STEPS) >= F.col("cut")))))
    return rows, stage_table(kept.select("rid", "rank", "start", "end"), "secret-kept")


def discoveries(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """length_class, cut: the lowest score step at which decoys are at most ``fdr`` of the candidates at or above it.

    At most SCORE_STEPS + 1 histogram rows per length class and 31 classes, whatever the input.
    """
    both = (tested.select("length_class", F.col("score"), F.lit(1).alias("real"))
            .unionByName(tested.select("length_class", F.col("decoy").alias("score"), F.lit(0).alias("real"))))
    steps = both.groupBy("length_class", F.floor(F.col("score") * SCORE_STEPS).alias("step")).agg(
        F.sum("real").alias("real"), F.sum(1 - F.col("real")).alias("decoys"))
    above = Window.partitionBy("length_class").orderBy(F.desc("step"))
    return (steps.withColumn("reals", F.sum("real").over(above)).withColumn("fakes", F.sum("decoys").over(above))
            .where(F.col("fakes") <= fdr * F.col("reals")).groupBy("length_class").agg(F.min("step").alias("cut")))


def digest(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` the counts, the digest of the base spans and the text of all spans."""
    rows, spans = scan(docs)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("rank") + 1)
    text = F.concat_ws(":", kind, "start", "end")
    listed = spans.groupBy("rid").agg(
        *[F.count(F.when(F.col("rank") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sort_array(F.collect_list(F.struct("start", "rank", text.alias("span")))).alias("all"))
    joined = lambda items: F.array_join(F.transform(items, lambda s: s["span"]), ",")
    base = F.filter(F.col("all"), lambda s: s["rank"] < KINDS.index("random"))
    return (rows.select("rid", "doc_id").join(listed, "rid", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(joined(base), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("all")), F.lit("")).alias("spans")))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span, merged where they overlap, replaced by MASK; other rows and columns stay as they are."""
    rows, spans = scan(docs)
    before = Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    islands = (spans.withColumn("new", (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int"))
               .withColumn("island", F.sum("new").over(Window.partitionBy("rid").orderBy("start", "end")
                                                       .rowsBetween(Window.unboundedPreceding, 0)))
               .groupBy("rid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
               .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_cuts")))
    keyed = (rows.join(islands, "rid").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_cuts")
             .dropDuplicates(["_id", "_key"]))
    cuts = F.concat(F.col("_cuts"), F.array(F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))))
    keep = F.transform(cuts, lambda c, i: F.concat(
        F.substring(F.col("text"), F.when(i == 0, 1).otherwise(F.get(F.col("_cuts"), i - 1)["end"] + 1).cast("int"),
                    (F.coalesce(c["start"], F.char_length("text"))
                     - F.when(i == 0, 0).otherwise(F.get(F.col("_cuts"), i - 1)["end"])).cast("int")),
        F.when(c["start"].isNull(), "").otherwise(MASK)))
    met = docs.withColumn("_text_key", F.xxhash64(F.coalesce("text", F.lit("")))).join(
        keyed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    clean = F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.array_join(keep, ""))
    out = met.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(
            F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
