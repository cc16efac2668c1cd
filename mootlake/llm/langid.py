"""Language of texts from a linear-chain conditional random field over words.

Every word is scored by weights of its form (the word itself, affixes, n-grams) and of a lexicon, the languages in which
training documents use it; learned transitions tie neighbours.  Forward-backward gives each word a distribution over
languages, so code-switched texts get labels word by word; a document gets the language with the greatest sum of word
probabilities, and that mean probability as its score.

Training: a sample of at most ``PER_LANGUAGE`` documents of every language, fewer if there are so many languages that the
sample would pass ``SAMPLE_ROWS`` rows, but one at least.  They are those with the least hash of their id among texts of up
to ``SAMPLE_CHARS`` characters; a language without such a text is learned from its shortest one, whole.  Their lines become
chains; lines of different languages are spliced at random, so that switches are seen.  The sample is the only thing that
reaches the driver.  Prediction runs in tasks, in batches, over whole texts.  Chains are cut after ``CHAIN`` words.

Defined results: null texts and texts without letters are ``und`` with score 0; ties go to the language first in order of
code points; without training rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .wordhash import LETTERS, factorize, features

PER_LANGUAGE = 200
SAMPLE_CHARS = 20_000
SAMPLE_ROWS = 12_800
CHAIN = 64
BITS = 17
EPOCHS = 20
RATE = 0.15
DECAY = 1e-4
UNKNOWN = "und"


def tokens(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> pd.DataFrame:
    """Up to ``per_language`` rows (text, lang) of every language, about SAMPLE_ROWS in all; one of each at least."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.min(F.char_length("text")).alias("least")).collect()
    share = max(1, min(per_language, SAMPLE_ROWS // max(len(sizes), 1)))
    long = [r["lang"] for r in sizes if r["least"] > SAMPLE_CHARS]
    fits = F.char_length("text") <= SAMPLE_CHARS
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), F.xxhash64("text"))
    kept = rows.where(fits).withColumn("k", F.row_number().over(order)).where(F.col("k") <= share).select("lang", "text")
    if long:
        shortest = F.min_by("text", F.struct(F.char_length("text"), F.xxhash64(F.col("doc_id").cast("string")))).alias("text")
        kept = kept.unionByName(rows.where(F.col("lang").isin(long)).groupBy("lang").agg(shortest))
    return kept.toPandas().sort_values(["lang", "text"], kind="stable").reset_index(drop=True)


class Field:
    """Weights of the field; ``emission`` and ``marginals`` are all that prediction needs."""

    def __init__(self, labels: list[str], weights: np.ndarray, lexicon: dict[str, int], lexical: np.ndarray,
                 transitions: np.ndarray, start: np.ndarray):
        self.labels, self.weights, self.lexicon = labels, weights, lexicon
        self.lexical, self.transitions, self.start = lexical, transitions, start

    def emission(self, distinct: list[str]) -> np.ndarray:
        """Log scores (words x labels), a block of words at a time."""
        out = np.zeros((len(distinct), len(self.labels)), np.float32)
        for i in range(0, len(distinct), 50_000):
            block = distinct[i:i + 50_000]
            ids, mask = features(block, BITS)
            for slot in range(ids.shape[1]):
                out[i:i + len(block)] += self.weights[ids[:, slot]] * mask[:, slot, None]
            classes = np.fromiter((self.lexicon.get(w, 0) for w in block), np.int64, len(block))
            out[i:i + len(block)] += self.lexical[classes]
        return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray,
                     pairs: bool = False):
    """Marginals of padded chains (chains x steps x labels), scaled; with ``pairs`` also the summed pair marginals."""
    n, steps, k = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(transitions - transitions.max())
    alpha = np.empty_like(e)
    first = e[:, 0] * np.exp(start - start.max())
    alpha[:, 0] = first / first.sum(1, keepdims=True)
    for t in range(1, steps):
        step = (alpha[:, t - 1] @ a) * e[:, t]
        alpha[:, t] = step / np.maximum(step.sum(1, keepdims=True), 1e-30)
    beta = np.ones((n, k), e.dtype)
    out = np.empty_like(e)
    both = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        inside = (t + 1 < lengths)[:, None]
        if t + 1 < steps:
            onward = e[:, t + 1] * beta
            if pairs:
                joint = alpha[:, t, :, None] * a[None] * onward[:, None, :]
                joint /= np.maximum(joint.sum((1, 2), keepdims=True), 1e-30)
                both += (joint * inside[:, :, None]).sum(0)
            back = onward @ a.T
            back /= np.maximum(back.sum(1, keepdims=True), 1e-30)
            beta = np.where(inside, back, 1.0).astype(e.dtype)
        p = alpha[:, t] * beta
        out[:, t] = p / np.maximum(p.sum(1, keepdims=True), 1e-30)
    return (out, both) if pairs else out


def chains_of(lengths: np.ndarray, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Cut lists laid end to end into chains: start and length of every chain."""
    ends = np.cumsum(lengths)
    parts = -(-lengths // chain)
    which = np.repeat(np.arange(len(lengths)), parts)
    place = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = (ends - lengths)[which] + place * chain
    return starts, np.minimum(chain, ends[which] - starts)


def padded(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, chain: int = CHAIN) -> np.ndarray:
    at = starts[:, None] + np.arange(chain)[None, :]
    return flat[np.minimum(at, max(len(flat) - 1, 0))]


def heads(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])


def train(rows: pd.DataFrame, seed: int = 7) -> Field | None:
    """Fit the field by gradient ascent of the likelihood (Adagrad)."""
    labels = sorted(rows["lang"].unique())
    if not labels:
        return None
    number = {lang: i for i, lang in enumerate(labels)}
    k = len(labels)
    rng = np.random.default_rng(seed)
    pieces = []
    for lang, text in zip(rows["lang"], rows["text"], strict=True):
        for line in text.split("\n"):
            found = tokens(line)
            pieces += [(found[i:i + CHAIN], number[lang]) for i in range(0, len(found), CHAIN)]
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    # Two neighbours after shuffling make one list in a fifth of the cases: chains that switch language inside.
    lists, golds = [], []
    for found, y in pieces:
        if lists and len(lists[-1]) < CHAIN and rng.random() < 0.2:
            lists[-1] = lists[-1] + found
            golds[-1] = golds[-1] + [y] * len(found)
        else:
            lists.append(found)
            golds.append([y] * len(found))
    flat, distinct, sizes = factorize(lists)
    if not len(flat):
        return None
    gold = np.array([y for ys in golds for y in ys], np.int64)
    seen = np.zeros((len(distinct), k))
    np.add.at(seen, (flat, gold), 1)
    # A word's lexicon class is the set of languages that use it at least twice; class 0 is for all other words.
    sets: dict[bytes, int] = {}
    held = seen >= 2
    lexicon = {w: sets.setdefault(held[i].tobytes(), len(sets) + 1) for i, w in enumerate(distinct) if held[i].any()}
    classes = np.fromiter((lexicon.get(w, 0) for w in distinct), np.int64, len(distinct))
    ids, mask = features(distinct, BITS)
    weights, lexical = np.zeros((1 << BITS, k)), np.zeros((len(sets) + 1, k))
    transitions, start = np.zeros((k, k)), np.zeros(k)
    squares = [np.full_like(x, 1e-3) for x in (weights, lexical, transitions, start)]
    starts, lengths = chains_of(sizes)
    words = padded(flat, starts, lengths)
    gold_at = padded(gold, starts, lengths)
    used = np.arange(CHAIN)[None, :] < lengths[:, None]
    slot_words, slots = np.nonzero(mask)
    slot_ids = ids[slot_words, slots]
    by_word, by_id = heads(slot_words), np.argsort(slot_ids, kind="stable")
    id_words, sorted_ids = slot_words[by_id], slot_ids[by_id]
    id_heads = heads(sorted_ids)
    touched = sorted_ids[id_heads]
    token_words = words[used]
    by_token = np.argsort(token_words, kind="stable")
    token_heads = heads(token_words[by_token])
    gold_at_tokens = np.eye(k)[gold_at[used]]
    class_order = np.argsort(classes, kind="stable")
    class_heads = heads(classes[class_order])
    gold_pairs = np.zeros((k, k))
    inner = used[:, 1:]
    np.add.at(gold_pairs, (gold_at[:, :-1][inner], gold_at[:, 1:][inner]), 1)
    total = float(used.sum())
    for _ in range(EPOCHS):
        scores = np.add.reduceat(weights[slot_ids], by_word, axis=0) + lexical[classes]
        p, both = forward_backward(scores[words], lengths, transitions, start, pairs=True)
        per_word = np.add.reduceat((gold_at_tokens - p[used])[by_token], token_heads, axis=0)
        first = np.bincount(gold_at[:, 0], minlength=k) - p[:, 0].sum(0)
        grads = [np.zeros_like(weights), np.zeros_like(lexical), gold_pairs - both, first]
        grads[0][touched] = np.add.reduceat(per_word[id_words], id_heads, axis=0)
        grads[1][classes[class_order][class_heads]] = np.add.reduceat(per_word[class_order], class_heads, axis=0)
        for x, g, s in zip((weights, lexical, transitions, start), grads, squares, strict=True):
            g = g / total - DECAY * x / len(labels)
            s += g * g
            x += RATE * g / np.sqrt(s)
    return Field(labels, weights.astype(np.float32), lexicon, lexical.astype(np.float32), transitions, start)


def predict_batch(field: Field | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if field is None:
        return names, scores
    flat, distinct, sizes = factorize([tokens(t) for t in texts])
    if not len(flat):
        return names, scores
    k = len(field.labels)
    emission = field.emission(distinct)
    starts, lengths = chains_of(sizes)
    doc = np.repeat(np.arange(len(texts)), -(-sizes // CHAIN))
    sums = np.zeros((len(texts), k))
    for i in range(0, len(starts), 4096):
        part = slice(i, i + 4096)
        p = forward_backward(emission[padded(flat, starts[part], lengths[part])], lengths[part],
                             field.transitions.astype(np.float32), field.start.astype(np.float32))
        p *= (np.arange(CHAIN)[None, :] < lengths[part][:, None])[:, :, None]
        np.add.at(sums, doc[part], p.sum(1))
    best = sums.argmax(1)
    for i in np.flatnonzero(sizes):
        names[i] = field.labels[best[i]]
        scores[i] = min(1.0, sums[i, best[i]] / sizes[i])
    return names, scores


def word_labels(field: Field, text: str) -> list[tuple[str, str, float]]:
    """Every word of one text with its language and probability."""
    found = tokens(text)
    if not found:
        return []
    flat, distinct, sizes = factorize([found])
    starts, lengths = chains_of(sizes)
    p = forward_backward(field.emission(distinct)[padded(flat, starts, lengths)], lengths, field.transitions, field.start)
    p = p.reshape(-1, p.shape[2])[:len(found)]
    return [(w, field.labels[i], float(q)) for w, i, q in zip(found, p.argmax(1), p.max(1), strict=True)]


def identify(docs: DataFrame, field: Field | None, keep: list[str] | None = None,
             names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default all) and the prediction; columns of ``docs`` with its names are left out."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    shape = StructType([docs.schema[c] for c in keep] + [StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                langs, scores = predict_batch(shared.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores)],
                                                 names=[*keep, *names])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, shape)


def known(docs: DataFrame, field: Field | None, least: float) -> DataFrame:
    """``docs`` whose language is recognised with a score of at least ``least``; all of them if nothing could be learned."""
    if field is None:
        return docs
    names = ("_lang_pred", "_lang_score")
    rows = identify(docs, field, names=names)
    return rows.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).select(*docs.columns)


def remainder(column: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(m))
