"""Toxicity of texts by a classifier that must not react to which group a text names.

Every distinct word of a text is scored from its form (the word, prefixes, suffixes, n-grams); the text's logit is a smooth
maximum of its words' scores, so one insult counts in a long text as it does in a short one.  Training minimises the
logistic loss plus a counterfactual penalty: identity terms in labelled texts are swapped for other terms of the same set
and language, and the squared change of the logit is penalised.  A term that merely co-occurs with insults therefore gets
the score of its whole set, and neutral mentions keep low scores.

Training: a sample of at most ``PER_CLASS[label]`` labelled texts of up to ``SAMPLE_CHARS`` characters per class, those with
the least hash of their id; nothing else reaches the driver.  Prediction runs in tasks, in batches, over whole texts.

Defined results: null and empty texts, and texts without letters, get the score of no evidence (the bias alone); without
training rows every score is 0; repeated rows get equal scores; null labels are not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .langid import heads, tokens
from .wordhash import factorize, features

# Identity terms by set; a term is swapped for the others of its line.
IDENTITY_TERMS = (
    "christian muslim jewish hindu buddhist atheist catholic protestant sikh",
    "christians muslims jews hindus buddhists atheists catholics protestants sikhs",
    "black white asian african european american latino arab mexican chinese indian",
    "gay lesbian straight bisexual transgender queer heterosexual",
    "woman man girl boy", "women men girls boys", "female male",
    "immigrant refugee foreigner citizen native", "immigrants refugees foreigners citizens natives",
    "disabled blind deaf elderly young",
    "christen muslime juden hindus buddhisten atheisten", "frauen männer mädchen jungen",
    "schwule lesben heterosexuelle transsexuelle", "ausländer flüchtlinge einwanderer deutsche türken",
    "chrétiens musulmans juifs hindous bouddhistes athées", "femmes hommes filles garçons",
    "homosexuels lesbiennes hétérosexuels", "étrangers réfugiés immigrés français",
    "cristianos musulmanes judíos hindúes budistas ateos", "mujeres hombres niñas niños",
    "homosexuales lesbianas heterosexuales", "extranjeros refugiados inmigrantes españoles",
)
SWAPS = {w: [x for x in line.split() if x != w] for line in IDENTITY_TERMS for w in line.split()}

PER_CLASS = {0: 4000, 1: 2000}
SAMPLE_CHARS = 20_000
BITS = 18
GRAMS, AFFIXES = (4, 5), (3, 4, 5)
EPOCHS = 40
RATE = 0.1
DECAY = 2e-6
BALANCE = 1.0
START = -7.0
TOXIC_SHARE = 0.3
PRIOR_SHARE, PRIOR_ERRORS = 0.3, 1.5


def sample(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = PER_CLASS) -> pd.DataFrame:
    """Labelled texts (text, toxic); ids are chosen before texts are read, so only chosen texts move."""
    order = Window.partitionBy("toxic").orderBy(F.xxhash64(F.col("doc_id").cast("string")))
    limit = F.when(F.col("toxic") == 1, per_class[1]).otherwise(per_class[0])
    chosen = (labels.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic").dropDuplicates(["doc_id"])
              .withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("k"))
    rows = (docs.select("doc_id", "text").where(F.char_length("text") <= SAMPLE_CHARS)
            .join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic"))
    return rows.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)


def counterfactual(words: list[str], turn: int) -> list[str] | None:
    """The words with every identity term swapped for another of its set; None if there is none."""
    if not any(w in SWAPS for w in words):
        return None
    return [SWAPS[w][(turn + i) % len(SWAPS[w])] if w in SWAPS else w for i, w in enumerate(words)]


class Model:
    """Hashed weights, a word bias and a text bias."""

    def __init__(self, weights: np.ndarray, floor: float, bias: float):
        self.weights, self.floor, self.bias = weights, floor, bias

    def word_scores(self, distinct: list[str]) -> np.ndarray:
        out = np.empty(len(distinct))
        for i in range(0, len(distinct), 50_000):
            ids, mask = features(distinct[i:i + 50_000], BITS, GRAMS, AFFIXES)
            out[i:i + 50_000] = (self.weights[ids] * mask).sum(1) + self.floor
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        flat, distinct, sizes = factorize([list(dict.fromkeys(tokens(t))) for t in texts])
        logits = np.zeros(len(texts))
        if len(flat):
            logits, _ = pool(self.word_scores(distinct)[flat], sizes)
        return 1.0 / (1.0 + np.exp(-(logits + self.bias)))


def pool(flat_scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log(1 + sum of exp) of each text's word scores, and each word's share in it."""
    e = np.exp(np.minimum(flat_scores, 30.0))
    at = np.r_[0, np.cumsum(sizes)]
    total = 1.0 + np.add.reduceat(np.r_[e, 0.0], np.minimum(at[:-1], len(e))) * (sizes > 0)
    return np.log(total), e / np.repeat(total, sizes)


def evidence(flat: np.ndarray, sizes: np.ndarray, gold: np.ndarray, id_words: np.ndarray, id_heads: np.ndarray,
             n_words: int) -> np.ndarray:
    """Where training begins: a share of the lower confidence bound of each feature's log odds, never below 0.

    Counts are of words in texts.  A smooth maximum alone would learn one insult of a text and overlook the others.
    """
    label = np.repeat(np.r_[gold, np.full(len(sizes) - len(gold), -1.0)], sizes)
    counts = [np.add.reduceat(np.bincount(flat[label == y], minlength=n_words)[id_words], id_heads) + 0.5 for y in (1, 0)]
    prior = np.log(max((label == 0).sum(), 1) / max((label == 1).sum(), 1))
    odds = np.log(counts[0] / counts[1]) + prior
    return PRIOR_SHARE * np.maximum(odds - PRIOR_ERRORS * np.sqrt(1 / counts[0] + 1 / counts[1]), 0.0)


def train(rows: pd.DataFrame, balance: float = BALANCE) -> Model | None:
    """Adagrad on the logistic loss and the counterfactual penalty."""
    if not len(rows) or rows["toxic"].nunique() < 2:
        return None
    lists = [list(dict.fromkeys(tokens(t))) for t in rows["text"]]
    gold = rows["toxic"].to_numpy(float)
    swapped = [(i, c) for i, words in enumerate(lists) for turn in range(2) if (c := counterfactual(words, turn + i))]
    n = len(lists)
    flat, distinct, sizes = factorize(lists + [c for _, c in swapped])
    if not len(flat):
        return None
    origin = np.array([i for i, _ in swapped], np.int64)
    ids, mask = features(distinct, BITS, GRAMS, AFFIXES)
    slot_words, slots = np.nonzero(mask)
    slot_ids = ids[slot_words, slots]
    del ids, mask, slots
    by_word, by_id = heads(slot_words), np.argsort(slot_ids, kind="stable")
    id_words, sorted_ids = slot_words[by_id], slot_ids[by_id]
    id_heads = heads(sorted_ids)
    touched = sorted_ids[id_heads]
    del sorted_ids
    dense = np.searchsorted(touched, slot_ids)
    weights, squares = evidence(flat, sizes, gold, id_words, id_heads, len(distinct)), np.full(len(touched), 1e-4)
    floor, bias, small = START, 0.0, np.full(2, 1e-2)
    share = np.where(gold == 1, TOXIC_SHARE / max(gold.sum(), 1), (1 - TOXIC_SHARE) / max(n - gold.sum(), 1))
    for _ in range(EPOCHS):
        scores = np.add.reduceat(weights[dense], by_word) + floor
        logits, parts = pool(scores[flat], sizes)
        p = 1.0 / (1.0 + np.exp(-(logits[:n] + bias)))
        pull = np.zeros(len(sizes))
        pull[:n] = (p - gold) * share
        change = logits[n:] - logits[origin] if len(origin) else np.zeros(0)
        pull[n:] += 2 * balance * change / max(n, 1)
        np.add.at(pull, origin, -2 * balance * change / max(n, 1))
        per_word = np.bincount(flat, parts * np.repeat(pull, sizes), minlength=len(distinct))
        g = np.add.reduceat(per_word[id_words], id_heads) + DECAY * weights
        squares += g * g
        weights -= RATE * g / np.sqrt(squares)
        for i, x in enumerate((per_word.sum(), pull[:n].sum())):
            small[i] += x * x
            step = RATE * x / np.sqrt(small[i])
            floor, bias = (floor - step, bias) if i == 0 else (floor, bias - step)
    full = np.zeros(1 << BITS, np.float32)
    full[touched] = weights
    return Model(full, floor, bias)


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default all) and ``score``, which takes the place of a column of that name."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    shape = StructType([docs.schema[c] for c in keep] + [StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = part.column("text").to_pylist()
                scores = shared.value.scores(texts) if shared.value else np.zeros(len(texts))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(scores)], names=[*keep, "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, shape)
