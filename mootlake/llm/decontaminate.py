"""Benchmark decontamination: documents that hold a benchmark item, also an edited one.

Texts are sequences of lower-case words.  A CGK walk with its own random bits turns a window into a longer string, so that
windows at a small edit distance agree in most coordinates; a bit-sampling key is the window's first word and ``SAMPLED``
coordinates, repeated with ``REPEATS`` independent walks.  Items are entered from their ``STARTS`` rarest words on; document
windows begin at every occurrence of such a word and walk as far as the item's length class needs.  Windows that share a key
are verified by exact edit distance: the item against the best stretch of the item-sized surroundings, at most ``EDITS`` of
the item's words apart.

The items are the stated query set: they are taken in blocks of ``BLOCK``, and every document is scanned whole per block.

Defined results: null texts and items, and those without words, match nothing; repeated items and rows are reported each;
an empty table gives an empty result; an item contained several times is reported once, by its best and then first stretch.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import mix

WORD = re.compile(r"[^\W_]+")
SAMPLED, REPEATS, STARTS = 3, 6, 6
EDITS = 0.2
BLOCK = 20_000
BATCH_DOCS = 2000
CELLS = 500_000  # of one step of the edit distance
SHAPE = "item_id bigint, distance int, n_words int, first_word int, last_word int"


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def length_class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)


def coordinates(repeat: int, klass: int) -> np.ndarray:
    """Sampled steps of a walk, below one and a half times the least length of the class."""
    reach = max(1, int(1.5 * (1 << klass)))
    steps = np.arange(1, reach)
    order = np.argsort(mix(steps.astype(np.uint64) + np.uint64((repeat * 64 + klass + 1) * 7919)))
    return np.sort(steps[order[:SAMPLED]])


def walk_keys(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeat: int, klass: int) -> np.ndarray:
    """Keys of the windows that begin at ``starts``; ``ends`` are the places of the blanks behind their texts."""
    steps = coordinates(repeat, klass)
    at = starts.copy()
    key = mix(symbols[at] + np.uint64(repeat * 64 + klass + 1))
    j = 0
    for step in steps:
        while j < step:
            moves = mix(symbols[at] + np.uint64((repeat * 100_003 + j) * 2_000_003 + 1)) & np.uint64(1)
            at = np.minimum(at + moves.astype(np.int64), ends)
            j += 1
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + symbols[at])
    return key


class Items:
    """A block of items: vocabulary, words end to end, and the keys of their windows."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        lists = [tokens(t) for t in texts]
        self.ids = [i for i, x in zip(ids, lists, strict=True) if x]
        lists = [x for x in lists if x]
        self.number: dict[str, int] = {}
        self.items = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in x], np.int64) for x in lists]
        used = Counter(int(w) for x in self.items for w in set(x.tolist()))
        sizes = np.array([len(x) for x in self.items], np.int64)
        flat = np.concatenate([np.r_[x, 0] for x in self.items]).astype(np.uint64) if lists else np.zeros(0, np.uint64)
        begin = np.cumsum(sizes + 1) - (sizes + 1)
        entries = []
        for i, x in enumerate(self.items):
            half = x[:max(1, -(-len(x) // 2))].tolist()
            chosen = sorted(range(len(half)), key=lambda o, half=half: (used[half[o]], o))[:STARTS]
            entries += [(i, o) for o in chosen]
        self.entries = np.array(entries, np.int64).reshape(-1, 2)
        item, offset = self.entries.T
        self.classes = length_class(sizes[item] - offset) if len(item) else np.zeros(0, np.int64)
        starts = begin[item] + offset if len(item) else np.zeros(0, np.int64)
        ends = begin[item] + sizes[item] if len(item) else starts
        keys, which = [], []
        for klass in np.unique(self.classes):
            own = np.flatnonzero(self.classes == klass)
            for repeat in range(REPEATS):
                keys.append(walk_keys(flat, starts[own], ends[own], repeat, int(klass)))
                which.append(own)
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.which = (np.concatenate(which) if which else np.zeros(0, np.int64))[order]
        # Which classes begin with a word, as bits.
        self.begins = np.zeros(len(self.number) + 1, np.int64)
        if len(item):
            np.bitwise_or.at(self.begins, flat[starts].astype(np.int64), np.int64(1) << self.classes)

    def windows(self, symbols: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates: text number, item number, place where the item would begin; each once."""
        begins = self.begins[symbols.astype(np.int64)]
        found = []
        for klass in np.unique(self.classes):
            starts = np.flatnonzero(begins >> klass & 1)
            if not len(starts):
                continue
            stop = ends[doc[starts]]
            for repeat in range(REPEATS):
                keys = walk_keys(symbols, starts, stop, repeat, int(klass))
                low = np.searchsorted(self.keys, keys, "left")
                count = np.searchsorted(self.keys, keys, "right") - low
                hit = np.flatnonzero(count)
                at = np.repeat(low[hit] - (np.cumsum(count[hit]) - count[hit]), count[hit]) + np.arange(int(count[hit].sum()))
                entry, start = self.which[at], np.repeat(starts[hit], count[hit])
                found.append(np.stack([doc[start], self.entries[entry, 0], start - self.entries[entry, 1]], axis=1))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.unique(np.concatenate(found), axis=0).T)


def best_stretch(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edit distance of the item to a stretch of each window (rows), and that stretch's begin and end."""
    rows, width = windows.shape
    places = np.arange(width + 1)
    cost = np.zeros((rows, width + 1), np.int64)
    # Distance and begin travel as one number, so that ties prefer the later begin, the shorter stretch.
    scale = width + 2
    state = cost * scale + (width - places)[None, :]
    for word in item:
        take = state[:, :-1] + (windows != word) * scale
        skip = state[:, 1:] + scale
        inner = np.minimum(take, skip)
        line = np.concatenate([state[:, :1] + scale, inner], axis=1)
        state = np.minimum.accumulate(line - places * scale, axis=1) + places * scale
    end = state.argmin(1)
    least = state[np.arange(rows), end]
    return least // scale, width - least % scale, end


def spaced(texts: np.ndarray, places: np.ndarray, near: int) -> np.ndarray:
    """Which of the sorted (text, place) pairs are more than ``near`` behind the last one chosen."""
    chosen, last = [], (-1, 0)
    for i, (t, p) in enumerate(zip(texts.tolist(), places.tolist(), strict=True)):
        if t != last[0] or p > last[1] + near:
            chosen.append(i)
            last = (t, p)
    return np.array(chosen, np.int64)


def scan_batch(items: Items, texts: list[str | None]) -> list[tuple]:
    """(text number, item number, distance, first word, last word exclusive), best per text and item."""
    get = items.number.get
    flat: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        before = len(flat)
        flat += [get(w, 0) for w in tokens(text)]
        flat.append(0)
        sizes[i] = len(flat) - before
    symbols = np.array(flat, np.int64).view(np.uint64)
    ends = np.cumsum(sizes) - 1
    begin = ends - sizes + 1
    doc = np.repeat(np.arange(len(texts)), sizes)
    which, item, place = items.windows(symbols, doc, ends)
    best: dict[tuple[int, int], tuple] = {}
    for number in np.unique(item):
        words = items.items[number]
        own = item == number
        # Places that lie close together share the surroundings of the first of them.
        near = max(1, len(words) // 8)
        slack = int(np.ceil(EDITS * len(words))) + near + 1
        apart = spaced(which[own], place[own], near)
        texts_of, first = which[own][apart], place[own][apart] - slack
        reach = first[:, None] + np.arange(len(words) + 2 * slack)[None, :]
        inside = (reach >= begin[texts_of][:, None]) & (reach < ends[texts_of][:, None])
        rows = max(1, CELLS // reach.shape[1])
        for i in range(0, len(first), rows):
            part = slice(i, i + rows)
            values = np.where(inside[part], symbols[np.clip(reach[part], 0, len(symbols) - 1)].astype(np.int64), 0)
            distance, start, end = best_stretch(words, values)
            for j in np.flatnonzero(distance <= int(EDITS * len(words))):
                t = int(texts_of[part][j])
                shift = int(first[part][j] - begin[t])
                row = (int(distance[j]), shift + int(start[j]), shift + int(end[j]))
                best[t, int(number)] = min(best.get((t, int(number)), row), row)
    return [(t, number, *row) for (t, number), row in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, distance, n_words, first_word, last_word for every document and item that it holds."""
    spark = docs.sparkSession
    key = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for ids, texts in _blocks(benchmark, block):
        shared = spark.sparkContext.broadcast(Items(ids, texts))

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            for whole in batches:
                for i in range(0, whole.num_rows, BATCH_DOCS):
                    part, items = whole.slice(i, BATCH_DOCS), shared.value
                    rows = scan_batch(items, part.column("text").to_pylist())
                    if rows:
                        t, number, distance, first, last = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(t)), pa.array([items.ids[n] for n in number], pa.int64()),
                             pa.array(distance, pa.int32()), pa.array([len(items.items[n]) for n in number], pa.int32()),
                             pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                            names=["doc_id", "item_id", "distance", "n_words", "first_word", "last_word"])

        found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, {SHAPE}")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"doc_id {key}, {SHAPE}")


def _blocks(benchmark: DataFrame, block: int) -> Iterator:
    """Ids and texts of the items, a block at a time."""
    ids: list[int] = []
    texts: list[str | None] = []
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        if len(ids) == block:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; ids without a value are never dropped by id."""
    from .common import stage_table

    held = stage_table(leaks(docs, benchmark).select("doc_id").distinct(), "leaks")
    return docs.join(held, "doc_id", "left_anti")
